"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, language, licences, lm, manifest, mixing, multiset, negatives, simhash, suffixes, topk, toxicity, urls, whole
from tessera.llm.common import crc_mod, stored, table

TOXIC_AT = 0.7
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    return toxicity.score(docs, model).select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(crc_mod("doc_id", 5) != 0))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(ids, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = docs.filter(crc_mod("doc_id", 7) != 2)
    counts = stored(lm.count_words(learned))
    vocabulary = lm.vocabulary(counts)
    rows = lm.encoded(docs.withColumn("learned", F.coalesce(crc_mod("doc_id", 7) != 2, F.lit(False))), vocabulary)
    found = lm.score(rows, counts, vocabulary, lm.train(rows.filter("learned"), vocabulary))
    return found.select(
        "doc_id",
        (crc_mod("doc_id", 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (
        multiset.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), "head"))
        .withColumns({"lanes": multiset.lanes(F.col("text")), "edited_lanes": multiset.lanes(F.col("edited"))})
    )
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        multiset.as_hex(F.col("lanes")).alias("fingerprint"),
        multiset.as_hex(F.col("edited_lanes")).alias("edited_fingerprint"),
        multiset.likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        multiset.likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )


#: Share of the words by domain: quality and toxicity as `labels` marks them.
MIX = {"good": 0.75, "poor": 0.2, "toxic": 0.05}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return table(spark, sf_dir, "labels").select("doc_id", domain.alias("domain"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.fit(docs, domain_labels(spark, sf_dir))
    rated = mixing.mixed(docs, model, {d: MIX[d] for d in model.domains})
    p = F.col("posterior")
    return rated.select("doc_id", "n_words", *(p[k].alias(f"p_{d}") for k, d in enumerate(model.domains)), "rate")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(simhash.fingerprints(table(spark, sf_dir, "documents"), 3))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source/<id>, source/lang/<id> or source/lang/<id % 16>/<id>, by id % 3. One that is a
    licence segment for half of its length speaks for its directory."""
    part = lambda c: F.coalesce(c, F.lit("-"))
    doc, kind = part(F.col("doc_id").cast("string")), F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0))
    deep = F.when(kind > 0, part(F.col("lang"))), F.when(kind > 1, part(F.pmod("doc_id", F.lit(16)).cast("string")))
    path = F.concat_ws("/", part(F.col("source")), *deep, doc)
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    found = licences.inherited(files, licences.stated(files), speaks=F.col("share") >= 0.5)
    return found.withColumn("doc_id", F.regexp_extract("path", "([^/]*)$", 1).try_cast("long"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v"))
    return topk.search(rows, rows.filter("vec_id % 100 = 0"))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(crc_mod("doc_id", 3) == 0, manifest.leaf(*(lowered if c == "text" else F.col(c) for c in fields)))
    rows = manifest.manifest(docs, fields=fields, also={"tampered": tampered})
    rows = rows.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole.whole_numbers(F.col("embedding"), 256).alias("v")))


OP10_SQL = """
WITH w AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM w q JOIN w c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP13_SQL = """
WITH w AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM w a JOIN w c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT * FROM n WHERE rank <= 3
"""

OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT k, doc_id, s, array_slice(b, s, s + 49) AS w FROM (SELECT k, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS s FROM d WHERE doc_id IS NOT NULL AND octet_length(b) >= 50)),
hit AS (SELECT k, s FROM (SELECT k, s, doc_id, min(doc_id) OVER (PARTITION BY w) AS first FROM w) WHERE first < doc_id),
ends AS (SELECT k, s, max(s + 50) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hit),
runs AS (SELECT k, run, min(s) AS lo, max(s) + 50 AS hi FROM (SELECT k, s, count(*) FILTER (WHERE before IS NULL OR s > before) OVER (PARTITION BY k ORDER BY s) AS run FROM ends) GROUP BY k, run),
cut AS (SELECT k, lo, hi, coalesce(lag(hi) OVER (PARTITION BY k ORDER BY lo), 1) AS from_ FROM runs),
kept AS (SELECT k, string_agg(hex(array_slice(b, from_, lo - 1)), '' ORDER BY lo) || hex(array_slice(any_value(b), max(hi), octet_length(any_value(b)))) AS h, sum(hi - lo) AS gone, count(*) AS n FROM cut JOIN d USING (k) GROUP BY k)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(CASE WHEN kept.k IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN kept USING (k)
"""

#: crc32 of a decimal number, a byte and a bit at a time.
CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(map(_field_sql, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


OP12_SQL = f"""
WITH RECURSIVE d AS (
  SELECT *, {_leaf_sql("text")} AS leaf,
    CASE WHEN {CRC_SQL} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS tampered FROM documents),
leaves AS (
  SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (
  SELECT lang, 0 AS level, pos, n, leaf AS digest FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n),
tops AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_ AS (
  SELECT 0 AS level, pos, n, digest FROM tops
  UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper_ WHERE n > 1 GROUP BY level, pos // 8, n),
inner_runs AS (
  SELECT lang, level, pos // 8 AS up, list(digest ORDER BY pos) AS digests FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT level, pos // 8 AS up, list(digest ORDER BY pos) AS digests FROM upper_ WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT k, level AS step, (pos >> CAST(3 * level AS BIGINT)) % 8 AS place, digests FROM leaves l JOIN inner_runs r ON r.lang IS NOT DISTINCT FROM l.lang AND r.up = pos >> CAST(3 * level + 3 AS BIGINT)
  UNION ALL SELECT k, 1000 + level, (t.pos >> CAST(3 * level AS BIGINT)) % 8, digests FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN upper_runs r ON r.up = t.pos >> CAST(3 * level + 3 AS BIGINT)),
turns AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY step) AS turn, array_to_string(digests[:place], '') AS before, array_to_string(digests[place + 2:], '') AS behind FROM steps),
folds AS (
  SELECT k, 0 AS turn, coalesce(tampered, leaf) AS digest FROM leaves
  UNION ALL SELECT k, t.turn, sha256(before || digest || behind) FROM folds f JOIN turns t USING (k) WHERE t.turn = f.turn + 1),
proofs AS (SELECT k, string_agg(before || behind, '' ORDER BY turn) AS proof FROM turns GROUP BY k)
SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT digest FROM upper_ WHERE n = 1) r ON true
LEFT JOIN proofs p ON p.k = l.k JOIN (SELECT k, arg_max(digest, turn) AS digest FROM folds GROUP BY k) f ON f.k = l.k
"""

OP4_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT row_number() OVER () AS k, page_id, host, path FROM parts),
best AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM fits JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits LEFT JOIN best USING (k)
"""

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_byte_bpe, op4_url_filter, op5_lm_scoring, op6_fingerprint, op7_mixing, op8_simhash, op9_licences, op10_topk, op11_suffixes, op12_manifest, op13_hard_negatives)}
SQL = {"op4_url_filter": OP4_SQL, "op10_topk": OP10_SQL, "op11_suffixes": OP11_SQL, "op12_manifest": OP12_SQL, "op13_hard_negatives": OP13_SQL}
