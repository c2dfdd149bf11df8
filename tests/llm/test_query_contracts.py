"""The registered text queries and the pipeline on a small corpus, against plain Python."""

import hashlib
import random
import zlib
from collections import Counter
from math import exp, log

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from tessera.llm import bpe, language, mixing, queries, toxicity
from tessera.llm.common import table
from tests.llm.test_text_operators import by_all_pairs, grouped, prose

TOXIC = "you stupid scumbag of a clown go away idiot"


def held(k, n, remainder):
    return k is not None and zlib.crc32(str(k).encode()) % n == remainder


def made():
    rng = random.Random(21)
    docs, labels = [], []
    for k in range(360):
        lang = ("en", "de")[k % 2]
        text = prose(lang, 45) + " " + " ".join(f"w{rng.randrange(900)}" for _ in range(25))
        bad = k % 6 == 0
        docs.append((k, text + (f" {TOXIC}" if bad else ""), lang))
        labels.append((k, int(k % 3 > 0), int(bad)))
    for k in range(40):  # copies and near copies
        text = docs[k * 3 + 1][1]
        docs.append((400 + k, text.upper() if k % 2 else text + " more", docs[k * 3 + 1][2]))
    docs += [(500, None, "en"), (501, "", "en"), (502, "12 34 !?", "de"), (503, "è 漢字 😀 " * 40, None), (504, prose("en", 6000), "en")]
    return docs, labels


MADE = made()


def corpus(flip=False, other_lang=False):
    """Rows of documents and labels. flip: other labels for held-out documents; other_lang: another lang for those."""
    docs, labels = MADE
    if flip:
        labels = [(k, q, 1 - t if held(k, 3, 1) else t) for k, q, t in labels]
    if other_lang:
        docs = [(k, t, "xx" if held(k, 5, 0) else lang) for k, t, lang in docs]
    return [(k, t, lang, f"s{k % 3}", len(t or "")) for k, t, lang in docs], labels


def written(spark, path, **how):
    docs, labels = corpus(**how)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("corpus"))


def types(df):
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


TEXTS = {k: t for k, t, *_ in corpus()[0]}


def plain_toxicity(model, text):
    """Forward-backward over one text, a token at a time."""
    rows = [toxicity.units(w) for w in toxicity.TOKEN.findall(text or "")]
    if not rows:
        return float(model.score(np.zeros(1), np.zeros(1))[0])
    e = []
    for k, r in enumerate(rows):
        x = sum(float(model.word[u]) for u in r) + model.bias
        if k:
            x += float(model.before[rows[k - 1][0]])
        if k + 1 < len(rows):
            x += float(model.after[rows[k + 1][0]])
        e.append(x)
    alpha, beta = [], [(0.5, 0.5)] * len(rows)
    for k, x in enumerate(e):
        step = model.move if k else model.first
        before = alpha[-1] if k else (0.5, 0.5)
        now = [sum(before[i] * exp(step[i][j]) for i in (0, 1)) * (exp(x) if j else 1) for j in (0, 1)]
        alpha.append([v / sum(now) for v in now])
    for k in range(len(rows) - 2, -1, -1):
        now = [sum(exp(model.move[i][j]) * (exp(e[k + 1]) if j else 1) * beta[k + 1][j] for j in (0, 1)) for i in (0, 1)]
        beta[k] = [v / sum(now) for v in now]
    p = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(alpha, beta, strict=True)]
    return float(model.score(np.array([sum(p)]), np.array([max(p)]))[0])


def test_op1(spark, folder, tmp_path):
    df = queries.op1_toxicity(spark, folder)
    assert types(df)[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    found = {r["doc_id"]: r for r in df.collect()}
    assert set(found) == set(TEXTS)
    model = toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels").filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    for k, r in found.items():
        assert r["held_out"] == held(k, 3, 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
        assert r["score"] == pytest.approx(plain_toxicity(model, TEXTS[k]), abs=1e-4)
    unseen = [k for k in range(360) if held(k, 3, 1)]
    assert sum(found[k]["predicted"] == int(k % 6 == 0) for k in unseen) >= 0.97 * len(unseen)
    again = queries.op1_toxicity(spark, written(spark, tmp_path, flip=True))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {k: r["score"] for k, r in found.items()}


def test_op2(spark, folder, tmp_path):
    df = queries.op2_language_id(spark, folder)
    assert types(df)[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    found = {r["doc_id"]: r for r in df.collect()}
    assert set(found) == set(TEXTS) and all(r["held_out"] == held(k, 5, 0) for k, r in found.items())
    assert [found[k]["lang_pred"] for k in (500, 501, 502)] == ["und"] * 3 and {r["lang_pred"] for r in found.values()} == {"und", "en", "de"}
    assert sum(found[k]["lang_pred"] == ("en", "de")[k % 2] for k in range(360)) >= 355
    again = queries.op2_language_id(spark, written(spark, tmp_path, other_lang=True))
    assert {r["doc_id"]: r["lang_pred"] for r in again.collect()} == {k: r["lang_pred"] for k, r in found.items()}


def library():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op3(spark, folder):
    df = queries.op3_byte_bpe(spark, folder)
    assert types(df) == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    sha, known = lambda b: hashlib.sha256(b).hexdigest(), library()
    for r in df.collect():
        ids = known.encode_ordinary(TEXTS[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((TEXTS[r["doc_id"]] or "").encode()))


def plain_posteriors(texts, domains, strength=50.0, smooth=0.5):
    """Naive Bayes over hashed words, by dictionaries; domains: id -> domain."""
    import regex

    def bag(t):
        return [h & (mixing.FEATURES - 1) for h in (xxhash.xxh64_intdigest(w.encode(), 42) for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w)]

    names, seen = sorted(set(domains.values())), {}
    for k, d in domains.items():
        for f in set(bag(texts[k])):
            seen[d, f] = seen.get((d, f), 0) + 1
    total = {d: sum(seen.get((d, f), 0) for f in range(mixing.FEATURES)) + smooth * mixing.FEATURES for d in names}
    prior = Counter(domains.values())
    out = {}
    for k, t in texts.items():
        kinds = set(bag(t))
        n = max(1, len(kinds))
        logs = [log(prior[d] / len(domains)) + min(strength, n) / n * sum(log((seen.get((d, f), 0) + smooth) / total[d]) for f in kinds) for d in names]
        odds = [exp(x - max(logs)) for x in logs]
        out[k] = len(bag(t)), [x / sum(odds) for x in odds]
    return names, out


def test_op7(spark, folder):
    df = queries.op7_mixing(spark, folder)
    domains = {k: "toxic" if t else "good" if q else "poor" for k, q, t in corpus()[1]}
    names, want = plain_posteriors(TEXTS, domains)
    assert types(df) == [("doc_id", "bigint"), ("n_words", "bigint"), *((f"p_{d}", "double") for d in names), ("rate", "double")]
    rows = df.collect()
    for r in rows:
        n, p = want[r["doc_id"]]
        assert r["n_words"] == n and [r[f"p_{d}"] for d in names] == pytest.approx(p, abs=1e-6) and r["rate"] >= 0
    got = {d: sum(r["rate"] * r["n_words"] * r[f"p_{d}"] for r in rows) for d in names}
    assert {d: v / sum(got.values()) for d, v in got.items()} == pytest.approx(queries.MIX, abs=1e-3)


def test_mixing_tells_what_it_misses(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), queries.domain_labels(spark, folder)
    model = mixing.fit(docs, labels)
    with pytest.raises(ValueError, match="is missed by"):
        mixing.mixed(docs, model, queries.MIX | {"toxic": 40.0}, allowed=0.01, low=0.9, high=1.1, steps=2)


def plain_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_op8(spark, folder):
    df = queries.op8_simhash(spark, folder)
    assert types(df) == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    prints = {k: plain_print(t) for k, t in TEXTS.items()}
    want = grouped(prints)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}
    assert [k for k, v in prints.items() if found[k] != (f"{v:016x}", want[k])] == [] and len(found) == len(prints)


def test_pipeline_stages_equal_plain_python(spark, folder):
    docs, labels = corpus()
    now = table(spark, folder, "documents")
    stage = dict(corpus_pipeline.STAGES)
    columns = now.columns

    def ran(name, df):
        out = stage[name](spark, df, folder)
        rows = out.collect()
        assert out.columns == columns
        return spark.createDataFrame(rows, df.schema), {r["doc_id"]: r["text"] for r in rows}, rows

    model = toxicity.train(now, table(spark, folder, "labels"))
    now_, kept, _ = ran("toxicity", now)
    assert set(kept) == {k for k, t in TEXTS.items() if plain_toxicity(model, t) < queries.TOXIC_AT}
    assert all(k % 6 == 0 for k in set(TEXTS) - set(kept) if k < 360) and len(set(range(0, 360, 6)) & set(kept)) <= 2
    words = language.train(now_)
    before = kept
    now_, kept, _ = ran("language", now_)
    _, _, far = words.predict(list(before.values()))
    assert set(kept) == {k for k, x in zip(before, far, strict=True) if not x} and not {500, 501, 502} & set(kept)
    before = kept
    now_, kept, _ = ran("near_copies", now_)
    group = by_all_pairs(before)
    assert set(kept) == set(group.values()) and len(kept) < len(before)
    before = kept
    now_, kept, rows = ran("mixture", now_)
    assert set(kept) == set(before) and all(1 <= n <= corpus_pipeline.HIGH for n in Counter(r["doc_id"] for r in rows).values())
    domains = {k: "good" if q else "poor" for k, q, t in labels if not t and k in before}
    names, post = plain_posteriors(before, domains)
    share = Counter()
    for r in rows:
        n, p = post[r["doc_id"]]
        share.update({d: n * x for d, x in zip(names, p, strict=True)})
    assert share["good"] / sum(share.values()) == pytest.approx(corpus_pipeline.MIX["good"], abs=0.03)
    known = library()
    out = stage["tokens"](spark, now_, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    for r in out.collect():
        ids = known.encode_ordinary(before[r["doc_id"]])
        assert (r["ids"] == ids) is True and r["n_tokens"] == len(ids)


def test_near_copies_go_by_fingerprints_and_by_sets(spark, folder):
    """The stage keeps one of each group of op8, and one of each of what all pairs of sets link besides."""
    rng = random.Random(4)
    some = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    line, base = some(11), [some(120) for _ in range(3)]
    texts = {k: f"{line} " * 100 + some(25) for k in range(6)}  # a line repeated: the same fingerprint, other sets
    texts |= {10 + k: b for k, b in enumerate(base)} | {20 + k: f"{b} {some(12)}" for k, b in enumerate(base)}  # the same sets but for an end
    texts |= {30 + k: some(60) for k in range(8)} | {40: texts[3] + " " + base[1]}
    prints, sets = grouped({k: plain_print(t) for k, t in texts.items()}), by_all_pairs(texts)
    assert {prints[k] for k in range(6)} == {0} and {sets[k] for k in range(6)} == set(range(6))
    assert [prints[20 + k] for k in range(3)] == [20, 21, 22] and [sets[20 + k] for k in range(3)] == [10, 11, 12]
    df = spark.createDataFrame([(k, t, "en") for k, t in texts.items()], "doc_id long, text string, lang string").repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, folder).collect()}
    top = {k: k for k in texts}
    for _ in texts:  # the smallest id that links of either kind reach
        for part in (prints, sets):
            least = {g: min(top[k] for k in texts if part[k] == g) for g in part.values()}
            top = {k: least[part[k]] for k in texts}
    assert kept == set(top.values()) and {0, 10, 11, 12} <= kept and not {1, 2, 3, 4, 5, 20, 21, 22} & kept


def test_pipeline_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    assert types(rows)[:3] == [("doc_id", "bigint"), ("lang", "string"), ("source", "string")]
    ids = {r["doc_id"] for r in rows.collect()}
    assert ids < set(TEXTS) and not {0, 6, 500, 501, 502} & ids and {1, 2, 3, 4, 5} & ids
