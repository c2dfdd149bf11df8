"""The text operators on awkward rows, against brute force, round trips and held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, golay, language, licences, mixing, queries, simhash, topk, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, score string, rate string"
RNG = random.Random(4)
WORDS = {"en": "the of and stone river light walk bird green house".split(), "de": "der die und stein fluss licht gehen vogel grün haus".split()}


def prose(lang, n):
    return " ".join(RNG.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def awkward(n=60):
    rows = [(k, prose(lang := RNG.choice(("en", "de")), RNG.randrange(4, 60)), lang, f"s{k % 3}", "x", "y") for k in range(n)]
    rows += [(n, None, "en", None, None, None), (n + 1, "", None, "s0", "x", "y"), (n + 2, " \n\t ", "en", "s0", "x", "y"), (None, "the river", "en", "s0", "x", "y")]
    rows += [rows[3], rows[3], (n + 3, rows[4][1], "en", "s1", "x", "y"), (n + 4, "é 漢字 😀\x00 " * 50, "en", "s1", "x", "y"), (n + 5, prose("en", 30_000), "en", "s1", "x", "y")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).cache()


def labels(spark, toxic):
    return spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for sizes in ([1], [2, 1, 5], [7]):
        n = sum(sizes)
        e, move, first = rng.normal(size=n), rng.normal(size=(2, 2)), rng.normal(size=2)
        starts = np.cumsum([0, *sizes[:-1]])
        p, moves = toxicity.marginals(e, starts, move, np.array([first, first]))
        want, pairs, at = [], np.zeros((2, 2)), 0
        for size in sizes:
            total, hit = 0.0, np.zeros(size)
            own = np.zeros((2, 2))
            for bits in range(1 << size):
                y = [bits >> k & 1 for k in range(size)]
                w = np.exp(first[y[0]] + sum(e[at + k] * y[k] for k in range(size)) + sum(move[y[k - 1], y[k]] for k in range(1, size)))
                total += w
                hit += w * np.array(y)
                for k in range(1, size):
                    own[y[k - 1], y[k]] += w
            want += (hit / total).tolist()
            pairs += own / total
            at += size
        assert np.allclose(p, want) and np.allclose(moves, pairs)


def test_toxicity_finds_spans_and_spares_clean(spark):
    bad = {k for k in range(400) if k % 5 == 0}
    rows = [(k, prose("en", 40) + (" you stupid scumbag of a clown" if k in bad else "")) for k in range(400)] + [(999, None), (998, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(df, spark.createDataFrame([(k, int(k in bad)) for k in range(300)], "doc_id long, toxic int"))
    found = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [k for k in range(300, 400)]
    assert all((found[k]["score"] >= 0.7) == (k in bad) for k in held)
    text = dict(rows)[300]
    assert "stupid scumbag" in " | ".join(text[s["start"] : s["end"]] for s in found[300]["spans"])
    assert found[999]["score"] == found[998]["score"] < 0.5 and found[999]["spans"] == []


def test_toxicity_awkward(spark, docs):
    out = toxicity.score(docs, toxicity.train(docs, labels(spark, {1, 2, 5})))
    assert out.count() == docs.count() and out.filter("score is null or not score between 0 and 1").count() == 0
    none = toxicity.train(docs.limit(0), labels(spark, set()).limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}


def test_language(spark, docs):
    model = language.train(docs)
    found = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    right = [found[k]["lang_pred"] == r[2] for k, r in enumerate(awkward_rows(docs)) if k < 60]
    assert sum(right) >= 58
    assert [found[k]["lang_pred"] for k in (60, 61, 62)] == ["und"] * 3 and found[60]["rejected"] and found[60]["score"] == 0
    empty = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(docs, empty).collect()} == {"und"}


def test_language_rejects_what_is_far_from_all_centroids(spark):
    rows = [(k, prose(("en", "de")[k % 2], 30), ("en", "de")[k % 2]) for k in range(200)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(k, " ".join("".join(RNG.choice("абвгдежзиклмнопрстуфхцчшщ") for _ in range(7)) for _ in range(20)), None) for k in range(300, 320)]
    more = [(k, prose(("en", "de")[k % 2], 30), None) for k in range(400, 440)]
    found = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(odd + more, "doc_id long, text string, lang string"), model).collect()}
    assert all(found[k]["rejected"] for k, _, _ in odd) and not any(found[k]["rejected"] for k, _, _ in more)
    assert all(found[k]["lang_pred"] in ("en", "de") and found[k]["score"] < 0.5 for k, _, _ in odd)


def test_language_equals_plain_tf_idf(spark):
    """With one centroid a language: cosines to the mean of unit vectors, by dictionaries. Counts are not clipped."""
    rows = [(k, prose(("en", "de")[k % 2], 25), ("en", "de")[k % 2]) for k in range(40)] + [(40, "a" * 80_000, "en")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), clusters=1)

    def grams(text):
        out, t = {}, "".join(c if c.isalpha() else " " for c in text.lower()) + "  "
        u = lambda x: x & 0xFFFFFFFF
        for i in range(len(t) - 2):
            a, b, c = map(ord, t[i : i + 3])
            h = [u(u(u(a * 2654435761) + 1) * 2246822519) >> 20, u(u(u(u(a * 2654435761) + b) * 2246822519 + 2) * 3266489917) >> 20]
            h.append(u((u((u((a * 2654435761) + b) * 2246822519) + c) * 3266489917 + 3) * 2654435761) >> 20)
            for key, ok in zip(h, (t[i] != " ", t[i] != " " or t[i + 1] != " ", t[i + 1] != " "), strict=True):
                if ok:
                    out[key] = out.get(key, 0) + 1
        return out

    every = [grams(t) for _, t, _ in rows]
    idf = lambda g: np.log((1 + len(rows)) / (1 + sum(g in x for x in every))) + 0.1

    def unit(found):
        x = {g: np.sqrt(n) * idf(g) for g, n in found.items()}
        size = np.sqrt(sum(v * v for v in x.values()))
        return {g: v / size for g, v in x.items()}

    mean = {}
    for lang in ("en", "de"):
        total = {}
        for (_, _, own), x in zip(rows, every, strict=True):
            if own == lang:
                for g, v in unit(x).items():
                    total[g] = total.get(g, 0) + v
        size = np.sqrt(sum(v * v for v in total.values()))
        mean[lang] = {g: v / size for g, v in total.items()}
    for r in language.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect():
        x = unit(grams(r["text"]))
        cosine = {lang: sum(v * m.get(g, 0) for g, v in x.items()) for lang, m in mean.items()}
        assert r["score"] == pytest.approx(max(cosine.values()), abs=1e-4) and r["lang_pred"] == max(cosine, key=cosine.get)


def awkward_rows(docs):
    return sorted((tuple(r) for r in docs.filter("doc_id < 60").dropDuplicates(["doc_id"]).collect()), key=lambda r: r[0])


def test_bpe_equals_the_library_and_round_trips(spark, docs):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["it's  'll\t\n x", " lead", "trail  ", "a\r\n \r\nb", "\x1c b  c", "x" * 3000, "1234 ٣٤ ½ ²", "zzqj" * 40]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "doc_id long, text string").union(docs.select("doc_id", "text"))
    for r in bpe.decode(bpe.encode(rows, ranks, public_tokenizers.PATTERN), ranks).collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(rows.limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_perfect_hash():
    keys = [str(k).encode() for k in range(5000)]
    table = bpe.PerfectHash.build(keys, list(range(5000)))
    assert table.find(keys).tolist() == list(range(5000)) and sorted(table.value) == list(range(5000))
    assert set(table.find([b"no", b"never"])) == {-1}


def test_urls(spark):
    rows = [
        ("http://a.Example.ORG/es/x?q#f", "example.org/es/", "block"), ("https://example.org/en/12", "example.org/en/1", "block"), ("http://example.org/en/2", "org/", "allow"),
        ("http://badexample.org/es/", "org/", "allow"), ("http://x.com/de/1", "com/de/", "block"), ("http://x.com/de", None, "allow"), ("http://org", None, "allow"),
        ("no scheme", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("http://x.net/?a=/de/", None, "allow"),
    ]
    df = spark.createDataFrame([(k, u, "clash") for k, (u, _, _) in enumerate(rows)], "page_id long, url string, rule string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(df, queries.URL_RULES).collect()}
    assert [found[k] for k in range(len(rows))] == [(r, v) for _, r, v in rows]
    assert urls.filter_urls(df.limit(0), queries.URL_RULES).count() == 0
    rules = [("allow", "org/a/very/long/path"), ("block", "example.org/"), ("allow", "net/x"), ("block", "net/x"), ("block", "deep.com/" + "s/" * 1200)]
    more = [(0, "http://example.org/a/very/long/path", "x"), (1, "http://example.org/a/very", "x"), (2, "http://net/xy", "x"), (3, "http://deep.com/" + "s/" * 1300, "x")]
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(spark.createDataFrame(more, df.schema), rules).collect()}
    assert got == {0: "allow", 1: "block", 2: "block", 3: "block"}


def test_golay():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    assert {bin(int(x)).count("1") for x in golay.tables()[1]} == {0, 1, 2, 3}
    for _ in range(3):
        bits = rng.integers(0, 23, (2, len(words)))
        other = words ^ (1 << bits[0]) ^ (1 << bits[1])
        assert all(set(a) & set(b) for a, b in zip(golay.near(words), golay.near(other), strict=True))
    assert max(len(set(x)) for x in golay.near(words)) == 6


def grouped(prints):
    """Smallest id reachable over links of two bits, by comparing all."""
    ids = sorted(prints)
    top = {k: k for k in ids}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def near_prints(n=160):
    rng, out = random.Random(3), {}
    for k in range(n):
        base = out[rng.randrange(k)] if k and rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            base ^= 1 << rng.randrange(64)
        out[k] = base
    return out


@pytest.mark.parametrize("most", [64, 0])
def test_simhash_links_lose_nothing(spark, most):
    prints = near_prints()
    signed = [(k, v - (1 << 64) if v >> 63 else v) for k, v in prints.items()]
    nodes = spark.createDataFrame(signed, "id long, fp long").groupBy("fp").agg(F.min("id").alias("id"))
    part = {r["node"]: r["component"] for r in simhash.connected_components(simhash.links(nodes, most)).collect()}
    want = grouped(prints)
    first = {}
    for k in sorted(prints):
        first.setdefault(prints[k], k)
    assert all(part.get(first[v], first[v]) == want[k] for k, v in prints.items())


def test_simhash_query_on_awkward_rows(spark, docs):
    found = simhash.groups(simhash.fingerprints(docs, 3)).collect()
    assert len(found) == docs.count()
    by = {r["doc_id"]: r for r in found}
    assert by[60]["fp"] == by[61]["fp"] == by[62]["fp"] == 0 and {by[k]["component_id"] for k in (60, 61, 62)} == {60}
    words = simhash.words(by and awkward_rows(docs)[7][1])
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert by[7]["fp"] % (1 << 64) == want
    assert simhash.groups(simhash.fingerprints(docs.limit(0), 3)).count() == 0


def test_near_copies(spark, docs):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randrange(4000)}" for _ in range(300)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        w = t.split()
        for at in rng.sample(range(300), 3):
            w[at] = "new"
        rows.append((100 + k, " ".join(w)))
        rows.append((200 + k, t.upper() if k % 2 else t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {d: d % 100 for d, _ in rows}
    assert sorted(r["doc_id"] for r in simhash.first_of_each(df.union(df)).collect()) == list(range(12))
    kept = simhash.first_of_each(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id = 3").count() == 1
    assert simhash.first_of_each(docs.limit(0)).count() == 0


def by_all_pairs(texts, k=5, similarity=0.8):
    """Smallest id reachable over pairs of this similarity, by comparing all."""
    sets = {}
    for d, t in texts.items():
        w = t.lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}
    top = {d: d for d in texts}

    def find(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: find(d) for d in texts}


def components(spark, texts, **options):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, **options).collect()}


def test_near_copies_of_short_texts_equal_all_pairs(spark):
    rng, texts = random.Random(11), {}
    for k in range(0, 600, 4):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(5, 101))]
        texts[k] = " ".join(w)
        texts[k + 1] = " ".join([*w, "new"])
        texts[k + 2] = " ".join(["new", *w, "more"])
        edited = list(w)
        edited[rng.randrange(len(w))] = "other"
        texts[k + 3] = " ".join(edited)
    want = by_all_pairs(texts)
    assert sum(d != c for d, c in want.items()) > 250
    assert components(spark, texts) == want


@pytest.mark.parametrize("options", [{}, {"share": 1.0, "least": 3}, {"most": 2}])
def test_near_copies_of_templates_equal_all_pairs(spark, options):
    """Texts that share most of their words with all others, and have near copies of their own."""
    rng, texts = random.Random(12), {}
    shared = [f"t{rng.randrange(3000)}" for _ in range(90)]
    for k in range(0, 200, 2):
        own = [f"w{rng.randrange(3000)}" for _ in range(40)]
        texts[k] = " ".join([*shared, *own])
        own[rng.randrange(35)] = "new"
        texts[k + 1] = " ".join([*shared, *own])
    for k in range(200, 280):  # variants: each of its neighbours, few of the first
        words = [f"v{j}" for j in range(60)]
        words[k % 50], words[(7 * k) % 55] = f"x{k // 4}", f"y{k // 3}"
        texts[k] = " ".join(words)
    want = by_all_pairs(texts)
    assert len(set(want.values())) > 40
    assert components(spark, texts, **options) == want


def test_near_copies_that_repeat_a_line_differently(spark):
    rng, texts = random.Random(13), {}
    for k in range(0, 80, 2):
        own = " ".join(f"w{rng.randrange(4000)}" for _ in range(500))
        line = " ".join(f"w{rng.randrange(4000)}" for _ in range(10))
        texts[k], texts[k + 1] = f"{own}\n{line}", own + f"\n{line}" * 200
    want = {d: d - d % 2 for d in texts}
    assert by_all_pairs(texts) == want
    assert components(spark, texts) == want


def test_mixing(spark, docs):
    rows = spark.createDataFrame([(k, prose("en" if k % 4 else "de", 20 + k % 30)) for k in range(200)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, "a" if k % 4 else "b") for k in range(0, 200, 2)], "doc_id long, domain string")
    model = mixing.fit(rows, marks)
    rated = mixing.mixed(rows, model, {"a": 0.4, "b": 0.6}).collect()
    total = sum(r["n_words"] for r in rated)
    for d, share in enumerate((0.4, 0.6)):
        assert sum(r["rate"] * r["n_words"] * r["posterior"][d] for r in rated) == pytest.approx(share * total, rel=1e-4)
    assert all(r["rate"] >= 0 for r in rated)
    more = mixing.mixed(rows, model, {"a": 0.4, "b": 0.6}, low=1.0)
    assert more.filter("rate < 1").count() == 0 and mixing.repeated(more).select("doc_id").distinct().count() == 200
    out = mixing.mixed(docs, model, {"a": 1, "b": 1})
    assert out.count() == docs.count() and out.filter("rate is null").count() == 0
    none = mixing.fit(docs.limit(0), marks.limit(0))
    assert {r["rate"] for r in mixing.mixed(docs, none, {}).collect()} == {1.0}


def test_rates_equal_projected_gradient_in_numpy(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet((1, 1, 1), 80)
    n = rng.integers(1, 50, 80)
    rows = spark.createDataFrame([(int(k), x.tolist()) for k, x in zip(n, p, strict=True)], "n_words long, posterior array<double>")
    model = mixing.DomainModel(["a", "b", "c"], [], [])
    rate = [r[0] for r in rows.select(mixing.fit_rates(rows, model, {"a": 0.7, "b": 0.2, "c": 0.1}).rate).collect()]
    a = (p * n[:, None]).T
    goal, r = np.array([0.7, 0.2, 0.1]) * n.sum(), np.ones(80)
    m = np.linalg.inv(a @ a.T)
    for _ in range(300):  # plain projected gradient, many steps
        r = np.clip(r - a.T @ m @ (a @ r - goal), 0, 20)
    miss = lambda x: np.abs(a @ x - goal).max() / goal.sum()
    assert miss(np.array(rate)) <= max(1e-6, miss(r)) and min(rate) >= 0 and max(rate) <= 20


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."
    rows = [
        ("a/LICENSE", mit), ("a/b/x.py", "print(1)"), ("a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"), ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/z.py", None), ("q/w.py", ""), ("top.py", "license"), (None, mit), ("a/LICENSE", mit), ("ab/v.py", "Released under the MIT License"),
    ]
    files = spark.createDataFrame([(p, t, "clash") for p, t in rows], "path string, text string, licence string")
    found = licences.inherited(files, licences.stated(files)).collect()
    assert len(found) == len(rows)
    got = {r["path"]: (r["licence"], r["source"], r["licence_dir"]) for r in found}
    assert got["a/LICENSE"][:2] == ("MIT", "header") and got["ab/v.py"][0] == "MIT"
    assert got["a/b/x.py"] == ("GPL-3.0", "inherited", "a/b") == got["a/b/c/z.py"]
    assert got["a/b/c/y.py"][:2] == ("Apache-2.0", "header") and got["q/w.py"] == (None, "none", None) == got["top.py"] == got[None]
    assert licences.inherited(files.limit(0), licences.stated(files.limit(0))).count() == 0


def plain_licence(text, threshold=0.8):
    """Every line and sentence against every template, by dictionaries."""
    idf, other, rows = licences.template_vectors(licences.TEMPLATES)
    vectors = {}
    for name, k, w, x in rows:
        vectors.setdefault((name, k), {})[w] = x
    t = (text or "").lower()
    paragraphs = re.split(r"\n[ \t]*(?:#+|//+|\*+|;+|--+|%+)?[ \t]*(?=\n)", t)
    joined = [re.sub(r"\n[ \t]*(?:#+|//+|\*+|;+|--+|%+)?[ \t]*", " ", p) for p in paragraphs]
    best, hits = {}, {}
    for part in {*t.split("\n"), *(x for p in joined for x in re.split(r"(?<=[.!?])\s", p))}:
        words = Counter(w for w in re.split(r"[\W_]+", part) if w)
        norm = sum((n * idf.get(w, other)) ** 2 for w, n in words.items()) ** 0.5
        for (name, k), v in vectors.items():
            cosine = round(min(1.0, sum(n * idf.get(w, other) * v.get(w, 0) for w, n in words.items()) / norm), 6) if norm else 0
            if cosine >= threshold:
                best[name] = max(best.get(name, 0), cosine)
                hits.setdefault(name, set()).add(k)
    return min(((-x, -len(hits[n]), n) for n, x in best.items()), default=(0, 0, None))


HEADERS = {
    "MIT": "# Copyright (c) 2020 Someone\n#\n# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction, including without limitation the rights\n# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n# copies of the Software, and to permit persons to whom the Software is\n# furnished to do so, subject to the following conditions:\n#\n# The above copyright notice and so on.\nimport os",
    "ISC": " * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n * copyright notice and this permission notice appear in all copies.\n",
    "BSD-3-Clause": "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are met:\n//\n// Neither the name of the copyright holder nor the names of its contributors\n// may be used to endorse or promote products derived from this software without\n// specific prior written permission.\nint main() {}",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that the following conditions are met:\r\n\r\n1. Something.",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991",
    "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nx = 1",
    "LGPL-2.1": "/* This library is free software; you can redistribute it and/or\n   modify it under the terms of the GNU Lesser General Public\n   License as published by the Free Software Foundation; either\n   version 2.1 of the License, or (at your option) any later version.\n*/",
    "AGPL-3.0": "SPDX-License-Identifier: AGPL-3.0-or-later\ncode",
    "Apache-2.0": "   Licensed under the Apache License, Version 2.0 (the \"License\");\n   you may not use this file except in compliance with the License.\n   You may obtain a copy",
    "CC0-1.0": "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\nText",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free",
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this */",
}


def test_licences_of_wrapped_headers_equal_plain_python(spark):
    rows = [(name, text) for name, text in HEADERS.items()] + [(f"no {k}", t) for k, t in enumerate(("the license of a car", "permission to use the road is granted", "software and documentation", "see version 2.0", None, ""))]
    found = {r["path"]: (r["licence"], r["score"]) for r in licences.stated(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: v for k, (v, _) in found.items()} == {k: k for k in HEADERS}
    for path, text in rows:
        score, _, name = plain_licence(text.replace("\r", "") if text else text)
        assert found.get(path, (None, 0)) == (name, pytest.approx(-score, abs=1e-5)), path


def test_licence_query_equals_a_walk_up_the_tree(spark, tmp_path):
    rng, rows = random.Random(6), []
    for k in range(400):
        header = rng.choice((None, None, None, "Released under the MIT License.", "Licensed under CC BY 4.0.", HEADERS["GPL-3.0"]))
        text = None if k % 50 == 0 else " ".join(filter(None, (prose("en", rng.choice((0, 3, 40))), "\n", header)))
        rows.append((k, text, rng.choice(("en", "de", None)), f"s{k % 4}", "clash"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, path string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op9_licences(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    own, given, paths = {}, {}, {}
    for k, text, lang, source, _ in rows:
        paths[k] = "/".join([source, *([lang or "-"] if k % 3 > 0 else []), *([str(k % 16)] if k % 3 > 1 else []), str(k)])
        score, _, name = plain_licence(text)
        if name:
            own[k] = name, -score
    speaks = {r["path"]: r for r in licences.stated(spark.createDataFrame([(paths[k], t) for k, t, *_ in rows], "path string, text string")).collect() if r["share"] >= 0.5}
    for path, r in speaks.items():
        at = path.rpartition("/")[0]
        given[at] = max(given.get(at, (0, "")), (r["score"], r["licence"]))
    seen = Counter()
    for k, path in paths.items():
        at = path.rpartition("/")[0]
        while at not in given and "/" in at:
            at = at.rpartition("/")[0]
        want = (own[k][0], "header", None) if k in own else (given[at][1], "inherited", at) if at in given else (None, "none", None)
        assert (got[k]["licence"], got[k]["source"], got[k]["licence_dir"]) == want, path
        seen[want[1], want[2] and path.rpartition("/")[0] != at] += 1
    assert seen["inherited", True] > 0  # from an ancestor further up


def test_needed_words_are_needed():
    _, _, rows = licences.template_vectors(licences.TEMPLATES)
    needed = set(licences.needed_words(rows, 0.8))
    for key in {(n, k) for n, k, _, _ in rows}:
        rest = sum(x * x for n, k, w, x in rows if (n, k) == key and w not in needed)
        assert rest < 0.64


def test_topk(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)).round(2)
    x[300:330] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(700, None), (800, [1.0, None]), (900, [float("nan")] * 8), (1000, [float("inf")] * 8), (None, x[0].tolist()), (1001, []), (1002, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.whole_numbers(F.col("embedding")).alias("v"))
    got = {}
    for r in topk.search(df.repartition(5), df.filter("vec_id % 100 = 0"), wave=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    w = {k: np.floor(1024 * np.array(v, float)).astype(int) for k, v in rows if k is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    assert set(got) == {k for k in w if k % 100 == 0}
    for q, found in got.items():
        score = sorted((-int((w[q][: len(v)] * v[: len(w[q])]).sum()), k) for k, v in w.items() if k != q)[:10]
        assert sorted(found) == [(i + 1, k, -s) for i, (s, k) in enumerate(score)]
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    """Products beyond 2^53, and scores beyond 64 bits, which are held at the ends."""
    rng = random.Random(2)
    w = {k: [rng.randrange(-(1 << 40), 1 << 40) for _ in range(4)] for k in range(60)} | {100: [(1 << 62), 3, 5, 7], 101: [(1 << 62), 4, 5, 7]}
    df = spark.createDataFrame(list(w.items()), "vec_id long, v array<long>").repartition(3)
    got = {}
    for r in topk.search(df, df.filter("vec_id % 20 = 0"), wave=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {0, 20, 40, 100}
    for q, found in got.items():
        score = sorted((-sum(a * b for a, b in zip(w[q], v, strict=True)), k) for k, v in w.items() if k != q)[:10]
        assert sorted(found) == [(i + 1, k, max(-(1 << 63), min((1 << 63) - 1, -s))) for i, (s, k) in enumerate(score)]


def test_pipeline_on_awkward_rows(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark, {1, 2}).write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns, name
            assert after.filter("rate is not null and rate <> 'y' or score is not null and score <> 'x'").count() == 0
        after.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    assert now.count() > 20 and "ids" in now.columns


@pytest.mark.parametrize(("line", "licence"), [
    ("Licensed under the MIT license.", "MIT"), ("This file is licensed under the Apache License 2.0", "Apache-2.0"), ("BSD License", "BSD-3-Clause"),
    ("Distributed under the terms of the GNU General Public License v3", "GPL-3.0"), ("Licensed under GPLv3", "GPL-3.0"), ("// SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT OR Apache-2.0"),
    ("All rights reserved. This program and the accompanying materials\n * are made available under the terms of the Eclipse Public License v1.0", "EPL-1.0"),
    ("This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"), ("the license of the house was under the river", None),
])
def test_licence_phrases(spark, line, licence):
    rows = spark.createDataFrame([("a/b.c", f"/*\n * {line}\n */\nint main() {{}}\n")], "path string, text string")
    assert [r["licence"] for r in licences.stated(rows).collect()] == ([licence] if licence else [])


def test_tokenizer_keeps_what_recurs(monkeypatch):
    """Full tables don't lose a word that each batch has, and a worker's next task goes on with them."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256}
    whole, merged = bpe.PerfectHash.build(list(ranks), list(ranks.values())), []
    monkeypatch.setattr(bpe, "KEPT", 40)
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks, plain=bpe.merge: merged.append(piece) or plain(piece, ranks))
    tokenizer = bpe.Tokenizer(ranks, r" ?\p{L}+|\s+", whole)
    letters = "ghijklmnopqrstuvwxyz"
    texts = ["abcab " + " ".join(f"{letters[k]}{a}{b}" for a in letters[:5] for b in letters[:5]) for k in range(12)]
    found = [tokenizer.encode([t])[0] for t in texts]
    assert merged.count(b"abcab") == 1 and len(tokenizer.chunks) + len(tokenizer.older) < 120
    parts = {v: k for k, v in ranks.items()}
    assert [b"".join(parts[i] for i in memoryview(x).cast("i")).decode() for x in found] == texts
    assert memoryview(found[0]).cast("i")[:3].tolist() == [256, 99, 256]
    assert bpe.live("a", ranks, r"\S+", whole) is bpe.live("a", ranks, r"\S+", whole) is not bpe.live("b", ranks, r"\S+", whole)
