"""Each operator against brute force on small tables with nulls, empty and odd texts, repeated rows and clashing names."""

import collections
import hashlib
import math
import random

import pytest

from quillgraph.llm import common, fingerprints, jaccard, licenses, mixing, pieces, quality, sharding, suffixes, topk, warc

random.seed(3)
VOCABULARY = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 6))) for _ in range(300)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


BASE, PASSAGE = prose(120), prose(60)
TEXTS = [
    None, "", " \n", "one", "one two", "One TWO three", BASE, BASE, BASE.replace(VOCABULARY[5], "zzz"), BASE + " tail", prose(40) + " " + PASSAGE + " " + prose(30),
    PASSAGE + " " + prose(50), "é漢😀 " * 80, "a" * 900, "ab " * 400, prose(3000), "x\x00y " + prose(20), *[prose(random.randint(1, 90)) for _ in range(40)],
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rank string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], ["s1", "s0", None][i % 3 if i % 5 else 0], len(t or ""), "clash", "x") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6], rows[20]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def all_rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_fingerprints(docs, empty):
    got = fingerprints.edited_fingerprints(docs).collect()
    rows = sorted(all_rows(docs), key=lambda r: r[0])
    texts = [t or "" for _, t in rows]
    edits = collections.Counter()
    for i, t in enumerate(texts):
        m = len(t) // 4
        edits[rows[i][0], hashlib.sha256((t[: len(t) - m] + texts[(i + 1) % len(texts)][:m]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == edits
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[dict(rows)[r.doc_id] or ""].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_fingerprints_in_order_of_any_ids(spark):
    rng = random.Random(5)
    ids = [None] * 40 + [-(2**62) - 5, 2**62 + 5, 2**63 - 1, -(2**63)] + list(range(100, 200)) + [7] * 60
    rows = [(i, prose(30)) for i in ids]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    placed, buckets = fingerprints.in_order(d, 2000, 64)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r["__text_key"], r["__bucket"], len(r.text)) for r in placed.collect()))
    assert [g[3] for g in got] == sorted(g[3] for g in got) and {g[3] for g in got} == set(buckets)
    sizes = collections.Counter()
    for g in got:
        sizes[g[3]] += g[4] + 64
    assert max(sizes.values()) < 4 * max(2000, sum(sizes.values()) / 64)
    assert fingerprints.edited_fingerprints(d).count() == len(rows)


def test_fingerprints_by_brute_force(spark):
    import xxhash

    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    base = [prose(80) for _ in range(12)]
    texts = [*base, base[0], base[1] + " tail", "", None, "solo"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lexicon = {r.term for r in fingerprints.lexicon(d.fillna(""), 0.1, 0.5).collect()}
    terms = [{signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in (t or "").lower().split()} for t in texts]
    df = collections.Counter(h for s in terms for h in s)
    assert lexicon == {h for h, n in df.items() if max(2, 0.1 * len(texts)) <= n <= max(2, 0.5 * len(texts))}
    kept = [sorted(s if len(s) < 12 else s & lexicon) for s in terms]

    def likeness(a, b):
        if kept[a] == kept[b] and (kept[a] or (texts[a] or "") == (texts[b] or "")):
            return 1.0
        same = either = 0
        for tier, (parts, count) in enumerate(fingerprints.TIERS):
            for k in range(count):
                x, y = ([h for h in s if ((h % 2**64) >> (3 + 16 * tier)) % parts == k] for s in (kept[a], kept[b]))
                either += bool(x or y)
                same += bool(x) and x == y
        return same / either if either else 0.0

    for r in fingerprints.edited_fingerprints(d, 0.1, 0.5).collect():
        assert r.near_next == pytest.approx(likeness(r.doc_id, (r.doc_id + 1) % len(texts)), abs=1e-9)


def test_licenses(spark, empty):
    texts = ["x\nReleased under the MIT License.\ny", "a license", None, "", "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.", "plain words"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.family) for r in licenses.scan(d).collect() if r.confirmed}
    assert got == {(0, "mit"), (4, "cc-by-nc")}
    assert licenses.scan(empty).count() == 0
    assert licenses.train()["held_out_accuracy"] > 0.95


def test_licenses_names_and_wrapped_notices(spark):
    wrapped = "\n".join(["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files (the \"Software\"), to deal", "in the Software without restriction, including without limitation the rights", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies"])
    texts = ["CC-BY-SA 4.0", "x\nCC-BY-NC 4.0", "CC-BY 4.0", "Apache-2.0", "MPL 2.0", "public  domain", "GPLv3", "plain words\n\n" + wrapped + "\n\nmore", "use it freely\nthis file of the work\nfree", "mit\nfree"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.scan(d).collect()
    assert {(r.doc_id, r.family) for r in found if r.confirmed and r.doc_id < 5} == {(0, "cc-by-sa"), (1, "cc-by-nc"), (2, "cc-by"), (3, "apache-2.0"), (4, "mpl-2.0")}
    assert {5, 6} <= {r.doc_id for r in found} and 8 not in {r.doc_id for r in found}
    assert [(r.doc_id, r.family) for r in found if r.paragraph == wrapped and r.confirmed] == [(7, "mit")]


def test_licenses_tell_families_apart(spark):
    model = licenses.train()
    assert model["new_wrong"] < 0.15
    texts = ["Free software foundation news", "Eclipse Public License 2.0", "Redistributions of source code must retain the above copyright notice", licenses.TEMPLATES["bsd"][4],
             "Licensed under the Mozilla Public License 2.0", "the eclipse was a public event with a license", "word " * 60_000 + "\n" + "SPDX-License-Identifier: Zlib"]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, family string")
    got = {r.doc_id: r.family for r in licenses.scan(d.union(d)).collect() if r.confirmed}
    assert got == {1: "epl-2.0", 2: "bsd", 3: "bsd", 4: "mpl-2.0", 6: "zlib"}
    assert licenses.scan(d.union(d)).count() == licenses.scan(d).count()


def test_licenses_by_brute_force(spark):
    import numpy as np

    model = licenses.train()
    rng = random.Random(41)
    pool = [t for ts in licenses.TEMPLATES.values() for t in ts] + licenses.UNKNOWN
    texts = [" ".join(w for w in rng.choice(pool).split() if rng.random() > 0.2) + rng.choice(["", " " + prose(8)]) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at, sole = {g: i for i, g in enumerate(model["grams"])}, licenses.specific()
    for r in licenses.scan(d).collect():
        grams = licenses.grams_of(r.paragraph)
        hits = [at[g] for g in grams if g in at]
        z = model["weights"][hits].astype(float).sum(0) / np.sqrt(max(1, len(hits))) + model["base"].astype(float)
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p[:-1].argmax())
        family = licenses.FAMILIES[best]
        near = max(len(grams & licenses.grams_of(t)) / min(len(grams), len(licenses.grams_of(t))) for t in licenses.TEMPLATES[family])
        assert (r.probability, r.unknown_probability, r.similarity) == pytest.approx((p[best], p[-1], near), abs=1e-5)
        sure = p[best] >= 0.5
        assert r.family == (family if sure else "unknown") and r.confirmed == (sure and near >= 0.6 and any(sole.get(g) == best for g in grams))


def bm25(rows, query, k):
    tf = [collections.Counter((t or "").encode().lower().split()) for _, t in rows]
    size = [sum(c.values()) for c in tf]
    mean, df = sum(size) / len(rows), collections.Counter(w for c in tf for w in c)
    out = []
    for (i, _), c, n in zip(rows, tf, size, strict=True):
        s = sum(math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w in set((query or "").encode().lower().split()) if w in c)
        if s > 0:
            out.append((-round(s, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_topk(docs, empty):
    rows = all_rows(docs)
    asked = docs.where("doc_id % 7 = 0").select(docs.doc_id.alias("query_id"), "text")
    got = collections.defaultdict(list)
    for r in topk.search(docs, asked, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, pytest.approx(r.score, abs=1e-5)))
    for i, t in dict(rows).items():
        if i % 7 == 0:
            assert got.get(i, []) == bm25(rows, t, 5)
    assert topk.search(empty, asked).count() == 0
    far = docs.where("doc_id = 6").selectExpr("CAST(NULL AS LONG) AS query_id", "text", "'x' AS score").union(docs.where("doc_id = 10").selectExpr("9007199254740993", "text", "'x'"))
    odd = topk.search(docs, far, 3).collect()
    assert {r.query_id for r in odd} == {None, 9007199254740993}
    assert [r.doc_id for r in sorted(odd, key=lambda r: r["rank"]) if r.query_id is None] == [i for i, _ in bm25(rows, BASE, 3)]
    assert topk.search(docs, asked.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard(docs, empty, size, percent):
    rows = all_rows(docs)

    def sets(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    s = [sets(t) for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = up[i], up[j]
                up = [b if u == a else u for u in up]
    least = {u: min(rows[i][0] for i in range(len(rows)) if up[i] == u) for u in up}
    want = sorted((rows[i][0], len(s[i]), least[up[i]]) for i in range(len(rows)))
    assert sorted(map(tuple, jaccard.join(docs, size, percent).collect())) == want
    assert sorted(map(tuple, jaccard.join(docs, size, percent, chunk=2).collect())) == want  # groups dealt out by chunks
    assert jaccard.join(empty).count() == 0


def test_jaccard_repeated_and_null_ids(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices(VOCABULARY, k=90)) for _ in range(30)]
    copies = [t + " tail" for t in texts]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts[:10]] + [(100 + i, t) for i, t in enumerate(copies)] + [(None, texts[0])]
    ids = [100 + i for i in range(30)]
    want = sorted([(100 + i, 5 if i < 10 else 100 + i) for i in range(30)] + [(5, 5)] * 10 + [(-1, 5)] * 11 + [(-1, i) for i in ids[10:]])
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id long, text string").repartition(1)
        got = jaccard.join(d, 3, 90).collect()
        assert sorted(tuple(-1 if v is None else v for v in (r.doc_id, r.component_id)) for r in got) == want
    # unlike texts without any named copy: each null-id row keeps to itself, told apart by the text's hash
    alone = jaccard.groups(spark.createDataFrame([(None, t) for t in [*texts, texts[3]]], "doc_id long, text string"), 3, 90).collect()
    assert len({r.component_hash for r in alone}) == len(texts) and all(r.component_id is None for r in alone)


@pytest.mark.parametrize(("percent", "small", "large"), [(60, 25, 41), (40, 25, 62)])
def test_jaccard_levels_far_apart(spark, percent, small, large):
    words = [f"w{i}" for i in range(large)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:small]))], "doc_id long, text string")
    assert {r.component_id for r in jaccard.join(d, 1, percent).collect()} == {1}
    for n in range(1, 400):
        least = -(-n * percent // 100)
        assert all(jaccard.levels(m, percent)[0] in jaccard.levels(n, percent) for m in range(least, n + 1))


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in common.components(e).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_keys_that_clash_are_told_apart(spark):
    d = spark.createDataFrame([(1, 10, "a"), (1, 10, "a"), (1, 11, "b"), (2, 10, "c")], "k long, o long, t string")
    got = {(r.t, r.k) for r in common.told_apart(d, "k", "o").collect()}
    assert len(got) == 3 and len({k for _, k in got}) == 3 and ("c", 2) in got
    assert common.told_apart(d.where("t <> 'b'"), "k", "o").columns == ["k", "t"]


def test_components_with_a_hot_node(spark):
    e = spark.createDataFrame([(5, 10 + i) for i in range(3000)] + [(10 + i, 5000 + i) for i in range(50)] + [(9000, 9001)], "a long, b long")
    got = {r.id: r.component for r in common.components(e).collect()}
    assert set(got.values()) == {5, 9000} and sum(c == 5 for c in got.values()) == 3051


def test_sharding(docs, empty):
    got = sharding.shard(docs, 4).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in all_rows(docs))
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    for r in got:
        assert r.size == len((r.text or "").encode()) + 16
    small = [r for r in got if r.size < 2000]
    assert len({r.shard for r in small}) > 1
    assert [r.slot for r in sharding.shard(docs, 4, rows_per_sort=3).collect() if r.slot < 0] == []
    assert sharding.shard(empty, 4).count() == 0


def test_sharding_law_with_one_id_for_many(spark):
    import zlib

    rows = [(5, prose(random.randint(1, 60))) for _ in range(400)] + [(i, prose(30)) for i in range(100)] + [(None, prose(20)) for _ in range(200)] + [(2**63 - 1, "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(d, 8).collect()
    sizes, total = collections.Counter(), 0
    for r in got:
        assert r.size == len(r.text.encode()) + 16 and r.text_crc32 == zlib.crc32(r.text.encode())
        sizes[r.shard] += r.size
        total += r.size
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) < 0.1 * total / 8
    place = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert place == sorted(place)
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    parts = sharding.shard(d, 8, rows_per_sort=20).collect()
    assert sorted((r.shard, r.slot) for r in parts) == sorted({(r.shard, r.slot) for r in parts}) and len(parts) == len(rows)


def test_suffixes(docs, empty):
    rows, n = all_rows(docs), 200
    held = collections.Counter(b[i : i + n] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - n + 1))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if held[b[p : p + n]] > 1:
                gone[p : p + n] = [True] * n
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert suffixes.dedup(empty).count() == 0


def test_suffixes_of_a_hot_passage(spark, monkeypatch):
    rng = random.Random(21)
    word = lambda k: " ".join(rng.choices(VOCABULARY, k=k))
    passage = word(70)
    texts = [word(10) + " " + passage + " " + word(12) for _ in range(60)] + [passage] * 25 + [passage + " "] * 3 + [word(60) for _ in range(30)] + ["z" * 1500, "z" * 700 + "y" + "z" * 400]
    held = collections.Counter(b[i : i + 200] for t in texts for b in [t.encode()] for i in range(len(b) - 199))
    want = []
    for i, t in enumerate(texts):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if held[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        want.append((i, sum(gone), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    for run in (40, 30_000):
        monkeypatch.setattr(suffixes, "RUN", run)
        assert sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in suffixes.dedup(d).collect()) == want


def test_merge_compares_no_known_prefix():
    words = sorted(random.choice(["aa", "ab", "b"]) * random.randint(1, 4) + prose(2) for _ in range(300))
    import numpy as np

    def run(part):
        raw = np.array([list(w.encode().ljust(60, b"\0")[:60]) for w in part], dtype=np.uint8)
        return suffixes.front_code(raw, np.array([min(60, len(w)) for w in part]), [b""] * len(part), np.arange(len(part)), np.arange(len(part)), np.ones(len(part), dtype=int))

    out = list(suffixes.merge([run(words[i::3]) for i in range(3)]))
    assert [x[1] for x in out] == [w.encode()[:60] for w in words]
    for a, b in zip(out, out[1:], strict=False):
        k = b[0]
        assert a[1][:k] == b[1][:k] and (len(a[1]) == k or len(b[1]) == k or a[1][k] != b[1][k])


def test_warc(spark, tmp_path):
    big = "<p>" + "ü" * 200
    rows = [(1, "u1", big), (2, "u2", big), (3, "u3", None), (4, None, ""), (5, "u5", "short"), (6, "u6", "short"), (7, "u7", big + "x"), (1, "u1", big), (9, "u\r\n9", "a\r\n\r\nb" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages, str(tmp_path / "w"), archive_bytes=2000)
    got = warc.read(index, str(tmp_path / "w")).collect()
    assert len(got) == len(rows) and index.select("archive").distinct().count() > 1
    html = {r[0]: (r[2] or "") for r in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id].encode()) and r.digest == hashlib.sha256(html[r.page_id].encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 1) if r.page_id == 2 else ("response", None))
        assert r.payload is None or bytes(r.payload) == html[r.page_id].encode()
    one = warc.read(index.where("page_id = 7"), str(tmp_path / "w")).collect()
    assert len(one) == 1 and bytes(one[0].payload) == html[7].encode()
    none = warc.write(pages.limit(0), str(tmp_path / "e"))
    assert none.count() == 0


def test_pieces(docs, empty):
    import sentencepiece

    ref, model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load()
    texts = dict(all_rows(docs))
    for r in pieces.encode(docs, model).collect():
        assert list(r.ids) == ref.encode(texts[r.doc_id] or "") and r.decoded_equal and r.n_tokens == len(r.ids)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    assert back == {i: t or "" for i, t in texts.items()}
    assert pieces.encode(empty, model).count() == 0


def test_unigram_search():
    vocabulary = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -2.2, "▁a": -2.4, "ba": -3.1, "aba": -4.0, "▁ab": -4.2}
    model = {"pieces": ["<unk>", *vocabulary], "scores": [0.0, *vocabulary.values()], "normal": [False] + [True] * len(vocabulary), "byte": [False] * (1 + len(vocabulary)), "unk": 0, "bpe": False}
    codec = pieces.Codec(model)

    def best(word):
        if not word:
            return 0.0, []
        return max(((best(word[:-k])[0] + vocabulary[word[-k:]], [*best(word[:-k])[1], word[-k:]]) for k in range(1, len(word) + 1) if word[-k:] in vocabulary), key=lambda x: x[0])

    words = ["▁" + "".join(random.choice("ab") for _ in range(random.randint(1, 9))) for _ in range(50)]
    for w, parts in codec.segment(list(set(words))).items():
        assert sum(vocabulary[p] for p in parts) == pytest.approx(best(w)[0])


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1 if i % 2 else 0, 0) for i in range(17, 57)] + [(20, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    bad = docs.withColumn("text", __import__("pyspark").sql.functions.expr("if(doc_id > 16 and doc_id % 2 = 0, repeat('!!$$ | ', 30), text)"))
    got = quality.classify(bad, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id > 16:
            assert r.keep == bool(r.doc_id % 2)
    assert all(r.keep for r in quality.classify(docs, labels.limit(0)).collect())
    assert quality.classify(empty, labels).count() == 0


def posteriors(rows, prior_of=None):
    """Quality of (source, lang, evidence) rows by the hierarchical model, in plain Python."""
    n, total = len(rows), sum(e for *_, e in rows)
    prior = min(max(total / n, 1e-4), 1 - 1e-4)
    within = max(sum(e * e for *_, e in rows) / n - prior**2, 1e-9)
    hosts, sites = collections.defaultdict(list), collections.defaultdict(list)
    for s, lang, e in rows:
        hosts[s].append(e)
        sites[s, lang].append(e)
    spread = lambda groups: sum(sum(g) ** 2 / len(g) for g in groups.values())
    strength = lambda groups, between: min(max(prior * (1 - prior) / max(between - within * groups / n, 1e-9) - 1, 1.0), 1e6)
    host_rows = strength(len(hosts), spread(hosts) / n - prior**2)
    path_rows = strength(len(sites) - len(hosts), (spread(sites) - spread(hosts)) / n)
    bound, odds = (lambda p: min(max(p, 1e-6), 1 - 1e-6)), (lambda p: math.log(p / (1 - p)))
    out = []
    for s, lang, e in rows:
        host = bound((sum(hosts[s]) - e + host_rows * prior) / (len(hosts[s]) - 1 + host_rows))
        path = bound((sum(sites[s, lang]) - e + path_rows * host) / (len(sites[s, lang]) - 1 + path_rows))
        out.append(1 / (1 + math.exp(-(odds(bound(e)) + odds(path) - odds(prior)))))
    return out


def junk(t):
    return "!!$$ | " * 30 + (t or "")


def test_quality_by_brute_force(docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(17, 57)], "doc_id long, quality int, toxic int")
    mixed = spark.createDataFrame([(r.doc_id, junk(r.text) if r.doc_id > 16 and r.doc_id % 2 == 0 else r.text, r.lang, r.source, "x") for r in docs.collect()], "doc_id long, text string, lang string, source string, quality string")
    for most in (100_000, 0):
        got = quality.classify(mixed, labels, most_sites=most).collect()
        want = posteriors([(r.source, r.lang, r.evidence) for r in got])
        assert [r.quality for r in got] == pytest.approx(want, abs=1e-6)
        assert all(r.keep == (r.quality >= 0.5) for r in got) and 0 < sum(r.keep for r in got) < len(got)


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in all_rows(docs))
    totals = collections.defaultdict(int)
    for r in got:
        assert r.size == len((r.text or "").encode().split()) and 0 <= r.taken <= 2 * r.size
        totals[r.source] += r.taken
    sizes, targets = {r.source: r.source_size for r in got}, {r.source: r.target for r in got}
    assert all(abs(totals[s] - targets[s]) <= 0.5 for s in totals)
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1] * 9, strict=False))
    left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            want[s] = 2 * sizes[s] if full else share * weight[s]
        left -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    assert {s: pytest.approx(t) for s, t in targets.items()} == want
    assert mixing.mix(empty).count() == 0
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_mixing_of_equal_rows_and_ids(spark):
    rng = random.Random(31)
    rows = [(1, "a b c", "s")] * 50 + [(1, "a b c", "t")] * 7 + [(None, " ".join(rng.choices(VOCABULARY, k=rng.randint(1, 9))), rng.choice("st")) for _ in range(80)] + [(None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for most in (32 << 20, 0):
        got = mixing.mix(d, most_broadcast=most).collect()
        assert sorted(map(repr, rows)) == sorted(repr((r.doc_id, r.text, r.source)) for r in got)
        taken, targets = collections.Counter(), {}
        for r in got:
            assert 0 <= r.taken <= 2 * r.size
            taken[r.source] += r.taken
            targets[r.source] = r.target
        assert all(abs(taken[s] - targets[s]) <= 0.5 for s in targets)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.drop("size", "rank").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = common.stored(stage(spark, now, str(tmp_path)), "test")
        kept[name] = now
        if name != "pieces":
            assert now.columns == corpus_pipeline.COLUMNS
    ids = [r.doc_id for r in kept["near_copies"].collect()]
    assert 6 in ids and not {7, 9} & set(ids) and len(ids) == len(set(ids))
    assert all(PASSAGE not in (r.text or "") for r in kept["repeats"].collect())
    assert kept["pieces"].where("NOT decoded_equal").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["pieces"].count()


def test_pipeline_by_brute_force(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline

    rng = random.Random(51)
    word = lambda k: " ".join(rng.choices(VOCABULARY, k=k))
    passage = word(60)
    texts = [word(90) for _ in range(30)]
    texts += [t + " tail" for t in texts[:6]] + texts[6:9] + [word(20) + " " + passage + " " + word(20) for _ in range(4)] + [None, "", "one", "é" * 300] + [junk(word(5)) for _ in range(20)]
    ids = [None if i in (3, 40) else 9 if i in (11, 12) else i for i in range(len(texts))]
    rows = [(i, t, ["en", "de"][k % 2], [f"h{k % 3}", None][k % 7 == 0], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    good = [(i, int(not (t or "").startswith("!!")), 0) for i, t in zip(ids, texts, strict=True) if i is not None and i % 2]
    spark.createDataFrame(good, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    as_list = lambda df: sorted(map(repr, ((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())))
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = common.stored(stage(spark, now, str(tmp_path)), "test")
        if name == "quality":
            scored = quality.evidence(spark.createDataFrame(before), quality.train(spark.createDataFrame(before), labels)).collect()
            keep = [p >= 0.5 for p in posteriors([(r.source, r.lang, r.evidence) for r in scored])]
            assert as_list(now) == sorted(repr((r.doc_id, r.text, r.lang, r.source, r.n_chars)) for r, k in zip(scored, keep, strict=True) if k) and not all(keep)
        elif name == "near_copies":
            def shingled(t):
                w = (t or "").encode().lower().split()
                return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

            sets, up = [shingled(r.text) for r in before], list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        up = [up[j] if u == up[i] else u for u in up]
            groups = collections.defaultdict(list)
            for r, u in zip(before, up, strict=True):
                groups[u].append(r)
            left = {(r.doc_id, r.text) for r in now.collect()}
            assert now.count() == len(groups) < len(before)
            for g in groups.values():
                named = [r for r in g if r.doc_id is not None]
                least = min(r.doc_id for r in named) if named else None
                assert {(r.doc_id, r.text) for r in g} & left <= {(r.doc_id, r.text) for r in g if r.doc_id == least} and len({(r.doc_id, r.text) for r in g} & left) == 1
        elif name == "repeats":
            held = collections.Counter(b[i : i + 200] for r in before for b in [(r.text or "").encode()] for i in range(len(b) - 199))
            want = []
            for r in before:
                b = (r.text or "").encode()
                gone = bytearray(len(b))
                for p in range(len(b) - 199):
                    if held[b[p : p + 200]] > 1:
                        gone[p : p + 200] = b"\1" * 200
                kept = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
                want.append(repr((r.doc_id, None if r.text is None else kept, r.lang, r.source, None if r.text is None else len(kept))))
            assert as_list(now) == sorted(want) and passage not in "".join(r.text or "" for r in now.collect())
        elif name == "mixing":
            sizes, weight, times = collections.Counter(), {}, collections.Counter(repr((r.doc_id, r.text)) for r in now.collect())
            for r in before:
                sizes[r.source] += len((r.text or "").split())
            weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1] * 9, strict=False))
            left, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
            while open_:
                full = {s for s in open_ if left / sum(weight[x] for x in open_) * weight[s] > 2 * sizes[s]}
                share = left / sum(weight[s] for s in open_)
                for s in full or open_:
                    target[s] = 2 * sizes[s] if full else share * weight[s]
                left, open_ = left - sum(target[s] for s in full), open_ - full if full else set()
            got = collections.Counter()
            for r in now.collect():
                got[r.source] += len((r.text or "").split())
            for s in sizes:
                low, most = math.floor(target[s] / sizes[s]) if sizes[s] else 1, max(len((r.text or "").split()) for r in before if r.source == s)
                assert abs(got[s] - target[s]) <= most / 2 + 1
                assert all(low <= times[repr((r.doc_id, r.text))] <= low + 1 for r in before if r.source == s and (r.text or "").split())
        else:
            ref = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            assert sorted((repr(r.doc_id), list(r.ids)) for r in now.collect()) == sorted((repr(r.doc_id), ref.encode(r.text or "")) for r in before)
    assert sorted(map(repr, now.collect())) == sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    none = tmp_path / "none"
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(none / "documents.parquet"))
    labels.write.parquet(str(none / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0


def test_near_copies_keep_rows_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(12)
    text = [" ".join(rng.choices(VOCABULARY, k=120)) for _ in range(8)]
    rows = [(None, t) for t in text[:3]] + [(3, text[3]), (7, text[3] + " tail"), (7, text[4]), (7, text[5]), (8, text[6]), (8, text[6]), (9, text[6] + " end"), (None, text[7]), (None, text[7])]
    rows += [(None, None), (None, ""), (7, " "), (7, " ")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = [(None, t) for t in text[:3]] + [(3, text[3]), (7, text[4]), (7, text[5]), (8, text[6]), (None, text[7]), (None, None), (None, ""), (7, " "), (7, " ")]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies_stage(spark, d, "").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_mixing_stage_emits_whole_texts(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    rows = [(i, " \n".join(rng.choices(VOCABULARY, k=rng.randint(5, 60))), "en", f"host{i if i < 9 else 9}") for i in range(40)] + [(None, " ", "en", None)]
    d = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.mixing_stage(spark, d, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in out} <= {r[:2] for r in rows} and all(r.n_chars == len(r.text) for r in out)
    times, words = collections.Counter(r.doc_id for r in out), collections.Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    mixed = mixing.mix(d).collect()
    for r in mixed:
        assert times[r.doc_id] == (int(r.taken / r.size + 0.5) if r.size else 1)
        most = max(x.size for x in mixed if x.source == r.source)
        assert abs(words[r.source] - r.target) <= most / 2 + 0.5
