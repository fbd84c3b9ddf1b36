"""Operators on tables: brute force, and the cases that each has to stand: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from knotwork.llm import components, decontaminate, htmlcrf, imatch, jaccard_join, kd_shards, langid, pii, quality, sentencepiece_codec, toxicity
from tests.conftest import SMALL

LONG = "lorem ipsum dolor " * 9000


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(140):
        if rows and r.random() < 0.6:
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((i, " ".join(w)))
        else:
            rows.append((i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 5, 30, 60, 100])))))
    rows += [(500, None), (501, ""), (502, "A b"), (503, "a  B"), (504, rows[3][1]), (505, LONG), (505, LONG)]
    # further columns, with names that the operators use themselves
    return spark.createDataFrame([(*x, "en", "s", 1, "clash", 5, 0.5) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, token string, node long, score double").repartition(5)


@pytest.fixture(scope="module")
def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))


def bare(spark):
    return spark.createDataFrame([(None, None), (None, "a"), (1, "x y z")], "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_jaccard_components(docs, block):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, jaccard_join.components(docs, block=block).collect()))
    assert got == sorted(jaccard_join.brute_force(rows))


def test_jaccard_keeps_the_first_of_each_group(spark, docs):
    kept = jaccard_join.keep_first(docs)
    comp = {c for _, _, c in jaccard_join.brute_force([(r.doc_id, r.text) for r in docs.collect()])}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == comp
    assert jaccard_join.components(docs.limit(0)).count() == 0 and jaccard_join.components(bare(spark)).count() == 3


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


@pytest.mark.parametrize("block_words", [10**6, 12])
def test_decontamination(spark, docs, block_words):
    texts = {r.doc_id: r.text for r in docs.filter("doc_id < 100").collect()}
    items = [(1, " ".join((texts[i] or "").split()[:20])) for i in (7,)] + [(i, texts[i]) for i in (11, 12, 20, 30)] + [(90, "w1"), (91, None), (92, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(docs, bench, block_words=block_words).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = decontaminate.brute_force([t for _, t in rows], [(str(i), t) for i, t in items])
    for (i, _), w in zip(rows, want, strict=True):
        assert (got[i].n_words, got[i].n_hit, sorted(got[i].item_ids), got[i].longest_match, sorted(map(tuple, got[i].spans), key=str)) == w
    out = decontaminate.report(docs, bench).collect()
    assert len(out) == len(rows)
    for r in out:
        n, h, own, *_ = want[[i for i, _ in rows].index(r.doc_id)]
        assert r.items_sha256 == decontaminate.items_digest(own) and r.contaminated == (h > 0 and 20 * h >= n)
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not r.contaminated for r in out)
    assert decontaminate.report(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_kd_shards(spark, docs):
    rows = kd_shards.shard(docs, 7).collect()
    assert len(rows) == docs.count()
    by, slots = {}, {}
    for r in rows:
        by[r.shard] = by.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    small = [(r.doc_id, r.text) for r in docs.collect() if r.text != LONG]
    even = kd_shards.shard(spark.createDataFrame([(1000 * i + k, t) for i, t in small for k in range(20)], "doc_id long, text string"), 7).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(even) == 7 and max(r.b for r in even) < 1.2 * min(r.b for r in even)
    texts = {i: t for i, t in small} | {505: LONG}
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t) and r.law == "bytes" and r.grown_shard is None
    assert kd_shards.shard(docs.limit(0)).count() == 0 and kd_shards.shard(bare(spark)).count() == 3
    assert {r.shard for r in kd_shards.shard(docs, 1).collect()} == {0}


def test_kd_shards_split_a_hot_group(spark):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same text for all").alias("text"))
    n = [r["count"] for r in kd_shards.shard(hot).groupBy("shard").count().collect()]
    assert len(n) == 40 and max(n) <= min(n) + 1


def test_imatch(spark, docs):
    out = imatch.fingerprints(docs.filter("doc_id <> 505")).collect()
    src = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id != 505), reverse=True)
    after = {src[i][0]: src[(i + 1) % len(src)] for i in range(len(src))}
    text, prints = dict(src), {r.doc_id: r for r in out}
    for i, t in src:
        half = len(t) // 2
        edited = t[: len(t) - half] + after[i][1][:half]
        r = prints[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = r.fingerprint.split(" "), prints[after[i][0]].fingerprint.split(" ")
        some = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-", "-")]
        assert abs(r.near_next - (sum(x == y for x, y in some) / len(some) if some else 1.0)) < 1e-12
        if edited == t:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
    same = {}
    for r in out:
        assert same.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert imatch.fingerprints(docs.limit(0)).count() == 0
    one = imatch.fingerprints(spark.createDataFrame([(9, "a b c d")], "doc_id long, text string")).first()
    assert one.near_next == 1.0
    assert imatch.fingerprints(docs).count() == docs.count() and imatch.fingerprints(bare(spark)).count() == 3


def murmur(values):
    """Spark's hash() of an array of longs."""
    m = 0xFFFFFFFF
    rot = lambda x, r: (x << r | x >> 32 - r) & m
    h = 42
    for v in values:
        for part in (v & m, v >> 32 & m):
            k = rot(part * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
            h = rot(h ^ k, 13) * 5 + 0xE6546B64 & m
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & m
        h = (h ^ h >> 13) * 0xC2B2AE35 & m
        h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_imatch_fingerprints_by_brute_force(docs):
    import re
    import struct

    import xxhash

    rows = docs.filter("doc_id <> 505")
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    signed = lambda u: u - (1 << 64) if u >> 63 else u
    term = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), seed=42))
    other = lambda t: signed(xxhash.xxh64_intdigest(struct.pack("<i", 1), seed=xxhash.xxh64_intdigest(struct.pack("<q", t), seed=42)))
    words = {i: {term(w) for w in re.split(r"[^\w]+|_+", t.lower()) if w} for i, t in texts.items()}
    df = {}
    for own in words.values():
        for t in own:
            df[t] = df.get(t, 0) + 1
    n = len(texts)
    band = {t for t, k in df.items() if max(2, imatch.LEAST_SHARE * n) <= k <= max(2, imatch.MOST_SHARE * n)}
    got = {r.doc_id: r.fingerprint.split(" ") for r in imatch.fingerprints(rows).collect()}
    for i, own in words.items():
        lexicon = sorted(own & band) or sorted(own)
        subsets = [lexicon]
        for family in range(imatch.FAMILIES):
            for seed in range(imatch.SEEDS):
                keep = list(lexicon) if not family else [other(t) for t in lexicon]
                for bit in range(seed * imatch.LEVELS, (seed + 1) * imatch.LEVELS):
                    keep = [t for t in keep if not t >> bit & 1]
                    subsets.append(keep)
        assert got[i] == [str(murmur(s)) if s else "-" for s in subsets], i


def test_imatch_ranges_meet(spark, monkeypatch):
    bounds = imatch.id_bounds
    monkeypatch.setattr(imatch, "id_bounds", lambda d: bounds(d, 3))
    rows = [(i * 7 % 101 - 50, f"t{i}") for i in range(101)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in imatch.with_next(d, imatch.id_bounds(d), ["text"]).collect()}
    order = sorted(rows, reverse=True)
    assert got == {order[i][0]: order[(i + 1) % 101][1] for i in range(101)}


def test_codec_tables(spark, docs):
    path = sentencepiece_codec.model_path()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    full = sentencepiece_codec.decode_ids(sentencepiece_codec.encode_spans(docs, path), path).collect()
    for r in full:
        assert r.decoded == texts[r.doc_id] and r.ends[-1] == len(texts[r.doc_id].encode())
    digests = {r.doc_id: r for r in sentencepiece_codec.token_digests(docs, path).collect()}
    for r in full:
        assert digests[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() and digests[r.doc_id].n_tokens == len(r.ids)
    assert sentencepiece_codec.token_digests(docs.limit(0), path).count() == 0 and sentencepiece_codec.token_digests(bare(spark), path).count() == 3


def test_langid_tables(spark, docs):
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = langid.report(real).collect()
    lang = {r.doc_id: r.lang for r in real.collect()}
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    kept = langid.drop_rejected(docs)
    assert kept.columns == docs.columns and 500 not in {r.doc_id for r in kept.collect()}
    assert langid.report(docs.limit(0)).count() == 0 and {r.lang_pred for r in langid.report(bare(spark)).collect()} == {"und"}


def test_pii_tables(spark, docs):
    extra = spark.createDataFrame([(900, "write a.b@c.de or +1 (564) 555-4526"), (901, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.report(extra).collect()}
    assert (out[900].n_email, out[900].n_phone, out[900].spans) == (1, 1, "email:6:14,phone:18:35") and out[901].spans == ""
    assert out[900].base_sha256 == hashlib.sha256(b"email:6:14,phone:18:35").hexdigest()
    masked = pii.mask_documents(extra.withColumn("n_chars", F.lit(1).cast("long"))).collect()
    assert [r for r in masked if r.doc_id == 900][0].text == "write <EMAIL> or <PHONE>" and [r for r in masked if r.doc_id == 900][0].n_chars == 24
    assert pii.mask_documents(docs).columns == docs.columns and pii.report(docs).count() == docs.count() and pii.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifier_tables(spark, docs, labels, operator):
    out = operator.report(docs, labels)
    assert out.count() == docs.count() and out.filter("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.5)").count() == 0
    assert operator.report(docs.limit(0), labels).count() == 0
    assert operator.report(bare(spark), labels.limit(0)).count() == 3


def test_toxicity_accuracy(spark):
    d, y = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = toxicity.report(d, y).filter("held_out").join(y, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.93


def test_pages(spark):
    p = spark.createDataFrame([(1, "u", "<nav><a href=x>menu</a></nav><article><h1>A title.</h1><p>Some text that is long enough to be read.</article>", 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    out = {r.page_id: r for r in htmlcrf.extract(p).collect()}
    assert out[1].text == "A title. Some text that is long enough to be read." and out[None].text == "" and out[1].n_chars == len(out[1].text)
    assert htmlcrf.extract(p.limit(0)).count() == 0


def hashed(ids):
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_pipeline(spark):
    """run() against each stage's brute force in turn, on real documents with cases planted among them."""
    import corpus_pipeline
    import sentencepiece

    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in d.select("doc_id", "text", "lang").collect()]
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = next(t for _, t, k in rows if k == "en" and 60 < len((t or "").split()) < 200)
    words = clean.split()
    rows += [(9001, clean, "en"), (9002, " ".join([*words[:-1], "changed"]), "en"), (9003, bench[0][1] + " " + bench[1][1], "en"), (9004, None, "en"), (9005, "", None)]
    rows += [(9006, " ".join(words[::-1]) + " write to a.b@c.de or 10.1.2.3", "en"), (9007, "Жжж щщщ ыыы " * 20, None), (9008, " ".join(words[::2]) + " " + bench[2][1], "en")]
    rows += [(9006, rows[-3][1], "en"), (9006, " ".join(sorted(words)) + " twice one id", "en"), (None, " ".join(sorted(words, key=len)), "en"), (None, " ".join(sorted(words, key=len)), "en")]
    docs = spark.createDataFrame([(*r, "s", len(r[1] or ""), 7, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _id int, node string").repartition(3)
    model = langid.train(docs)
    want = [(i, t) for i, t, _ in rows if not model.predict(t)[2]]
    assert not {9004, 9005, 9007} & {i for i, _ in want}
    order = sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    groups = [c for _, _, c in jaccard_join.brute_force([(k, t) for k, (_, t) in enumerate(order)])]
    want = [r for k, r in enumerate(order) if groups[k] == k]
    windows = {tuple(w[p : p + 13]) for _, t in bench if (w := decontaminate.words_of(t.encode())) for p in range(max(1, len(w) - 12))}

    def clean_of_benchmark(t):
        w = decontaminate.words_of(t.encode())
        hit = {k for n in {len(x) for x in windows} for q in range(len(w) - n + 1) if tuple(w[q : q + n]) in windows for k in range(q, q + n)}
        return not (hit and 20 * len(hit) >= len(w))

    want = [r for r in want if clean_of_benchmark(r[1])]
    assert not {9001, 9002, 9003, 9008} & {i for i, _ in want}
    field = pii.train()
    want = [(i, pii.mask(t, pii.all_spans(t, field))) for i, t in want]
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    ids = [(i, library.encode(t, add_eos=True)) for i, t in want]
    out = corpus_pipeline.apply(spark, docs, SMALL)
    got = [(r.doc_id, list(r.ids)) for r in out.collect()]
    assert sorted(got, key=str) == sorted(ids, key=str)
    assert all(r.ids_sha256 == hashed(r.ids) and r.n_tokens == len(r.ids) for r in out.collect())
    assert corpus_pipeline.apply(spark, docs.limit(0), SMALL).count() == 0
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_keep_first_decides_by_row(spark):
    rows = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (1, "x y z u v w q", 2), (2, "a b c d e f", 3), (None, "m n", 1), (None, "m n", 1), (None, "m n", 2), (3, "x y z u v w q", 1), (4, None, 1), (4, "", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_first(d).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (1, "x y z u v w q"), (None, "m n"), (4, None), (4, "")], key=str)


def median_tree(rows, shards, first=0):
    """Shards of (place, ..., size) rows by a plain weighted median tree over the same measured columns."""
    if shards == 1 or not rows:
        return {r["i"]: first for r in rows}
    width = [max(r[d] for r in rows) - min(r[d] for r in rows) for d in kd_shards.DIMS]
    axis = kd_shards.DIMS[width.index(max(width))]
    order = sorted(rows, key=lambda r: (r[axis], r["tie"], r["equal"]))
    half = shards // 2
    goal, total, cut = sum(r["size"] for r in rows) * half // shards, 0, 0
    while total + order[cut]["size"] <= goal:
        total += order[cut]["size"]
        cut += 1
    return median_tree(order[:cut], half, first) | median_tree(order[cut:], shards - half, first + half)


@pytest.mark.parametrize("most", [4096, 2])
def test_kd_shards_by_a_plain_median_tree(spark, docs, monkeypatch, most):
    monkeypatch.setattr(kd_shards, "MOST_SUMS", most)
    every = docs.unionByName(docs).unionByName(docs.filter("doc_id < 5"))
    rows = spark.createDataFrame(kd_shards.measured(every).withColumn("i", F.monotonically_increasing_id()).toArrow())
    want = median_tree([r.asDict() for r in rows.collect()], 11)
    assert {r.i: r.s for r in rows.withColumn("s", kd_shards.shard_column(rows, 11)).collect()} == want


@pytest.mark.parametrize("ids", ["cast(null as long)", "cast(5 as long)", "id"])
def test_kd_shards_cut_equal_rows(spark, ids):
    hot = spark.range(4000).select(F.expr(ids).alias("doc_id"), F.lit("same text for all").alias("text"))
    assert [r["count"] for r in kd_shards.shard(hot).groupBy("shard").count().collect()] == [100] * 40


def test_sample_is_whole_and_bounded(spark, docs):
    from knotwork.llm.common import sample

    rows = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y")).union(spark.createDataFrame([(2, 1)], "doc_id long, y int"))
    got = sample(docs, rows, 10, "y", 2000).collect()
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in got} <= texts and 2 not in {r.doc_id for r in got}
    for y in (0, 1):
        own = [r for r in got if r.y == y]
        assert 0 < len(own) <= 10 and sum(len((r.text or "").encode()) for r in own) <= 2000
    assert sorted(map(tuple, sample(docs.repartition(2), rows.repartition(3), 10, "y", 2000).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_odd_pages(spark):
    rows = [(1, "u", "<p>x</p>" * 3), (1, "u", "<p>x</p>" * 3), (None, None, ""), (2, "v", "<article>" + "<p>Some words of a long page.</p>" * 20000 + "</article>"), (3, "w", "<" * 5000 + "<div " * 5000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = htmlcrf.extract(p).collect()
    assert len(out) == 5 and [r.text for r in out if r.page_id == 1] == ["x x x"] * 2
    assert next(r for r in out if r.page_id == 2).text == " ".join(["Some words of a long page."] * 20000)


def test_repeated_rows_and_long_texts(spark):
    """Every operator on repeated rows, ties and a text of 200,000 characters."""
    long_text = "The quick brown fox jumps over the lazy dog, and so it goes on. " * 3000
    rows = [(1, "one two three four five six", "en"), (1, "one two three four five six", "en"), (2, long_text, "en"), (2, long_text, "en"), (3, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    y = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, toxic int, quality int")
    for got in (toxicity.report(d, y), quality.report(d, y), langid.report(d), pii.report(d), imatch.fingerprints(d), kd_shards.shard(d), jaccard_join.components(d), decontaminate.report(d, d.select(F.col("doc_id").alias("item_id"), "text"))):
        assert got.count() == 5
