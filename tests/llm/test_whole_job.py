"""What a reviewer found left out: each case failed before it was mended."""

from __future__ import annotations

import random
import string
import zlib

import duckdb
import pyarrow.parquet as pq
import pytest

from knotwork.llm import decontaminate, langid, pii
from knotwork.llm.queries import OP2

POLISH = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."


@pytest.mark.parametrize("outlier", [None, "Éç."])
def test_gibberish_and_unlearned_languages_are_rejected(outlier):
    rows = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows]
    known = [(r["lang"], r["text"]) for r, h in zip(rows, held, strict=True) if not h] + [("fr", outlier)] * (outlier is not None)
    sample = {k: [n for j, t in known[::-1] if j == k and (n := langid.counts(t)) is not None][:800] for k in {k for k, _ in known}}
    model = langid.fit([(k, n) for k, v in sorted(sample.items()) for n in v])
    r = random.Random(1)
    letters = [" ".join("".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (20, 60, 300, 3000) for _ in range(10)]
    base64 = ["".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(n)) for n in (200, 2000, 20000) for _ in range(10)]
    assert all(model.predict(t)[2] for t in [*letters, *base64, POLISH])
    clean = [model.predict(x["text"])[2] for x, h in zip(rows, held, strict=True) if h]
    assert sum(clean) <= 0.01 * len(clean)


def test_limits_of_a_few_texts():
    n = langid.counts("one text of this language")
    assert not langid.fit([("en", n)]).predict("one text of this language")[2]
    assert not langid.fit([("en", n), ("en", n), ("fr", langid.counts("un texte")), ("fr", langid.counts("deux textes"))]).predict("one text of this language")[2]


@pytest.mark.parametrize(
    "address",
    [
        "anna at students dot physics dot uni-heidelberg dot de",
        "max.mustermann (at) wirtschaftsinformatik-fakultaet (dot) de",
        "john.doe (at) mail.example (dot) co (dot) uk",
        "max [at] a [dot] b [dot] c [dot] d [dot] e [dot] org",
        "a.very.long.local.part.with.many.pieces.in.it (at) host (dot) org",
        "x1y2z3" * 12 + "(at)" + "y" * 70 + "(dot)x-y(dot)org",
    ],
)
def test_spelled_out_addresses_are_masked_whole(address):
    model = pii.train()
    for left, right in (("", ""), ("Write to ", ", or call."), ("x\n", ".\nNo 12")):
        text = left + address + right
        assert pii.mask(text, pii.all_spans(text, model)) == f"{left}<EMAIL>{right}"


@pytest.mark.parametrize("block_words", [10**6, 12])
def test_repeated_and_null_item_ids(spark, block_words):
    part = [" ".join(f"{c}{i}" for i in range(15)) for c in "abcd"]
    docs = spark.createDataFrame([(1, f"{part[0]} x {part[1]}"), (2, f"y {part[2]}"), (3, part[3]), (4, f"{part[0]} {part[2]}")], "doc_id long, text string")
    items = [("7", part[0]), ("7", part[1]), ("7", part[0]), (None, part[2]), ("8", "a0 b0 c0")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r.item_ids, key=str)) for r in decontaminate.matches(docs, bench, block_words=block_words).collect()}
    assert got == {1: (31, 30, ["7"]), 2: (16, 15, [None]), 3: (15, 0, []), 4: (30, 30, ["7", None])}
    assert [got[i] for i in (1, 2, 3, 4)] == [w[:3] for w in decontaminate.brute_force([r.text for r in docs.orderBy("doc_id").collect()], items)]
    duck = duckdb.connect()
    for name, t in (("documents", docs), ("benchmark", bench)):
        duck.register(name, t.toArrow())
    want = duck.execute(OP2)
    report = decontaminate.report(docs, bench).select(*[c[0] for c in want.description])
    assert sorted(map(tuple, report.collect())) == sorted(want.fetchall())
