"""Plans, command line, sources and registered functions on small data of their own."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from knotwork import cli, schema
from knotwork.functions import similarity, textnorm
from knotwork.operators import learn, models
from knotwork.plans import features, linkage, postprocess
from knotwork.plans.workspace import Workspace
from knotwork.sources import sinks, tables

FIRST = "blue red green north south royal grand silver golden prime urban coastal".split()
LAST = "fern river bakery motors tailor garden bridge harbour kitchen studio market press".split()
STREETS = "Elm Oak Maple Cedar Pine Lake Hill River Mill Church".split()


def write(path, rows, header="entity_id\tbusiness_name\tbusiness_address\tcountry"):
    path.write_text("\n".join([header, *("\t".join(r) for r in rows)]) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """80 entities; most have a noisy copy in either source, and a neighbour with a moved number and an added word."""
    r, p = random.Random(6), tmp_path_factory.mktemp("data")
    s1, s2, s3, truth = [], [], [], []
    for i in range(80):
        name, no, street = f"{FIRST[i % 12].title()} {LAST[i * 7 % 12].title()} {LAST[i // 12].title()}", 10 + 3 * i, STREETS[i % 10]
        s1.append((f"e{i}", f"{name} Corporation", f"{no} {street} Road, Springfield", "US"))
        own = []
        if i % 5:
            own.append(f"b{i}")
            s2.append((f"b{i}", f"{name} {r.choice(['Inc', 'Corp', ''])}".strip(), f"{no} {street} Rd, Springfield", "US"))
        if i % 3:
            own.append(f"c{i}")
            s3.append((f"c{i}", f"{name.upper()} Company", f"No {no}, {street} Road", "US"))
        s3.append((f"d{i}", f"{name} Holdings Group", f"{no + 2} {street} Road, Springfield", "US"))
        truth.append((f"e{i}", ",".join(own)))
    for n, rows in ((1, s1), (2, s2), (3, s3)):
        write(p / f"train_source{n}.tsv", rows)
    write(p / "train_ground_truth.tsv", truth, "source1_entity_id\tmatched_entity_ids")
    return p


def test_command_line(spark, folder, tmp_path, capsys):
    where = ["--data-dir", str(folder), "--work-dir", (tmp_path / "work").as_uri(), "--out-dir", str(tmp_path / "out"), "--rounds", "2", "--least-words", "3"]
    for stage in ("all", "validate", "report"):
        cli.main([stage, *where], spark)
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert shown[0]["mode"] in ("threshold", "ef") and shown[1] == {"links_that_are_no_candidates": 0}
    assert shown[2]["blocking_recall"]["5"] > 0.9 and shown[2]["fold_0"]["macro_f05"] > 0.5
    lists = tables.read_tsv(spark, str(tmp_path / "out" / "matching_results"), schema.LINKS)
    assert lists.count() == 80 and lists.select("source1_entity_id").distinct().count() == 80
    before = {(r.source1_entity_id, x) for r in lists.collect() for x in (r.matched_entity_ids or "").split(",") if x}
    cli.main(["postprocess", *where], spark)
    after = tables.read_tsv(spark, str(tmp_path / "out" / "matching_results_final"), schema.LINKS)
    left = {(r.source1_entity_id, x) for r in after.collect() for x in (r.matched_entity_ids or "").split(",") if x}
    assert left <= before and after.count() == 80
    # the pruned pairs carry every feature of both blocks
    work = Workspace(spark, (tmp_path / "work").as_uri())
    assert set(features.PRUNE) <= set(work.load("features").columns) and set(features.SECOND) <= set(work.load("second").columns)
    assert len(features.PRUNE) == 50 and len(features.SECOND) == 29
    final = work.load("final")
    names = [c for c in final.columns if c not in ("q_idx", "s1_idx", "y", "fold", "q_src", "label")]
    ranker = models.fit_ranker(final, names, 1, 2)
    top = models.importances(ranker, names, 5)
    assert len(top) == 5 and top[0][1] >= top[-1][1]


def test_subset(spark, folder, tmp_path):
    cli.main(["subset", "--data-dir", str(folder), "--out-dir", str(tmp_path), "--share", "0.4", "--work-dir", (tmp_path / "w").as_uri()], spark)
    s1 = tables.read_tsv(spark, str(tmp_path / "train_source1.tsv"), schema.RAW)
    truth = tables.read_tsv(spark, str(tmp_path / "train_ground_truth.tsv"), schema.TRUTH)
    assert 0 < s1.count() < 80 and truth.count() == s1.count()


def test_index_over_many_ranges(spark):
    rows = [(f"k{i * 37 % 1000:04}", i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "entity_id string, src int").repartition(7)
    got = [(r.src, r.entity_id, r.idx) for r in tables.with_index(df, "src", "entity_id", start=5, rows_a_part=40).collect()]
    want = sorted((s, e) for e, s in rows)
    assert sorted(got) == [(s, e, i + 5) for i, (s, e) in enumerate(want)]
    assert tables.with_index(df.limit(0), "entity_id").count() == 0


def test_dictionaries(spark, tmp_path):
    sinks.save_json({"name": {"नी": "blue"}, "addr": {"ला": "road", "बा": "lane"}}, str(tmp_path / "d.json"))
    got = sorted(map(tuple, tables.read_dictionaries(spark, str(tmp_path / "d.json")).collect()))
    assert got == [("addr", "बा", "lane"), ("addr", "ला", "road"), ("name", "नी", "blue")]
    raw = lambda rows: spark.createDataFrame(rows, "idx long, entity_id string, business_name string, business_address string, country string")
    s1 = raw([(1, "a", "Général Bakery", "12 Elm Road", "IN"), (2, "b", "Général Motors", "3 Oak Road", "IN")])
    q = raw([(1, "x", "जनरल Bakery", "12 एल्म Road", "IN"), (2, "y", "जनरल Motors", "3 Oak Road", "IN")])
    truth = spark.createDataFrame([(1, 1), (2, 2)], "q_idx long, s1_idx long")
    a, b = linkage.prepare(s1, q, truth)
    assert {r.idx: r.ntok for r in b.collect()} == {1: ["general", "bakery"], 2: ["general", "motors"]}
    assert all(x.fold == y.fold for x, y in zip(a.orderBy("idx").collect(), b.orderBy("idx").collect(), strict=True))
    with pytest.raises(ValueError):
        learn.as_dictionary(spark.createDataFrame([("a", "b"), ("c", "d")], "native string, latin string"), 1)


def test_vote_tokens_and_romanisation():
    assert textnorm.vote_tokens("L'Étoile du Général, 5") == ["letoile", "du", "general", "5"] and textnorm.vote_tokens(None) == []
    # spellings by the characters' names: inherent vowels stand, long signs are doubled
    table = {"क": "ka", "का": "kaaa", "दीप": "daiipa", "ж": "zhe", "١٢": "12", "ab": "ab"}
    assert {k: textnorm.romanise(k) for k in table} == table
    assert textnorm.romanise_text("Café ab") == "cafe ab"


def test_registered_functions(spark):
    names = similarity.register(spark)
    assert {"partial_ratio", "jaro_winkler", "osa", "fold_text", "extra_tokens"} <= set(names)
    row = spark.sql("SELECT partial_ratio('abc', 'xxabcxx') AS p, osa('abc', 'acb') AS o, fold_text('Éa') AS f, extra_tokens(array('blue'), array('blu', 'group')) AS e").first()
    assert (row.p, row.o, row.f, row.e) == (100.0, 1, "ea", ["group"])


def test_rules_over_links(spark):
    s1 = spark.createDataFrame([(i, f"e{i}", "France", ["nogent", "primaire", "sas"], ["nogent", "primaire"], ["5"]) for i in range(6)], "idx long, entity_id string, country string, ntok array<string>, ncore array<string>, anum array<string>")
    q = spark.createDataFrame([(i, f"q{i}", ["nogent", w, "sas"], ["nogent", w], ["5"], False, 2) for i, w in enumerate(["patrimoine", "patrimoine", "primaire", "primaire", "patrimoine", "primaire"])], "idx long, entity_id string, ntok array<string>, ncore array<string>, anum array<string>, amiss boolean, src int")
    more = spark.createDataFrame([(9, "e9", "France", ["nogent", "patrimoine"], ["nogent", "patrimoine"], ["5"])], s1.schema)
    s1 = s1.union(more)
    links = spark.createDataFrame([(f"e{i}", f"q{i}") for i in range(6)] + [("e9", "q2"), ("e9", "q9")], "sid string, qid string")
    rows = postprocess.with_records(links, s1, q).withColumn("p", F.lit(0.9))
    assert rows.count() == 7
    left = {(r.sid, r.qid) for r in postprocess.remove(rows, s1, ("fr_swap",), least_removed=1).collect()}
    assert left == {("e2", "q2"), ("e3", "q3"), ("e5", "q5")}
    namesakes = postprocess.remove(rows.withColumn("amiss", F.lit(True)), s1, ("namesake",))
    assert {(r.sid, r.qid) for r in namesakes.collect()} == {("e0", "q0"), ("e1", "q1"), ("e4", "q4")}


def test_workspace_needs_a_shared_folder(spark, tmp_path):
    work = Workspace(spark, tmp_path.as_uri())
    assert work.save("x", spark.range(3)).count() == 3 and work.load("x").count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        work.save("x", spark.range(3))


def test_streams_of_models(spark):
    c = models.CharEmbedder(width=64)
    r = spark.createDataFrame([(1, "blue fern"), (2, "blue fern"), (3, "red mill")], "id long, mtext string")
    v = {x.id: x.vec for x in c.fit(r).transform(r).collect()}
    assert v[1] == v[2] != v[3] and abs(sum(x * x for x in v[1]) - 1) < 1e-5
    # a linear scorer is its coefficients: the logit is their inner product with the features
    seen = spark.createDataFrame([(i, i % 7 / 7, i % 5 / 5, i % 7 > 3) for i in range(70)], "q_idx long, a double, b double, y boolean")
    s = models.LogisticScorer(["a", "b"]).fit(seen)
    fitted = s.model.stages[-1]
    for x in s.score(seen).collect():
        assert abs(x.xe - (fitted.intercept + fitted.coefficients[0] * x.a + fitted.coefficients[1] * x.b)) < 1e-9


def test_records_are_dealt_out_before_they_are_normalised(spark):
    """One small file is not normalised by one task."""
    from knotwork.plans import linkage

    s1 = spark.createDataFrame([(i, f"a{i}", "Blue Fern Corporation", f"{i} Road, Xville", "US") for i in range(20)], "idx long, entity_id string, business_name string, business_address string, country string").coalesce(1)
    true = spark.createDataFrame([(i, i) for i in range(9)], "q_idx long, s1_idx long")
    for side in linkage.prepare(s1, s1, true):
        assert "RepartitionByExpression [idx" in side._jdf.queryExecution().optimizedPlan().toString()
