"""Operators against brute force and invariants."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.operators import decide, evaluate, knn, learn, rules, tfidf
from knotwork.sources import sinks, tables
from knotwork import schema


def test_merge_directions(spark):
    f = spark.createDataFrame([(1, 10, 0.9, 0)], "q_idx long, s1_idx long, cos double, rq int")
    r = spark.createDataFrame([(1, 10, 0.9, 2), (2, 10, 0.4, 5)], "q_idx long, s1_idx long, cos double, rs int")
    assert sorted(map(tuple, knn.merge_directions(f, r).collect())) == [(1, 10, 0.9, 0, 2), (2, 10, 0.4, 255, 5)]


def test_knn_blocks_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 5)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], v[i].tolist()) for i in range(60)], "id long, country string, vec array<float>")
    got = knn.bidirectional(knn.knn_blocks(df.filter("id % 2 = 1"), df.filter("id % 2 = 0"), 3, 2, size=4), 3, 2).collect()
    want = {}
    for name in "ab":
        q, s = ([i for i in range(60) if i % 2 == odd and "ab"[i % 3 == 0] == name] for odd in (1, 0))
        sims = v[q].astype(float) @ v[s].astype(float).T
        for i, row in enumerate(sims):
            for r, j in enumerate(np.argsort(-row, kind="stable")[:3]):
                want.setdefault((q[i], s[j]), [255, 255])[0] = r
        for j, row in enumerate(sims.T):
            for r, i in enumerate(np.argsort(-row, kind="stable")[:2]):
                want.setdefault((q[i], s[j]), [255, 255])[1] = r
    assert {(r.q_idx, r.s1_idx): [r.rq, r.rs] for r in got} == want


def test_sparse_products():
    rng = np.random.default_rng(5)
    for heavy in (2, 40):
        a, b = (rng.random((n, 30)) * (rng.random((n, 30)) < 0.2) for n in (25, 17))
        a[:, :heavy % 30] = rng.random((25, heavy % 30))
        rows = lambda x: ([np.flatnonzero(r) for r in x], [r[r > 0] for r in x])
        got = knn.sparse_product(*rows(a), *rows(b))
        want = np.where((a > 0).astype(int) @ (b > 0).T > 0, a @ b.T, -np.inf)
        assert np.allclose(got, want)
    none = knn.sparse_product([np.array([1])], [np.array([1.0])], [np.array([2])], [np.array([1.0])])
    assert none.tolist() == [[-np.inf]]


def test_margins(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.7), (1, 3, 0.4), (2, 1, 0.5)], "q_idx long, s1_idx long, cos double")
    got = {(r.q_idx, r.s1_idx): round(r.margin_q, 9) for r in knn.context_windows(df).collect()}
    assert got == {(1, 1): 0.2, (1, 2): -0.2, (1, 3): -0.5, (2, 1): 1.5}


def test_f05_cases(spark):
    got = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 1, 2), (2, 2, 2)], "a int, b int, c int").select(decide.f05(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert [round(r[0], 6) for r in got] == [1, 0, 0.833333, 1]


def test_decisions(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (2, 2, 0.4), (3, 1, 0.2), (4, 3, 0.001)], "q_idx long, s1_idx long, p double")
    best = decide.best_per_query(scored)
    assert sorted((r.q_idx, r.s1_idx) for r in best.collect()) == [(1, 1), (2, 2), (3, 1), (4, 3)]
    assert sorted(map(tuple, decide.ef_select(best).collect())) == [(1, 1)]
    assert decide.prune(scored, 1, 0.003).count() == 3
    u = spark.createDataFrame([(1,), (2,), (9,)], "s1_idx long")
    gt = spark.createDataFrame([(1, 1), (2, 2)], "q_idx long, s1_idx long")
    sweep = {r.t: r.macro_f05 for r in decide.threshold_sweep(best, gt, u, [0.1, 0.3, 0.5]).collect()}
    for t, f in sweep.items():
        assert abs(f - decide.macro_f05(decide.threshold_links(best, t), gt, u).first().macro_f05) < 1e-12
    rule = decide.pick_rule(decide.threshold_sweep(best, gt, u, [0.1, 0.3]), decide.ef_sweep(best, gt, u, (1.0,), (0.0,)))
    assert rule["mode"] == "threshold" and rule["t"] == 0.3
    thresholds = spark.createDataFrame([("x", 0.95)], "country string, t double")
    assert decide.country_threshold_links(best.withColumn("country", F.lit("x")), thresholds, 0.1).count() == 0


def test_loss_budget_invariants(spark):
    rng = np.random.default_rng(3)
    rows = [(q, int(s), float(rng.random())) for q in range(60) for s in rng.choice(12, 3, replace=False)]
    scored = spark.createDataFrame(rows, "q_idx long, s1_idx long, p double")
    gt = spark.createDataFrame([(q, int(rng.integers(10))) for q in range(50)], "q_idx long, s1_idx long")
    u = spark.createDataFrame([(i,) for i in range(12)], "s1_idx long")
    best = decide.best_per_query(scored)
    links = decide.threshold_links(best, 0.4)
    items = evaluate.loss_items(gt, scored, scored, best, links, u)
    n = {r["cat"]: r["count"] for r in items.groupBy("cat").count().collect()}
    assert sum(n.get(c, 0) for c in "abcde") == gt.count()
    assert sum(n.get(c, 0) for c in "efg") == links.count()
    scores = decide.entity_scores(links, gt, u)
    gain = evaluate.loss_gains(items.withColumn("k", F.lit(1)), scores, ["k"]).first().gain
    assert abs(scores.agg(F.avg("f")).first()[0] + gain - 1) < 1e-9
    recall = [r.recall for r in evaluate.recall_at(gt, scored.withColumn("rq", (F.col("s1_idx") % 12).cast("int"))).orderBy("k").collect()]
    assert recall == sorted(recall)


def test_rules_only_remove(spark):
    links = spark.createDataFrame([(1, q, 2, q / 10) for q in range(7)], "s1_idx long, q_idx long, src int, p double")
    assert sorted(r.q_idx for r in rules.cap_rule(links).collect()) == [2, 3, 4, 5, 6]
    q = spark.createDataFrame([(1, 3, 7), (2, 3, None)], "q_idx long, fold int, true_s1 long")
    c = spark.createDataFrame([(1, 7, 0.5), (2, 8, 0.4)], "q_idx long, s1_idx long, cos double")
    s = spark.createDataFrame([(7, 0), (8, 0)], "s1_idx long, fold int")
    once = rules.refold(q, c, s)
    assert {r.q_idx: r.fold for r in once.collect()} == {1: 3, 2: 0}
    assert sorted(map(str, rules.refold(once, c, s).collect())) == sorted(map(str, once.collect()))
    sw = spark.createDataFrame([(["a"], ["b"], True, "France"), (["b"], ["a"], True, "France"), (["a"], ["b"], True, "US"), (["a", "c"], ["b"], True, "France")], "extra array<string>, missing array<string>, same_number boolean, country string")
    assert rules.swap_rule(sw, rules.swap_vocabulary(sw, 1)).count() == 2


def test_learned_dictionaries(spark):
    pairs = spark.createDataFrame([(["blue", "fern"], ["नी", "fern"])] * 2 + [(["red", "x"], ["ला", "बा"])] * 2, "s_tok array<string>, q_tok array<string>")
    assert {r.native: r.latin for r in learn.translit_votes(pairs).collect()} == {"नी": "blue", "ला": "red", "बा": "x"}
    s1 = spark.createDataFrame([(1, "F", ["paris", "rare"]), (2, "F", ["paris"]), (3, "F", [])], "idx long, country string, aloc array<string>")
    got = {r.idx: (r.afine1, r.afine2, round(r.afine1_share, 3)) for r in learn.rare_localities(s1).collect()}
    assert got == {1: ("rare", "paris", 0.333), 2: ("paris", "", 0.667), 3: ("", "", 0.0)}


def test_tfidf_of_equal_and_empty_texts(spark):
    r = spark.createDataFrame([(1, "a b"), (2, "b a"), (3, ""), (4, "c")], "id long, text string")
    p = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    got = {x.b: x.cos for x in tfidf.pair_cosines(p, tfidf.weights(r, tfidf.word_terms(F.col("text"))), "cos").collect()}
    assert got == {2: 1.0, 3: 0.0, 4: 0.0}
    assert spark.createDataFrame([("ab a",)], "t string").select(tfidf.char3_terms(F.col("t"))).first()[0] == [" ab", "ab ", " a "]


def test_tsv_round_trip(spark, tmp_path):
    p = tmp_path / "train_source1.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\ne2\t"Q" é\t\t\ne1\ta b \tx, y\tFR\n')
    for n in (2, 3):
        (tmp_path / f"train_source{n}.tsv").write_text(f"entity_id\tbusiness_name\tbusiness_address\tcountry\nq{n}\tn\ta\tUS\n")
    s1, q = tables.load_split(spark, str(tmp_path), "train")
    assert [(r.idx, r.entity_id, r.business_name, r.business_address, r.country) for r in s1.orderBy("idx").collect()] == [(0, "e1", "a b ", "x, y", "FR"), (1, "e2", '"Q" é', None, "UNK")]
    assert [(r.idx, r.src) for r in q.orderBy("idx").collect()] == [(0, 2), (1, 3)]
    (tmp_path / "gt.tsv").write_text("source1_entity_id\tmatched_entity_ids\ne1\tq2,,q3\ne2\t\n")
    gt = tables.read_truth(spark, str(tmp_path / "gt.tsv"), s1, q)
    assert sorted(map(tuple, gt.collect())) == [(0, 0), (1, 0)]
    links = sinks.link_lists(spark.createDataFrame([("e1", "q3"), ("e1", "q2")], "sid string, qid string"), s1.select(F.col("entity_id").alias("sid")))
    assert sorted(map(tuple, links.collect())) == [("e1", "q2,q3"), ("e2", "")]
    sinks.write_tsv(links.coalesce(1).orderBy("sid"), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("part-*")).read_text() == "sid\tids\ne1\tq2,q3\ne2\t\n"
    assert spark.createDataFrame([], schema.SCORED).count() == 0


def test_link_stream(spark, tmp_path):
    from knotwork.streaming.link_stream import link_stream

    e = spark.createDataFrame([(0, "x", [1.0, 0.0]), (2, "x", [0.0, 1.0])], "id long, country string, vec array<float>")
    new = spark.createDataFrame([(1, "x", [0.0, 1.0]), (3, "x", [0.7, 0.7]), (5, "y", [1.0, 0.0])], "id long, country string, vec array<float>")
    new.write.parquet(str(tmp_path / "in"))
    got = []
    q = link_stream(spark.readStream.schema(new.schema).parquet(str(tmp_path / "in")), e, lambda links, _: got.extend(links.collect()), str(tmp_path / "c"), 0.75)
    q.processAllAvailable()
    q.stop()
    assert [(r.q_idx, r.s1_idx) for r in got] == [(1, 2)]


@pytest.mark.parametrize("size", [3, 50, 8192])
def test_sparse_neighbours_against_all_pairs(spark, tmp_path, size):
    """Chunks of any size, many copies, ties, records without terms and of no label: ranks as of
    a table of all pairs, and no record is laid out twice."""
    texts = "select id, if(id % 17 = 0, null, if(id % 3 = 0, 'x', 'y')) as label, id % 2 = 1 as is_query, case when id % 13 = 0 then '' when id % 4 = 0 then 'same text here' else concat('w', id % 5, ' w', id % 7, ' here r', id % 50) end as text from range(300)"
    df = spark.sql(texts)
    w = tfidf.weights(df, tfidf.word_terms(F.col("text")), "label")
    a, b = (w.join(df.select("id", "is_query"), "id").filter(F.col("is_query") == q).select("label", "term", F.col("id").alias(n), F.col("w").alias("v" + n)) for q, n in ((True, "q_idx"), (False, "s1_idx")))
    all_pairs = a.join(b, ["label", "term"]).groupBy("q_idx", "s1_idx").agg(F.round(F.sum(F.col("vq_idx") * F.col("vs1_idx")), 6).alias("cos"))
    want = knn.bidirectional(all_pairs, 4, 3)
    chunks = knn.packed_chunks(df, tfidf.word_terms(F.col("text")), size)
    chunks.write.parquet(str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    assert packed.select(F.sum(F.size("ids"))).first()[0] == df.filter("text <> ''").count()
    assert packed.count() > (30 if size == 3 else 1)
    got = knn.sparse_neighbours(df, packed, 4, 3)
    key = ["q_idx", "s1_idx", "cos", "rq", "rs"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


@pytest.mark.parametrize(("strip", "products"), [(16, 40), (64, 5_000), (256, 131_072)])
@pytest.mark.parametrize("words", [3, 40])
def test_cells_of_sparse_chunks_against_all_pairs(monkeypatch, strip, products, words):
    """The best of both directions of two chunks, a bounded number of products at once; few words make many ties, and ties of rounded values
    go to the lower id."""
    monkeypatch.setattr(knn, "STRIP", strip)
    monkeypatch.setattr(knn, "PRODUCTS", products)
    rng = np.random.default_rng(words)

    def chunk(n: int, first: int) -> knn._Chunk:
        rows = [np.unique(rng.integers(0, words, rng.integers(1, 6))) for _ in range(n)]
        terms, codes = np.unique(np.concatenate(rows), return_inverse=True)
        row = {"reps": np.arange(first, first + 2 * n, 2), "lens": np.array([len(x) for x in rows]), "codes": codes.astype(np.int32), "terms": terms, "dfs": 1 + terms * 7 % 5}
        return knn._Chunk(row, 500)

    a, b = chunk(150, 1), chunk(90, 2)
    whole = np.zeros((a.n, b.n))
    for i, m in knn._strips(a, b):
        whole[i : i + len(m)] = m
    dense = [np.zeros((c.n, words)) for c in (a, b)]
    for c, d in zip((a, b), dense, strict=True):
        d[c.row, c.terms[c.code]] = c.w
    assert np.allclose(whole, dense[0] @ dense[1].T, atol=1e-12)
    m = np.round(np.where(whole > 0, whole, -np.inf), 4)
    best = lambda m, k: {(i, int(j)) for i, row in enumerate(m) for j in np.lexsort((np.arange(len(row)), -row))[:k] if row[j] > -np.inf}
    for k, r in ((4, 3), (2, 0), (0, 2)):
        want = {(int(a.ids[i]), int(b.ids[j])): m[i, j] for i, j in best(m, k) | {(j, i) for i, j in best(m.T, r)}}
        got = list(zip(*(x.tolist() for x in knn._cell(a, b, k, r, 4)), strict=True))
        assert {(x, y): v for x, y, v in got} == want and len(got) == len(want)


def test_cells_are_multiplied_once(spark):
    """No direction multiplies the chunks anew: the plan of the neighbours starts from a table of what the cells gave."""
    from knotwork.plans import linkage

    records = spark.createDataFrame([(i, "x", f"a{i % 3} b{i % 5}", i % 2 == 1) for i in range(40)], "id long, label string, text string, is_query boolean")
    plan = linkage.candidates_by_words(records)._jdf.queryExecution().optimizedPlan().toString()
    assert "q_codes" not in plan and "cells" in "".join(linkage.candidates_by_words(records).inputFiles())
