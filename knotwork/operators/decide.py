"""Assignment and decoding: at most one entity a query, thresholds, expected-F top-k, and their scores."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.pairs import GRID, calibrate


def top_per_query(scored: DataFrame, n: int, score: str = "p") -> DataFrame:
    """The n best entities of each query; ties to the lower id. A task sends on n rows a query at most."""
    w = Window.partitionBy("q_idx").orderBy(F.col(score).desc(), "s1_idx")
    return scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def best_per_query(scored: DataFrame, score: str = "p") -> DataFrame:
    """The best entity of each query, as a maximum, so no query's rows are sorted or even sent."""
    others = [c for c in scored.columns if c not in ("q_idx", "s1_idx", score)]
    top = F.max_by(F.struct("s1_idx", score, *others), F.struct(F.col(score), -F.col("s1_idx")))
    return scored.groupBy("q_idx").agg(top.alias("_b")).select("q_idx", "_b.*")


def prune(scored: DataFrame, keep: int = 4, least: float = 0.003, score: str = "p") -> DataFrame:
    """The best `keep` of each query, then those of at least `least`."""
    return top_per_query(scored, keep, score).filter(F.col(score) >= least)


def threshold_links(best: DataFrame, t: float) -> DataFrame:
    return best.filter(F.col("p") >= t)


def country_threshold_links(best: DataFrame, thresholds: DataFrame, default: float, label: str = "country") -> DataFrame:
    """thresholds: label, t; labels without one take the default."""
    return best.join(F.broadcast(thresholds.select(label, "t")), label, "left").filter(F.col("p") >= F.coalesce("t", F.lit(default))).drop("t")


# -- F0.5 -------------------------------------------------------------------------------------------------------------
def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """1 for nothing to find and nothing claimed, 0 without a hit, else 1.25 tp / (0.25 n_true + n_pred)."""
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * tp / (0.25 * n_true + n_pred))


def entity_scores(pred: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """s1_idx, tp, n_pred, n_true, f of each entity of the universe. Claims and truths meet in one union and one aggregation."""
    one = lambda df, p, t: df.select("s1_idx", "q_idx", F.lit(p).alias("p"), F.lit(t).alias("t"))
    pairs = one(pred, 1, 0).unionByName(one(truth, 0, 1)).groupBy("s1_idx", "q_idx").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    counts = pairs.groupBy("s1_idx").agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tp", "n_pred", "n_true")}
    return universe.select("s1_idx").join(counts, "s1_idx", "left").withColumns(zero).withColumn("f", f05(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f05(pred: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: entities, macro F0.5, micro precision and recall, F0.5 of entities with and without truths."""
    u = entity_scores(pred, truth, universe)
    none = F.col("n_true") == 0
    return u.agg(
        F.count("*").alias("n_entities"),
        F.avg("f").alias("macro_f05"),
        F.try_divide(F.sum("tp"), F.sum("n_pred")).alias("micro_p"),
        F.try_divide(F.sum("tp"), F.sum("n_true")).alias("micro_r"),
        F.avg(F.when(none, F.col("f"))).alias("f_singletons"),
        F.avg(F.when(~none, F.col("f"))).alias("f_others"),
    )


def threshold_sweep(best: DataFrame, truth: DataFrame, universe: DataFrame, grid: list[float] = GRID) -> DataFrame:
    """t, macro_f05 of every threshold of the grid from one pass: a link counts for all thresholds up to its score, so counts are
    summed up along the grid once per entity that has links; entities without links score the same at each threshold."""
    n_t = len(grid)
    truths = truth.select("s1_idx", "q_idx", F.lit(1).alias("t"))
    pred = best.join(universe.select("s1_idx"), "s1_idx", "left_semi").select("s1_idx", "q_idx", "p")
    step = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("p")))  # thresholds that the link passes
    hits = pred.join(truths, ["s1_idx", "q_idx"], "left").select("s1_idx", step.alias("k"), F.coalesce("t", F.lit(0)).alias("hit")).filter("k > 0")
    by_k = hits.groupBy("s1_idx", "k").agg(F.sum("hit").alias("tp"), F.count("*").alias("n"))
    lists = by_k.groupBy("s1_idx").agg(F.collect_list(F.struct("k", "tp", "n")).alias("ks"))  # at most one row a threshold
    n_true = truth.groupBy("s1_idx").agg(F.count("*").alias("n_true"))
    u = universe.select("s1_idx").join(lists, "s1_idx", "left").join(n_true, "s1_idx", "left")
    total = lambda name: lambda i: F.aggregate(F.coalesce(F.col("ks"), F.array().cast("array<struct<k:int,tp:bigint,n:bigint>>")), F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["k"] > i, x[name]).otherwise(0))
    fs = F.transform(F.sequence(F.lit(0), F.lit(n_t - 1)), lambda i: f05(total("tp")(i), total("n")(i), F.coalesce(F.col("n_true"), F.lit(0))))
    long = u.select(F.posexplode(fs).alias("i", "f"))
    at = F.get(F.array(*map(F.lit, grid)), F.col("i"))
    return long.groupBy("i").agg(F.avg("f").alias("macro_f05")).select(at.alias("t"), "macro_f05")


# -- expected F0.5 ----------------------------------------------------------------------------------------------------
def expected_f05(p: list[float], miss: float = 0.0) -> list[float]:
    """Expected score of keeping the first 0..n candidates, which are true independently with probabilities p.

    Hits among those kept and truths among the rest are Poisson-binomial; both are built up a candidate at a time, so the work grows
    with a power of n and not with the number of labelings.
    """

    def spread(values: list[float]) -> list[list[float]]:
        out = [[1.0]]
        for v in values:
            last = out[-1]
            out.append([(last[i] if i < len(last) else 0.0) * (1 - v) + (last[i - 1] * v if i else 0.0) for i in range(len(last) + 1)])
        return out

    n, first, rest = len(p), spread(p), spread(p[::-1])
    result = [first[n][0] * math.exp(-miss)]
    for k in range(1, n + 1):
        hits, others = first[k], rest[n - k]
        result.append(sum(a * b * 1.25 * t / (0.25 * (t + r + miss) + k) for t, a in enumerate(hits) if t for r, b in enumerate(others)))
    return result


def expected_f05_enumerated(p: list[float], miss: float = 0.0) -> list[float]:
    """The same over all labelings; for tests."""
    out = [0.0] * (len(p) + 1)
    for y in itertools.product((0, 1), repeat=len(p)):
        w = math.prod(v if t else 1 - v for v, t in zip(p, y, strict=True))
        out[0] += w * math.exp(-miss) * (not any(y))
        for k in range(1, len(p) + 1):
            tp = sum(y[:k])
            out[k] += w * (1.25 * tp / (0.25 * (sum(y) + miss) + k) if tp else 0.0)
    return out


def ef_select(best: DataFrame, a: float = 1.0, miss: float = 0.0, floor: float = 0.01, n_most: int = 10) -> DataFrame:
    """s1_idx, q_idx of the links that maximise each entity's expected F0.5 among its n_most best candidates; the fewer on a tie.

    Candidates of an entity are a list of at most n_most, so the choice is a function of one row.
    """
    w = Window.partitionBy("s1_idx").orderBy(F.col("p").desc(), "q_idx")
    top = best.filter(F.col("p") >= floor).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n_most)
    lists = top.withColumn("c", calibrate(F.col("p"), a)).groupBy("s1_idx").agg(F.array_sort(F.collect_list(F.struct("r", "q_idx", "c"))).alias("xs"))

    def choose(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for p in s:
                e = expected_f05([float(v) for v in p], miss)
                out.append(max(range(len(e)), key=lambda k: (e[k], -k)))
            yield pd.Series(out)

    keep = F.pandas_udf(choose, "int")
    chosen = lists.withColumn("k", keep(F.transform("xs", lambda x: x["c"])))
    return chosen.select("s1_idx", F.explode(F.slice("xs", F.lit(1), F.col("k"))).alias("x")).select("s1_idx", F.col("x.q_idx").alias("q_idx"))


def ef_sweep(best: DataFrame, truth: DataFrame, universe: DataFrame, temperatures: tuple[float, ...] = (0.8, 1.0, 1.25, 1.5, 2.0), misses: tuple[float, ...] = (0.0, 0.05, 0.15)) -> DataFrame:
    """a, miss, macro_f05 over the grid, a fixed number of plans in one union."""
    out = None
    for a, m in itertools.product(temperatures, misses):
        row = macro_f05(ef_select(best, a, m), truth, universe).select(F.lit(a).alias("a"), F.lit(m).alias("miss"), "macro_f05")
        out = row if out is None else out.unionByName(row)
    return out


def pick_rule(sweep: DataFrame, ef: DataFrame) -> dict:
    """The better rule; a threshold unless expected F is strictly better."""
    t = sweep.orderBy(F.col("macro_f05").desc(), "t").first()
    e = ef.orderBy(F.col("macro_f05").desc(), "a", "miss").first()
    if e is not None and (t is None or e["macro_f05"] > t["macro_f05"]):
        return {"mode": "ef", "a": e["a"], "miss": e["miss"], "f05": e["macro_f05"]}
    return {"mode": "threshold", "t": t["t"], "f05": t["macro_f05"]}
