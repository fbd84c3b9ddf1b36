"""Reports: recall, where true pairs are lost, what repairing each loss would gain, label-free precision, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.pairs import BANDS, LOSS_BANDS, PROFILE_BANDS, band
from knotwork.operators.decide import entity_scores, f05
from knotwork.operators.knn import ABSENT

KEYS = ["q_idx", "s1_idx"]


def recall_at(truth: DataFrame, candidates: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """k, recall: share of true pairs among their query's k nearest."""
    hit = truth.join(candidates.select(*KEYS, "rq"), KEYS, "left")
    row = hit.agg(*[F.avg(F.when(F.coalesce("rq", F.lit(ABSENT)) < k, 1.0).otherwise(0.0)).alias(f"k{k}") for k in ks])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("recall")) for k in ks])).alias("x")).select("x.*")


def recall_after(truth: DataFrame, kept: DataFrame) -> DataFrame:
    """n_true, recall: share of true pairs among those kept."""
    found = truth.join(kept.select(*KEYS, F.lit(1.0).alias("hit")).distinct(), KEYS, "left")
    return found.agg(F.count("*").alias("n_true"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def miss_stages(truth: DataFrame, candidates: DataFrame, pruned: DataFrame, best: DataFrame, links: DataFrame) -> DataFrame:
    """The true pairs that were not linked, with the stage that lost them."""
    mark = lambda df, name: df.select(*KEYS, F.lit(True).alias(name)).distinct()
    missed = truth.join(links.select(*KEYS), KEYS, "left_anti")
    t = missed.join(mark(candidates, "in_c"), KEYS, "left").join(mark(pruned, "in_p"), KEYS, "left").join(best.select("q_idx", F.col("s1_idx").alias("best_s1")), "q_idx", "left")
    stage = F.when(F.col("in_c").isNull(), "lost_in_blocking").when(F.col("in_p").isNull(), "lost_in_pruning").when(F.coalesce(F.col("best_s1") != F.col("s1_idx"), F.lit(True)), "other_s1_won").otherwise("below_threshold")
    return t.select(*KEYS, stage.alias("stage"))


def false_merges(links: DataFrame, truth: DataFrame, texts_q: DataFrame, texts_s: DataFrame) -> DataFrame:
    """Links that are not true, with both records' texts (tables keyed by q_idx and s1_idx)."""
    return links.join(truth.select(*KEYS), KEYS, "left_anti").join(texts_q, "q_idx").join(texts_s, "s1_idx")


def loss_items(truth: DataFrame, candidates: DataFrame, scored: DataFrame, best: DataFrame, links: DataFrame, universe: DataFrame) -> DataFrame:
    """Every true pair and false link with its fate and what repairing it would change.

    a never a candidate, b pruned away, c another entity won, d below the threshold, e linked; f false link of an entity with
    truths, g of one without.
    """
    mark = lambda df, name: df.select(*KEYS, F.lit(True).alias(name)).distinct()
    gt = truth.join(universe.select("s1_idx"), "s1_idx", "left_semi").select(*KEYS)
    own = links.join(universe.select("s1_idx"), "s1_idx", "left_semi")
    p_true = scored.join(gt, KEYS, "left_semi").groupBy(*KEYS).agg(F.max("p").alias("p"))
    t = gt.join(p_true, KEYS, "left").join(mark(candidates, "in_c"), KEYS, "left").join(mark(own, "linked"), KEYS, "left").join(best.select("q_idx", F.col("s1_idx").alias("best_s1")), "q_idx", "left")
    fate = F.when(F.col("linked"), "e").when(F.col("best_s1") == F.col("s1_idx"), "d").when(F.col("p").isNotNull(), "c").when(F.col("in_c"), "b").otherwise("a")
    change = lambda hit: F.when(F.col("cat") == "e", 0).otherwise(hit)
    true = t.withColumn("cat", fate).select(*KEYS, "cat", "p", change(1).alias("dtp"), change(1).alias("dnp"))
    n = gt.groupBy("s1_idx").agg(F.count("*").alias("n"))
    wrong = own.join(gt, KEYS, "left_anti").join(n, "s1_idx", "left")
    false = wrong.select(*KEYS, F.when(F.col("n").isNull(), "g").otherwise("f").alias("cat"), "p", F.lit(0).alias("dtp"), F.lit(-1).alias("dnp"))
    return true.unionByName(false)


def loss_gains(items: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of keys: items, entities, and the macro F0.5 gained if all of the group's losses were repaired."""
    per = items.groupBy(*keys, "s1_idx").agg(F.count("*").alias("n"), F.sum("dtp").alias("dtp"), F.sum("dnp").alias("dnp")).join(scores, "s1_idx")
    gain = f05(F.col("tp") + F.col("dtp"), F.col("n_pred") + F.col("dnp"), F.col("n_true")) - F.col("f")
    total = scores.agg(F.count("*").alias("n_ent"))
    out = per.withColumn("df", gain).groupBy(*keys).agg(F.sum("n").alias("n"), F.count_distinct("s1_idx").alias("n_s1"), F.sum("df").alias("df"))
    return out.join(F.broadcast(total)).withColumn("gain", F.col("df") / F.col("n_ent")).drop("df", "n_ent")


def loss_budget(truth: DataFrame, candidates: DataFrame, scored: DataFrame, best: DataFrame, links: DataFrame, universe: DataFrame, slices: DataFrame | None = None) -> DataFrame:
    """cat (and slice, with `all`): n, n_s1, gain. slices: s1_idx, slice."""
    items = loss_items(truth, candidates, scored, best, links, universe)
    scores = entity_scores(links.join(universe.select("s1_idx"), "s1_idx", "left_semi"), truth.join(universe.select("s1_idx"), "s1_idx", "left_semi"), universe)
    if slices is None:
        return loss_gains(items, scores, ["cat"])
    items = items.join(slices, "s1_idx").withColumn("slice", F.explode(F.array(F.lit("all"), F.col("slice"))))
    return loss_gains(items, scores, ["cat", "slice"])


def loss_bands(items: DataFrame, scores: DataFrame) -> DataFrame:
    """cat, band of the score (pairs without one are in the open band): n, n_s1, gain."""
    return loss_gains(items.withColumn("band", band(F.col("p"), LOSS_BANDS, open_end=True)), scores, ["cat", "band"])


def band_precision(best: DataFrame, truth: DataFrame, edges: list[float] = BANDS) -> DataFrame:
    """Per band of p: links, and the share that is true. The last band ends just above 1."""
    y = best.join(truth.select(*KEYS, F.lit(1.0).alias("y")), KEYS, "left").withColumn("band", band(F.col("p"), edges)).filter(F.col("band").isNotNull())
    return y.groupBy("band").agg(F.count("*").alias("links"), F.avg(F.coalesce("y", F.lit(0.0))).alias("precision"))


def implied_precision(links: DataFrame, silver: DataFrame) -> DataFrame:
    """Per country and band: links (qid, sid, country, band), those with a silver label, and how often that agrees."""
    t = links.join(silver.select("qid", F.col("sid").alias("silver")), "qid", "left")
    return t.groupBy("country", "band").agg(F.count("*").alias("links"), F.count("silver").alias("silver_links"), F.avg(F.when(F.col("silver").isNotNull(), (F.col("sid") == F.col("silver")).cast("double"))).alias("agree"))


def profile(links: DataFrame, signals: list[str], by: list[str] | None = None, edges: list[float] = PROFILE_BANDS) -> DataFrame:
    """Share of links per band of p, and mean of the signals."""
    shares = [F.avg(((F.col("p") >= lo) & (F.col("p") < hi)).cast("double")).alias(f"p_{lo:.2f}") for lo, hi in zip(edges, edges[1:], strict=False)]
    return links.groupBy(*(by or [])).agg(F.count("*").alias("links"), *shares, *[F.avg(F.col(s).cast("double")).alias(s) for s in signals])


def compare_groups(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """feature, and the mean in each group: means by group, turned on their side."""
    means = rows.groupBy(group).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    long = means.unpivot(group, columns, "feature", "mean")
    return long.groupBy("feature").pivot(group).agg(F.first("mean"))


def dense_top2(candidates: DataFrame) -> DataFrame:
    """Nearest entity of each query, and its lead over the second (over -1 without one)."""
    second = candidates.filter("rq = 1").select("q_idx", F.col("cos").alias("cos2"))
    return candidates.filter("rq = 0").select(*KEYS, "cos").join(second, "q_idx", "left").withColumn("margin", F.col("cos") - F.coalesce("cos2", F.lit(-1.0))).drop("cos2")


def dense_grid(top: DataFrame, truth: DataFrame, universe: DataFrame, n: int = 36, margins: tuple[float, ...] = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05)) -> DataFrame:
    """t, m, macro_f05 over quantiles of cos and the margins. The grid is broadcast: its size is fixed."""
    spark = top.sparkSession
    share = [0.01 + i * 0.69 / (n - 1) for i in range(n)]
    ts = top.agg(F.array_distinct(F.percentile("cos", F.array(*map(F.lit, share)))).alias("ts")).select(F.explode("ts").alias("t"))
    grid = ts.join(F.broadcast(spark.createDataFrame([(m,) for m in margins], "m double")))
    hits = top.join(truth.select(*KEYS, F.lit(1).alias("hit")), KEYS, "left").select("s1_idx", "cos", "margin", F.coalesce("hit", F.lit(0)).alias("hit"))
    kept = hits.join(F.broadcast(grid), (F.col("cos") >= F.col("t")) & (F.col("margin") >= F.col("m")))
    per = kept.groupBy("t", "m", "s1_idx").agg(F.sum("hit").alias("tp"), F.count("*").alias("n_pred"))
    n_true = truth.join(universe.select("s1_idx"), "s1_idx", "left_semi").groupBy("s1_idx").agg(F.count("*").alias("n_true"))
    base = universe.select("s1_idx").join(n_true, "s1_idx", "left").select("s1_idx", F.coalesce("n_true", F.lit(0)).alias("n_true"))
    # an entity without links scores 1 without truths and 0 with: start from all of them and correct those with links
    flat = base.agg(F.count("*").alias("n"), F.sum(F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)).alias("f0"))
    delta = per.join(base, "s1_idx").select("t", "m", (f05(F.col("tp"), F.col("n_pred"), F.col("n_true")) - F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)).alias("d"))
    return grid.join(delta.groupBy("t", "m").agg(F.sum("d").alias("d")), ["t", "m"], "left").join(F.broadcast(flat)).select("t", "m", ((F.col("f0") + F.coalesce("d", F.lit(0.0))) / F.col("n")).alias("macro_f05"))


def links_per_entity(links: DataFrame, entities: DataFrame, label: str = "country") -> DataFrame:
    n = links.join(entities.select("s1_idx", label), "s1_idx").groupBy(label).agg(F.count("*").alias("links"))
    return entities.groupBy(label).agg(F.count("*").alias("entities")).join(n, label, "left").select(label, "entities", F.coalesce("links", F.lit(0)).alias("links"), (F.coalesce("links", F.lit(0)) / F.col("entities")).alias("per_entity"))


def address_class(entities: DataFrame, q: DataFrame, label: str = "country", name: str = "ntok") -> DataFrame:
    """Adds addr: addr, noaddr-namesake (at least two entities have the name), noaddr-unique."""
    n = entities.groupBy(label, name).agg(F.count("*").alias("_n"))
    kind = F.when(~F.coalesce(F.col("amiss"), F.lit(False)), "addr").when(F.coalesce("_n", F.lit(0)) >= 2, "noaddr-namesake").otherwise("noaddr-unique")
    return q.join(n, [label, name], "left").withColumn("addr", kind).drop("_n")


def frequency(rows: DataFrame, column: str | Column) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
