"""Post-processing of a link file: read, remove links by rules, write again. Rules only remove, so links stay candidates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork import schema
from knotwork.functions import lexicon as L
from knotwork.functions import pairs as P
from knotwork.functions import similarity
from knotwork.operators import cells, rules
from knotwork.sources import sinks, tables

RULES = ("fr_swap", "namesake", "cap", "veto")


def with_records(links: DataFrame, s1: DataFrame, q: DataFrame) -> DataFrame:
    """links: sid, qid (ids as in the files). Adds both records' columns that rules look at; ids of no record are dropped."""
    a = s1.select(F.col("entity_id").alias("sid"), F.col("idx").alias("s1_idx"), "country", F.col("ntok").alias("s_ntok"), F.col("ncore").alias("s_ncore"), F.col("anum").alias("s_anum"))
    b = q.select(F.col("entity_id").alias("qid"), F.col("idx").alias("q_idx"), "ntok", F.col("ncore").alias("q_ncore"), F.col("anum").alias("q_anum"), "amiss", "src")
    return links.join(a, "sid").join(b, "qid")


def swap_columns(links: DataFrame) -> DataFrame:
    """Adds extra and missing core words and whether the first numbers agree."""
    extra = similarity.extra_udf()
    same = F.coalesce(F.get("s_anum", F.lit(0)) == F.get("q_anum", F.lit(0)), F.lit(False))
    return links.withColumns({"extra": extra(F.col("s_ncore"), F.col("q_ncore")), "missing": extra(F.col("q_ncore"), F.col("s_ncore")), "same_number": same})


def decoys(links: DataFrame) -> DataFrame:
    """Adds whether a link has the signature of a neighbouring business: a number moved by a telling step, and a word added."""
    extra = similarity.extra_udf()(F.col("s_ntok"), F.col("ntok"))
    return links.withColumn("_extra", extra).withColumn("decoy", P.decoy(F.col("s_ntok"), F.col("ntok"), F.col("s_anum"), F.col("q_anum"), F.col("_extra"))).drop("_extra")


def remove(links: DataFrame, s1: DataFrame, which: Sequence[str] = RULES, country: str = "France", least_removed: int = 200) -> DataFrame:
    """The links (with_records, and p) that the rules leave. The cap counts what the rules before it have left."""
    out = links
    if "fr_swap" in which:
        out = swap_columns(out)
        vocabulary = rules.swap_vocabulary(out.filter(F.col("country") == country), least_removed)
        out = rules.swap_rule(out, vocabulary, country).drop("extra", "missing", "same_number")
    if "namesake" in which:
        out = rules.namesake_rule(out, s1)
    if "cap" in which:
        out = rules.cap_rule(out)
    if "veto" in which:
        out = rules.veto_rule(decoys(out)).drop("decoy")
    return out


def remove_in_blocks(s1: DataFrame, q: DataFrame, block: Sequence[str], score: Callable, caps: dict[int, int] = L.LINK_CAPS, default: int = 99) -> DataFrame:
    """sid, qid of the links that the rules namesake and cap leave of all pairs of a block, as remove does of these links: records that
    the first rule takes out are no pairs, and of the others only the best of an entity and source are laid out. score: from the idx of
    entities (a column) and of queries (a row) to the matrix of p."""
    left = rules.namesake_rule(q.select("idx", "entity_id", *dict.fromkeys([*block, "country"]), "ntok", "amiss", "src"), s1)
    a, b = s1.select(F.col("idx").alias("s1_idx"), *block), left.select(F.col("idx").alias("q_idx"), *block, F.col("src").cast("int").alias("src"))
    kept = cells.best_pairs(a, b, block, ("s1_idx", "q_idx"), "src", score, caps, default)
    kept = kept.join(s1.select(F.col("idx").alias("s1_idx"), F.col("entity_id").alias("sid")), "s1_idx")
    return kept.join(q.select(F.col("idx").alias("q_idx"), F.col("entity_id").alias("qid")), "q_idx").select("sid", "qid")


def rewrite(spark, source: str, target: str, s1: DataFrame, q: DataFrame, scored: DataFrame, which: Sequence[str] = RULES) -> DataFrame:  # noqa: ANN001
    """Link file to link file; every entity keeps its row. Returns what was written."""
    listed = tables.read_tsv(spark, source, schema.LINKS).withColumnRenamed("source1_entity_id", "sid")
    links = with_records(tables.explode_links(listed, "sid", "matched_entity_ids", "qid"), s1, q)
    links = links.join(scored.select("q_idx", "s1_idx", "p"), ["q_idx", "s1_idx"], "left")
    out = sinks.link_lists(remove(links, s1, which), s1.select(F.col("entity_id").alias("sid")))
    out = out.select(F.col("sid").alias("source1_entity_id"), F.col("ids").alias("matched_entity_ids"))
    sinks.write_tsv(out, target)
    return out
