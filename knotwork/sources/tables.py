"""Readers: unquoted TSV, record splits, truth and link files, vectors, JSON dictionaries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork import schema


def read_tsv(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """Tab-separated with a header, quotes literal, every column as declared (all strings); empty fields are null."""
    return spark.read.schema(kind).csv(path, sep="\t", header=True, quote="", escape="", mode="PERMISSIVE")


def with_index(df: DataFrame, *order: str, start: int = 0, rows_a_part: int = 200_000) -> DataFrame:
    """Adds a dense idx in the given total order without moving all rows to one task: a row's place within its range, plus the counts of
    the ranges before. Ranges are cut at a bounded number of keys (those of least hash). The order must be total, or ties may change
    places between runs."""
    key = F.struct(*order)
    few = min(10_000, df.count() // rows_a_part)
    cuts = sorted(tuple(r) for r in df.select(*order).orderBy(F.xxhash64(*order), *order).limit(few).collect()) if few else []
    kind = ", ".join(f"{c}: {df.schema[c].dataType.simpleString()}" for c in order)
    bounds = F.from_json(F.lit(json.dumps([dict(zip(order, c, strict=True)) for c in cuts])), f"array<struct<{kind}>>")
    steps = [1 << s for s in range(len(cuts).bit_length() - 1, -1, -1)]
    # how many cuts are not above the key, by binary search in the constant array
    part = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= key, at + s).otherwise(at)) if cuts else F.lit(0)
    rows = df.withColumn("_part", part)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a range
    placed = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(before), "_part")
    return placed.withColumn("idx", F.col("_before") + F.col("_r") + (start - 1)).drop("_part", "_r", "_before")


def load_split(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Entities (source 1) and queries (sources 2 and 3), keyed by idx in the order of source and id; no country is `UNK`."""

    def one(n: int) -> DataFrame:
        raw = read_tsv(spark, f"{folder}/{split}_source{n}.tsv", schema.RAW)
        return raw.withColumn("country", F.coalesce("country", F.lit("UNK"))).withColumn("src", F.lit(n))

    return with_index(one(1), "entity_id"), with_index(one(2).unionByName(one(3)), "src", "entity_id")


def explode_links(links: DataFrame, key: str, listed: str, item: str) -> DataFrame:
    """One row a listed id: comma lists, empty ones and empty items gone."""
    return links.select(F.col(key), F.explode(F.split(F.coalesce(F.col(listed), F.lit("")), ",")).alias(item)).filter(F.col(item) != "")


def resolve_pairs(pairs: DataFrame, s1: DataFrame, q: DataFrame) -> DataFrame:
    """(sid, qid) to (q_idx, s1_idx); ids that no record has are dropped."""
    a = s1.select(F.col("entity_id").alias("sid"), F.col("idx").alias("s1_idx"))
    b = q.select(F.col("entity_id").alias("qid"), F.col("idx").alias("q_idx"))
    return pairs.join(a, "sid").join(b, "qid").select("q_idx", "s1_idx")


def read_truth(spark: SparkSession, path: str, s1: DataFrame, q: DataFrame) -> DataFrame:
    pairs = explode_links(read_tsv(spark, path, schema.TRUTH).withColumnRenamed("source1_entity_id", "sid"), "sid", "matched_entity_ids", "qid")
    return resolve_pairs(pairs, s1, q)


def read_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """kind, native, latin of a file {kind: {native: latin}}, a JSON object of objects."""
    whole = spark.read.schema("value string").text(path, wholetext=True)
    kinds = whole.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("kind", "words"))
    return kinds.select("kind", F.explode("words").alias("native", "latin"))
