"""What the training-data operators share: shared-folder tables, deterministic bounded samples, table reading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Texts reach 100 kB and more, so batches stay small enough for a Python worker of a few hundred MB.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20
#: Labels that a classifier can have; their counts are gathered and broadcast, so a table with more is refused.
MOST_LABELS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine (local master) may go without."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + os.path.join(tempfile.gettempdir(), "knotwork-shared")
    return got.rstrip("/")


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/knotwork/{name}-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def discard(spark: SparkSession, path: str | None) -> None:
    """Deletes a folder that nothing reads any more."""
    if path:
        fs, p = _path(spark, path)
        fs.delete(p, True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts lineage: df written as Parquet below the shared folder and read back, so a lost executor costs no recomputation; and its path."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The table alone, for results that read it until the application ends."""
    return written(df, name)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    """_label, _n: one row a label, MOST_LABELS at most (more are an error), so it may be broadcast."""
    got = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n")).limit(MOST_LABELS + 1)
    kind = rows.schema[label].dataType.simpleString()
    found = got.collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} different values of {label}")
    return rows.sparkSession.createDataFrame([tuple(r) for r in found], f"_label {kind}, _n long")


def sample(docs: DataFrame, rows: DataFrame, per_class: int, label: str, most_bytes: int, seed: int = 7) -> DataFrame:
    """doc_id, text, label: a sample of docs that depends on neither order nor partitions.

    rows: doc_id, label. At most per_class ids of each label are taken, those of the lowest hash, as long as their texts together stay
    within most_bytes a label (a text that would pass it is left out whole). An id met there with two labels is not taken; of an
    id's different texts the one of least hash is. Counts by label tell under which hash about twice as many rows lie; only those leave
    the scan, so no task gets a whole label, and ids of about twice the sample, which the driver ranks, are all that is gathered.
    """
    spark = docs.sparkSession
    kind = rows.schema[label].dataType.simpleString()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30))
    low = place < (1 << 30) * ((2.0 * per_class + 200) / F.col("_n"))
    few = rows.join(F.broadcast(label_counts(rows, label)), F.col(label) == F.col("_label")).filter(low)
    few = few.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("_other")).filter(F.col(label) == F.col("_other"))
    ids, taken_of = [], {}
    for r in sorted(few.select("doc_id", label, place.alias("_place")).collect(), key=lambda r: (r["_place"], r["doc_id"])):
        taken_of[r[label]] = n = taken_of.get(r[label], 0) + 1
        if n <= per_class:
            ids.append((r["doc_id"], r[label], n))
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    # a bounded list of ids, so a broadcast
    one = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(ids, f"doc_id {id_kind}, {label} {kind}, _r int")), "doc_id")
    sizes = one.groupBy("doc_id").agg(F.first(label).alias(label), F.first("_r").alias("_r"), F.min_by(F.octet_length("text"), F.xxhash64("text")).alias("_size"), F.min(F.xxhash64("text")).alias("_hash"))
    taken, spent = [], {}
    for r in sorted(sizes.collect(), key=lambda r: r["_r"]):
        size = spent.get(r[label], 0) + (r["_size"] or 0)
        if size <= most_bytes:
            spent[r[label]] = size
            taken.append((r["doc_id"], r[label], r["_hash"]))
    side = spark.createDataFrame(taken, f"doc_id {id_kind}, {label} {kind}, _hash long")
    got = docs.select("doc_id", "text").join(F.broadcast(side), "doc_id").filter(F.xxhash64("text") == F.col("_hash"))
    return got.groupBy("doc_id").agg(F.first("text").alias("text"), F.first(label).alias(label))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column has it."""
    out = []
    for n in names:
        while n.lower() in {c.lower() for c in columns}:
            n += "_"
        out.append(n)
    return out


def batches(it: Iterator, size: int) -> Iterator[list]:
    out: list = []
    for x in it:
        out.append(x)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out
