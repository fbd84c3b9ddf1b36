"""K-d tree sharding: shards of near equal bytes whose documents are alike in their metadata.

A node with k shards to make is split at the weighted median (weights: bytes; share: half its shards, rounded down) along its
widest dimension, until every leaf is one shard. Dimensions are whole numbers of DIM_BITS bits on fixed scales: log length, bytes a
character, language and source (places given by hashes). Documents of equal place along the split are told apart by a hash of text
and id, so copies are next to each other, and equal rows by their place in the table, so a group of any size can be cut.

Medians are found in digits, for all nodes of a level at once: bytes are summed by node and digit (at most MOST_SUMS a node, combined
before the shuffle), and a running sum over a node's digits names the one that holds the median; rows at that digit go on to the next.
The first pass of a level sums along every dimension and so gives the widest one too; where a node has no more than MOST_SUMS rows
left, one more pass tells them all apart. Only a few rows a node reach the driver. The rows that are scanned hold ids and numbers, never
texts.

Slots are dealt by counts: shard and hash bucket give an offset, the row number within a bucket the rest, so that no task
sorts a whole shard. Null texts weigh 16 bytes; null ids, repeated rows and ties are ordered by hashes (which of several equal rows goes
to which shard is open, how many do is not); an empty table gives an empty result; other columns are used if they are there (lang,
source) and never returned.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import materialize

DIM_BITS, DIGIT_BITS, HASH_DIGITS, EQUAL_DIGITS = 12, 12, 3, 3
MOST_SUMS = 1 << DIGIT_BITS
DIMS = ("d_length", "d_width", "d_lang", "d_source")
FIXED = 16


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes plus a fixed charge for each document."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + FIXED


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions, and tie and equal: the order among rows of equal place, and among equal rows."""
    top = (1 << DIM_BITS) - 1
    scale = lambda c, most: F.least(F.lit(top), F.greatest(F.lit(0), F.floor(c / most * top))).cast("int")
    place = lambda name: (F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit(""))), F.lit(top + 1)) if name in docs.columns else F.lit(0)).cast("int")
    chars = F.coalesce(F.length("text"), F.lit(0))
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return docs.select(
        "doc_id",
        size_of().alias("size"),
        crc.alias("text_crc32"),
        scale(F.log2(chars + 1.0), 32.0).alias("d_length"),
        scale((size_of() - FIXED) / F.greatest(chars, F.lit(1)) - 1, 3.0).alias("d_width"),
        place("lang").alias("d_lang"),
        place("source").alias("d_source"),
        # a digit of the text's hash, then two of text and id: copies are neighbours
        (F.shiftleft(F.pmod(F.xxhash64(crc), F.lit(1 << DIGIT_BITS)), DIGIT_BITS * (HASH_DIGITS - 1)) + F.pmod(F.xxhash64("doc_id", crc), F.lit(1 << (DIGIT_BITS * (HASH_DIGITS - 1))))).alias("tie"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << (DIGIT_BITS * EQUAL_DIGITS))).alias("equal"),
    )


def _at(values: list[int | None], node: Column, kind: str = "long") -> Column:
    """values[node], as one constant array (a single literal, folded when the plan is made); null past its end."""
    return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), node)


def _key(axis: list[int | None], node: Column) -> Column:
    """Place along the node's dimension, then tie."""
    return F.shiftleft(F.get(F.array(*[F.col(d).cast("long") for d in DIMS]), _at(axis, node, "int")), DIGIT_BITS * HASH_DIGITS) + F.col("tie")


def _prefix(key: Column, equal: Column, known: int) -> tuple[Column, Column]:
    """What is left of a row's place when only the first `known` digits after its dimension count: of the hashes, then of equal rows."""
    digits = HASH_DIGITS + EQUAL_DIGITS - known
    return F.shiftright(key, DIGIT_BITS * max(0, digits - EQUAL_DIGITS)), F.shiftright(equal, DIGIT_BITS * min(EQUAL_DIGITS, digits))


def _node(axis: list[int | None], cut: list[int | None], equal: list[int | None], depth: int) -> Column:
    """The node that a row has come to, walking down from node 1: children of n are 2 n and 2 n + 1."""

    def down(node: Column, _: Column) -> Column:
        key, at = _key(axis, node), _at(cut, node)
        beyond = (key > at) | ((key == at) & (F.col("equal") >= _at(equal, node)))
        return F.when(at.isNull(), node).otherwise(2 * node + beyond.cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), down) if depth else F.lit(1)


def _passing(sums: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the first digit whose running sum of bytes passes the goal: digit, upto and bytes (sums up to and at it), n (its
    rows), goal, least and most digit. sums: node, digit, bytes, n, goal."""
    run = sums.withColumn("upto", F.sum("bytes").over(Window.partitionBy(*by).orderBy("digit")))
    first = F.min_by(F.struct("digit", "upto", "bytes", "n", "goal"), F.when(F.col("upto") > F.col("goal"), F.col("digit")))
    return run.groupBy(*by).agg(first.alias("x"), F.min("digit").alias("least"), F.max("digit").alias("most")).select(*by, "x.*", "least", "most")


def shard_column(rows: DataFrame, shards: int) -> Column:
    """The shard number over the measured columns. Reads rows two or more times a level; gets a few numbers a node each time."""
    todo = {1: (0, shards)}  # node: first shard, number of shards
    leaf: list[int | None] = [None, 0 if shards == 1 else None]
    axis: list[int | None] = [None, None]
    cut: list[int | None] = [None, None]
    equal: list[int | None] = [None, None]
    depth, weigh = 0, (F.sum("size").alias("bytes"), F.count("*").alias("n"))
    while todo := {n: v for n, v in todo.items() if v[1] > 1}:
        size = 2 << (depth + 1)
        for x in (axis, cut, equal, leaf):
            x += [None] * (size - len(x))
        of = lambda d: [d.get(n) for n in range(size)]  # noqa: E731, B023
        at = rows.withColumn("node", _node(axis, cut, equal, depth))
        parts = of({n: k for n, (_, k) in todo.items()})
        at = at.filter(_at(parts, F.col("node")).isNotNull())
        # every dimension at once: sums by digit, from which follow the widest dimension and the median's digit along it
        sums = at.select("node", "size", F.posexplode(F.array(*DIMS)).alias("dim", "digit")).groupBy("node", "dim", "digit").agg(*weigh)
        total = F.sum("bytes").over(Window.partitionBy("node", "dim"))
        sums = sums.withColumn("k", _at(parts, F.col("node"))).withColumn("total", total).withColumn("goal", F.expr("total * (k div 2) div k"))
        goal, found, among = {}, {}, {}
        wide: dict[int, int] = {}
        for r in sorted(_passing(sums, ["node", "dim"]).collect()):
            n = r["node"]
            if r["most"] - r["least"] > wide.get(n, -1):
                wide[n], axis[n] = r["most"] - r["least"], r["dim"]
                found[n], among[n], goal[n] = (r["digit"], 0), r["n"], r["goal"] - r["upto"] + r["bytes"]
        node, known = F.col("node"), 0
        key = _key(axis, node)
        while goal and known < HASH_DIGITS + EQUAL_DIGITS:
            a, b = _prefix(key, F.col("equal"), known)
            part = at.filter((a == _at(of({n: f[0] for n, f in found.items()}), node)) & (b == _at(of({n: f[1] for n, f in found.items()}), node)))
            known = known + 1 if max(among.values()) > MOST_SUMS else HASH_DIGITS + EQUAL_DIGITS
            digit = F.struct(*_prefix(key, F.col("equal"), known)).alias("digit")
            for r in _passing(part.groupBy("node", digit).agg(*weigh).withColumn("goal", _at(of(goal), node)), ["node"]).collect():
                found[r["node"]], among[r["node"]] = tuple(r["digit"]), r["n"]
                goal[r["node"]] -= r["upto"] - r["bytes"]
        down = {}
        for n, (first, k) in todo.items():
            if n not in found:  # no rows here: the node's shards stay empty
                leaf[n] = first
                continue
            cut[n], equal[n] = found[n]
            down |= {2 * n: (first, k // 2), 2 * n + 1: (first + k // 2, k - k // 2)}
        for m, (first, k) in down.items():
            if k == 1:
                leaf[m] = first
        todo, depth = down, depth + 1
    return _at(leaf, _node(axis, cut, equal, depth), "int")


def shard(docs: DataFrame, shards: int = 40, rows_a_bucket: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `bytes`, not `key`)."""
    rows = materialize(measured(docs), "kd-rows")
    dealt = rows.select("doc_id", "size", "text_crc32", "equal", shard_column(rows, shards).alias("shard"))
    buckets = max(1, -(-rows.count() // (shards * rows_a_bucket)))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "equal"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "equal"))
    placed = dealt.withColumn("r", within).join(before, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("r") - 1).cast("int").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Writes the rows of docs (with unique ids) to one folder a shard."""
    placed = shard(docs, shards).select("doc_id", "shard", "slot")
    docs.join(placed, "doc_id").repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
