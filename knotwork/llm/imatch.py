"""I-Match fingerprints over randomised lexicon subsets, in DataFrame functions only.

Terms: lower-cased runs of letters and digits, by 64-bit hash. The lexicon keeps the terms whose document frequency lies in
[LEAST_SHARE, MOST_SHARE] of all documents, a band of inverse document frequency; as a document adds one for each of its distinct
terms, it holds at most (mean distinct terms) / LEAST_SHARE terms, whatever the corpus size, and is a constant of the plan.
A document's distinct lexicon terms are sorted; besides the whole lexicon, subset (level l, seed s) keeps each of its terms with chance 2^-l, by bits of the
term's hash, and the terms of the document in it, in order, are hashed to 32 bits. Small subsets survive large edits of long
texts, large ones tell short texts apart. A document without lexicon terms takes all its terms instead.

Fingerprint: one hash a subset, `-` where the document has none of its terms. Likeness: subsets of equal hash over those that
either document has terms in; 1 for two documents without any. Equal texts have equal fingerprints.

Null texts count as empty; texts without terms have dashes only. Null ids come last in descending order; repeated rows are each
other's neighbours. One row is its own next. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SHARE, MOST_SHARE = 0.001, 0.1
LEVELS, FAMILIES, SEEDS = 11, 2, 5  # seeds a family: LEVELS bits each of a 64-bit hash


def terms(text: Column) -> Column:
    """Distinct term hashes."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame) -> list[int]:
    """The terms in the band, a bounded number. Frequencies come from all documents, combined before the shuffle."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = df.filter((F.col("df") >= max(2.0, LEAST_SHARE * n)) & (F.col("df") <= max(2.0, MOST_SHARE * n)))
    return sorted(r["t"] for r in band.select("t").toLocalIterator())


def cuckoo(keys: list[int]) -> list[int]:
    """A table in which each key lies at one of its two places; 0 where no key does (0 itself counts as absent)."""
    size = 1 << max(4, (5 * len(keys) // 2).bit_length())
    while True:
        table, fits = [0] * size, True
        for key in keys:
            at = key & (size - 1)
            for _ in range(500):
                key, table[at] = table[at], key
                if not key:
                    break
                one, two = key & (size - 1), key >> 24 & (size - 1)
                at = two if at == one else one
            fits = fits and not key
        if fits:
            return table
        size *= 2


def member(table: list[int], t: Column) -> Column:
    """Whether the table holds t: two looks at a constant array (one text literal, parsed when the plan is made)."""
    array = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    look = lambda at: F.get(array, at.bitwiseAND(F.lit(len(table) - 1)).cast("int")) == t
    return look(t) | look(F.shiftright(t, 24))


def with_hashes(rows: DataFrame, text: str, out: str, table: list[int]) -> DataFrame:
    """Adds an array of one hash a subset, null where the text has no term in it."""
    rows = rows.withColumn("_all", terms(F.col(text)))
    rows = rows.withColumn("_in", F.filter("_all", lambda t: member(table, t)))
    rows = rows.withColumn("_in", F.sort_array(F.when(F.size("_in") > 0, F.col("_in")).otherwise(F.col("_all"))))
    empty = F.array().cast("array<bigint>")
    value = lambda own: F.nullif(F.hash(own), F.hash(empty))
    hashes = F.array(value(F.col("_in")))
    for family in range(FAMILIES):
        bits = F.transform("_in", lambda t: F.xxhash64(t, F.lit(family))) if family else F.col("_in")  # noqa: B023
        for seed in range(SEEDS):
            # each level halves the one before it
            halve = lambda own, bit: F.array_append(own, F.filter(F.element_at(own, -1), lambda t: F.getbit(t, bit) == 0))
            nested = F.aggregate(F.sequence(F.lit(seed * LEVELS), F.lit((seed + 1) * LEVELS - 1)), F.array(bits), halve)
            hashes = F.concat(hashes, F.transform(F.slice(nested, 2, LEVELS), value))
    return rows.withColumn(out, hashes).drop("_all", "_in")


def likeness(a: str, b: str) -> Column:
    both = F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))
    same = F.size(F.filter(both, lambda x: x["a"] == x["b"]))
    some = F.size(F.filter(both, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    return F.when(some == 0, 1.0).otherwise(same / some)


def fingerprint(hashes: str) -> Column:
    return F.array_join(hashes, " ", "-")


def id_bounds(docs: DataFrame, rows_a_part: int = 500, most: int = 20_000) -> list[int]:
    """Ids that cut the table into parts of about equal size, rising to the greatest; a bounded number, from one pass over the ids."""
    n = docs.count()
    parts = max(1, min(most, n // rows_a_part))
    got = docs.agg(F.percentile_approx("doc_id", [(i + 1) / parts for i in range(parts)], max(10_000, 20 * parts)).alias("b"), F.max("doc_id").alias("top")).first()
    return sorted({*(got["b"] or ()), got["top"] if got["top"] is not None else -(1 << 63)})


def below(bounds: list[int], value: Column) -> Column:
    """How many bounds are less than the value, by binary search."""
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << s for s in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(array, at + s - 1) < value, at + s).otherwise(at))


def with_next(rows: DataFrame, bounds: list[int], columns: list[str]) -> DataFrame:
    """Adds next_<c> of the row that follows by descending doc_id, the first one's for the last.

    Rows are dealt by id ranges; each range's greatest id is an id of the table, and its rows are also laid at the end of the range
    above (the greatest of all: of the lowest), so the next row is always at hand and no range is joined to another.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    part = below(bounds, F.col("_key"))
    top = F.get(F.array(*[F.lit(b).cast("long") for b in bounds]), F.col("_part"))
    places = F.when(F.col("_key") == top, F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("guest")), F.struct(F.pmod(F.col("_part") + 1, F.lit(len(bounds))).alias("p"), F.lit(1).alias("guest"))))
    laid = rows.withColumn("_key", key).withColumn("_part", part)
    laid = laid.withColumn("_at", F.explode(places.otherwise(F.array(F.struct(F.col("_part").alias("p"), F.lit(0).alias("guest"))))))
    laid = laid.select(*rows.columns, "_key", F.col("_at.p").alias("_p"), F.col("_at.guest").alias("_guest"), F.xxhash64("text").alias("_tie"))
    w = Window.partitionBy("_p").orderBy("_guest", F.col("_key").desc(), "_tie")  # one sort, and one exchange, for all columns
    return laid.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).filter("_guest = 0").drop("_key", "_p", "_guest", "_tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = cuckoo(lexicon(rows))
    rows = with_next(with_hashes(rows, "text", "own", table), id_bounds(docs), ["text", "own"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_hashes(rows.drop("text", "next_text"), "edited", "new", table)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("own").alias("fingerprint"), fingerprint("new").alias("edited_fingerprint"), likeness("own", "new").alias("near_edited"), likeness("own", "next_own").alias("near_next"))
