"""Benchmark decontamination by suffix arrays.

Each shard (an Arrow batch of documents) becomes one array of word numbers, 0 for words that no benchmark item has and between
documents, and the suffixes that begin with a known word are sorted by rank doubling over as many words as the longest item has
(beyond that, or beyond an unknown word, no test suffix can tell them apart). Every test suffix, that is every place of every item,
is binary-searched word by word: the suffixes between its two bounds after d words are all the places in the shard that match it for
d words. From bounds of span_words words (or a whole shorter item) the matches that no longer one holds are followed to their ends
and listed with their places in text and item; so each document's longest match with any item is known, whatever its length. Bounds
of a window give the words that count as hit. Work is in proportion to the shard, the items and what is listed, repetitive texts
included. No text is shuffled and nothing is gathered from the documents.

A benchmark is read in blocks of at most block_words words (an item of more is a block of its own), and only one block is held at a
time; with several blocks each is searched for itself, in one pass over the documents, and hits are joined per document afterwards.
So what a task holds of the benchmark is bounded. A pass costs about a tokenisation of the documents, so up to some tens of blocks
(1e8 benchmark words) this is cheaper than shuffling every document word to a join; beyond, join on hashed windows first.

Words: A-Z lower-cased, then [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+. A window is 13 consecutive words of an item; an item of fewer, but
not none, is one window. Null and empty texts have no words, items without words no window. Repeated rows give repeated rows; with
no benchmark rows nothing is hit; further columns are ignored. An item_id on several benchmark rows is one item; all rows
without item_id are one more, null in item_ids and left out of the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
SPAN_WORDS = 8  # matches from this length on are listed
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

HITS = "n_words long, n_hit long, item_ids array<string>, longest_match long, spans array<struct<begin:long,end:long,item_id:string,item_begin:long>>, hits array<struct<begin:long,end:long>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


@dataclass
class Suffixes:
    """Test suffixes of one block of items: every place of every item, in one array of word numbers with -1 between items."""

    items: list[tuple[str | None, list[bytes]]]
    window: int = WINDOW
    span_words: int = SPAN_WORDS
    number: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.items = [(i, w) for i, w in self.items if w]
        flat: list[int] = []
        for _, words in self.items:
            flat += [self.number.setdefault(w, len(self.number) + 1) for w in words]
            flat.append(-1)
        self.flat = np.array([*flat, -1], np.int64)
        size = np.array([len(w) for _, w in self.items], np.int64)
        self.longest = int(size.max()) if len(size) else 0
        self.depth = int(np.minimum(size, max(self.window, self.span_words)).max()) if len(size) else 0  # words that are searched for
        self.item = np.repeat(np.arange(len(size)), size)
        self.place = np.arange(len(self.item)) - np.repeat(np.cumsum(size) - size, size)
        self.at = self.place + np.repeat(np.cumsum(size + 1) - size - 1, size)  # of each test suffix, in flat
        self.left = size[self.item] - self.place  # words to the item's end
        self.words = np.minimum(self.window, size)  # of an item's windows
        self.need = self.words[self.item]
        self.least = np.minimum(self.span_words, size)[self.item]


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of the known words, sorted by the words that follow, up to `depth` of them or the first unknown one (0)."""
    sa = np.flatnonzero(ids)
    sa = sa[np.argsort(ids[sa], kind="stable")]
    if not len(sa):
        return sa
    rank = np.zeros(len(ids) + depth + 1, np.int64)  # a suffix's first place among those not yet told apart from it, from 1; 0: nothing
    word = ids[sa]
    new = np.concatenate([[True], word[1:] != word[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(sa)), 0))
    rank[sa] = first + 1
    slots = np.flatnonzero(~new | ~np.append(new[1:], True))  # places in sa that share their rank with another
    first, known = first[slots], 1
    while known < depth and len(slots):
        own = sa[slots]
        after = rank[own + known]
        order = np.lexsort((after, first))
        sa[slots] = own = own[order]
        after = after[order]  # first is sorted already
        new = np.ones(len(slots), bool)
        new[1:] = (after[1:] != after[:-1]) | (first[1:] != first[:-1])
        first = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[own] = first + 1
        tied = (~new | ~np.append(new[1:], True)) & (after > 0)  # equal up to an unknown word stays equal
        slots, first, known = slots[tied], first[tied], 2 * known
    return sa


def _bound(words: np.ndarray, sa: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, want: np.ndarray, beyond: bool) -> np.ndarray:
    """Binary search of all test suffixes at once: of the suffixes low to high, sorted by the word at `depth`, the first whose word there
    is not below (or is beyond) the wanted one."""
    low, high = low.copy(), high.copy()
    live = np.arange(len(low))
    while len(live := live[low[live] < high[live]]):
        mid = (low[live] + high[live]) >> 1
        w = words[sa[mid] + depth]
        up = w <= want[live] if beyond else w < want[live]
        low[live[up]] = mid[up] + 1
        high[live[~up]] = mid[~up]
    return low


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place) of all places of the ranges low to high."""
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups of equal keys, and the first member of each."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    new[:1] = True
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _maximal(ids: np.ndarray, sa: np.ndarray, tests: Suffixes, live: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(test suffix, place) of the ranges whose words before differ, so no longer match holds them. Test suffixes of one range and one
    word before are laid out together, so what is not maximal is never paired."""
    before = tests.flat[tests.at[live] - 1]  # -1 at the start of an item
    number, first = _groups(low, before)
    which, at = _spread(low[first], high[first])
    place = sa[at]
    other = np.where(place > 0, ids[place - 1], 0)
    keep = other != before[first][which]
    which, place = which[keep], place[keep]
    member = np.argsort(number, kind="stable")
    start = np.searchsorted(number[member], np.arange(len(first) + 1))
    pair, own = _spread(start[which], start[which + 1])
    return live[member[own]], place[pair]


def search(ids: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """longest: of each word of the shard, how many words from it on match some test suffix (as far as is searched here); ranges of places
    (item, places from and to, in sa) where a window occurs; sa; (test suffix, place) of every maximal match of span length."""
    sa = suffix_array(ids, tests.longest)
    padded = np.concatenate([ids, np.zeros(tests.depth + 1, np.int64)])
    longest = np.zeros(len(ids), np.int64)
    windows, spans = [], []
    live = np.arange(len(tests.item))
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    for depth in range(tests.depth):
        keep = tests.left[live] > depth
        live, low, high = live[keep], low[keep], high[keep]
        want = tests.flat[tests.at[live] + depth]
        low = _bound(padded, sa, low, high, depth, want, False)
        high = _bound(padded, sa, low, high, depth, want, True)
        keep = high > low
        live, low, high = live[keep], low[keep], high[keep]
        if not len(live):
            break
        edge = np.bincount(low, minlength=len(sa) + 1) - np.bincount(high, minlength=len(sa) + 1)
        longest[sa[np.cumsum(edge[:-1]) > 0]] = depth + 1
        if len(now := np.flatnonzero(tests.need[live] == depth + 1)):
            item = tests.item[live[now]]
            _, first = _groups(item, low[now])  # an item's equal windows are one range
            windows.append((item[first], low[now[first]], high[now[first]]))
        if len(now := np.flatnonzero(tests.least[live] == depth + 1)):
            spans.append(_maximal(ids, sa, tests, live[now], low[now], high[now]))
    none = np.zeros(0, np.int64)
    return longest, windows, sa, *(tuple(np.concatenate(x) for x in zip(*spans, strict=True)) if spans else (none, none))


def follow(ids: np.ndarray, tests: Suffixes, test: np.ndarray, place: np.ndarray, steps: int = 64) -> np.ndarray:
    """Words that the given test suffixes and places have in common: word by word at first, then by blocks of powers of two."""
    length = tests.least[test].copy()
    padded = np.append(ids, 0)
    live = np.arange(len(test))
    for _ in range(steps):
        live = live[tests.flat[tests.at[test[live]] + length[live]] == padded[np.minimum(place[live] + length[live], len(ids))]]
        if not len(live):
            return length
        length[live] += 1
    # equal blocks get equal numbers; 0 stands in no item and -1 in no text, so blocks of the two are equal in known words only
    every = np.concatenate([ids, [0], tests.flat])
    blocks = [every]
    while 2 << len(blocks) <= 2 * tests.longest:
        half = 1 << (len(blocks) - 1)
        after = np.concatenate([blocks[-1][half:], np.full(half, -2)])
        blocks.append(np.unique(blocks[-1] * (after.max() + 3) + after, return_inverse=True)[1].ravel())
    for level in range(len(blocks) - 1, -1, -1):
        at = np.minimum(len(ids) + 1 + tests.at[test[live]] + length[live], len(every) - 1)
        same = blocks[level][at] == blocks[level][np.minimum(place[live] + length[live], len(ids))]
        length[live[same]] += 1 << level
    return length


def scan(texts: list[bytes | None], tests: Suffixes) -> list[tuple[int, int, list[str], int, list[tuple[int, int, str | None, int]], list[tuple[int, int]]]]:
    """For each text: words, words hit, items with occurring windows, words of the longest match, maximal matches of span length with their
    places in text and item, and the runs of words that are hit."""
    get, flat, starts = tests.number.get, [], []
    for t in texts:
        starts.append(len(flat))
        flat += [get(w, 0) for w in words_of(t)]
        flat.append(0)
    ids, begin = np.array(flat, np.int64), np.array([*starts, len(flat)], np.int64)
    longest, windows, sa, span, at = search(ids, tests)
    edge = np.zeros(len(ids) + 1, np.int64)
    own: list[np.ndarray] = []  # (document, item) pairs
    for item, low, high in windows:
        which, k = _spread(low, high)
        place, n = sa[k], tests.words[item[which]]
        edge += np.bincount(place, minlength=len(edge)) - np.bincount(place + n, minlength=len(edge))
        own.append(np.unique((np.searchsorted(begin, place, side="right") - 1) * len(tests.items) + item[which]))
    covered = np.concatenate([[False], np.cumsum(edge[:-1]) > 0])
    hit = np.cumsum(covered)
    n_hit = hit[begin[1:]] - hit[begin[:-1]]
    length = follow(ids, tests, span, at)
    np.maximum.at(longest, at, length)
    most = np.maximum.reduceat(longest, begin[:-1]) if len(texts) else longest
    out = [(int(n), int(h), [], int(m), [], []) for n, h, m in zip(np.diff(begin) - 1, n_hit, most, strict=True)]
    turns = np.flatnonzero(np.diff(np.append(covered, False)))  # no run reaches over the end of a text
    for d, a, b in zip((np.searchsorted(begin, turns[::2], side="right") - 1).tolist(), turns[::2].tolist(), turns[1::2].tolist(), strict=True):
        out[d][5].append((a - starts[d], b - starts[d]))
    listed = set()
    for pair in np.unique(np.concatenate(own)).tolist() if own else ():
        d, name = pair // len(tests.items), tests.items[pair % len(tests.items)][0]
        if (d, name) not in listed:
            listed.add((d, name))
            out[d][2].append(name)
    doc = np.searchsorted(begin, at, side="right") - 1
    for d, t, p, n in sorted(zip(doc.tolist(), span.tolist(), at.tolist(), length.tolist(), strict=True)):
        out[d][4].append((p - starts[d], p - starts[d] + n, tests.items[tests.item[t]][0], int(tests.place[t])))
    return out


def blocks_of(benchmark: DataFrame, block_words: int, key: str, text: str) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The query set, read in blocks of bounded size, one at a time."""
    out, size = [], 0
    for r in benchmark.select(F.col(key).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        words = words_of(bytes(r[1]) if r[1] is not None else None)
        if size + len(words) > block_words and out:
            yield out
            out, size = [], 0
        size += len(words)
        out.append((r[0], words))
    yield out


def _matched(docs: DataFrame, benchmark: DataFrame, names: list[str], text: str, item_key: str, block_words: int, span_words: int = SPAN_WORDS) -> DataFrame:
    """The named columns as _c0, _c1, ... (so that no name can clash), and HITS."""
    spark = docs.sparkSession
    # a broadcast block lies on disk, not in the driver's memory
    blocks = [spark.sparkContext.broadcast(b) for b in blocks_of(benchmark, block_words, item_key, "text")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], F.col(text).cast("binary").alias("_text"))
    keep = rows.columns[:-1]
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*keep).schema)
    schema = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("longest_match", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("item_id", pa.string()), ("item_begin", pa.int64())]))), ("hits", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])

    def one(shared, rows: DataFrame, names: list[str], ddl: str) -> DataFrame:  # noqa: ANN001
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = Suffixes(shared.value, span_words=span_words)
            for b in it:
                got = scan(b.column(b.num_columns - 1).to_pylist(), tests)
                spans = [[dict(zip(("begin", "end", "item_id", "item_begin"), s, strict=True)) for s in g[4]] for g in got]
                hits = [[{"begin": x, "end": y} for x, y in g[5]] for g in got]
                columns = [[g[j] for g in got] for j in range(4)] + [spans, hits]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, f.type) for c, f in zip(columns, schema, strict=True))], [*names, *schema.names])

        return rows.mapInArrow(run, ddl + HITS)

    if len(blocks) == 1:
        return one(blocks[0], rows, keep, head)
    from knotwork.llm.common import materialize

    base = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "decontaminate").select(*keep, "_row", "_text")
    parts = [one(b, base, [*keep, "_row"], head + "_row long, ") for b in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    whole = lambda c: F.array_sort(F.flatten(F.collect_list(c))).alias(c)
    merged = every.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("longest_match").alias("longest_match"), whole("spans"), whole("hits"))
    # runs are sorted: words hit are those beyond the furthest end so far
    sweep = F.aggregate("hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["begin"], a["end"]))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")))
    return base.drop("_text").join(merged.withColumn("n_hit", sweep["n"]), "_row").select(*keep, "n_words", "n_hit", "item_ids", "longest_match", "spans", "hits")


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", block_words: int = 2_000_000, key: str = "doc_id", span_words: int = SPAN_WORDS) -> DataFrame:
    """The key with n_words, n_hit, item_ids, longest_match, spans of the maximal verbatim matches of at least span_words words (or of a
    whole shorter item), and hits: the runs of words that windows cover (with several blocks they may overlap)."""
    return _matched(docs, benchmark, [key], text, item_key, block_words, span_words).withColumnRenamed("_c0", key)


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match, and locations: the listed matches as
    begin:end:item_id:begin in the item, by begin, comma-joined."""
    m = matches(docs, benchmark)
    ids = F.array_join(F.array_sort("item_ids"), ",")
    where = F.array_join(F.transform(F.array_sort("spans"), lambda s: F.concat_ws(":", s["begin"], s["end"], F.coalesce(s["item_id"], F.lit("")), s["item_begin"])), ",")
    return m.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated().alias("contaminated"), "longest_match", where.alias("locations"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs, all their columns, that are not contaminated."""
    kept = _matched(docs, benchmark, docs.columns, "text", "item_id", 2_000_000).filter(~contaminated())
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def brute_force(texts: list[str | None], items: list[tuple[str | None, str | None]], window: int = WINDOW, span_words: int = SPAN_WORDS) -> list[tuple[int, int, list[str], int, list[tuple[int, int, str | None, int]]]]:
    """Word by word; for tests."""
    out = []
    for t in texts:
        words = words_of((t or "").encode())
        hit, found, spans, longest = set(), set(), [], 0
        for i, x in items:
            own = words_of((x or "").encode())
            n = min(window, len(own))
            for p in range(len(own)):
                for q in range(len(words)):
                    same = 0
                    while q + same < len(words) and p + same < len(own) and words[q + same] == own[p + same]:
                        same += 1
                    longest = max(longest, same)
                    if n and same >= n:
                        hit |= set(range(q, q + n))
                        found.add(i)
                    if same and same >= min(span_words, len(own)) and not (p and q and own[p - 1] == words[q - 1]):
                        spans.append((q, q + same, i, p))
        out.append((len(words), len(hit), sorted(found, key=lambda i: (i is None, i or "")), longest, sorted(spans, key=str)))
    return out


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
