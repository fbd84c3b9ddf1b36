"""Exact n-gram Jaccard self-join of documents, with set-relation skipping.

1. tokenise: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, a document's set its distinct k-word shingles (hashed to 64 bits). A map
   task packs the sets of a run of documents (a chunk; copies within it once) by token bucket: sorted 40-bit remainders as
   low words under a table of high bytes, with 16-bit document numbers. One shuffle of about six bytes a shingle. What a chunk
   knows of its rows (ids, sizes, signatures) is a group of its own there and meets no other chunk's.
2. count: a bucket's task counts how many chunk members hold each token. Tokens that only one holds can link nothing; the others
   go back to their chunks with a frequency class. Second, smaller shuffle.
3. filter: rarest tokens first, two sets of Jaccard >= t share one of the first n - ceil(t n) + 1. A set whose prefix consists of
   tokens nobody else holds has no partner and ends here; most documents do.
4. candidates: star edges from the least holder of each prefix token; their connected components are closed under links.
5. verify: each component's sets meet in one task and links are decided exactly. A component that is too large for a task is linked in
   parts first; what is not in its heaviest class then meets all parts, in cells of bounded size. Index lists are blocks of postings sorted by position; a block is skipped when its positions leave too few
   tokens for the overlap, its sizes do not fit, or all its sets are linked to the probing set already. A set that is highly similar
   to one answered before derives its overlaps from that set's: bounds by the sizes of the two differences decide most, and only the
   differing tokens are looked up for the rest. Links that cannot change the components are not expanded.

Shingles are told apart by 46 to 60 bits of their hash (40 and those of the bucket): among 5e9 shingles and 49 bits some 20,000 of
them share a token by chance, spread over as many sets, and a link is wrong only where the true overlap is within that one token of
the threshold. Everything after the hash is exact.

Sets without words are empty and linked with nothing; fewer than k words make one shingle of the sequence. Null texts count as
empty. Equal sets always link. Repeated rows and rows without id each keep their row; component_id is the least doc_id of the
component. An empty table gives an empty result; further columns are ignored. No partner or candidate is capped or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import materialize, unused
from knotwork.llm.components import connected_components

_SPLIT = bytes(32 if c in (9, 10, 11, 12, 13, 32) else c + 32 if 65 <= c <= 90 else c for c in range(256))
_P = np.uint64(0x9E3779B97F4A7C15)
CHUNK_TOKENS = 1_500_000
CHUNK_DOCS = 60_000
REST = 40  # bits of a token below its bucket


class _Words(dict):
    """Word to 64-bit hash; forgets when it gets large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, k: int = 5, words: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    # bytes.split() also cuts at nothing else: \x1c-\x1f are no white space to it
    parts = text.translate(_SPLIT).split(b" ") if text else []
    parts = [p for p in parts if p]
    if not parts:
        return np.zeros(0, np.uint64)
    words = _Words() if words is None else words
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * _P + w[j : len(w) - n + 1 + j]
        h = _mix(h)
    return np.unique(h)


def pack(tokens: np.ndarray, owner: np.ndarray) -> bytes:
    """Sorted remainders and their owners: count, counts below each high byte, low words, owners."""
    high = np.searchsorted(tokens >> np.uint64(32), np.arange(257, dtype=np.uint64)).astype("<u4")
    return high.tobytes() + (tokens & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + owner.astype("<u2").tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    high = np.frombuffer(blob, "<u4", 257)
    n = int(high[-1])
    low = np.frombuffer(blob, "<u4", n, 1028).astype(np.uint64)
    return low | np.repeat(np.arange(256, dtype=np.uint64), np.diff(high)) << np.uint64(32), np.frombuffer(blob, "<u2", n, 1028 + 4 * n)


def tokenise(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """bucket, chunk, kind, data: kind 0 lists a chunk's rows (ids, text hashes, set sizes, signatures, the first row of the chunk with
    the same set) under a bucket of its own, kind 1 its tokens of a bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        words = _Words()

        def flush(ids: list, hashes: list, sizes: list, sigs: list, firsts: list, sets: list, owners: list) -> pa.RecordBatch:
            nonlocal chunk
            meta = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(firsts, pa.int64())], ["doc_id", "h", "n", "sig", "first"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, meta.schema) as w:
                w.write_batch(meta)
            rows = [((1 << bits) + chunk, 0, sink.getvalue().to_pybytes())]
            if sets:
                tok = np.concatenate(sets) >> np.uint64(64 - REST - bits)
                own = np.repeat(np.array(owners), [len(s) for s in sets])
                order = np.argsort(tok, kind="stable")
                tok, own = tok[order], own[order]
                bucket = tok >> np.uint64(REST)
                cuts = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=np.uint64)).tolist()
                tok &= np.uint64((1 << REST) - 1)
                rows += [(b, 1, pack(tok[i:j], own[i:j])) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "chunk", "kind", "data"])
            chunk += 1
            return out

        ids, hashes, sizes, sigs, firsts, sets, owners, seen, total = [], [], [], [], [], [], [], {}, 0
        for b in it:
            for doc, text, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingles(text, k, words)
                sig = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if len(s) and sig not in seen:
                    seen[sig] = len(ids)
                    sets.append(s)
                    owners.append(len(ids))
                    total += len(s)
                firsts.append(seen[sig] if len(s) else len(ids))
                ids.append(doc)
                hashes.append(h)
                sizes.append(len(s))
                sigs.append(sig)
                if total >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield flush(ids, hashes, sizes, sigs, firsts, sets, owners)
                    ids, hashes, sizes, sigs, firsts, sets, owners, seen, total = [], [], [], [], [], [], [], {}, 0
        if ids:
            yield flush(ids, hashes, sizes, sigs, firsts, sets, owners)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), F.xxhash64("text")).mapInArrow(run, "bucket long, chunk long, kind int, data binary")


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the tokens that several chunk members hold, with their frequency class, for each chunk; a chunk's own group passes."""
    plain, packed = pdf[pdf.kind == 0], pdf[pdf.kind == 1]
    rows = [(c, 0, d) for c, d in zip(plain.chunk, plain.data, strict=True)]
    if len(packed):
        bucket = np.uint64(int(packed.bucket.iloc[0]))
        got = [unpack(d) for d in packed.data]
        sizes = [len(t) for t, _ in got]
        tok, own = np.concatenate([t for t, _ in got]), np.concatenate([o for _, o in got])
        src = np.repeat(np.arange(len(got), dtype=np.uint32), sizes)
        del got
        order = np.argsort(tok, kind="stable")
        tok = tok[order]
        first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        df = np.diff(np.append(first, len(tok)))
        keep = np.repeat(df > 1, df)
        cls = np.minimum(255, 4 * np.log2(np.repeat(df, df)[keep])).astype(np.uint64)
        order = order[keep]
        # class, bucket, remainder: one number whose order is the global one
        code = cls << np.uint64(56) | (bucket << np.uint64(REST) | tok[keep]) & np.uint64((1 << 56) - 1)
        src, own = src[order], own[order]
        by = np.argsort(src, kind="stable")
        code, own, src = code[by], own[by], src[by]
        cuts = np.searchsorted(src, np.arange(len(sizes) + 1)).tolist()
        for c, i, j in zip(packed.chunk, cuts, cuts[1:], strict=False):
            if j > i:
                rows.append((c, 1, own[i:j].astype("<u2").tobytes() + code[i:j].astype("<u8").tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "kind", "data"])


def prefix_size(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _filter(percent: int):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One chunk: its rows; those whose prefix holds a shared token get their shared tokens in global order."""
        meta = pd.concat([pa.ipc.open_stream(d).read_pandas() for d in pdf[pdf.kind == 0].data])
        ids, n, sig = meta.doc_id.array, meta.n.to_numpy(), meta.sig.tolist()
        own, code = [], []
        for d in pdf[pdf.kind == 1].data:
            m = len(d) // 10
            own.append(np.frombuffer(d, "<u2", m))
            code.append(np.frombuffer(d, "<u8", m, 2 * m))
        tokens: list[bytes | None] = [None] * len(n)
        if own:
            o, c = np.concatenate(own), np.concatenate(code)
            order = np.lexsort((c, o))
            o, c = o[order], c[order]
            cuts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])).tolist() + [len(o)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                k = int(o[i])
                if n[k] - (j - i) < prefix_size(int(n[k]), percent):
                    tokens[k] = c[i:j].tobytes()
        base, first = int(pdf.chunk.iloc[0]) << 16, meta["first"].to_numpy()
        doc, h = pd.array(ids, "Int64"), meta.h.to_numpy()
        # the least of the chunk's copies, by id (rows without one last) and text
        order = np.lexsort((h, doc.fillna(0).to_numpy(np.int64), doc.isna()))
        kinds, at = np.unique(first[order], return_index=True)
        least = order[at][np.searchsorted(kinds, first)]
        return pd.DataFrame({"node": base + np.arange(len(n)), "first": base + first, "doc_id": doc, "h": h, "low": doc[least], "low_h": h[least], "n": n, "sig": sig, "tokens": tokens})

    return run


def _prefix_tokens(percent: int):  # noqa: ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            nodes, toks = [], []
            for node, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                code = np.frombuffer(t, "<i8")
                own = code[: max(0, prefix_size(n, percent) - (n - len(code)))]
                toks.append(own)
                nodes.append(np.full(len(own), node, np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(toks))], ["node", "token"])

    return run


class Links:
    """Decides which sets of a group link, as far as the components need it. Sets come by size, each with its shared tokens in
    global order (rarest first) and n, its whole size; tokens that are not listed are in no other set."""

    BLOCK = 64

    def __init__(self, percent: int, near: int = 90):
        self.percent, self.near = percent, near
        self.sets: list[frozenset[int]] = []
        self.size: list[int] = []
        self.group: list[int] = []
        self.index: dict[int, list[list]] = {}  # token -> blocks: [least position, most position, least size, most size, members, all linked]
        self.answers: list[dict[int, int]] = []  # overlaps computed or derived
        self.computed = self.derived = self.skipped = 0

    def find(self, x: int) -> int:
        while self.group[x] != x:
            self.group[x] = self.group[self.group[x]]
            x = self.group[x]
        return x

    def need(self, a: int, b: int) -> int:
        """Least overlap o of linked sets: 100 o >= percent (a + b - o)."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def add(self, n: int, tokens: list[int]) -> int:
        x, own = len(self.sets), frozenset(tokens)
        self.sets.append(own)
        self.size.append(n)
        self.group.append(x)
        self.answers.append({})
        ahead = n - len(tokens)  # tokens of no other set come first
        prefix = tokens[: max(0, prefix_size(n, self.percent) - ahead)]
        leader, less, more, tried = -1, frozenset(), frozenset(), set()
        for at, token in enumerate(prefix, ahead):
            for block in self.index.get(token, ()):
                low, high, small, large, members, one = block
                if self.percent * n > 100 * large or 100 * n < self.percent * small or 1 + min(n - at - 1, large - low - 1) < self.need(n, small):
                    self.skipped += 1
                    continue
                mine = self.find(x)
                if one and self.find(members[0]) == mine:
                    self.skipped += 1
                    continue
                for y in members:
                    if y in tried or self.find(y) == self.find(x):
                        continue
                    tried.add(y)
                    need, o = self.need(n, self.size[y]), None
                    if leader >= 0 and (known := self.answers[leader].get(y)) is not None:
                        if known - len(less) >= need or known + len(more) < need:
                            link = known - len(less) >= need
                            self.derived += 1
                        else:
                            other = self.sets[y]
                            o = known - len(less & other) + len(more & other)
                            link = o >= need
                            self.derived += 1
                    else:
                        o = len(own & self.sets[y])
                        link = o >= need
                        self.computed += 1
                    if o is not None:
                        self.answers[x][y] = o
                    if link:
                        self.group[self.find(y)] = self.find(x)
                        if leader < 0 and o is not None and 100 * o >= self.near * (n + self.size[y] - o):
                            leader, less, more = y, self.sets[y] - own, own - self.sets[y]
                block[5] = one or all(self.find(y) == self.find(members[0]) for y in members)
        for at, token in enumerate(prefix, ahead):
            blocks = self.index.setdefault(token, [])
            if not blocks or len(blocks[-1][4]) >= self.BLOCK:
                blocks.append([at, at, n, n, [x], True])
            else:
                b = blocks[-1]
                b[0], b[1], b[2], b[3] = min(b[0], at), max(b[1], at), min(b[2], n), max(b[3], n)
                b[5] = b[5] and self.find(b[4][0]) == self.find(x)
                b[4].append(x)
        return x


def link_group(rows: list[tuple[int, int, bytes]], percent: int) -> dict[int, int]:
    """rows: node, size, packed tokens. Node to the least node linked with it, directly or through others of the rows."""
    links, nodes, copies = Links(percent), [], {}
    same: dict[int, int] = {}
    for node, n, t in sorted(rows, key=lambda r: (r[1], r[0])):
        x = copies.get((n, t))
        if x is None:
            x = copies[n, t] = links.add(n, np.frombuffer(t, "<u8").tolist())
            nodes.append(node)
        # equal lists of shared tokens are equal sets only if no token is theirs alone
        elif len(t) // 8 < n:
            x = links.add(n, np.frombuffer(t, "<u8").tolist())
            nodes.append(node)
        same[node] = x
    least: dict[int, int] = {}
    for node, x in same.items():
        g = links.find(x)
        least[g] = min(node, least.get(g, node))
    return {node: least[links.find(x)] for node, x in same.items()}


def _verify(percent: int):  # noqa: ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, so only one group is held at a time."""
        group, rows = None, []

        def done() -> pa.RecordBatch:
            got = link_group(rows, percent)
            return pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], ["node", "root"])

        for b in it:
            for g, node, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != group:
                    if len(rows) > 1:
                        yield done()
                    group, rows = g, []
                rows.append((node, n, t))
        if len(rows) > 1:
            yield done()

    return run


def _large_groups(rows: DataFrame, verified: Callable[[DataFrame, str], DataFrame], block: int) -> DataFrame:
    """node, root of the links in groups that are larger than a task should hold. rows: root, node, own (tokens).

    A group is dealt in parts, each part linked within itself, and one set of each class so found meets those of the other parts. Mostly
    a group is one class of near copies then, and few sets are in none or another. Sets of the heaviest class need not meet each
    other any more: they stay in their parts, and only the other sets are laid out for all of those, and for each other.
    """
    dealt = lambda key, parts: F.pmod(F.xxhash64(key), parts).cast("int")
    many = lambda weight: F.greatest(F.lit(1), F.ceil(weight / block)).cast("int")

    def step(members: DataFrame, name: str) -> DataFrame:
        """root, node, own, with the class that the node's part puts it in."""
        sums = members.groupBy("root").agg(many(F.sum("own")).alias("parts"))
        cells = members.join(sums, "root").select(F.xxhash64("root", dealt("node", F.col("parts"))).alias("g"), "node")
        got = verified(cells, name).select("node", F.col("root").alias("to"))
        return members.join(got, "node", "left").withColumn("to", F.coalesce("to", "node"))

    one = materialize(step(rows, "parts"), "classes")
    two = step(one.filter("node = to").select("root", "node", "own"), "heads").select(F.col("node").alias("to"), F.col("to").alias("class"))
    classed = materialize(one.join(two, "to"), "classes")
    main = classed.groupBy("root", "class").agg(F.sum("own").alias("w")).groupBy("root").agg(F.max_by("class", F.struct("w", "class")).alias("main"), F.max("w").alias("w_main"), (F.sum("w") - F.max("w")).alias("w_rest"))
    told = classed.join(main.filter("w_rest > 0").select("root", "main", many(F.col("w_main")).alias("p_main"), many(F.col("w_rest")).alias("p_rest")), "root")
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    none, own = F.lit(0), dealt("node", F.col("p_rest"))
    home = F.array(cell("main", dealt("node", F.col("p_main")), none))
    abroad = F.transform(F.sequence(none, F.col("p_main") - 1), lambda o: cell("main", o, none))
    among = F.transform(F.sequence(none, F.col("p_rest") - 1), lambda o: cell("rest", F.least(o, own), F.greatest(o, own)))
    cells = told.withColumn("cell", F.explode(F.when(F.col("class") == F.col("main"), home).otherwise(F.concat(abroad, among))))
    last = verified(cells.select(F.xxhash64("root", "cell.kind", "cell.x", "cell.y").alias("g"), "node"), "cells")
    edges = one.select(F.col("node").alias("u"), F.col("to").alias("v")).union(two.select("to", "class")).union(last.select("node", "root"))
    merged = connected_components(edges)
    return one.select("node").join(merged, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _classed(docs: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """doc_id, h (hash of the text), n, component_id, and the least row (low, low_h) of the component, of every row of docs."""
    spark: SparkSession = docs.sparkSession
    bits = max(6, min(20, math.ceil(math.log2(2 * max(1, docs.rdd.getNumPartitions())))))
    counted = tokenise(docs, k, bits).groupBy("bucket").applyInPandas(_count, "chunk long, kind int, data binary")
    sets = materialize(counted.groupBy("chunk").applyInPandas(_filter(percent), "node long, first long, doc_id long, h long, low long, low_h long, n long, sig binary, tokens binary"), "sets")

    live = sets.filter("tokens is not null").select("node", "n", "tokens")
    postings = live.mapInArrow(_prefix_tokens(percent), "node long, token long")
    least = postings.groupBy("token").agg(F.min("node").alias("least"), F.count("*").alias("holders")).filter("holders > 1").select("token", "least")
    star = postings.join(least, "token").filter("node > least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    near = materialize(connected_components(star), "candidates")

    light = live.select("node", (F.octet_length("tokens") / 8).alias("own"))  # token lists are joined once, after their groups are weighed
    sizes = near.join(light, "node").groupBy("root").agg(F.sum("own").alias("weight"))
    large = sizes.filter(F.col("weight") > 2 * block)

    def verified(cells: DataFrame, name: str) -> DataFrame:
        """node, root of the links within each cell. cells: g, node."""
        laid = cells.join(live, "node").select("g", "node", "n", "tokens")
        return materialize(laid.repartition("g").sortWithinPartitions("g").mapInArrow(_verify(percent), "node long, root long"), name)

    if not large.limit(1).count():
        found = verified(near.select(F.xxhash64("root").alias("g"), "node"), "links")
    else:
        found = verified(near.join(large, "root", "left_anti").select(F.xxhash64("root").alias("g"), "node"), "links")
        found = found.unionByName(_large_groups(materialize(near.join(large.select("root"), "root").join(light, "node"), "large"), verified, block))

    # one row a chunk stands for all its copies of a set, so copies of any number meet as few rows
    firsts = sets.filter("sig is not null and node = first").select("node", "sig", F.struct(F.col("low").isNull().alias("none"), "low", "low_h").alias("low"))
    classes = firsts.groupBy("sig").agg(F.min("low").alias("rep"))
    by_sig = found.join(firsts.select("node", "sig"), "node").select("sig", "root").distinct()
    roots = by_sig.join(classes, "sig").groupBy("root").agg(F.min("rep").alias("comp"))
    joined = by_sig.join(roots, "root").groupBy("sig").agg(F.min("comp").alias("comp"))
    label = classes.join(joined, "sig", "left").select("sig", F.coalesce("comp", "rep").alias("least"))
    by_first = firsts.join(label, "sig").select(F.col("node").alias("first"), "least")
    return sets.select("doc_id", "h", "n", "first").join(by_first, "first", "left").select("doc_id", "h", "n", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.low")).alias("component_id"), F.col("least.low").alias("low"), F.col("least.low_h").alias("low_h"))


def components(docs: DataFrame, k: int = 5, percent: int = 75, block: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text). block: about how many tokens each of the two sides
    that meet in a task has, if a group is larger than both."""
    return _classed(docs, k, percent, block).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 75, block: int = 1_000_000) -> DataFrame:
    """One row of docs, all its columns, of each component: the least by doc_id (rows without id last), then by a hash of the text.

    Decided by id and text together, so rows that share an id but not a text have each their own answer. Of several rows with the id
    and text that stay, the one of the least hash of all columns does. Rows without words are linked with nothing and stay.
    """
    rows = materialize(_classed(docs, k, percent, block).filter("n > 0"), "near")
    of_id, of_text, n, row = unused(docs.columns, "_id", "_text", "_n", "_row")  # docs may have columns of any name
    own = [F.col("doc_id").alias(of_id), F.col("h").alias(of_text)]
    key = F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("h") == F.col("low_h"))
    gone = rows.filter(~key).select(*own).distinct()
    h = F.xxhash64("text")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(of_id)) & (h == F.col(of_text))
    kept = docs.join(gone, match, "left_anti")
    again = rows.filter(key).groupBy(*own).agg(F.count("*").alias(n)).filter(F.col(n) > 1).drop(n)
    if not again.limit(1).count():
        return kept.select(*docs.columns)
    # combined before the shuffle, so any number of equal rows is one row a task
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.join(again, match, "left_semi").groupBy(F.col("doc_id").alias(of_id), h.alias(of_text)).agg(F.min_by(every, F.xxhash64(F.to_json(every))).alias(row))
    return kept.join(again, match, "left_anti").select(*docs.columns).unionByName(once.select(f"{row}.*"))


def brute_force(rows: list[tuple[int, str | None]], k: int = 5, percent: int = 75) -> list[tuple[int, int, int]]:
    """All pairs; for tests."""
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {g: min(r[0] for r, x in zip(rows, group, strict=True) if x == g) for g in set(group)}
    return [(r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group, strict=True)]
