"""Quality: a byte-level convolutional network in numpy.

Every byte of a text has a learned vector; learned filters of WIDTH bytes, moved by STRIDE, run over the whole text and are
max-pooled over chunks of CHUNK blocks of BLOCK steps that overlap by one block. A text is then described by each filter's greatest,
mean and least chunk value (the least tells repetition: a chunk in which little happens), its log length, and one hidden layer makes
a probability of that. Trained end to end by Adam on the logistic loss: as pooling passes gradients only to the steps that won,
a step back costs little more than the steps it touches.

Fitted on at most per_class labelled texts of each class (lowest id hash), whole texts, of class_bytes bytes together at most, sent to
the driver as bytes; an id labelled both ways is left out. Scoring is one map. Memory is bounded: long texts are convolved in slabs. Null and empty texts are one blank. Without labels every score is 0.5.
Rows come out as often as they go in; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.boosting import sigmoid
from knotwork.llm.common import id_crc, sample

WIDTH, STRIDE, BLOCK, CHUNK, DIM, FILTERS, HIDDEN = 8, 2, 32, 8, 8, 24, 16
SLAB = 1 << 15  # steps convolved at once, a multiple of BLOCK


@dataclass
class Net:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mean: np.ndarray  # of the description, fixed after the first pass
    scale: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.w1, self.b1, self.w2, self.b2]


def start(seed: int) -> Net:
    rng = np.random.default_rng(seed)
    f = lambda *shape, by=1.0: (rng.standard_normal(shape) * by).astype(np.float32)
    width = 3 * FILTERS + 1
    return Net(f(256, DIM, by=0.5), f(WIDTH * DIM, FILTERS, by=(WIDTH * DIM) ** -0.5), np.zeros(FILTERS, np.float32), f(width, HIDDEN, by=width**-0.5), np.zeros(HIDDEN, np.float32), f(HIDDEN, by=0.1), np.zeros(1, np.float32), np.zeros(width, np.float32), np.ones(width, np.float32))


def windows(data: np.ndarray, first: int, last: int) -> np.ndarray:
    """Byte indices of the steps' windows."""
    return (np.arange(first, last) * STRIDE)[:, None] + np.arange(WIDTH)


def bytes_of(text: bytes | None) -> np.ndarray:
    data = np.frombuffer(text or b" ", np.uint8)
    short = WIDTH - len(data)
    if short > 0:
        data = np.concatenate([data, np.full(short, 32, np.uint8)])
    odd = (len(data) - WIDTH) % STRIDE
    return np.concatenate([data, np.full(STRIDE - odd, 32, np.uint8)]) if odd else data


def chunk_starts(blocks: int) -> np.ndarray:
    """First blocks of the chunks: overlapping by one, the last one reaching the end."""
    if blocks <= CHUNK:
        return np.zeros(1, np.int64)
    at = np.arange(0, blocks - CHUNK, CHUNK - 1)
    return np.append(at, blocks - CHUNK)


def describe(net: Net, data: np.ndarray, back: bool = False):  # noqa: ANN201
    """The text's description; with back also the steps that gave each part of it."""
    steps = (len(data) - WIDTH) // STRIDE + 1
    blocks = -(-steps // BLOCK)
    top = np.empty((blocks, FILTERS), np.float32)
    who = np.empty((blocks, FILTERS), np.int64) if back else None
    for first in range(0, steps, SLAB):
        last = min(steps, first + SLAB)
        emb = net.embed[data[first * STRIDE : (last - 1) * STRIDE + WIDTH]].ravel()
        view = np.lib.stride_tricks.as_strided(emb, (last - first, WIDTH * DIM), (STRIDE * DIM * emb.itemsize, emb.itemsize))
        out = np.ascontiguousarray(view) @ net.filters
        pad = -(last - first) % BLOCK
        if pad:
            out = np.concatenate([out, np.full((pad, FILTERS), -np.inf, np.float32)])
        out = out.reshape(-1, BLOCK, FILTERS)
        b = first // BLOCK
        if back:
            k = out.argmax(1)
            who[b : b + len(out)] = k + (np.arange(len(out)) * BLOCK + first)[:, None]
        top[b : b + len(out)] = out.max(1)
    at = chunk_starts(blocks)
    rows = np.minimum(at[:, None] + np.arange(CHUNK), blocks - 1)
    pooled = top[rows].max(1)
    value = np.maximum(pooled + net.bias, 0)
    best, least = value.argmax(0), value.argmin(0)
    cols = np.arange(FILTERS)
    vector = np.concatenate([value[best, cols], value.mean(0), value[least, cols], [np.log1p(len(data)) / 10]]).astype(np.float32)
    if not back:
        return vector
    k = top[rows].argmax(1)
    step = who[rows[np.arange(len(at))[:, None], k], cols]
    return vector, value, step, best, least


def predict(net: Net, texts: list[bytes | None]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x = (np.stack([describe(net, bytes_of(t)) for t in texts]) - net.mean) / net.scale
    return sigmoid(np.maximum(x @ net.w1 + net.b1, 0) @ net.w2 + net.b2).astype(np.float64)


def fit(texts: list[bytes | None], y: np.ndarray, epochs: int = 6, batch: int = 16, rate: float = 4e-3, seed: int = 3) -> Net:
    net = start(seed)
    if not len(y) or len(np.unique(y)) < 2:
        return net
    rng = np.random.default_rng(seed)
    first = np.stack([describe(net, bytes_of(t)) for t in texts[:256]])
    net.mean, net.scale = first.mean(0), first.std(0) + 0.1
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)) ** 0.5  # rarer labels count a little more
    weight /= weight.mean()
    m = [np.zeros_like(p) for p in net.parameters()]
    v = [np.zeros_like(p) for p in net.parameters()]
    t = 0
    total = epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            pick = order[k : k + batch]
            datas = [bytes_of(texts[i]) for i in pick]
            seen = [describe(net, d, back=True) for d in datas]
            x = (np.stack([s[0] for s in seen]) - net.mean) / net.scale
            h = np.maximum(x @ net.w1 + net.b1, 0)
            p = sigmoid(h @ net.w2 + net.b2)
            d = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dh = np.outer(d, net.w2) * (h > 0)
            dx = dh @ net.w1.T / net.scale
            g = [np.zeros_like(q) for q in net.parameters()]
            g[3], g[4], g[5], g[6] = x.T @ dh + 1e-4 * net.w1, dh.sum(0), h.T @ d, np.array([d.sum()])
            for (_, value, step, best, least), data, dv in zip(seen, datas, dx, strict=True):
                cols = np.arange(FILTERS)
                dval = np.repeat(dv[None, FILTERS : 2 * FILTERS] / len(value), len(value), 0)
                dval[best, cols] += dv[:FILTERS]
                dval[least, cols] += dv[2 * FILTERS : 3 * FILTERS]
                dval *= value > 0
                g[2] += dval.sum(0)
                at = step.ravel()
                idx = data[(at * STRIDE)[:, None] + np.arange(WIDTH)]  # winners' bytes
                emb = net.embed[idx].reshape(len(at), -1)
                dz = dval.ravel()
                col = np.tile(cols, len(value))
                live = np.flatnonzero(dz)
                np.add.at(g[1].T, col[live], dz[live, None] * emb[live])
                np.add.at(g[0], idx[live], (dz[live, None] * net.filters.T[col[live]]).reshape(len(live), WIDTH, DIM))
            t += 1
            lr = rate * min(1, t / 20) * (1 - 0.9 * t / total)
            for q, gq, mq, vq in zip(net.parameters(), g, m, v, strict=True):
                mq += 0.1 * (gq - mq)
                vq += 0.01 * (gq * gq - vq)
                q -= (lr * (mq / (1 - 0.9**t)) / (np.sqrt(vq / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, held_out: F.Column | None = None, label: str = "quality", class_bytes: int = 24 << 20) -> Net:
    rows = labels.select("doc_id", label).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out is not None:
        rows = rows.filter(~held_out)
    picked = sample(docs, rows, per_class, label, class_bytes)
    got = sorted((r[0], r[1], bytes(r[2] or b"")) for r in picked.select("doc_id", label, F.col("text").cast("binary")).collect())
    return fit([r[2] for r in got], np.array([r[1] for r in got], np.float32))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(predict(shared.value, b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, score double")


def held_out() -> F.Column:
    return id_crc() % 3 == 1


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; fitted on those not held out."""
    out = score(docs, train(docs, labels, held_out=held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
