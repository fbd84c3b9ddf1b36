"""Language identification by nearest centroids.

Texts become vectors of hashed letter n-grams (one to three lower-cased letters; every run of other characters is one blank),
weighted by 1 + ln tf times idf and scaled to length one. Spherical k-means gives each language several centroids, and a text goes
to the language of the centroid of greatest cosine. A text is rejected if it lies further from its centroid than all but a
thousandth of that language's training texts lie from centroids fitted without them (each half of the distinct texts is measured
against the other half's centroids), or has no letter. As cosines grow with the number of different n-grams, a text is held against
training texts of about as many or more. A language of a single distinct text takes the least limits of the others.

The classifier is fitted on at most per_language texts of each language (those of the lowest id hash, of language_bytes bytes together at
most; an id of two languages is left out), counted on the executors;
prediction reads every whole text, in one map without a shuffle. Null and letterless texts give `und`, score 0, rejected. Rows
come out as often as they go in; an empty table, or one without labelled texts, gives `und` throughout; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import id_crc, sample

BITS = 12
DIM = 1 << BITS
FEW = 50
_MUL = np.uint32(2654435761)
_tables: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point to lower-cased letter; 0 for what is not a letter."""
    if not _tables:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x20000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        for c in range(0x20000, 0x32000):
            if chr(c).isalpha():
                t[c] = c
        _tables.append(t)
    return _tables[0]


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text; None if it has no letter."""
    if not text:
        return None
    low = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    on = low > 0
    if not on.any():
        return None
    keep = on.copy()
    keep[1:] |= on[:-1]  # one blank after each run of letters
    s = np.concatenate([np.zeros(1, np.uint32), low[keep], np.zeros(1, np.uint32)])
    if s[-2] == 0:
        s = s[:-1]
    h = s * _MUL
    two = (h[:-1] ^ (s[1:] * np.uint32(40503) + np.uint32(77))) * _MUL
    three = (two[:-1] ^ (s[2:] * np.uint32(69069) + np.uint32(13))) * _MUL
    shift = np.uint32(32 - BITS)
    out = np.bincount(two >> shift, minlength=DIM)
    out += np.bincount(three >> shift, minlength=DIM)
    one = h[s > 0]
    return out + np.bincount(one >> shift, minlength=DIM)


def band(n: np.ndarray) -> int:
    """Number of different n-grams as a power of two."""
    return int(np.count_nonzero(n)).bit_length() - 1


def centroids(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; at most k unit vectors."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[[rng.integers(len(x))]]
    while len(c) < k:  # each further start is the text furthest from those so far
        c = np.vstack([c, x[(x @ c.T).max(1).argmin()]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    least: np.ndarray  # centroids x bands: cosine under which a text is rejected

    def vector(self, n: np.ndarray) -> np.ndarray:
        v = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0) * self.idf
        return v / max(np.linalg.norm(v), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        n = counts(text)
        if n is None or not self.langs:
            return "und", 0.0, True
        cos = self.centroids @ self.vector(n)
        j = int(cos.argmax())
        return self.langs[j], float(min(1.0, max(0.0, cos[j]))), bool(cos[j] < self.least[j, band(n)])


def unseen(own: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Cosine of each text to the nearest centroid of the half of the texts without it; copies fall in one half. Empty for one text."""
    number: dict[bytes, int] = {}
    half = np.array([number.setdefault(v.tobytes(), len(number)) % 2 for v in own])
    out = np.zeros(len(own) if len(number) > 1 else 0)
    for h in (0, 1) if len(out) else ():
        out[half == h] = (own[half == h] @ centroids(own[half != h], k, seed).T).max(1)
    return out


def limits(cos: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """For each band the 0.001 quantile of the cosines of texts from the band below upwards; where they are few, that of the band below."""
    out = np.full(BITS + 1, np.inf)
    for b in range(BITS + 1):
        own = cos[bands >= b - 1]
        out[b] = out[b - 1] if b and len(own) < FEW else np.quantile(own, 0.001) if len(own) else np.inf
    return out


def fit(rows: list[tuple[str, np.ndarray]], per_lang: int = 4, seed: int = 5) -> Model:
    """rows: language and counts of each training text."""
    if not rows:
        return Model(np.ones(DIM), np.zeros((0, DIM)), [], np.zeros((0, BITS + 1)))
    x = np.empty((len(rows), DIM), np.float32)
    df = np.zeros(DIM)
    for k, (_, n) in enumerate(rows):
        df += n > 0
        x[k] = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0)
    model = Model(np.log((1 + len(x)) / (1.0 + df)) + 1, np.zeros((0, DIM)), [], np.zeros((0, BITS + 1)))
    for row in x:  # in place: one copy of the sample is all that the driver holds
        row *= model.idf
        row /= max(float(np.linalg.norm(row)), 1e-12)
    lang, bands = np.array([r[0] for r in rows]), np.array([band(r[1]) for r in rows])
    found, least = [], []
    for name in sorted(set(lang)):
        own = x[lang == name]
        c = centroids(own, per_lang, seed)
        found.append(c)
        model.langs += [str(name)] * len(c)
        cos = unseen(own, per_lang, seed)
        least += [limits(cos, bands[lang == name][: len(cos)])] * len(c)
    model.centroids, model.least = np.vstack(found).astype(np.float64), np.array(least)
    known = model.least.min(0)
    model.least = np.where(np.isfinite(model.least), model.least, np.where(np.isfinite(known), known, 0.0))
    return model


def train(docs: DataFrame, per_language: int = 800, held_out: F.Column | None = None, language_bytes: int = 64 << 20) -> Model:
    """Fits on labelled rows that are not held out; what reaches the driver is bounded by per_language vectors a language."""
    rows = docs.select("doc_id", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    if held_out is not None:
        rows = rows.filter(~held_out)
    picked = sample(docs, rows, per_language, "lang", language_bytes)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            d = b.to_pydict()
            got = [(k, counts(t)) for k, t in zip(d["lang"], d["text"], strict=True)]
            got = [(k, n.astype("<u4").tobytes()) for k, n in got if n is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.binary())], ["lang", "n"])

    got = sorted((r[0], bytes(r[1])) for r in picked.select("lang", "text").mapInArrow(run, "lang string, n binary").toLocalIterator())
    return fit([(k, np.frombuffer(n, "<u4")) for k, n in got])


def _predicted(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns as _c0, _c1, ... (so that no name can clash) with lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of centroids of fixed width a language
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], F.col("text").alias("_text"))
    names = rows.columns[:-1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            got = [m.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*names).schema)
    return rows.mapInArrow(run, head + "lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected."""
    return _predicted(docs, model, ["doc_id"]).withColumnRenamed("_c0", "doc_id")


def held_out() -> F.Column:
    return id_crc() % 4 == 2


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; fitted on those not held out."""
    return identify(docs, train(docs, held_out=held_out())).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """Rows of docs, all their columns, whose language is not rejected."""
    kept = _predicted(docs, train(docs), docs.columns).filter(~F.col("rejected"))
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
