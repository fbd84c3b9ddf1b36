"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a built-in and of a learned lexicon (words, and word beginnings marked by `*`), hits near a
second-person word, the densest stretch, capitals, exclamation and other punctuation, digits, disguised words (letters replaced or
parted by symbols, single letters in a row) and how many of them are in the lexicons, repeated words, lengths. The learned lexicon
takes terms that are in far more toxic than other training texts; training texts are described by the lexicon of the half that they
are not in, so it does not flatter itself.

Fitted on at most per_class labelled texts of each class (lowest id hash), of class_bytes bytes together at most; term counts are summed on the executors, and
LEXICON terms a lexicon at most reach the driver. Scoring is one map over whole texts. Null and empty texts have features of zero and a score
like any other; without labels every score is 0.5. Rows come out as often as they go in; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.boosting import Isotonic, Trees, fit_calibrated
from knotwork.llm.common import id_crc, sample

LEXICON = 400
BEGINNINGS = (5, 6, 7, 8)
BUILT_IN = b"idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting garbage filth jerk fool imbecile ugly hate shut clown freak creep coward liar".split()
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch sie tu toi te vous votre vos tes ta usted ustedes ti tus vosotros eres".encode().split())
_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_CUT = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_MIXED = re.compile(rb"[a-z][0-9@$!*|._-]{1,2}(?=[a-z])")
_TOKEN_END = re.compile(rb"\s")
_APART, _JOINTS = re.compile(rb"[^a-z0-9@$!*|._-]+"), re.compile(rb"[._-]+")
_LEET = [bytes.maketrans(b"0134578@$!|", b"o" + i + b"eastbas" + i + i) for i in (b"i", b"l")]  # 1, ! and | stand for i or l
NAMES = ("words", "built_in", "learned", "hits", "dense", "second", "near_second", "capitals", "capital_words", "exclamations", "punctuation", "digits", "mixed", "disguised", "repeats", "word_length")


class Lexicon(dict):
    """Word to 2 (built in), 1 (learned) or 0; remembers a bounded number of words."""

    def __init__(self, learned: list[bytes]):
        super().__init__()
        self.words = frozenset(w for w in learned if w[-1:] != b"*")
        self.starts = frozenset(w[:-1] for w in learned if w[-1:] == b"*")
        self.built_in = frozenset(BUILT_IN)

    def __reduce__(self):  # noqa: ANN204
        return Lexicon, ([*self.words, *(w + b"*" for w in self.starts)],)

    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        v = 2 if w in self.built_in else 1 if w in self.words or any(w[:n] in self.starts for n in BEGINNINGS) else 0
        self[w] = v
        return v


def hidden(piece: bytes, lexicon: Lexicon) -> bool:
    """Whether a lexicon word hides in a run of letters, digits and the signs that stand for letters: in all of it, or between its dots and dashes."""
    for part in {piece.strip(_PUNCT), *_JOINTS.split(piece)}:
        if part and any(lexicon[w] or lexicon[w.translate(None, _PUNCT)] for w in (part, *(part.translate(t) for t in _LEET))):
            return True
    return False


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(NAMES)
    low = (text or "").lower().encode()
    words = low.translate(_CUT).split()
    n, size = max(1, len(words)), len(raw)
    marks = np.fromiter(map(lexicon.__getitem__, words), np.int8, len(words))
    hits = np.flatnonzero(marks)
    second = np.array([i for i, w in enumerate(words) if w in SECOND] if not SECOND.isdisjoint(words) else [], np.int64)
    near = 0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hits), np.abs(second[np.maximum(at - 1, 0)] - hits))
        near = int((gap <= 4).sum())
    dense = int((np.searchsorted(hits, hits + 40) - np.arange(len(hits))).max()) if len(hits) else 0
    disguised = mixed = last = 0
    for m in _MIXED.finditer(low):
        mixed += 1
        if m.start() >= last:
            begin = m.start()
            while begin > last and low[begin - 1] > 32:
                begin -= 1
            end = _TOKEN_END.search(low, m.end())
            last = end.start() if end else len(low)
            disguised += sum(hidden(piece, lexicon) for piece in _APART.split(low[begin:last]) if _MIXED.search(piece))
    single = [len(w) == 1 for w in words]
    if sum(single) >= 4:  # letters parted by blanks
        at = 0
        while at < len(words):
            end = at
            while end < len(words) and single[end]:
                end += 1
            if end - at >= 4:
                disguised += lexicon[b"".join(words[at:end])] > 0
            at = end + 1
    upper = size - len(raw.translate(None, _UPPER))
    lower = size - len(raw.translate(None, _LOWER))
    big = sum(1 for w in raw.translate(_CUT).split() if len(w) > 2 and w.isupper()) if upper else 0
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    built_in = int((marks == 2).sum())
    return [np.log1p(n), built_in / n, (len(hits) - built_in) / n, np.log1p(len(hits)), dense, len(second) / n, near, upper / max(1, upper + lower), big / n, raw.count(b"!") / size, (size - len(raw.translate(None, _PUNCT))) / size, (size - len(raw.translate(None, _DIGIT))) / size, mixed / n, disguised, repeats / n, size / n]


def terms(text: str | None) -> set[bytes]:
    """Words and word beginnings of a text."""
    words = set((text or "").lower().encode().translate(_CUT).split())
    return words | {w[:k] + b"*" for w in words for k in BEGINNINGS if len(w) > k}


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], np.float64).reshape(-1, len(NAMES))
        return self.calibration(self.trees.raw(x))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, held_out: F.Column | None = None, label: str = "toxic", class_bytes: int = 64 << 20) -> Model:
    rows = labels.select("doc_id", label).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out is not None:
        rows = rows.filter(~held_out)
    picked = sample(docs, rows, per_class, label, class_bytes).select("text", F.col(label).cast("int").alias("y"), (F.xxhash64("doc_id") % 2 == 0).alias("half"), F.xxhash64("doc_id").alias("place"))

    def explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t, y, half in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
                own = sorted(terms(t))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([y] * len(own), pa.int32()), pa.array([half] * len(own), pa.bool_())], ["term", "y", "half"])

    one = lambda y, half: F.sum(((F.col("y") == y) & (F.col("half") == half)).cast("long"))
    counts = picked.mapInArrow(explode, "term binary, y int, half boolean").groupBy("term").agg(one(1, True).alias("a"), one(0, True).alias("b"), one(1, False).alias("c"), one(0, False).alias("d"))
    sizes = {(r[0], r[1]): r[2] for r in picked.groupBy("y", "half").count().collect()}

    def pick(name: str, toxic: str, other: str, *halves: bool) -> DataFrame:
        """The LEXICON terms of greatest log-odds times text frequency, among those of log-odds 3 and more."""
        n_toxic, n_other = (sum(sizes.get((y, h), 0) for h in halves) for y in (1, 0))
        t, o = F.expr(toxic), F.expr(other)
        odds = F.log((t + 0.5) / (n_toxic + 1)) - F.log((o + 0.5) / (n_other + 1))
        return counts.filter((t >= max(4, n_toxic // 100)) & (odds >= 3.0)).orderBy((t * odds).desc(), "term").limit(LEXICON).select(F.lit(name).alias("name"), "term")

    own: dict[str, list[bytes]] = {"whole": [], "first": [], "second": []}
    for r in pick("whole", "a + c", "b + d", True, False).union(pick("first", "a", "b", True)).union(pick("second", "c", "d", False)).collect():
        own[r["name"]].append(bytes(r["term"]))
    whole, first, second = own["whole"], Lexicon(own["first"]), Lexicon(own["second"])

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            d = b.to_pydict()
            x = [features(t, second if half else first) for t, half in zip(d["text"], d["half"], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(d["place"], pa.int64()), pa.array(d["y"], pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["place", "y", "x"])

    got = sorted((r[0], r[1], r[2]) for r in picked.mapInArrow(describe, "place long, y int, x array<double>").collect())
    x = np.array([r[2] for r in got], np.float64).reshape(-1, len(NAMES))
    return Model(Lexicon(whole), *fit_calibrated(x, np.array([r[1] for r in got], np.float64)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def held_out() -> F.Column:
    return id_crc() % 5 == 0


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; fitted on those not held out."""
    out = score(docs, train(docs, labels, held_out=held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
