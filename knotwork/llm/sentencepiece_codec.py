"""SentencePiece encoding with byte offsets, and decoding.

normalise: the compiled character map (a double-array trie of longest-prefix rewrites) is walked over the UTF-8 bytes; for every
normalised character the source bytes it came from are kept. segment: words of the normalised text (a run of the space mark and
what follows up to the next one) are cut into pieces independently of each other, which is exact as long as no piece holds the
mark after another character (checked when the model is loaded; else the text is one word), by a copy of the model whose
normaliser is switched off. project: piece lengths in characters, summed up, index the alignment and give each piece its span of
source bytes. A character spelled by byte pieces belongs to the last of them; the others get empty spans.

Null texts count as empty: no piece but the end id. Every row gives one row, repeated rows repeated ones; an empty table an empty
one; other columns are neither read nor returned, so clashing names cannot matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import batches

MARK = "▁"


def fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message, one level deep."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (blob[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if blob[at - 1] < 128:
                return out, at

    at = 0
    while at < len(blob):
        key, at = varint(at)
        if key & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = blob[at : at + n], at + n
        yield key >> 3, value


class CharsMap:
    """Longest-prefix rewriting by a compiled character map: a size, a double-array trie, a pool of zero-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def prefix(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key at this place."""
        units, best = self.units, None
        if not units:
            return None
        leap = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = leap(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            unit = units[node]
            node ^= leap(unit)
            if unit & 256:
                best = k + 1 - at, units[node] & 0x7FFFFFFF
        return best and (best[0], self.pool[best[1] : self.pool.index(b"\0", best[1])])


class Codec:
    """model: its path or its bytes. cache: words whose pieces are kept; the bound of the memory of a Python worker."""

    def __init__(self, model: str | bytes, cache: int = 100_000):
        import sentencepiece

        blob = Path(model).read_bytes() if isinstance(model, str) else model
        spec: dict[int, int | bytes] = {}
        pieces, rest = [], bytearray()
        for number, value in fields(blob):
            if number == 1:
                pieces.append(dict(fields(value)))
            if number == 3:
                spec = dict(fields(value))
            elif number in (1, 2):
                rest += bytes([number << 3 | 2]) + _varint(len(value)) + value
        off = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=bytes(rest) + b"\x1a" + _varint(len(off)) + off)
        self.map, self.dummy, self.squeeze, self.escape = CharsMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        texts = [p[1].decode() for p in pieces]
        kind = [p.get(3, 1) for p in pieces]
        self.surface = ["" if k == 3 else " ⁇ " if k == 2 else t.replace(MARK, " ") for t, k in zip(texts, kind, strict=True)]
        self.byte = {i: int(t[3:5], 16) for i, (t, k) in enumerate(zip(texts, kind, strict=True)) if k == 6}
        self.id_text = [str(i) for i in range(len(texts))]
        #: Characters that a piece stands for (bytes: none, until it is known which byte ends a character), and whether it is a byte that continues one.
        self.chars = np.array([0 if k == 6 else len(t) for t, k in zip(texts, kind, strict=True)], np.int64)
        self.bytes = np.array([k == 6 for k in kind])
        self.inner = np.array([0x80 <= self.byte.get(i, 0) < 0xC0 for i in range(len(texts))])
        self.unknown, self.eos = self.segmenter.unk_id(), self.segmenter.eos_id()
        whole = any(MARK in t.lstrip(MARK) for t in texts)
        self.words = re.compile(r"[\s\S]+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.plain_words = not (whole or self.map.units or self.squeeze) and self.dummy and self.escape
        self.limit, self.known = cache, {}

    def normalize(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and len + 1 byte offsets: character i comes from source bytes [offsets[i], offsets[i + 1])."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze and self.escape:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            ends = np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000).astype(np.int64))
            return MARK * self.dummy + text.replace(" ", MARK), np.concatenate([np.zeros(1 + self.dummy, np.int64), ends])
        data, at, out, starts = text.encode(), 0, [], []
        space = MARK if self.escape else " "
        if self.dummy:
            out.append(space)
            starts.append(0)
        blank = self.squeeze  # whether a space here would be a repeated or leading one
        while at < len(data):
            n, new = self.map.prefix(data, at) or (0, b"")
            if not n:
                n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = data[at : at + n]
            for c in new.decode():
                if c == " ":
                    if blank:
                        continue
                    blank, c = self.squeeze, space
                else:
                    blank = False
                out.append(c)
                starts.append(at)
            at += n
        end = at
        while self.squeeze and out and out[-1] == space:
            out.pop()
            end = starts.pop()
        return "".join(out), np.array([*starts, end], np.int64)

    def _split(self, text: str) -> tuple[list[str], np.ndarray]:
        """Words of the normalised text and its alignment."""
        norm, offsets = self.normalize(text)
        if self.plain_words and text and "  " not in text and MARK not in text and text[-1] != " " != text[0]:
            return [MARK + w for w in text.split(" ")], offsets  # the same as below, sooner
        return self.words.findall(norm), offsets

    def _learn(self, texts: list[list[str]]) -> None:
        """Gets the pieces of words not seen before: ids, ids as text, surface."""
        if len(self.known) > self.limit:
            self.known.clear()
        new = list({w for words in texts for w in words}.difference(self.known))
        text, surface = self.id_text, self._surface
        for w, ids in zip(new, self.segmenter.encode(new, num_threads=1) if new else (), strict=True):
            self.known[w] = ids, " ".join([text[i] for i in ids]), surface(ids)

    def _surface(self, ids: Iterable[int]) -> str:
        """Text of pieces. Bytes that spell no character become U+FFFD, one each."""
        byte, surface = self.byte, self.surface
        if byte.keys().isdisjoint(ids):
            return "".join([surface[i] for i in ids])
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in byte:
                run.append(byte[i])
                continue
            while run:
                n = 1 + (run[0] >= 0xC0) + (run[0] >= 0xE0) + (run[0] >= 0xF0)
                try:
                    out.append(run[:n].decode())
                except UnicodeDecodeError:
                    n = 1
                    out.append("\ufffd")
                del run[:n]
            if i is not None:
                out.append(surface[i])
        return "".join(out)

    def _spans(self, ids: np.ndarray, words: list[str], parts: list, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each piece's source bytes."""
        lens = self.chars[ids]
        if self.bytes[ids].any():
            lens += self.bytes[ids] & ~np.append(self.inner[ids[1:]], False)
        if len(ids) and (ids == self.unknown).any():  # a run of characters that no piece has: what the word's other pieces leave
            at = 0
            for w, (own, *_) in zip(words, parts, strict=True):
                part = lens[at : at + len(own)]
                if self.unknown in own:
                    part[own.index(self.unknown)] += len(w) - part.sum()
                at += len(own)
        ends = np.cumsum(lens)
        return offsets[ends - lens], offsets[ends]

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
        """For each text: ids without the end id, begins and ends of their spans, parts of its words."""
        for some in batches(iter(texts), 256):
            split = [self._split(t or "") for t in some]
            self._learn([w for w, _ in split])
            for words, offsets in split:
                parts = [self.known[w] for w in words]
                ids = np.fromiter(chain.from_iterable([p[0] for p in parts]), np.int64)
                yield ids, *self._spans(ids, words, parts, offsets), parts

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with the end id; begin and end of each one's span of UTF-8 bytes of the text."""
        ids, begins, ends, _ = next(self.encode_batch([text]))
        n = len((text or "").encode())
        return np.append(ids, self.eos), np.append(begins, n), np.append(ends, n)

    def decode(self, ids: Iterable[int]) -> str:
        text = self._surface(list(ids))
        return text[1:] if self.dummy and text.startswith(" ") else text

    def digests(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str, int, np.ndarray]]:
        """Number of ids, SHA-256 of the ids and of the text decoded from them, source bytes that the spans cover, the ids."""
        for ids, begins, ends, parts in self.encode_batch(texts):
            joined = " ".join([*[p[1] for p in parts], str(self.eos)])
            back = "".join([p[2] for p in parts])
            back = back[1:] if self.dummy and back.startswith(" ") else back
            yield len(ids) + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), int((ends - begins).sum()), np.append(ids, self.eos)


def _model(docs: DataFrame, path: str):  # noqa: ANN202
    """The model's bytes, read on the driver: executors need no file."""
    return docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def encode_spans(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids, begins, ends: each text's ids (an end id last) and its pieces' spans of UTF-8 bytes."""
    kind, model = docs.schema[key].dataType.simpleString(), _model(docs, path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for b in it:
            got = [codec.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[j].tolist() for g in got], pa.list_(t)) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64())))], ["_k", "ids", "begins", "ends"])

    return docs.select(docs[key].alias("_k"), text).mapInArrow(run, f"_k {kind}, ids array<int>, begins array<bigint>, ends array<bigint>").withColumnRenamed("_k", key)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the text that their ids stand for (a null list: the empty text)."""
    model = _model(encoded, path)

    def back(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(model.value)
        for s in parts:
            yield s.map(lambda x: codec.decode([i for i in (() if x is None else x) if i != codec.eos]))

    return encoded.withColumn(out, F.pandas_udf(back, "string")(F.col(ids)))


def token_digests(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes (source bytes that the pieces' spans cover: all, or the encoding lost
    some); with_ids: also the ids, the end id last."""
    kind, model = docs.schema["doc_id"].dataType.simpleString(), _model(docs, path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "span_bytes", *(["ids"] if with_ids else [])]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for b in it:
            got = list(codec.digests(b.column(1).to_pylist()))
            columns = [b.column(0), *(pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64())))]
            if with_ids:
                columns.append(pa.array([g[4] for g in got], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long" + ", ids array<int>" * with_ids)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
