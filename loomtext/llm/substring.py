"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window of ``window`` words has a Rabin-Karp hash of 80 bits: 64 by Horner
over mixed word hashes, modulo 2**64, and 16 by prefix sums with another base. Map tasks keep one entry for each distinct hash of a
chunk, its first occurrence, so a passage that a third of all documents share
costs one entry a chunk; what a chunk already knows to be a repeat is passed on
as it is. Entries travel as packed blobs to the task that owns their hash, which
finds each hash's first occurrence and answers with the places of all others.
The answers meet the texts, again as blobs, by document; overlapping windows
merge there into maximal removal intervals.

Two windows count as equal if their hashes are: among n distinct windows a false
pair is expected n**2 / 2**81 times (once in 10**8 runs for the 135 million
windows of half a gigabyte of documents; 300 pairs among the 2.7 * 10**13 of
100 TB). Rows are told apart by id, those of a repeated or no id also by a 64-bit
hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_key, mix64, pack, partitions_for, stored, table, unpack

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWER = 0xD6E8FEB86659FD93
#: Texts are hashed in pieces of about so many bytes, windows counted in chunks of about so many.
_BYTES, _WINDOWS = 1 << 21, 2_500_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LONG_WORD = 255


class Words:
    """Hashes of the words of a run of bytes, by prefix sums of byte values times powers."""

    def __init__(self):
        self.values = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n + 1:
            for name, base in (("powers", _POWER), ("inverse", pow(_POWER, -1, 1 << 64))):
                x = np.full(n + 1, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start offsets and hashes of the words."""
        b = np.frombuffer(raw, np.uint8)
        self.grow(len(b))
        inside = np.empty(len(b) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(_SPACE[b], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.values[b] * self.powers[: len(b)], out=sums[1:])
        h = mix64((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > _LONG_WORD):  # a polynomial modulo 2**64 is weak on long periodic words
            h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]], 1)
        return start, h


def windows(h: np.ndarray, window: int) -> np.ndarray:
    """Rabin-Karp hashes of all windows of consecutive word hashes."""
    n = len(h) - window + 1
    acc = np.zeros(max(n, 0), np.uint64)
    for j in range(window if n > 0 else 0):
        acc = acc * _BASE + h[j : j + n]
    return mix64(acc)


def _second(h: np.ndarray, window: int, words: Words) -> np.ndarray:
    """Sixteen more bits of the windows' hashes, by prefix sums of word hashes times powers of another base."""
    words.grow(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * words.powers[: len(h)], out=sums[1:])
    n = max(len(h) - window + 1, 0)
    return (mix64((sums[window:] - sums[:-window])[:n] * words.inverse[:n]) >> np.uint64(48)).astype(np.uint16) if n else np.zeros(0, np.uint16)


def _hashed(ids: list[int], tags: list[int], texts: list[bytes], words: Words, window: int):
    """Hash, its second part, id, tag and start of every window of the texts."""
    start, h = words(b"\n".join(texts))
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))))
    w, g = windows(h, window), _second(h, window, words)
    n = len(w)
    whole = doc[:n] == doc[window - 1 : window - 1 + n] if n else np.zeros(0, bool)
    first = np.searchsorted(doc, np.arange(len(texts)))
    at = (np.arange(n) - first[doc[:n]])[whole]
    doc = doc[:n][whole]
    return w[whole], g[whole], np.array(ids, np.int64)[doc], np.array(tags, np.int64)[doc], at.astype(np.uint32)


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of runs of equal rows."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _by_doc(doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> bytes:
    """Window starts, in order of documents and starts, as a small blob."""
    s = _runs([doc, tag])
    n = np.diff(np.append(s, len(doc)))
    step = np.diff(at.astype(np.int64), prepend=0)
    step[s] = at[s]
    return pack(np.diff(doc[s], prepend=0), tag[s], n.astype(np.uint32), step.astype(np.uint32))


def _from_doc(blob: bytes):
    ids, tags, n, step = unpack(blob, np.int64, np.int64, np.uint32, np.uint32)
    n = n.astype(np.int64)
    at = np.cumsum(step.astype(np.int64))
    s = np.cumsum(n) - n
    at -= np.repeat(np.where(s > 0, at[np.maximum(s, 1) - 1], 0), n)
    return np.repeat(np.cumsum(ids), n), np.repeat(tags, n), at


def _seconds(h, g, doc, tag, at):
    """Which windows have an equal one that starts earlier, and which are a hash's first. Ties of id and start are no repeats."""
    o = np.lexsort((at, doc, h))
    same = h[o][1:] == h[o][:-1]
    if (same & (g[o][1:] != g[o][:-1])).any():
        o = np.lexsort((at, doc, g, h))
    h, g, doc, tag, at = (x[o] for x in (h, g, doc, tag, at))
    s = _runs([h, g])
    n = np.diff(np.append(s, len(h)))
    later = (doc != np.repeat(doc[s], n)) | (at != np.repeat(at[s], n))
    return (h, g, doc, tag, at), later


def _owner(doc: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    """The part of a row: by id and text, so that many rows of one id, or of none, spread."""
    return (mix64(doc.astype(np.uint64) * _BASE ^ tag.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


_OUT = pa.schema([("part", pa.int32()), ("kind", pa.int8()), ("body", pa.binary())])
_OUT_SQL = "part int, kind tinyint, body binary"


def _dealt(kind: int, part: np.ndarray, make) -> list[tuple]:
    """One blob for each part; ``make`` gets the positions of its rows."""
    o = np.argsort(part, kind="stable")
    s = _runs([part[o]])
    return [(int(part[o[i]]), kind, make(o[i:j])) for i, j in zip(s, np.append(s[1:], len(o))[: len(s)], strict=True)]


def _answers(doc, tag, at, n: int) -> list[tuple]:
    o = np.lexsort((at, tag, doc))
    doc, tag, at = doc[o], tag[o], at[o]
    return _dealt(1, _owner(doc, tag, n), lambda i: _by_doc(doc[i], tag[i], at[i]))


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _count_windows(window: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, total = Words(), [], 0

        def flush():
            (h, g, doc, tag, at), later = _seconds(*(np.concatenate(x) for x in zip(*held, strict=True)))
            rows = _answers(doc[later], tag[later], at[later], n) if later.any() else []
            keep = np.flatnonzero(~later)
            keep = keep[np.lexsort((at[keep], tag[keep], doc[keep]))]
            h, g, doc, tag, at = (x[keep] for x in (h, g, doc, tag, at))
            part = (h >> np.uint64(20)) % np.uint64(n)
            rows += _dealt(0, part.astype(np.int64), lambda i: (b := _by_doc(doc[i], tag[i], at[i])) and len(b).to_bytes(4, "little") + len(i).to_bytes(4, "little") + b + h[i].tobytes() + g[i].tobytes())
            held.clear()
            return table(rows, _OUT)

        for b in batches:
            ids, tags, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2))
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= _BYTES):
                    size += len(texts[end])
                    end += 1
                held.append(_hashed(ids[at:end], tags[at:end], texts[at:end], words, window))
                total += len(held[-1][0])
                at = end
                if total >= _WINDOWS:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return run


def _find_repeats(n: int):
    """Rows of one part: entries of the hashes it owns, and answers that chunks gave, which pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for part, kind, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == 1:
                    yield table([(part, 1, body)], _OUT)
                    continue
                cut, m = 8 + int.from_bytes(body[:4], "little"), int.from_bytes(body[4:8], "little")
                held.append((np.frombuffer(body, np.uint64, m, cut), np.frombuffer(body, np.uint16, m, cut + 8 * m), *_from_doc(body[8:cut])))
        if held:
            (_, _, doc, tag, at), later = _seconds(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if later.any():
                yield table(_answers(doc[later], tag[later], at[later], n), _OUT)

    return run


def _send_texts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags, null = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            texts = _texts(b.column(2))
            size = np.array([len(t) for t in texts], np.int64)

            def blob(i):
                return pack(ids[i], tags[i], null[i], size[i], np.frombuffer(b"".join(texts[k] for k in i), np.uint8))  # noqa: B023

            if len(texts):
                yield table(_dealt(2, _owner(ids, tags, n), blob), _OUT)

    return run


def intervals(at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of words that windows starting at ``at`` cover: starts and lengths."""
    at = np.unique(at)
    if not len(at):
        return at, at
    s = np.flatnonzero(np.append(True, np.diff(at) > window))
    return at[s], np.append(at[s[1:] - 1], at[-1]) + window - at[s]


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_KEPT_SQL = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, starts array<bigint>, lengths array<bigint>"


def _apply(window: int, with_text: bool):
    schema = _KEPT.append(pa.field("kept_text", pa.string())) if with_text else _KEPT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, packed = [], []
        for b in batches:
            for kind, body in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                (said if kind == 1 else packed).append(body)
        doc, tag, at = (np.concatenate(x) for x in zip(*(_from_doc(x) for x in said), strict=True)) if said else (np.zeros(0, np.int64),) * 3
        o = np.lexsort((at, tag, doc))
        doc, tag, at = doc[o], tag[o], at[o]
        s = _runs([doc, tag])
        places = {(int(doc[i]), int(tag[i])): (i, j) for i, j in zip(s, np.append(s[1:], len(doc))[: len(s)], strict=True)}
        for body in packed:
            ids, tags, null, size, data = unpack(body, np.int64, np.int64, np.bool_, np.int64, np.uint8)
            rows, data, begin = [], data.tobytes(), 0
            for i, t, no_id, m in zip(ids.tolist(), tags.tolist(), null.tolist(), size.tolist(), strict=True):
                words = data[begin : begin + m].split()
                begin += m
                lo, hi = places.get((i, t), (0, 0))
                start, length = intervals(at[lo:hi], window)
                kept, last = [], 0
                for a, k in zip(start.tolist(), length.tolist(), strict=True):
                    kept += words[last:a]
                    last = a + k
                kept = b" ".join(kept + words[last:])
                row = (None if no_id else i, len(words), int(length.sum()), hashlib.sha256(kept).hexdigest(), start.tolist(), length.tolist())
                rows.append((*row, kept.decode()) if with_text else row)
            yield table(rows, schema)

    return run


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): what is left once repeated windows are gone.

    A window is ``window`` consecutive words (runs of bytes that aren't ASCII
    white space); a word goes if a window over it has an equal one that starts
    earlier: in a smaller doc_id, or in the same document further ahead. Windows
    are judged on the input. Returns doc_id, n_words, n_removed, kept_sha256 (of
    the kept words joined by one space), starts and lengths of the maximal
    removal intervals in words, and kept_text if asked for.

    A null or empty text has no words; texts shorter than a window lose nothing.
    A null doc_id sorts after all others and comes back null. Rows of equal
    doc_id are one document's: of two equal windows the one that starts further
    ahead stays, and at the same start both stay, so repeated rows are treated
    alike. An empty table gives an empty result; other columns aren't read.
    """
    n = partitions_for(docs)
    # most ids name one row: the others' rows are told apart by their texts
    several = stored(docs.groupBy(id_key().alias("of")).agg(F.count("*").alias("m")).where("m > 1 or of = " + str(NULL_ID)).select("of"))
    tag = F.when(F.col("of").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.coalesce("text", F.lit("")))).alias("tag")
    rows = docs.select("doc_id", "text", id_key().alias("id")).join(several, F.col("id") == F.col("of"), "left")
    rows = rows.select("id", tag, "text", F.col("doc_id").isNull().alias("no_id"))
    entries = rows.select("id", "tag", "text").mapInArrow(_count_windows(window, n), _OUT_SQL).repartitionById(n, "part")
    answers = entries.mapInArrow(_find_repeats(n), _OUT_SQL)
    texts = rows.mapInArrow(_send_texts(n), _OUT_SQL)
    return answers.union(texts).repartitionById(n, "part").mapInArrow(_apply(window, with_text), _KEPT_SQL + (", kept_text string" if with_text else ""))
