"""Shingle sets: exact Jaccard similarities of candidate pairs, and an exact search for pairs that are alike.

A set is the sorted array of its shingles' 64-bit hashes, named by the hash of
that array (column ``c``); texts of equal sets are one class. Sets are eight
bytes a shingle and don't compress, so they are not kept: what is kept of a class
is its size and a bitmap of about a bit a shingle, whose bits say whether an odd
number of shingles fell on them. Two bitmaps differ in at most as many bits as
the sets have shingles of their own, which rules most pairs out for certain; the
sets of the others are made from their texts again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, mix64, pack, partitions_for, stored, table, unpack
from .substring import Words, windows

#: Texts are hashed in runs of about so many bytes.
_BYTES = 1 << 21


def shingle_sets(texts: list[bytes], size: int, words: Words) -> Iterator[np.ndarray]:
    """The sorted set of 64-bit hashes of each text's shingles of ``size`` words, A-Z in lower case; fewer words: one shingle of all; none: nothing."""
    at = 0
    while at < len(texts):
        end, total = at + 1, len(texts[at])
        while end < len(texts) and total + len(texts[end]) <= _BYTES:
            total += len(texts[end])
            end += 1
        run = texts[at:end]
        start, h = words(b"\n".join(run).lower())
        cuts = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in run)])).tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            yield np.unique(windows(h[lo:hi], min(size, hi - lo))) if hi > lo else np.zeros(0, np.uint64)
        at = end


def name_of(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 42) - (1 << 63)


def parity(h: np.ndarray, bits: int | None = None) -> bytes:
    """The set's bitmap; by default of the power of two that is at least the set's size, from 64 on."""
    m = bits or max(64, 1 << max(0, len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """The least number of shingles that only one of two sets has, by their bitmaps. The larger is folded to the smaller one's size."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def needed(x, y, similarity: float):
    """How many shingles two sets of these sizes must share."""
    return np.ceil(similarity / (1 + similarity) * (x + y) - 1e-9)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``similarity`` or more. The quotient is rounded correctly, so it is exact at the bound."""
    if not len(x) or not len(y) or min(len(x), len(y)) / max(len(x), len(y)) < similarity:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) >= similarity


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and bitmaps (``classes``: c, n, bits) don't rule them out."""
    of = lambda end: classes.select(F.col("c").alias(end), F.col("n").alias(f"n_{end}"), F.col("bits").alias(f"bits_{end}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            most = (x + y - 2 * needed(x, y, similarity)).tolist()
            near = [apart(p, q) <= m for p, q, m in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), most, strict=True)]
            yield b.select([0, 1]).filter(pa.array(near, pa.bool_()) if near else pa.array([], pa.bool_()))

    return both.transform(map_in_arrow, run, "a bigint, b bigint")


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b: names of sets) that are ``similarity`` or more alike, by their sets.

    ``classes`` (c, n, bits, doc, th) says which of ``texts`` (doc, th, text) has
    each set. Only texts of pairs that bitmaps leave are read.
    """
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stored(_likely(pairs, classes, similarity))
    ids = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    wanted = stored(classes.select("c", "doc", "th").join(ids, "c", "left_semi"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            found = [h.tobytes() for h in shingle_sets([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], shingle, words)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["c", "h"])

    held = texts.join(wanted, ["doc", "th"]).select("c", "text").transform(map_in_arrow, sets, "c bigint, h binary")
    held = stored(held.dropDuplicates(["c"]))
    both = pairs.join(held.select(F.col("c").alias("a"), F.col("h").alias("x")), "a").join(held.select(F.col("c").alias("b"), F.col("h").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return stored(both.select("a", "b", "x", "y").transform(map_in_arrow, run, "a bigint, b bigint"))


def _frequent(texts: DataFrame, shingle: int, rows: int = 8192, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of texts holds more than once, sorted, and how often. They only order the shingles of a set: any table gives the same pairs."""
    sample = texts.where(F.pmod("th", F.lit(max(1, texts.count() // rows))) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            sets = list(shingle_sets([t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()], shingle, words))
            s, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "n"])

    counts = sample.transform(map_in_arrow, run, "s bigint, n bigint").groupBy("s").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.col("n").desc(), "s").limit(most).toArrow()
    s, n = (np.asarray(counts.column(i).to_numpy()) for i in (0, 1))
    s = s.astype(np.int64).view(np.uint64)
    o = np.argsort(s)
    return s[o], n.astype(np.int64)[o]


def _prefix(h: np.ndarray, order: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest shingles of a set, so many that any set alike shares one of them."""
    keys, counts = order
    n = np.zeros(len(h), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        n = np.where(keys[at] == h, counts[at], 0)
    return h[np.lexsort((h, n))][: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]


def shared_rare(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(h, c, p): sets that share the rare shingle h, their p-th in order, with another set (prefix filtering).

    Two sets that are alike share at least ``similarity`` of the larger one, so
    the first of their shared shingles, in an order common to all sets, is among
    the first n - ceil(similarity * n) + 1 of both.
    """
    spark, n = texts.sparkSession, partitions_for(texts)
    order = spark.sparkContext.broadcast(_frequent(texts, shingle))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for b in batches:
            names, first = [], []
            for h in shingle_sets([t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()], shingle, words):
                c = name_of(h)
                if len(h) and c not in seen:
                    seen.add(c)
                    names.append(c)
                    first.append(_prefix(h, order.value, similarity))
            if not names:
                continue
            size = np.array([len(x) for x in first])
            h, c, k = np.concatenate(first), np.array(names, np.int64), np.repeat(np.arange(len(first)), size)
            p = np.concatenate([np.arange(x) for x in size])
            part = (mix64(h) % np.uint64(n)).astype(np.int64)
            o = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[o], prepend=-1))
            rows = []
            for i in np.split(o, cuts[1:]):
                own, place = np.unique(k[i], return_inverse=True)
                rows.append((int(part[i[0]]), pack(h[i], c[own], np.diff(place, prepend=0).astype(np.uint32), p[i].astype(np.uint32))))
            yield table(rows, pa.schema([("part", pa.int32()), ("x", pa.binary())]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            for blob in b.column(1).to_pylist():
                h, own, step, p = unpack(blob, np.uint64, np.int64, np.uint32, np.uint32)
                held.append((h, own[np.cumsum(step.astype(np.int64))], p))
        if not held:
            return
        h, c, p = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        o = np.lexsort((c, h))
        h, c, p = h[o], c[o], p[o]
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
        h, c, p = h[new], c[new], p[new]
        again = h[1:] == h[:-1]
        shared = np.flatnonzero(np.append(again, False) | np.append(False, again))
        for i in range(0, len(shared), 1 << 16):
            at = shared[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(c[at]), pa.array(p[at].astype(np.int32))], ["h", "c", "p"])

    dealt = texts.select("text").transform(map_in_arrow, deal, "part int, x binary")
    return dealt.repartitionById(n, F.col("part")).transform(map_in_arrow, meet, "h bigint, c bigint, p int")


def _pairs(h, c, n, p, label, small, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (sorted by h and n) with equal h that may be alike: their labels differ, and sizes, places and small bitmaps let them be."""

    def may(i, j):
        need = needed(n[i], n[j], similarity)
        good = (label[i] != label[j]) & (n[j] <= n[i] / similarity + 1e-6) & (np.minimum(n[i] - p[i], n[j] - p[j]) >= need)
        i, j, need = i[good], j[good], need[good]
        near = np.bitwise_count(small[i] ^ small[j]).sum(axis=1) <= n[i] + n[j] - 2 * need
        return c[i[near]], c[j[near]]

    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    size = np.diff(np.append(starts, len(h)))
    own = np.repeat(size, size)
    for d in range(1, 8):  # groups of up to eight, all at once
        i = np.flatnonzero((own[:-d] <= 8) & (h[d:] == h[:-d])) if len(h) > d else np.zeros(0, np.int64)
        yield may(i, i + d)
    for s, k in zip(starts[size > 8].tolist(), size[size > 8].tolist(), strict=True):
        last = s + np.searchsorted(n[s : s + k], n[s : s + k] / similarity + 1e-6, side="right")
        for i in range(k - 1):
            if last[i] > s + i + 1:
                yield may(np.full(last[i] - (s + i + 1), s + i), np.arange(s + i + 1, last[i]))


def unlinked(shared: DataFrame, classes: DataFrame, labels: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``shared`` sets in different components (``labels``: node, label) that their sizes, places and small bitmaps let be alike.

    A rare shingle's sets meet in one task, as a stream sorted by size; a pair is
    given once for each rare shingle that it shares.
    """
    known = classes.select("c", "n", "small").join(labels, F.col("c") == F.col("node"), "left").select("c", "n", "small", F.coalesce("label", "c").alias("label"))
    rows = shared.join(known, "c").select("h", "c", "n", "p", "label", "small")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, a, b, m = None, [], [], 0

        def out():
            both = np.unique(np.column_stack([np.concatenate(a), np.concatenate(b)]), axis=0)
            a.clear()
            b.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

        def ready(x):
            nonlocal m
            for c, d in _pairs(*x, similarity):
                a.append(c)
                b.append(d)
                m += len(c)
                if m > 200_000:
                    yield out()
                    m = 0

        for batch in batches:
            x = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            x.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, 2))
            x = x if held is None else [np.concatenate(z) for z in zip(held, x, strict=True)]
            if not len(x[0]):
                continue
            end = int(np.searchsorted(x[0], x[0][-1]))  # the last shingle's sets may go on in the next batch
            yield from ready([z[:end] for z in x])
            held = [z[end:] for z in x]
        if held is not None:
            yield from ready(held)
        if a:
            yield out()

    dealt = rows.repartition(partitions_for(shared), "h").sortWithinPartitions("h", "n", "c")
    return dealt.transform(map_in_arrow, run, "a bigint, b bigint")
