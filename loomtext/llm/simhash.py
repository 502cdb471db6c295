"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint is cut into blocks; each block emits every variant within half the
radius, so two fingerprints whose blocks differ in at most ``radius`` bits share
a variant. Variants that differ in low bits fall into the same bucket (a bucket
is a range of variants), so a fingerprint travels once for its own bucket and
once for each flipped high bit; the bucket's task spells out the rest, sorts
the variants and verifies each colliding pair by Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, map_in_arrow, mix64, partitions_for, stored, table
from .components import components
from .shingles import name_of, parity, shared_rare, shingle_sets, unlinked, verified
from .substring import Words

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; fewer words: the whole sequence; none: nothing."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.append(0, end[:-1] + 1)
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(line[a:b], 42) for a, b in zip(start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, shingle: int, words: int, repeats: bool = True) -> bytes:
    """``words`` 64-bit fingerprints, little-endian; the first is of the hashes themselves, the rest of hashes mixed from them.

    Without ``repeats`` each different shingle counts once, as in a Jaccard similarity.
    """
    h = _hashes(text, shingle)
    return _sum(h if repeats else np.unique(h), words)


def _sum(h: np.ndarray, words: int) -> bytes:
    out = np.zeros(words, np.uint64)
    lane = 256 * np.arange(8)
    for w in range(words if len(h) else 0):
        x = h if not w else mix64(h + np.uint64(w * 0x9E3779B97F4A7C15 % 2**64))
        seen = np.zeros(2048, np.int64)
        for i in range(0, len(x), 1 << 16):
            seen += np.bincount((x[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8) + lane).ravel(), minlength=2048)
        ones = np.einsum("ij,jk->ik", seen.reshape(8, 256), _BITS).ravel()
        out[w] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out.tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, keep: tuple[str, ...] = ("doc_id",), repeats: bool = True) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``fp``, the SimHash of the text (A-Z lower-cased; null: no words, all bits zero)."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col("text").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t or b"", shingle, words, repeats) for t in b.column(len(names)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.binary())], [*names, "fp"])

    kinds = dict(rows.dtypes)
    out = rows.transform(map_in_arrow, run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", fp binary")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "fp")


def _block(fp: np.ndarray, j: int, bits: int) -> np.ndarray:
    """Block ``j`` of ``bits`` bits of each fingerprint (rows of 64-bit words)."""
    w, s = divmod(j * bits, 64)
    x = fp[:, w] >> np.uint64(s)
    if s + bits > 64:
        x = x | (fp[:, w + 1] << np.uint64(64 - s))
    return x & np.uint64((1 << bits) - 1)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class _Forest:
    """Union-find that keeps the links that joined anything: a spanning forest."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _link(members: np.ndarray, fp: np.ndarray, most: int, forest: _Forest) -> None:
    """Joins what links within a group of one variant. What has been reached is compared with what hasn't, a few at a time; pairs aren't listed."""
    rest = members
    while len(rest) > 1:
        edge, rest = rest[:1], rest[1:]
        while len(edge) and len(rest):
            now, edge = edge[:32], edge[32:]
            hit = _far(fp[now][:, None, :], fp[rest][None, :, :]) <= most
            found = hit.any(axis=0)
            for x, y in zip(now[hit.argmax(axis=0)[found]].tolist(), rest[found].tolist(), strict=True):
                forest.join(x, y)
            edge, rest = np.concatenate([edge, rest[found]]), rest[~found]


_EDGE = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def ball_edges(fps: DataFrame, words: int = 1, block_bits: int = 64, blocks: int = 1, most: int = 2) -> DataFrame:
    """Links ``(a, b)`` between the distinct fingerprints of column ``fp``, enough to connect all that link.

    Two fingerprints link if they differ in at most ``most`` bits and some block
    in at most two. Each block emits all variants within one bit. A
    bucket's task returns a spanning forest of its verified links, fewer rows than
    fingerprints it holds, each of them a link: nothing that links is left apart.
    """
    n = partitions_for(fps)
    top = max(1, (max(1, -(-n // blocks)) - 1).bit_length())
    low = block_bits - top

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, words)
            part, flip, row = [], [], []
            for j in range(blocks):
                high = (_block(fp, j, block_bits) >> np.uint64(low)).astype(np.int64)
                for f in range(-1, top):
                    part.append((j << top) + (high if f < 0 else high ^ (1 << f)))
                    flip.append(np.full(len(fp), f, np.int8))
                    row.append(np.arange(len(fp)))
            part, flip, row = (np.concatenate(x) for x in (part, flip, row))
            o = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[o], prepend=-1))
            out = [(int(part[i[0]]), flip[i].tobytes(), fp[row[i]].tobytes()) for i in np.split(o, cuts[1:])]
            yield table(out, pa.schema([("bucket", pa.int32()), ("flip", pa.binary()), ("fps", pa.binary())]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for bucket, flip, fps_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(bucket, []).append((flip, fps_))
        for bucket in sorted(held):
            flip, fp = (b"".join(x) for x in zip(*held.pop(bucket), strict=True))
            flip, fp = np.frombuffer(flip, np.int8), np.frombuffer(fp, np.uint64).reshape(-1, words)
            own, at_home = _block(fp, bucket >> top, block_bits), np.flatnonzero(flip < 0)
            away = np.flatnonzero(flip >= 0)
            keys = [own[at_home], own[away] ^ (np.uint64(1) << (flip[away].astype(np.uint64) + np.uint64(low)))]
            keys += [own[at_home] ^ np.uint64(1 << f) for f in range(low)]
            row = np.concatenate([at_home, away, *[at_home] * low])
            keys = np.concatenate(keys)
            o = np.argsort(keys, kind="stable")
            keys, row = keys[o], row[o]
            s = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(s, len(keys)))
            forest = _Forest(len(fp))
            for m in range(2, 9):  # pairs of small groups all at once
                at = s[size == m]
                for i, j in zip(*np.triu_indices(m, 1), strict=True):
                    x, y = row[at + i], row[at + j]
                    near = _far(fp[x], fp[y]) <= most
                    for k, l in set(zip(x[near].tolist(), y[near].tolist(), strict=True)):  # noqa: E741
                        forest.join(k, l)
            for a, k in zip(s[size > 8].tolist(), size[size > 8].tolist(), strict=True):
                _link(np.sort(row[a : a + k]), fp, most, forest)
            yield table([(fp[x].tobytes(), fp[y].tobytes()) for x, y in forest.links], _EDGE)

    dealt = fps.select("fp").transform(map_in_arrow, deal, "bucket int, flip binary, fps binary")
    return dealt.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).transform(map_in_arrow, meet, "a binary, b binary")


def near_duplicates(fps: DataFrame, words: int = 1, block_bits: int = 64, blocks: int = 1, most: int = 2) -> DataFrame:
    """``fps`` (doc_id, fp, ...) with ``component_id``, the least doc_id that links reach, itself included, and label, the component's name.

    Fingerprints link if they differ in at most ``most`` bits (with several
    blocks: and one block in at most two). Equal fingerprints are one class,
    counted once however many documents share it; links are sought between
    classes. ``fps`` should be a stored table: it is read twice. A null doc_id
    joins its class but is never the least; a component without any other
    doc_id has a null component_id. Repeated rows come back as often as given.
    """
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(ball_edges(classes, words, block_bits, blocks, most))
    of = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("first").alias("component_id"))
    return fps.join(of.join(least, "label").select("fp", "component_id", "label"), "fp")


def _sketches(texts: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc, th, c, n, fp, small, bits) of ``texts`` (doc, th, text): the shingle set's name and size, its fingerprint and bitmaps. A task gives the last three once for each set, then nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hashed = Words()
        for b in batches:
            names, sizes, fps, small, bits = [], [], [], [], []
            for h in shingle_sets([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()], shingle, hashed):
                name = name_of(h)
                new = name not in seen
                seen.add(name)
                names.append(name)
                sizes.append(len(h))
                fps.append(_sum(h, words) if new else None)
                small.append(parity(h, 128) if new else None)
                bits.append(parity(h) if new else None)
            more = [pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(x, pa.binary()) for x in (fps, small, bits))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *more], ["doc", "th", "c", "n", "fp", "small", "bits"])

    return texts.select("doc", "th", "text").transform(map_in_arrow, run, "doc bigint, th bigint, c bigint, n bigint, fp binary, small binary, bits binary")


def _candidates(classes: DataFrame, words: int, block_bits: int, blocks: int, most: int) -> DataFrame:
    """Pairs (a, b) of names of ``classes`` (c, fp) whose fingerprints link or are the same."""
    first = stored(classes.groupBy("fp").agg(F.min("c").alias("first")))
    of = lambda end: first.select(F.col("fp").alias(end), F.col("first").alias(f"c_{end}"))
    links = ball_edges(first, words, block_bits, blocks, most).distinct().join(of("a"), "a").join(of("b"), "b")
    same = classes.select("c", "fp").join(first, "fp").where("c <> first")
    return links.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).union(same.select("c", "first"))


def distinct_documents(docs: DataFrame, shingle: int = 5, words: int = 4, block_bits: int | None = None, most: int = 48, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near copies: of each group of linked texts the row of the least doc_id stays.

    Texts link if the Jaccard similarity of their sets of ``shingle``-word shingles is
    ``similarity`` or more, so a shingle counts once however often a text
    repeats it; every link is verified by the two sets. Fingerprints of 64 times
    ``words`` bits propose the first pairs, by ball hashing of their blocks of ``block_bits`` (by default 24,
    more from 2**26 texts on, so that chance meetings stay few): those that differ in ``most`` bits at most. An exact search (prefix filtering) then proposes all
    pairs that may be similar enough and aren't in one group yet, so none is
    missed. Nulls in doc_id sort last; of repeated rows one stays; texts without
    words are one group; an empty table gives an empty result. All columns are
    kept, whatever their names.
    """
    key = ["loomtext_doc", "loomtext_th"]
    keyed = docs.withColumn(key[0], id_key()).withColumn(key[1], F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = keyed.select(F.col(key[0]).alias("doc"), F.col(key[1]).alias("th"), "text")
    rows = stored(_sketches(texts, shingle, words))
    one = F.struct("n", "fp", "small", "bits", "doc", "th")
    classes = stored(rows.where("fp is not null").groupBy("c").agg(F.min_by(one, F.struct("doc", "th")).alias("x")).select("c", "x.*"))
    bits = block_bits or min(32, max(24, classes.count().bit_length() - 2))
    links = verified(_candidates(classes, words, bits, 64 * words // bits, most), classes, texts, shingle, similarity)
    near = unlinked(shared_rare(texts, shingle, similarity), classes, components(links), similarity)
    links = links.union(verified(near, classes, texts, shingle, similarity))
    groups = rows.join(components(links), F.col("c") == F.col("node"), "left").select("doc", "th", F.coalesce("label", "c").alias("label"))
    stay = groups.groupBy("label").agg(F.min(F.struct("doc", "th")).alias("k")).select("k.*")
    times = groups.groupBy("doc", "th").agg(F.count("*").alias("times"))
    stay = stored(stay.join(times, ["doc", "th"]).select(F.col("doc").alias(key[0]), F.col("th").alias(key[1]), "times"))
    # rows that are there once need no shuffle of texts
    once = keyed.join(stay.where("times = 1"), key, "left_semi")
    again = keyed.join(stay.where("times > 1"), key, "left_semi").dropDuplicates(key)
    return once.union(again).drop(*key)
