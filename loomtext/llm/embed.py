"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are one class and travel once. Each table gives a class the signs
of its vector against random hyperplanes; classes with the same signs share a
bucket, where cosines are computed in blocks and pairs counted, not listed. A
pair counts in the first table that holds it, which tasks tell by signing its
vectors for the tables before. Large buckets are split into
blocks of which each pair is a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, stored, table
from .components import components

_SEED = 20_240_229
_EDGE = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def tables_for(n: int, cosine: float, recall: float, bucket: int = 512) -> tuple[int, int]:
    """Signs of a table and tables: about ``bucket`` vectors share a bucket by chance; pairs at ``cosine`` are found with probability ``recall``, closer ones oftener.

    Vectors travel once for each table, cosines are cheap: so few tables of full buckets.
    """
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / bucket))) if n > 16 * bucket else 4)
    hit = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _planes(dim: int, bits: int, n_tables: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([_SEED, dim, bits])).standard_normal((n_tables * bits, dim))


def _usable(vectors: DataFrame, kind: np.dtype) -> DataFrame:
    """vec_id and vec: the vector as bytes of ``kind``; null if it links with nothing (null id, null or empty vector, null or non-finite component, all zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            size = np.diff(v.offsets.to_numpy())
            x = v.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # nulls are NaN, minus zero is zero
            row = np.repeat(np.arange(len(size)), size)
            bad = np.bincount(row, ~np.isfinite(x), len(size)) + (np.bincount(row, x != 0, len(size)) == 0)
            raw, ends = x.tobytes(), np.cumsum(size) * kind.itemsize
            ok = (bad == 0) & b.column(0).is_valid().to_numpy(zero_copy_only=False) & v.is_valid().to_numpy(zero_copy_only=False)
            out = [raw[e - n : e] if k else None for e, n, k in zip(ends.tolist(), (size * kind.itemsize).tolist(), ok.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    name = "float" if kind.itemsize == 4 else "double"
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{name}>")).mapInArrow(run, "vec_id bigint, vec binary")


class _Signs:
    """Numbers of vectors' buckets in the first tables."""

    def __init__(self, bits: int):
        self.bits, self.planes = bits, {}

    def __call__(self, x: np.ndarray, n_tables: int) -> np.ndarray:
        dim = x.shape[1]
        if len(self.planes.get(dim, ())) < n_tables * self.bits:
            self.planes[dim] = _planes(dim, self.bits, n_tables)
        up = x @ self.planes[dim][: n_tables * self.bits].T > 0
        return (up.reshape(len(x), n_tables, self.bits) * (1 << np.arange(self.bits, dtype=np.int64))).sum(axis=2)


def _signed(classes: DataFrame, bits: int, n_tables: int, kind: np.dtype) -> DataFrame:
    """``classes`` (rep, n, vec) with signs, an array of one number for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _Signs(bits)
        for b in batches:
            vecs = b.column(2).to_pylist()
            signs = np.zeros((len(vecs), n_tables), np.int64)
            for size in {len(v) for v in vecs}:
                at = [i for i, v in enumerate(vecs) if len(v) == size]
                x = np.frombuffer(b"".join(vecs[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)
                for lo in range(0, len(at), 4096):
                    signs[at[lo : lo + 4096]] = sign(x[lo : lo + 4096], n_tables)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(signs), pa.list_(pa.int64()))], ["rep", "n", "vec", "signs"])

    return classes.select("rep", "n", "vec").mapInArrow(run, "rep bigint, n bigint, vec binary, signs array<bigint>")


def _links(x, y, sx, sy, cosine: float, same: bool, rows: int = 512):
    """Per block of rows: where cosines reach the bound and, of those, which pairs no earlier table (sx, sy: their signs) holds."""
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    for a in range(0, len(x), rows):
        near = (x[a : a + rows] @ y.T) / (nx[a : a + rows, None] * ny[None, :]) >= cosine
        if same:
            near[np.arange(near.shape[0]), np.arange(a, a + near.shape[0])] = False
        new = near.copy()
        for k in range(sx.shape[1]):
            if not new.any():
                break
            new &= sx[a : a + rows, k, None] != sy[None, :, k]
        yield a, near, new


def _bucket(t: int, rep, n, x, block, sign: _Signs, cosine: float) -> list[tuple[int, int, int]]:
    """(rep, links, root) of a bucket's classes, in order of rep: links with class members that no earlier table gives, and the least class that it reaches here."""
    links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
    signs = sign(x, t) if t else np.zeros((len(x), 0), np.int64)
    sides = [np.flatnonzero(block == k) for k in np.unique(block)]
    i, j = sides[0], sides[-1]
    for a, near, new in _links(x[i], x[j], signs[i], signs[j], cosine, len(sides) == 1):
        own = i[a : a + len(near)]
        links[own] += new @ n[j]
        if len(sides) > 1:
            links[j] += n[own] @ new
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            there = label[j[near[r]]]
            if (there != label[own[r]]).any():
                met = np.unique(np.append(there, label[own[r]]))
                label[np.isin(label, met)] = met[0]
    return [(int(rep[k]), int(links[k]), int(rep[label[k]])) for k in np.flatnonzero((links > 0) | (label != np.arange(len(rep)))).tolist()]


def _meet(cosine: float, bits: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, vecs, sign = [], [], _Signs(bits)
        for b in batches:
            held.append(np.column_stack([b.column(c).to_numpy().astype(np.int64) for c in range(7)]))
            vecs += b.column(7).to_pylist()
        if not vecs:
            return
        rows = np.concatenate(held)
        size = np.array([len(v) for v in vecs], np.int64)
        t, at, lo, hi, block, rep, n = rows.T
        o = np.lexsort((rep, size, hi, lo, at, t))
        key = np.column_stack([t, at, lo, hi, size])[o]
        starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(o)], strict=True):
            k = o[a:z]
            if len(k) < 2 or (lo[k[0]] != hi[k[0]] and (block[k] == block[k[0]]).all()):
                continue
            x = np.frombuffer(b"".join(vecs[i] for i in k.tolist()), kind).reshape(len(k), -1).astype(np.float64)
            yield table(_bucket(int(t[k[0]]), rep[k], n[k], x, block[k], sign, cosine), _EDGE)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995, bucket_rows: int = 2048) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs found with a cosine (in double precision) of ``cosine`` or
    more; ``recall`` is the chance of finding a pair at the bound itself. Vectors
    that are null, empty, all zero, or hold null or non-finite components, and
    rows with a null vec_id, link with nothing and are their own component.
    Vectors of different lengths don't link. Equal vectors always link; they are
    one class, whose members each count. Rows of equal vec_id are one vertex in
    components. An empty table gives an empty result; other columns aren't read.
    """
    # doubles stay doubles
    kind = np.dtype("<f8") if dict(vectors.dtypes)["embedding"] == "array<double>" else np.dtype("<f4")
    rows = stored(_usable(vectors, kind))
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = stored(classes)
    bits, n_tables = tables_for(classes.count(), cosine, recall)
    n = partitions_for(classes, max(1 << 16, (64 << 20) // n_tables))
    signed = stored(_signed(classes, bits, n_tables, kind))
    spread = signed.select("rep", "n", "vec", F.posexplode("signs").alias("t", "sign"))
    # large buckets are cut into blocks; a class meets each block of its bucket in another task
    large = stored(signed.select(F.posexplode("signs").alias("t", "sign")).groupBy("t", "sign").agg(F.count("*").alias("m")).where(F.col("m") > bucket_rows))
    blocks = F.coalesce(F.ceil(F.col("m") / bucket_rows), F.lit(1)).cast("int")
    spread = spread.join(large, ["t", "sign"], "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    dealt = spread.select("t", "sign", "lo", "hi", "block", "rep", "n", "vec").repartitionById(n, F.pmod(F.xxhash64("t", "sign", "lo", "hi"), F.lit(n)).cast("int"))
    met = stored(dealt.mapInArrow(_meet(cosine, bits, kind), "rep bigint, links bigint, root bigint"))
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(met, "rep", "root")
    of = classes.join(links, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    of = of.select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    out = rows.join(of, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
