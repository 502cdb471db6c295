"""Binary logistic regression by full-batch gradient descent.

Rows are sparse: one for each example, (columns array<int>, values
array<double>, label). A step is one job: tasks add up their part of the
gradient over Arrow batches against weights sent to all of them, and return one
row each; these are added up in tasks too, so the driver gets few of them and
never examples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def sigmoid(z) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def sparse_rows(features: DataFrame, targets: DataFrame, key: list[str], label: str) -> DataFrame:
    """(key, columns, values, label) from (key, column, value) and (key, label)."""
    x = features.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("column", "value"))).alias("x"))
    empty = F.expr("array()").cast("array<struct<column:int,value:double>>")
    rows = targets.select(*key, F.col(label).alias("label")).join(x, key, "left").withColumn("x", F.coalesce("x", empty))
    return rows.select(*key, F.transform("x", lambda s: s["column"]).alias("columns"), F.transform("x", lambda s: s["value"]).alias("values"), "label")


def _tree_sum(parts: DataFrame, n: int, most: int = 64) -> tuple[np.ndarray, float, float]:
    """The sums of (g, e, l) over rows that come from ``n`` tasks; tasks add them up until at most ``most`` reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, e, l = 0.0, 0.0, 0.0  # noqa: E741
        for b in batches:
            g = sum(map(np.frombuffer, b.column(0).to_pylist()), g)
            e, l = e + np.sum(b.column(1).to_numpy()), l + np.sum(b.column(2).to_numpy())  # noqa: E741
        if not np.isscalar(g):
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([e]), pa.array([l])], ["g", "e", "l"])

    while n > most:
        n = max(most, math.isqrt(n))
        parts = parts.repartition(n).mapInArrow(add, "g binary, e double, l double")
    got = parts.collect()
    return sum(np.frombuffer(r["g"]) for r in got), sum(r["e"] for r in got), sum(r["l"] for r in got)


@dataclass
class BinaryLogisticRegression:
    learning_rate: float = 0.15
    max_iter: int = 600
    l2: float = 0.0
    tolerance: float = 1e-7
    weights: np.ndarray | None = None
    bias: float = 0.0
    history: list[float] = field(default_factory=list)

    def __post_init__(self):
        if self.learning_rate <= 0 or self.max_iter < 1 or self.l2 < 0 or self.tolerance < 0:
            raise ValueError("bad hyper-parameters")

    def fit(self, rows: DataFrame, n_columns: int) -> BinaryLogisticRegression:
        """``rows``: columns, values, label (0 or 1). Stops when the loss has moved less than the tolerance, after the update."""
        spark = rows.sparkSession
        # each step plans anew: from stored rows it has nothing to plan, and a lost executor costs no recomputation
        rows = cut(rows.select("columns", "values", F.col("label").cast("double").alias("label")))
        n, bad, last, first = rows.agg(F.count("*"), F.sum(F.when(F.col("label").isin(0.0, 1.0), 0).otherwise(1)), F.max(F.array_max("columns")), F.min(F.array_min("columns"))).first()
        if not n or bad:
            raise ValueError("labels must be 0 or 1, and there must be some")
        if last is not None and (last >= n_columns or first < 0):
            raise ValueError(f"columns must be from 0 to {n_columns - 1}")
        rows_at_once = rows.rdd.getNumPartitions()
        w, b, self.history = np.zeros(n_columns), 0.0, []
        for _ in range(self.max_iter):
            shared = spark.sparkContext.broadcast((w, b))

            def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                w, b = shared.value  # noqa: B023
                gradient, off, loss = np.zeros(n_columns), 0.0, 0.0
                for batch in batches:
                    c, v, y = batch.column(0), batch.column(1), batch.column(2).to_numpy()
                    row = np.repeat(np.arange(len(y)), np.diff(c.offsets.to_numpy()))
                    c, v = c.flatten().to_numpy(), v.flatten().to_numpy()
                    p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v * w[c], len(y)) + b, -500, 500)))
                    e = p - y
                    gradient += np.bincount(c, v * e[row], n_columns)
                    off += e.sum()
                    p = np.clip(p, 1e-12, 1 - 1e-12)
                    loss -= (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
                yield pa.RecordBatch.from_arrays([pa.array([gradient.tobytes()]), pa.array([off]), pa.array([loss])], ["g", "e", "l"])

            gradient, off, loss = _tree_sum(rows.mapInArrow(part, "g binary, e double, l double"), rows_at_once)
            w, b = w - self.learning_rate * (gradient / n + self.l2 * w), b - self.learning_rate * off / n
            self.history.append(loss / n + self.l2 / 2 * float(w @ w))
            shared.destroy()
            if len(self.history) > 1 and abs(self.history[-1] - self.history[-2]) < self.tolerance:
                break
        self.weights, self.bias = w, b
        return self

    def decision(self, rows: DataFrame) -> DataFrame:
        """``rows`` with z, the raw score."""
        if self.weights is None:
            raise RuntimeError("fit first")
        w = F.array(*map(F.lit, self.weights.tolist())) if len(self.weights) <= 64 else None
        if w is not None:
            z = F.aggregate(F.arrays_zip("columns", "values"), F.lit(float(self.bias)), lambda a, x: a + x["values"] * F.get(w, x["columns"]))
            return rows.withColumn("z", z)
        shared, bias = rows.sparkSession.sparkContext.broadcast(self.weights), self.bias
        kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c, v = b.column(b.schema.get_field_index("columns")), b.column(b.schema.get_field_index("values"))
                row = np.repeat(np.arange(b.num_rows), np.diff(c.offsets.to_numpy()))
                z = np.bincount(row, v.flatten().to_numpy() * shared.value[c.flatten().to_numpy()], b.num_rows) + bias
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z)], [*b.schema.names, "z"])

        return rows.mapInArrow(run, f"{kinds}, z double")

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        return self.decision(rows).withColumn("probability", sigmoid("z"))

    def predict(self, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
        if not 0 < threshold < 1:
            raise ValueError("threshold must lie between 0 and 1")
        return self.predict_proba(rows).withColumn("pred", (F.col("probability") >= threshold).cast("int"))


def sql_steps(rows: DataFrame, columns: list[str], label: str, rate: float = 0.15, steps: int = 3) -> DataFrame:
    """A few gradient steps over dense columns in DataFrame functions alone: (step, loss, bias, one weight a column).

    Equal examples are counted first and weigh as many as they are. Each step's
    state is stored, so that the next one doesn't plan the former again.
    """
    names = [f"x_{i}" for i in range(len(columns))]
    examples = cut(rows.groupBy(*(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)), F.col(label).alias("y")).agg(F.count("*").alias("n")))
    total = F.sum("n")
    mean = lambda x: F.sum(F.col("n") * x) / total
    state, out = {n: 0.0 for n in ("bias", *names)}, []
    for step in range(1, steps + 1):
        z = F.lit(state["bias"])
        for n in names:
            z = z + F.col(n) * F.lit(state[n])
        said = examples.withColumn("p", sigmoid(z))
        p, y = F.greatest(F.least("p", F.lit(1 - 1e-12)), F.lit(1e-12)), F.col("y")
        e = F.col("p") - y
        got = said.agg(*(mean(F.col(n) * e).alias(n) for n in names), mean(e).alias("bias"), mean(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("loss")).first()
        state = {n: w - rate * got[n] for n, w in state.items()}
        out.append((step, *(round(state[n], 6) for n in names), round(state["bias"], 6), round(got["loss"], 6)))
    kinds = ", ".join(["step int", *(f"w_{i} double" for i in range(len(columns))), "bias double", "loss double"])
    return rows.sparkSession.createDataFrame(out, kinds)
