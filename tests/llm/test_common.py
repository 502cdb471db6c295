"""The Arrow helper: same rows, small batches, the session's own bound left alone."""

import pyarrow as pa

from loomtext.llm.common import bounded_batches, drop_stored, map_in_arrow, stored

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b.num_rows] * b.num_rows, pa.int64())], ["id", "n"])


def test_map_in_arrow_bounds_batches(spark):
    before = spark.conf.get(KEY, None)
    rows = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 100000) AS t")
    try:
        spark.conf.unset(KEY)
        assert max(r["n"] for r in map_in_arrow(rows, _sizes, "id bigint, n bigint").collect()) == 40
        assert spark.conf.get(KEY, None) is None  # operators leave the session's settings alone
        bounded_batches(spark, 1 << 20)
        out = map_in_arrow(rows, _sizes, "id bigint, n bigint").collect()
        assert sorted(r["id"] for r in out) == list(range(40))
        assert max(r["n"] for r in out) < 40
        spark.conf.set(KEY, "33554432")
        bounded_batches(spark)
        assert map_in_arrow(rows.limit(0), _sizes, "id bigint, n bigint").collect() == []
        assert spark.conf.get(KEY).rstrip("b") == "33554432"
    finally:
        spark.conf.set(KEY, before) if before else spark.conf.unset(KEY)


def test_stored_tables_can_be_dropped(spark):
    rows = stored(spark.range(3))
    (path,) = {f.rsplit("/", 1)[0] for f in rows.inputFiles()}
    assert rows.count() == 3
    drop_stored(spark)
    assert not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
