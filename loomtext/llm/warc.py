"""Merkle fixity audit of web archives.

Records lie in archive files in a fixed order, each at an offset. A record's
leaf hashes its file, offset, length and digest; a node hashes the up to
``fan_out`` nodes of the next ordered range below it; a file's root closes its
ranges, and files are ranges of the archive's tree. An audit compares roots of
two replicas and goes down only where nodes differ.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

FAN_OUT = 16


def record(record_id: Column, url: Column, body: Column) -> Column:
    """The text of a response record."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def scan(raw: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes | None, str | None]]:
    """Records of an uncompressed archive file: offset, length, headers (lower-case names), body, error.

    Where the layout breaks, the bytes up to the next record's first line are one
    row with an error and no body.
    """
    at = 0
    while at < len(raw):
        error, headers, stop = None, {}, at
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            error = f"no record at {at}"
        else:
            lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = headers.get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", size):
                error = f"no length at {at}"
            else:
                stop = end + 4 + int(size)
                if raw[stop : stop + 4] != b"\r\n\r\n":
                    error = f"the record at {at} doesn't end where it says"
        if error:
            again = raw.find(b"\r\n\r\nWARC/", at + 1)
            stop = len(raw) if again < 0 else again + 4
            yield at, stop - at, headers, None, error
            at = stop
        else:
            yield at, stop + 4 - at, headers, raw[end + 4 : stop], None
            at = stop + 4


def parse(raw: bytes) -> list[tuple[int, int, dict[str, str], bytes]]:
    """``scan`` for files that must be whole: offset, length, headers, body. Raises ValueError where the layout breaks."""
    out = []
    for at, length, headers, body, error in scan(raw):
        if error:
            raise ValueError(error)
        out.append((at, length, headers, body))
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of uncompressed archive files: file, record, start, length, target_uri, body, error. What isn't a record is a row with an error; a file must fit a task."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"], strict=True):
                rows = [(name, i, a, n, h.get("warc-target-uri"), body, error) for i, (a, n, h, body, error) in enumerate(scan(raw))]
                yield pd.DataFrame(rows, columns=["file", "record", "start", "length", "target_uri", "body", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, record int, start bigint, length bigint, target_uri string, body binary, error string")


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def manifest(pages: DataFrame, n_files: int) -> DataFrame:
    """The archive layout of ``pages`` (page_id, url, html): page_id, file, record, start, length, digest, leaf.

    Pages are dealt to files by a hash of their id and lie there in order of id
    (nulls first) and digest, so the layout doesn't depend on partitions and no
    file grows with the archive if ``n_files`` does.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), text.alias("text"))
    rows = rows.select("page_id", (_number(F.coalesce(F.col("page_id"), F.lit(-1)).cast("string")) % n_files).alias("file"), F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    rows = rows.withColumn("record", F.row_number().over(order).cast("long") - 1)
    rows = rows.withColumn("start", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length"))
    return rows.withColumn("leaf", F.sha2(F.concat_ws("|", F.lit("leaf"), "file", "start", "length", "digest"), 256))


def _above(nodes: DataFrame, key: list[str], by: str) -> DataFrame:
    """The nodes of the next level: of every FAN_OUT neighbours in order of ``by``."""
    rows = nodes.groupBy(*[k for k in key if k != by], F.expr(f"{by} div {FAN_OUT}").alias(by)).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("i"), "hash"))).alias("below"))
    return rows.select(*key, F.sha2(F.concat(F.lit("node|"), F.array_join(F.transform("below", lambda x: x["hash"]), "|")), 256).alias("hash"))


def tree(leaves: DataFrame, depth: int, n_files: int) -> list[DataFrame]:
    """Levels (file, record, hash) from the leaves (a stored table) up: ``depth`` levels within files, then ranges of files up to one root.

    Each level above the leaves is stored, a sixteenth of the one below, so an
    audit reads nodes and hashes nothing again.
    """
    levels = [leaves.select("file", "record", F.col("leaf").alias("hash"))]
    for _ in range(depth):
        levels.append(cut(_above(levels[-1], ["file", "record"], "record")))
    while n_files > 1:
        levels.append(cut(_above(levels[-1], ["file", "record"], "file")))
        n_files = -(-n_files // FAN_OUT)
    return levels


def depth_for(most_records: int) -> int:
    depth = 0
    while FAN_OUT**depth < most_records:
        depth += 1
    return depth


def audit(primary: DataFrame, replica: DataFrame, n_files: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Differences of two manifests (stored tables): (file, record, in_primary, in_replica), and each one's file roots (file, root).

    Starts at the archives' roots and follows the children of differing nodes
    alone. Level sizes fall by the fan-out, and only the largest record number
    reaches the driver. Equal archives give no rows; a record that one side
    lacks shifts the offsets of its file, all of whose later leaves then differ.
    """
    most = max((d.agg(F.max("record")).first()[0] or 0 for d in (primary, replica)), default=0) + 1
    depth = depth_for(most)
    a, b = tree(primary, depth, n_files), tree(replica, depth, n_files)
    differing = None
    for level in range(len(a) - 1, -1, -1):
        x, y = a[level], b[level]
        if differing is not None:
            by = "record" if level < depth else "file"
            up = differing.select(*(F.col(k).alias(f"up_{k}") for k in ("file", "record")))
            own = {k: F.expr(f"{k} div {FAN_OUT}") if k == by else F.col(k) for k in ("file", "record")}
            on = lambda d: [own[k] == F.col(f"up_{k}") for k in own]  # noqa: B023, E731
            x, y = x.join(up, on(x), "left_semi"), y.join(up, on(y), "left_semi")
        both = x.withColumnRenamed("hash", "in_primary").join(y.withColumnRenamed("hash", "in_replica"), ["file", "record"], "full")
        differing = cut(both.where(~F.col("in_primary").eqNullSafe(F.col("in_replica"))))
    return differing, *(t[depth].select("file", F.col("hash").alias("root")) for t in (a, b))


def rotten(pages: DataFrame, one_in: int = 211) -> DataFrame:
    """A replica of ``pages`` for drills: in about one of ``one_in`` pages the first character is another one, by a rule on the id."""
    hit = (_number(F.concat(F.lit("rot"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))) % one_in == 0) & (F.length("html") > 0)
    other = F.when(F.col("html").startswith("?"), "!").otherwise("?")
    return pages.withColumn("html", F.when(hit, F.concat(other, F.expr("substring(html, 2)"))).otherwise(F.col("html")))


def files_for(pages: int, records_a_file: int = 1024) -> int:
    """Archive files for so many pages: a power of two, so that pages stay in their files while an archive grows, until it doubles."""
    return 1 << max(0, -(-pages // records_a_file) - 1).bit_length()


def audit_pages(pages: DataFrame, replica: DataFrame, records_a_file: int = 1024) -> DataFrame:
    """Every record of the primary archive with the audit's findings.

    page_id, file, record, start, length, digest, root and replica_root (of its
    file), corrupt (its leaf differs). Nulls in url or html are empty; a null
    page_id is kept; repeated rows are records of their own; an empty table gives
    an empty result; other columns aren't read.
    """
    n_files = files_for(pages.count(), records_a_file)
    a, b = cut(manifest(pages, n_files)), cut(manifest(replica, n_files))
    differing, roots, replica_roots = audit(a, b, n_files)
    found = differing.where(F.col("in_primary").isNotNull()).select("file", "record", F.lit(True).alias("corrupt"))
    rows = a.join(found, ["file", "record"], "left").join(roots, "file").join(replica_roots.withColumnRenamed("root", "replica_root"), "file", "left")
    return rows.select("page_id", "file", "record", "start", "length", "digest", "root", "replica_root", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))


def oracle(records_a_file: int = 1024, one_in: int = 211, depth: int = 4) -> str:
    """DuckDB SQL of ``audit_pages`` over ``pages`` and its drill replica, without descending: all leaves are compared."""

    def side(name: str, html: str) -> str:
        number = "('0x' || substr(md5({}), 1, 12))::BIGINT"
        hit = number.format("'rot' || page_id::VARCHAR") + f" % {one_in} = 0 AND length(html) > 0"
        body = html.format(hit=hit)
        levels = []
        for k in range(1, depth + 1):
            below = f"{name}{k - 1}"
            levels.append(f"""{name}{k} AS (SELECT file, record // {FAN_OUT} AS record,
              CASE WHEN file_depth >= {k} THEN sha256('node|' || string_agg(hash, '|' ORDER BY record)) ELSE any_value(hash) END AS hash, file_depth
              FROM {below} GROUP BY file, record // {FAN_OUT}, file_depth)""")
        return f"""
{name}t AS (SELECT page_id, {number.format("page_id::VARCHAR")} % (SELECT pow(2, ceil(log2(greatest(1, (count(*) + {records_a_file - 1}) // {records_a_file}))))::BIGINT FROM pages) AS file,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)
  || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS text
  FROM (SELECT page_id, url, coalesce({body}, '') AS body FROM pages)),
{name}m AS (SELECT page_id, file, strlen(text) AS length, sha256(text) AS digest FROM {name}t),
{name} AS (SELECT *, row_number() OVER w - 1 AS record, (sum(length) OVER w - length)::BIGINT AS start FROM {name}m WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING)),
{name}0 AS (SELECT file, record, sha256('leaf|' || file || '|' || start || '|' || length || '|' || digest) AS hash,
  (SELECT CASE WHEN max(record) = 0 THEN 0 WHEN max(record) < 16 THEN 1 WHEN max(record) < 256 THEN 2 WHEN max(record) < 4096 THEN 3 ELSE 4 END FROM {name}) AS file_depth FROM {name}),
""" + ",\n".join(levels)

    rot = "CASE WHEN {hit} THEN (CASE WHEN html LIKE '?%' THEN '!' ELSE '?' END) || substr(html, 2) ELSE html END"
    return f"""
WITH {side("p", "html")}, {side("q", rot)}
SELECT a.page_id, a.file, a.record, a.start, a.length, a.digest, ra.hash AS root, rb.hash AS replica_root, x.hash <> y.hash AS corrupt
FROM p a JOIN p0 x USING (file, record) JOIN q0 y USING (file, record)
JOIN p{depth} ra ON ra.file = a.file JOIN q{depth} rb ON rb.file = a.file"""
