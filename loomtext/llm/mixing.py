"""Mixing sources to target weights, in DataFrame functions only.

Each source's words form one stream, cut into blocks of ``block`` words. A mix
is made of slots: every output shard draws the sources of its seats from a
multinomial over the sources' quotas; a source's slots are numbered through the
shards, and slot number k of pass p takes the block that a pseudorandom
permutation of the source's block indices gives for k. Seats that a source draws
beyond its quota go, in pseudorandom order, to the slots of sources that drew
too few, so each source gives exactly the whole part of its target and every
shard stays a mix; the slot that completes a quota takes the first words of its
block. Slots and blocks join by block index, which is spread evenly however
large a source is, and no source's rows ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, id_key, partitions_for

_ROUNDS = 12


def _number(*parts) -> Column:
    """A pseudorandom number of 48 bits that any SQL engine with MD5 can repeat."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, skey (the source, null apart from all texts), th (text hash), size in words (null text: 0)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: skey, source_size, weight and target, in words.

    Sources in order of code points, null last, have the ``weights`` in turn and
    share ``share`` times all words by weight. A target stops at ``cap`` times
    its source's size and the excess is shared anew: in order of how early they
    stop, the first source that needn't stop gives the level of all the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    most = F.lit(float(cap)) * F.col("source_size")
    by_stop = Window.orderBy(most / F.col("weight"), "skey")
    before, everything = by_stop.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", left / weight_left).withColumn("at", F.row_number().over(by_stop))
    level = F.min(F.when(F.col("level") * F.col("weight") <= most, F.struct("at", "level"))).over(everything)["level"]
    return rows.select("skey", "source_size", "weight", F.coalesce(F.least(most, level * F.col("weight")), most).alias("target"))


def _quotas(targets: DataFrame, block: int, seed: int) -> DataFrame:
    """What a source gives: take (words), n_blocks, slots; and for each pass its words, the place of the short last block, the round keys."""
    size, take = F.col("source_size"), F.floor("target").cast("long")
    rows = targets.where("source_size > 0 and target >= 1").select("skey", "source_size", take.alias("take"), F.ceil(size / block).cast("long").alias("n_blocks"))
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(take - 1) div source_size"))))
    rows = rows.withColumn("words", F.least(size, F.col("take") - F.col("pass") * size))
    rows = rows.withColumn("slots", F.least(F.col("n_blocks"), F.expr(f"words div {block}") + 2))
    keys = F.transform(F.sequence(F.lit(0), F.lit(_ROUNDS - 1)), lambda r: F.struct(r.alias("r"), (_number(seed, F.col("skey"), F.col("pass"), r) % F.col("n_blocks")).alias("key")))
    rows = rows.withColumn("rounds", keys)
    return rows.withColumn("short", _permuted(F.col("n_blocks") - 1, F.reverse("rounds"), seed))


def _permuted(x: Column, rounds: Column, seed: int) -> Column:
    """A swap-or-not shuffle of 0 .. n_blocks - 1: each round may swap x with key - x. Rounds in reverse order undo it."""

    def swap(x, step):
        other = (step["key"] + F.col("n_blocks") - x) % F.col("n_blocks")
        coin = _number(seed, "swap", F.col("skey"), F.col("pass"), step["r"], F.greatest(x, other)) % 2
        return F.when(coin == 1, other).otherwise(x)

    return F.aggregate(rounds, x.cast("long"), swap)


def _slots(quotas: DataFrame, block: int, shard_slots: int, seed: int) -> tuple[DataFrame, int]:
    """(skey, pass, block, words, shard, slot): which block each slot takes, how many of its words, and in which shard it lies; and the number of shards.

    What draws leave and exceed is ordered in one task: about the square root of
    the number of seats for each source and pass, and a shard's seats.
    """
    spark = quotas.sparkSession
    total, n_rows = (x or 0 for x in quotas.agg(F.sum("slots"), F.count("*")).first())
    n_shards = -(-total // shard_slots)
    # where a drawn number falls among the quotas, by cells narrower than most quotas
    cum = Window.orderBy("skey", "pass").rowsBetween(Window.unboundedPreceding, -1)
    q = quotas.select("skey", "pass", "slots", F.coalesce(F.sum("slots").over(cum), F.lit(0)).alias("lo"))
    width = max(1, total // (4 * max(1, n_rows)))
    cells = q.withColumn("cell", F.explode(F.expr(f"sequence(lo div {width}, (lo + slots - 1) div {width})")))
    draws = spark.range(n_shards * shard_slots).select(
        F.expr(f"id div {shard_slots}").alias("shard"), (_number(seed, "draw", F.col("id")) % F.lit(max(total, 1))).alias("v")
    )
    drawn = draws.withColumn("cell", F.expr(f"v div {width}")).join(cells, "cell").where("v >= lo and v < lo + slots")
    counts = cut(drawn.groupBy("shard", "skey", "pass").agg(F.count("*").alias("n")))
    by_shard = Window.partitionBy("skey", "pass").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("k", F.coalesce(F.sum("n").over(by_shard), F.lit(0))).join(q.select("skey", "pass", "slots"), ["skey", "pass"])
    runs = runs.select("skey", "pass", "shard", "k", "n", F.least("n", F.greatest(F.col("slots") - F.col("k"), F.lit(0))).alias("used"))
    had = counts.groupBy("skey", "pass").agg(F.sum("n").alias("had"))
    short = q.join(had, ["skey", "pass"], "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < slots")
    late, free = (d.agg(F.sum(x)).first()[0] or 0 for d, x in ((short, F.expr("slots - had")), (runs, F.expr("n - used"))))
    order = Window.orderBy(_number(seed, "late", F.col("skey"), F.col("pass"), F.col("k")), "skey", "pass", "k")
    missing = short.select("skey", "pass", F.explode(F.expr("sequence(had, slots - 1)")).alias("k")).withColumn("seat", F.row_number().over(order) - 1)
    missing = missing.withColumn("seat", F.expr(f"(seat * {free}L) div {max(late, 1)}L"))
    freed = runs.groupBy("shard").agg(F.sum(F.expr("n - used")).alias("m")).where("m > 0")
    freed = freed.withColumn("c", F.coalesce(F.sum("m").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    freed = freed.select("shard", F.explode(F.expr("sequence(c, c + m - 1)")).alias("seat"))
    rest = missing.join(freed, "seat").select("skey", "pass", "shard", "k", F.lit(1).cast("long"))
    runs = runs.where("used > 0").select("skey", "pass", "shard", "k", "used").union(rest)
    # few rows make all slots, and permuting is the work: runs are dealt out first
    runs = runs.repartition(max(partitions_for(quotas), -(-total // (1 << 16)))).join(quotas, ["skey", "pass"])
    slot = runs.withColumn("slot", F.explode(F.expr("sequence(k, k + used - 1)")))
    before = F.expr(f"slot * {block} - if(slot > short, n_blocks * {block} - source_size, 0)")
    of_block = F.expr(f"if(slot = short, source_size - (n_blocks - 1) * {block}, {block})")
    slot = slot.withColumn("words", F.least(of_block, F.col("words") - before)).where("words > 0")
    return slot.select("skey", "pass", _permuted(F.col("slot"), F.col("rounds"), seed).alias("block"), "words", "shard", "slot"), n_shards


def _streams(sizes: DataFrame, lanes: int) -> DataFrame:
    """``sizes`` with ``off``, the words of its source ahead of each row: lanes are summed first, then rows within their lane. Rows without an id are dealt by text."""
    rows = sizes.withColumn("lane", _number(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), "th"))) % lanes)
    ahead = Window.partitionBy("skey").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("skey", "lane").agg(F.sum("size").alias("lane_size")).select("skey", "lane", F.coalesce(F.sum("lane_size").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("skey", "lane").orderBy(id_key(), "th", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("own", F.sum("size").over(within)).join(bases, ["skey", "lane"]).withColumn("off", F.expr("base + own - size")).drop("lane", "own", "base")


def lanes_for(rows: int) -> int:
    """Lanes of a source: 1,024, and more from 2**26 rows on, so that a lane has 2**16 rows on average."""
    return max(1024, 1 << max(0, (rows >> 16) - 1).bit_length())


def mix_pieces(sizes: DataFrame, targets: DataFrame, block: int = 256, shard_slots: int = 4096, lanes: int | None = None, seed: int = 1) -> tuple[DataFrame, int]:
    """Every piece of every document that lies in one block, with the slots that take it; and the number of shards.

    Columns: those of ``sizes`` (a stored table), off; pass, shard, slot (null if
    no slot takes the piece); lo and hi, the words taken (in the document), equal
    if none. Rows without words give no piece.
    """
    slots, n_shards = _slots(cut(_quotas(targets, block, seed)), block, shard_slots, seed)
    pieces = _streams(sizes, lanes or lanes_for(sizes.count())).where("size > 0").withColumn("block", F.explode(F.expr(f"sequence(off div {block}, (off + size - 1) div {block})")))
    joined = pieces.join(slots, ["skey", "block"], "left")
    lo = F.greatest("off", F.col("block") * block)
    hi = F.least(F.col("off") + F.col("size"), F.col("block") * block + F.coalesce("words", F.lit(0)))
    taken = joined.withColumn("lo", lo - F.col("off")).withColumn("hi", F.greatest(lo, hi) - F.col("off"))
    names = [*sizes.columns, "off", "pass", "shard", "slot", "lo", "hi"]
    return taken.select(*names), n_shards


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, **how) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target (of its source), taken; first_shard and last_shard that take any of it (null: none) and shard_words, the sum of the shards of all taken words.

    Sizes are words; a null or empty text has none and gives none. A null source
    is a source of its own, last in order. ``taken`` counts repeats; no row gives
    more than ``cap`` (a whole number) times its size. Rows are told apart by
    their place in the source's stream, so repeated rows and null ids come back
    as often as given. Reruns agree; an empty table gives an empty result; other
    columns aren't read.
    """
    sizes = cut(sized(docs).repartition(partitions_for(docs, 64 << 20)))
    targets = cut(source_targets(sizes, weights, share, cap))
    pieces, _ = mix_pieces(sizes, targets, **how)
    words, shard = F.col("hi") - F.col("lo"), F.when(F.col("hi") > F.col("lo"), F.col("shard"))
    more = [F.min(shard).alias("first_shard"), F.max(shard).alias("last_shard"), F.coalesce(F.sum(words * shard), F.lit(0)).alias("shard_words")]
    taken = pieces.groupBy("skey", "doc_id", "th", "size", "off").agg(F.sum(words).alias("taken"), *more)
    names = ["skey", "doc_id", "size", "taken", "first_shard", "last_shard", "shard_words"]
    none = F.lit(None).cast("long")
    rows = taken.select(*names).union(sizes.where("size = 0").select("skey", "doc_id", "size", "size", none, none, F.lit(0).cast("long")))
    return rows.join(targets, "skey").select("doc_id", "size", "source_size", "target", *names[3:])


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, **how) -> DataFrame:
    """The mix as documents: doc_id, text, lang, source, n_chars; one row for each document and pass that takes any of it, in order of shards.

    A text that a pass takes whole stays as it is; else its taken words, in
    order, are joined by one space. A row lies in one of the shards that take
    some of it, by a hash (the first one would gather all long texts); partitions are ranges of shards, rows of a shard lie in
    pseudorandom order of sources. Nothing is taken of texts without words.
    """
    sizes = cut(sized(docs).repartition(partitions_for(docs, 64 << 20)))
    pieces, n_shards = mix_pieces(sizes, cut(source_targets(sizes, weights, share, cap)), **how)
    key = ["skey", "doc", "th"]
    spans = pieces.where("hi > lo").withColumn("doc", id_key()).groupBy(*key, "size", "off", "pass").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.min_by("shard", F.xxhash64("skey", "off", "pass", "lo")).alias("shard"))
    texts = docs.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), id_key().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.struct("doc_id", "text", "lang", "source").alias("row"),
    )
    texts = texts.groupBy(*key).agg(F.first("row").alias("row"))
    words = F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1))
    whole = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"]) == F.col("size")
    parts = F.flatten(F.transform("spans", lambda s: F.slice(F.col("words"), (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int"))))
    rows = spans.join(texts, key).withColumn("words", F.when(whole, None).otherwise(words))
    rows = rows.withColumn("text", F.when(F.col("words").isNull(), F.col("row.text")).otherwise(F.array_join(parts, " ")))
    n = partitions_for(docs)
    rows = rows.repartitionById(n, F.expr(f"shard * {n} div {max(n_shards, 1)}").cast("int")).sortWithinPartitions("shard", F.xxhash64("skey", "off", "pass"))
    return rows.select("row.doc_id", "text", "row.lang", "row.source", F.length("text").cast("long").alias("n_chars"))


def oracle(block: int = 256, shard_slots: int = 4096, lanes: int = 1024, seed: int = 1) -> str:
    """DuckDB SQL of ``mix`` over ``documents`` (up to 2**26 rows) with weights 3, 1, 2, 150 % and a limit of 2."""

    def number(text: str) -> str:
        return f"('0x' || substr(md5({text}), 1, 12))::BIGINT"

    x, chain = "slot", "slots"
    for r in range(_ROUNDS):
        key = number(f"'{seed}|' || skey || '|' || pass || '|{r}'") + " % n_blocks"
        other = f"(({key}) + n_blocks - {x}) % n_blocks"
        coin = number(f"'{seed}|swap|' || skey || '|' || pass || '|{r}|' || greatest({x}, other)") + " % 2"
        chain = f"(SELECT * EXCLUDE (other), CASE WHEN {coin} = 1 THEN other ELSE {x} END AS x{r} FROM (SELECT *, {other} AS other FROM {chain}))"
        x = f"x{r}"
    return f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         {number("doc_id::VARCHAR")} % {lanes} AS lane
  FROM documents),
sources AS (
  SELECT skey, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM sizes GROUP BY skey, source),
levels AS (
  SELECT *, row_number() OVER w AS place,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER b, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM sources WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size::DOUBLE / weight::DOUBLE, skey),
                      b AS (ORDER BY 2.0::DOUBLE * source_size::DOUBLE / weight::DOUBLE, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT skey, source_size, least(2.0::DOUBLE * source_size::DOUBLE, (SELECT arg_min(level, place) FROM levels WHERE level * weight::DOUBLE <= 2.0::DOUBLE * source_size::DOUBLE) * weight::DOUBLE) AS target
  FROM levels),
passes AS (
  SELECT *, least(source_size, floor(target)::BIGINT - pass * source_size) AS words
  FROM (SELECT skey, source_size, target, (source_size + {block - 1}) // {block} AS n_blocks, unnest(range(0, (floor(target)::BIGINT + source_size - 1) // source_size)) AS pass
        FROM targets WHERE source_size > 0 AND target >= 1)),
quotas AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY skey, pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo
  FROM (SELECT *, least(n_blocks, words // {block} + 2) AS slots FROM passes)),
drawn AS (
  SELECT q.skey, q.pass, q.slots, d.shard, row_number() OVER (PARTITION BY q.skey, q.pass ORDER BY d.id) - 1 AS slot
  FROM (SELECT id, id // {shard_slots} AS shard, {number(f"'{seed}|draw|' || id")} % (SELECT sum(slots)::BIGINT FROM quotas) AS v
        FROM (SELECT unnest(range(0, ((SELECT sum(slots)::BIGINT FROM quotas) + {shard_slots - 1}) // {shard_slots} * {shard_slots})) AS id)) d ASOF JOIN quotas q ON d.v >= q.lo),
freed AS (SELECT shard, row_number() OVER (ORDER BY shard) - 1 AS seat FROM drawn WHERE slot >= slots),
missing AS (
  SELECT skey, pass, slot, row_number() OVER (ORDER BY {number(f"'{seed}|late|' || skey || '|' || pass || '|' || slot")}, skey, pass, slot) - 1 AS x
  FROM (SELECT skey, pass, unnest(range(had, slots)) AS slot FROM (
    SELECT q.skey, q.pass, q.slots, count(d.slot) AS had FROM quotas q LEFT JOIN drawn d ON q.skey = d.skey AND q.pass = d.pass GROUP BY ALL))),
seated AS (
  SELECT skey, pass, slot, shard FROM drawn WHERE slot < slots
  UNION ALL SELECT skey, pass, slot, shard FROM missing JOIN freed ON seat = x * (SELECT count(*) FROM freed) // (SELECT count(*) FROM missing)),
slots AS (SELECT q.*, s.slot, s.shard FROM quotas q JOIN seated s ON q.skey = s.skey AND q.pass = s.pass),
placed AS (
  SELECT skey, pass, block, shard, greatest(0, least(of_block, words - ahead)) AS words
  FROM (SELECT *, coalesce(sum(of_block) OVER (PARTITION BY skey, pass ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
        FROM (SELECT *, {x} AS block, least({block}, source_size - {x} * {block}) AS of_block FROM {chain}))),
docs AS (
  SELECT *, sum(size) OVER (PARTITION BY skey ORDER BY lane, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - size AS off FROM sizes),
pieces AS (SELECT *, unnest(range(off // {block}, (off + size - 1) // {block} + 1)) AS block FROM docs WHERE size > 0),
cuts AS (
  SELECT p.doc_id, w.shard, greatest(0, least(off + size, p.block * {block} + w.words) - greatest(off, p.block * {block}))::BIGINT AS n
  FROM pieces p JOIN placed w ON p.skey = w.skey AND p.block = w.block),
taken AS (
  SELECT doc_id, sum(n)::BIGINT AS taken, min(shard) FILTER (n > 0) AS first_shard, max(shard) FILTER (n > 0) AS last_shard, sum(n * shard)::BIGINT AS shard_words FROM cuts GROUP BY doc_id)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken, first_shard, last_shard, coalesce(shard_words, 0)::BIGINT AS shard_words
FROM docs d JOIN targets t USING (skey) LEFT JOIN taken k ON d.doc_id = k.doc_id"""
