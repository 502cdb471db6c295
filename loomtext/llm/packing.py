"""Best-fit packing of token sequences by a linear grouping scheme.

Lengths are whole numbers up to the capacity, so all that the plan needs is how
often each length occurs: at most ``capacity`` counts, whatever the input's
size. The plan rounds large lengths up within groups of equal cardinality,
solves the configuration program of the few rounded sizes by column generation,
puts actual lengths for the rounded ones, and best-fits what is left and the
small lengths into the room of open sequences. It says, for each length, which
ranks go where; ranks come from a two-step count, so no length's rows meet in
one task.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_key, map_in_arrow, table

TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker remembers before it starts anew: about 150 bytes each, which it keeps between tasks.
_REMEMBERED = 1_200_000
#: ASCII marks that make one token run after letters (an apostrophe may begin a contraction).
_END_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: A capital sigma's lower case depends on what follows it.
_SIGMA = "\u03a3".encode()


class _Old(dict):
    """Characters that have been letters since Unicode 3.2, looked up once each."""

    def __missing__(self, c: str) -> bool:
        self[c] = found = unicodedata.ucd_3_2_0.category(c)[0] == "L"
        return found


class _Encoder:
    """Token ids of texts, as little-endian bytes.

    The default vocabulary drops white space before it looks for tokens, so the
    ids of a text are those of its words in turn, and a worker remembers the
    words it has met. A new word of letters and closing marks is its letters'
    ids and its marks', unless a letter's lower case isn't letters alone, or depends on
    what follows. Letters are encoded many words at a time, with a digit,
    whose one id occurs in no word of letters, between them. A tokenizer of
    another path gets whole texts.
    """

    def __init__(self, path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.by_word = path is None
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer, self.known, self.most, self.old = Tokenizer.from_file(path), {}, _REMEMBERED, _Old()
        if self.by_word:
            (self.digit,) = self.ids(["0"])[0]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, text: str) -> bool:
        """Whether the tokenizer is sure to take ``text`` for one run of letters, in lower case too, whatever its version of Unicode."""
        return text.isalpha() and text.lower().isalpha() and all(self.old[c] for c in text)

    def learn(self, new: list[bytes]) -> None:
        known, whole, letters, later = self.known, [], {}, []
        for word in new:
            core = word.rstrip(_END_MARKS)
            if core.isalpha():  # ASCII letters
                low = core.lower()
            elif self.letters(core.decode()) and not (len(core) < len(word) and _SIGMA in core):
                low = core
            else:
                whole.append(word)
                continue
            marks = word[len(core) :]
            if low not in known:
                letters[low] = None
            if marks and marks not in known:
                whole.append(marks)
            later.append((word, low, marks))
        for word, ids in zip(whole, self.ids([w.decode() for w in whole]), strict=True):
            known[word] = np.array(ids, "<u4").tobytes()
        if letters:
            ids = np.array(self.ids([" 0 ".join(w.decode() for w in letters)])[0], "<u4")
            ends = np.append(np.flatnonzero(ids == self.digit), len(ids)).tolist()
            raw, begin = ids.tobytes(), 0
            for word, end in zip(letters, ends, strict=True):
                known[word] = raw[4 * begin : 4 * end]
                begin = end + 1
        for word, low, marks in later:
            known[word] = known[low] + known[marks] if marks else known[low]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [np.array(ids, "<u4").tobytes() for ids in self.ids([t.decode() for t in texts])]
        if len(self.known) > self.most:
            self.known.clear()
        words = [t.split() for t in texts]
        found = [list(map(self.known.get, w)) for w in words]
        gaps = [[k for k, x in enumerate(f) if x is None] if None in f else [] for f in found]
        self.learn(list({w[k] for w, g in zip(words, gaps, strict=True) for k in g}))
        for w, f, g in zip(words, found, gaps, strict=True):
            for k in g:
                f[k] = self.known[w[k]]
        return [b"".join(f) for f in found]


_MET: dict[str | None, _Encoder] = {}


def _encoder(path: str | None) -> _Encoder:
    """The encoder of this worker process, with what it remembers from earlier tasks."""
    if path not in _MET:
        _MET[path] = _Encoder(path)
    return _MET[path]


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes."""
    at = 0
    while at < len(sizes):
        end, total = at + 1, sizes[at]
        while end < len(sizes) and total + sizes[end] <= most:
            total += sizes[end]
            end += 1
        yield at, end
        at = end


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, text_hash: bool = False, remember: int = _REMEMBERED) -> DataFrame:
    """Each text's token ids and ``end_id``, in pieces of ``capacity`` (the last may be shorter): doc_id, piece, start, length, ids_crc32, and ids and text_hash (xxhash64 of the text) if asked for.

    ``tokenizer`` is the path of a tokenizers file that executors can read; by
    default that of the installed vocabulary of word pieces. A null text counts as empty: one
    piece of one token.
    """
    more = ([("ids", pa.binary(), "binary")] if with_ids else []) + ([("text_hash", pa.int64(), "bigint")] if text_hash else [])
    schema = pa.schema([*_PIECE, *(pa.field(n, t) for n, t, _ in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer), int(end_id).to_bytes(4, "little")
        encode.most = remember
        for b in batches:
            ids, texts, hashes = b.column(0).to_pylist(), [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], b.column(2).to_pylist()
            for lo, hi in _groups([len(t) for t in texts], 1 << 20):
                rows = []
                for doc, raw, h in zip(ids[lo:hi], encode(texts[lo:hi]), hashes[lo:hi], strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = raw[at : at + 4 * capacity]
                        row = (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece))
                        rows.append((*row, *([piece] if with_ids else []), *([h] if text_hash else [])))
                yield table(rows, schema)

    kinds = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + "".join(f", {n} {t}" for n, _, t in more)
    h = F.xxhash64(F.coalesce("text", F.lit(""))) if text_hash else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), "text", h.alias("h")).transform(map_in_arrow, run, kinds)


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity. As many capacities as the least size has are settled at once."""
    low = int(sizes.min())
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(low, capacity + 1, low):
        at = np.arange(c, min(c + low, capacity + 1))
        rest = at[None, :] - sizes[:, None]
        gain = np.where(rest >= 0, best[np.maximum(rest, 0)] + value[:, None], -1.0)
        i = gain.argmax(axis=0)
        top = gain[i, np.arange(len(at))]
        # more room is never worth less
        own = np.maximum.accumulate(np.append(best[c - 1], top))
        new = own[1:] > own[:-1]
        best[at], pick[at] = own[1:], np.where(new, i, -1)
    count, c = np.zeros(len(sizes), np.int64), capacity
    while c >= low:
        if pick[c] < 0:
            c -= 1
        else:
            count[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), count


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns of ``sizes`` and how often to use each: the configuration program by column generation, rounded down."""
    basis = np.diag(capacity // sizes).astype(float)
    inverse = np.linalg.inv(basis)
    for k in range(rounds):
        if k % 50 == 49:  # what rounding errors have added up to
            inverse = np.linalg.inv(basis)
        worth, column = _knapsack(sizes, np.maximum(inverse.sum(axis=0), 0), capacity)
        if worth <= 1 + 1e-6:
            break
        step, x = inverse @ column, inverse @ need
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        j = int(ratio.argmin())
        basis[:, j] = column
        row = inverse[j] / step[j]
        inverse -= np.outer(step, row)
        inverse[j] = row
    used = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-9).astype(np.int64)
    return [(basis[:, j].astype(np.int64), int(n)) for j, n in enumerate(used) if n > 0]


class Plan:
    """Runs of alike sequences: how many, and which lengths each holds in turn as (length, copies)."""

    def __init__(self, capacity: int):
        self.capacity, self.runs = capacity, []

    def add(self, count: int, items: list[tuple[int, int]]) -> None:
        self.runs.append((count, items))

    def rows(self) -> np.ndarray:
        """length, first rank, ranks, copies in a sequence, first sequence, offset; in order of lengths and ranks."""
        out, used, sequence = [], Counter(), 0
        for count, items in self.runs:
            offset = 0
            for length, copies in items:
                out.append((length, used[length], count * copies, copies, sequence, offset))
                used[length] += count * copies
                offset += length * copies
            sequence += count
        return np.array(sorted(out), np.int64).reshape(-1, 6)


def _substitute(pattern: list[int], times: int, have: np.ndarray, capacity: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Sequences of a pattern of rounded sizes (largest first) with actual lengths in their place, taken from ``have``.

    A slot takes the largest length at hand up to its rounded size, the last of
    several the largest that the sequence has room for.
    """
    todo = [(times, capacity, 0, [])]
    while todo:
        n, free, k, items = todo.pop()
        if k == len(pattern):
            yield n, items
            continue
        most = free if k and k == len(pattern) - 1 else pattern[k]
        there = np.flatnonzero(have[: most + 1])
        if not len(there):
            if items:
                yield n, items
            continue
        length = int(there[-1])
        used = min(n, int(have[length]))
        have[length] -= used
        if used < n:
            todo.append((n - used, free, k, items))
        todo.append((used, free - length, k + 1, [*items, (length, 1)]))


def _best_fit(left: Counter, open_runs: dict[int, list], capacity: int) -> None:
    """Puts ``left`` (length: how many) into the room of ``open_runs`` (free room: runs) and of new sequences, largest first: a sequence takes all copies it has room for before the next one opens."""
    for length in sorted(left, reverse=True):
        n = left[length]
        for free in sorted(f for f in open_runs if f >= length):
            if not n:
                break
            runs = open_runs[free]
            while n and runs:
                count, items = runs.pop()
                fit = free // length
                used = min(count, n // fit)
                if used:
                    open_runs[free - fit * length].append((used, [*items, (length, fit)]))
                    n -= used * fit
                if used < count and n:
                    open_runs[free - n * length].append((1, [*items, (length, n)]))
                    used, n = used + 1, 0
                if used < count:
                    runs.append((count - used, items))
            if not runs:
                del open_runs[free]
        fit = capacity // length
        if n >= fit:
            open_runs[capacity - fit * length].append((n // fit, [(length, fit)]))
        if n % fit:
            open_runs[capacity - n % fit * length].append((1, [(length, n % fit)]))


def _refit(open_runs: dict[int, list], room: float, capacity: int) -> dict[int, list]:
    """The runs with those that have ``room`` or more free taken apart and best-fitted anew."""
    kept, left = defaultdict(list), Counter()
    for free, runs in open_runs.items():
        if free < room:
            kept[free] = list(runs)
        else:
            for count, items in runs:
                for length, copies in items:
                    left[length] += count * copies
    _best_fit(left, kept, capacity)
    return kept


def plan_packing(counts: dict[int, int], capacity: int = 2048, n_groups: int = 64, small: float = 0.3, refits: tuple[float, ...] = (0.0005, 0.001, 0.002, 0.004, 0.008, 0.016, 0.032, 0.064)) -> Plan:
    """Which lengths share a sequence, from how often each occurs.

    Lengths above ``small`` of the capacity are grouped, the rest fill gaps. Then
    the sequences that have some share of the capacity free, one of ``refits``,
    are best-fitted anew, if that makes them fewer. The
    work depends on the number of different lengths alone.
    """
    plan, open_runs = Plan(capacity), defaultdict(list)
    if any(not 1 <= length <= capacity for length in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    left: Counter = Counter({k: v for k, v in counts.items() if k <= small * capacity})
    large = [(k, v) for k, v in sorted(counts.items(), reverse=True) if k > small * capacity]
    if full := dict(large).get(capacity):
        plan.add(full, [(capacity, 1)])
        large = large[1:]
    # groups of equal cardinality, largest first; each rounds up to its largest
    each, need, room = max(1, -(-sum(v for _, v in large) // n_groups)), Counter(), 0
    for length, n in large:
        while n:
            if not room:
                rounded, room = length, each
            k = min(n, room)
            need[rounded] += k
            n, room = n - k, room - k
    have = np.zeros(capacity + 1, np.int64)
    for length, n in large:
        have[length] = n
    if need:
        sizes = np.array(list(need), np.int64)
        for pattern, times in sorted(configurations(sizes, np.array(list(need.values())), capacity), key=lambda x: (-x[1], x[0].tolist())):
            for n, items in _substitute(np.repeat(sizes, pattern).tolist(), times, have, capacity):
                open_runs[capacity - sum(length for length, _ in items)].append((n, items))
    for length in np.flatnonzero(have).tolist():
        left[length] = int(have[length])
    _best_fit(left, open_runs, capacity)
    size = lambda runs: sum(count for r in runs.values() for count, _ in r)
    open_runs = min([open_runs, *(_refit(open_runs, r * capacity, capacity) for r in refits)], key=size)
    for free in sorted(open_runs):
        for count, items in open_runs[free]:
            plan.add(count, items)
    return plan


def _ranked(pieces: DataFrame, lanes: int) -> DataFrame:
    """``pieces`` with ``rank`` among those of the same length: lanes are counted first, then rows within their lane."""
    order = [id_key(), "piece", "ids_crc32"]
    rows = pieces.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lanes)).cast("int"))
    ahead = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "lane").agg(F.count("*").alias("n")).select("length", "lane", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "lane").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(bases, ["length", "lane"]).withColumn("rank", F.col("base") + F.col("own")).drop("lane", "own", "base")


def pack_pieces(pieces: DataFrame, capacity: int = 2048, n_groups: int = 64, small: float = 0.3, lanes: int | None = None) -> DataFrame:
    """``pieces`` (a stored table with doc_id, piece, length, ids_crc32) with sequence_id and offset.

    Sequences hold at most ``capacity`` tokens, without gaps from 0. At most
    ``capacity`` counts reach the driver, and the plan that goes back is bounded
    by the number of lengths, groups and gaps, not by rows. Repeated rows are
    packed as often as given; an empty table gives an empty result.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan_packing(counts, capacity, n_groups, small).rows()
    # a length's rows are dealt to lanes of 2**16 each if all are of one length
    lanes = lanes or max(256, 1 << (sum(counts.values()) >> 16).bit_length())
    shared = pieces.sparkSession.sparkContext.broadcast((rows, (rows[:, 0] << 44) + rows[:, 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, keys = shared.value
        for b in batches:
            if b.num_rows:
                length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
                r = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
                k = rank - r[:, 1]
                placed = [pa.array(r[:, 4] + k // r[:, 3]), pa.array(r[:, 5] + k % r[:, 3] * length)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *placed], [*b.schema.names[:-1], "sequence_id", "offset"])

    ranked = _ranked(pieces, lanes).select(*pieces.columns, "rank")
    kinds = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes[:-1])
    return ranked.transform(map_in_arrow, run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, text_hash: bool = False, remember: int = _REMEMBERED, **how) -> DataFrame:
    """Token pieces of all ``docs`` (doc_id, text) and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty (one token); null ids are kept; other columns
    aren't read. With ``text_hash`` a column says which text a piece is of, for
    tables in which several texts share a doc_id. ``remember`` bounds the words that a worker keeps in mind: fewer
    take less memory and more time.
    """
    return pack_pieces(cut(token_pieces(docs, capacity, tokenizer, text_hash=text_hash, remember=remember)), capacity, **how)
