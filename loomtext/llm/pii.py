"""Personal data: patterns, and information-theoretic sanitisation around them.

Patterns find the protected entities. Which terms of an entity's documents would give it
away is estimated from the corpus: a term discloses an entity if their pointwise
mutual information, over documents, is a large part of the entity's information
content. Terms over the upper threshold are removed, over the lower one
generalised, wherever they stand in a document that holds the entity.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, map_in_arrow, stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A term is a run of letters.
_TERM = re.compile(r"[^\W\d_]{3,}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the run before it that no earlier match has taken: linear however long runs are."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in ``KINDS``, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _entity(kind: str, value: str) -> str:
    """An entity's name: its kind and a digest of the value in plain form."""
    plain = value.lower() if kind == "email" else value if kind == "ip" else "".join(filter(str.isdigit, value))
    return f"{kind}:{hashlib.blake2b(plain.encode(), digest_size=12).hexdigest()}"


def _terms(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The terms of a text that lie outside all spans."""
    out, rest = [], sorted((a, b) for _, a, b in spans)
    i, last = 0, -1
    for m in _TERM.finditer(text):
        while i < len(rest) and rest[i][0] < m.end():
            last = max(last, rest[i][1])
            i += 1
        if last <= m.start():
            out.append({"term": m[0].lower(), "start": m.start(), "end": m.end()})
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_PLACE = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND = "doc_id bigint, th bigint, spans array<struct<kind:string,start:bigint,end:bigint>>, entities array<string>, terms array<struct<term:string,start:bigint,end:bigint>>"


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, th (hash of the text), spans by pattern, the entities, and, if there are any, all terms of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, entities, terms = [], [], []
            for text in b.column(2).to_pylist():
                found = base_spans(text or "")
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
                entities.append(sorted({_entity(kind, text[x:y]) for kind, x, y in found}))
                terms.append(_terms(text, found) if found else [])
            columns = [pa.array(spans, pa.list_(_SPAN)), pa.array(entities, pa.list_(pa.string())), pa.array(terms, pa.list_(_PLACE))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *columns], ["doc_id", "th", "spans", "entities", "terms"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text").transform(map_in_arrow, run, _FOUND)


def _term_documents(docs: DataFrame, terms: DataFrame, most_broadcast: int) -> DataFrame:
    """(term, n_term): how many documents hold each of ``terms``.

    Tasks count first. Up to ``most_broadcast`` terms go to all tasks as a set;
    more are joined to the counts of all terms instead.
    """
    few = terms.limit(most_broadcast + 1).collect()
    if not few:
        return terms.select("term", F.lit(0).cast("long").alias("n_term"))
    chosen = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in few)) if len(few) <= most_broadcast else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])
            counts.clear()
            return out

        for b in batches:
            for text in b.column(0).to_pylist():
                have = {w.lower() for w in set(_TERM.findall(text or ""))}
                counts.update(have & chosen.value if chosen else have)
                if len(counts) > 500_000:
                    yield flush()
        yield flush()

    counts = docs.select("text").transform(map_in_arrow, run, "term string, n bigint")
    return counts.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing(docs: DataFrame, found: DataFrame, generalise: float = 0.8, remove: float = 0.9, min_texts: int = 3, most_broadcast: int = 200_000) -> DataFrame:
    """(entity, term, disclosure, action) of terms that give entities away.

    disclosure = PMI(term, entity) / IC(entity) with probabilities over all
    documents, which hold a pair wherever its parts stand; a pair must occur in ``min_texts`` different texts, so that copies
    are no evidence. A pair's, a term's and an entity's documents are counted
    over the whole corpus.

    Only pairs that can reach the lower threshold are made: as no pair is in more
    documents than its entity, a term of over n * (n_entity / n) ** generalise
    documents can't disclose it. So a text of many entities and words gives few pairs.
    """
    n = float(found.count())
    key = [id_key().alias("doc"), "th"]
    seen = found.select(*key, F.explode("entities").alias("entity")).distinct()
    entities = seen.groupBy("entity", "th").agg(F.count("*").alias("m")).groupBy("entity").agg(F.sum("m").alias("n_entity"), F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    entities = stored(entities.select("entity", "n_entity"))
    held = seen.join(entities, "entity").groupBy("doc", "th").agg(F.collect_list(F.struct("entity", "n_entity")).alias("entities"))
    words = found.select(*key, F.array_distinct("terms.term").alias("terms")).dropDuplicates(["doc", "th"])
    # stored with the largest number, so that a text's entities aren't carried along when its words are rows
    largest = F.array_max(F.transform("entities", lambda e: e["n_entity"])).alias("largest")
    held = stored(held.join(words, ["doc", "th"]).select("doc", "th", "entities", "terms", largest))
    most = lambda n_entity: F.lit(n) * F.pow(n_entity / F.lit(n), F.lit(generalise)) * (1 + 1e-9)
    common = held.select("th", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    terms = stored(_term_documents(docs, stored(common.select("term")), most_broadcast))
    # a text's few possible terms first, its entities after them: its entities aren't repeated for each of its words
    some = held.select("doc", "th", "largest", F.explode("terms").alias("term")).join(terms, "term").where(F.col("n_term") <= most(F.col("largest")))
    some = some.groupBy("doc", "th").agg(F.collect_list(F.struct("term", "n_term")).alias("some"))
    pairs = some.join(held.select("doc", "th", "entities"), ["doc", "th"]).select("th", "entities", F.explode("some").alias("t"))
    pairs = pairs.select("th", "t.term", "t.n_term", F.explode(F.filter("entities", lambda e: F.col("t.n_term") <= most(e["n_entity"]))).alias("e"))
    pairs = pairs.groupBy("e.entity", "e.n_entity", "term", "n_term", "th").agg(F.count("*").alias("m"))
    rows = pairs.groupBy("entity", "n_entity", "term", "n_term").agg(F.sum("m").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= min_texts)
    pmi = F.log2(F.col("n_both") * F.lit(n) / F.col("n_term") / F.col("n_entity"))
    rows = rows.withColumn("disclosure", pmi / F.log2(F.lit(n) / F.col("n_entity"))).where(F.col("disclosure") >= generalise)
    return rows.select("entity", "term", "disclosure", F.when(F.col("disclosure") >= remove, "removed").otherwise("generalised").alias("action"))


def _added(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc, th, added): the spans of disclosing terms, in order; a term that several rules of a text name is removed if one of them says so."""
    key = [id_key().alias("doc"), "th"]
    ruled = found.select(*key, F.explode("entities").alias("entity")).join(rules, "entity").groupBy("doc", "th", "term").agg(F.max("action").alias("action"))
    places = found.where("size(terms) > 0").select(*key, F.explode("terms").alias("t")).select("doc", "th", "t.*").join(ruled, ["doc", "th", "term"])
    return places.groupBy("doc", "th").agg(F.array_sort(F.collect_set(F.struct("start", "end", "action"))).alias("added"))


def protected_spans(docs: DataFrame, **how) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, th, spans by pattern, and added: terms to remove or generalise (start, end, action).

    A null text counts as empty. Rows are told apart by doc_id and text; repeated
    rows have the same spans, null ids come back null. An empty table gives an
    empty result; other columns aren't read. A text's own spans and terms are one
    row, so that they must fit a task.
    """
    found = stored(find(docs))
    rules = stored(disclosing(docs, found, **how))
    rows = found.select(id_key().alias("doc"), "doc_id", "th", "spans").join(_added(found, rules), ["doc", "th"], "left")
    return rows.select("doc_id", "th", "spans", F.coalesce("added", F.expr("array()").cast("array<struct<start:bigint,end:bigint,action:string>>")).alias("added"))


def sanitised(text: str, spans: list, added: list) -> str:
    """``text`` with its spans replaced: entities by their kind in brackets, general terms by [word], removed ones by nothing. Overlapping spans are one."""
    marks = sorted([(s["start"], -s["end"], f"[{s['kind'].upper()}]") for s in spans] + [(a["start"], -a["end"], "" if a["action"] == "removed" else "[word]") for a in added])
    out, at = [], 0
    for start, end, by in marks:
        if start >= at:
            out += [text[at:start], by]
        at = max(at, -end)
    return "".join(out) + text[at:]


def sanitised_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with sanitised texts and their lengths."""
    spans = protected_spans(docs, **how).where("size(spans) > 0").groupBy(id_key().alias("doc"), "th").agg(F.first("spans").alias("spans"), F.first("added").alias("added"))
    keyed = docs.select("doc_id", "text", "lang", "source", id_key().alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = keyed.join(spans, ["doc", "th"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans, added = (c.to_pylist() for c in b.columns[3:])
            texts = [sanitised(t, s, a or []) if s else t for t, s, a in zip(texts, spans, added, strict=True)]
            sizes = [None if t is None else len(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "lang", "source", "text", "n_chars"])

    out = rows.select("doc_id", "lang", "source", "text", "spans", "added").transform(map_in_arrow, run, "doc_id bigint, lang string, source string, text string, n_chars bigint")
    return out.select("doc_id", "text", "lang", "source", "n_chars")


def digests(protected: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans (kind:start:end, by kind and start; generalised and removed terms come last) of ``protected_spans``; native."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.array_join(F.transform("spans", line), ",")
    more = F.array_sort(F.transform("added", lambda a: F.struct(a["action"].alias("kind"), a["start"].alias("start"), a["end"].alias("end"))))
    more = F.transform(more, line)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return protected.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.array_join(F.concat(F.transform("spans", line), more), ",").alias("spans"))
