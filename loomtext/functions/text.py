"""Text functions over columns: cleaning, tokens, spelling, token shapes.

All are Spark expressions but ``normalised``, ``unescaped`` and ``stemmed``,
which have no built-in counterpart and run as Arrow functions.
"""

from __future__ import annotations

import functools
import html
import unicodedata
from array import array

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# The pictograph ranges that cleaning removes.
PICTOGRAPHS = (
    (0x1F1E6, 0x1F1FF), (0x1F300, 0x1F5FF), (0x1F600, 0x1F64F), (0x1F680, 0x1F6FF), (0x1F700, 0x1F77F), (0x1F780, 0x1F7FF),
    (0x1F800, 0x1F8FF), (0x1F900, 0x1F9FF), (0x1FA00, 0x1FAFF), (0x2600, 0x26FF), (0x2700, 0x27BF),
)
EMOJI = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in PICTOGRAPHS) + "]+"
JOINERS = "[\\x{200D}\\x{FE0E}\\x{FE0F}]"
SPACES = "(?U)[\\s\\x1c-\\x1f]+"
#: Character references that cleaning resolves without Python, in order; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&amp;", "&"))

# The vocabulary and the aliases of spelling correction.
VOCABULARY = (
    "account", "address", "amount", "bank", "call", "confirm", "contact", "email", "name", "number", "payment", "phone",
    "please", "send", "transfer",
)
ALIASES = {"acc": "account", "acct": "account", "addr": "address", "amt": "amount", "phn": "phone", "plz": "please", "pymnt": "payment"}

STOP_WORDS = tuple("a an and are as at be but by for from had has have he her his i in is it its me my not of on or our she so that the their them they this to was we were will with you your".split())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """NFKC; nulls stay."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """All HTML character references, in one pass; nulls stay."""
    return texts.map(lambda t: None if t is None else html.unescape(t))


def checked(c) -> Column:
    """The column; reading it fails if it isn't of text."""
    c = _col(c)
    return F.when(F.typeof(c).rlike("^(string|void|(var)?char)"), c).otherwise(F.raise_error(F.lit("text must be a string")))


def strip_tags(c) -> Column:
    return F.regexp_replace(_col(c), "<[^>]*>", " ")


def collapse(c) -> Column:
    """Unicode white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), SPACES, " "))


def strip_emoji(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), EMOJI, " "), JOINERS, "")


def clean(c, remove_emoji: bool = True, exact: bool = False) -> Column:
    """Tags to spaces, character references resolved, emoji out, white space collapsed. Null stays null.

    ``exact`` adds NFKC and all references; texts that need neither go past
    Python as nulls. Without it, only ``ENTITIES`` are resolved, natively.
    Anything but text fails.
    """
    text = checked(c)
    if exact:
        text = F.coalesce(normalised(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)
    text = strip_tags(text)
    if exact:
        text = F.coalesce(unescaped(F.when(text.contains("&"), text)), text)
    else:
        for name, mark in ENTITIES:
            text = F.replace(text, F.lit(name), F.lit(mark))
    return collapse(strip_emoji(text) if remove_emoji else text)


#: Rules of Penn Treebank tokens as replacements, in order; \1 stands for a group. Quotes stay as they are, so tokens are slices of the text.
TREEBANK = (
    (r"\.\.\.", r" ... "),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])\z", r" \1 "),
    (r"([;@#$%&?!\[\]\(\)\{\}<>\"])", r" \1 "),
    (r"([^.])(\.)([\]\)}>\"']*)[ \t\n\r]*\z", r"\1 \2 \3 "),
    (r"--", r" -- "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|'ll|'LL|'re|'RE|'ve|'VE|n't|N'T|') ", r"\1 \2 "),
)


def treebank(c) -> Column:
    """Tokens by the published Treebank conventions; null gives null, a blank text none."""
    text = F.concat(F.lit(" "), F.trim(_col(c)))
    for pattern, by in TREEBANK:
        text = F.regexp_replace(text, pattern, by.replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3"))
        if pattern.startswith("--"):
            text = F.concat(text, F.lit(" "))
    return words(text)


def words(c) -> Column:
    """Runs that aren't ASCII white space."""
    return F.array_remove(F.split(_col(c), "[ \\t\\n\\x0B\\f\\r]+"), "")


@F.arrow_udf(ArrayType(StructType().add("token", StringType()).add("start", IntegerType()).add("end", IntegerType())))
def _offsets(texts: pa.Array, tokens: pa.Array) -> pa.Array:
    # one row's strings at a time: the batch's tokens stay as they came, and only numbers are added
    null = pc.or_(pc.is_null(texts), pc.is_null(tokens))
    starts, ends, sizes = array("i"), array("i"), array("i", [0])
    for text, own in zip(texts, tokens, strict=True):
        text, end = text.as_py(), 0
        for token in own.as_py() or [] if text is not None else []:
            start = text.find(token, end)
            end = start + len(token)
            starts.append(start)
            ends.append(end)
        sizes.append(len(starts))
    held = tokens.filter(pc.invert(null)).flatten()
    rows = pa.StructArray.from_arrays([held, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["token", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows, mask=null)


def offsets(text, tokens) -> Column:
    """array<struct<token, start, end>> of tokens that are slices of the text in order; offsets from 0 in code points, ends excluded.

    One pass over the text, in Arrow batches: a native fold copies its array for
    each token, which is quadratic for long texts. Nulls give null.
    """
    return _offsets(_col(text), _col(tokens))


# Words before a full stop that doesn't end a sentence.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "St", "Jr", "Sr", "Inc", "Ltd", "Co", "No", "vs", "etc")


def sentences(c) -> Column:
    """Sentences of a text by rule: an end mark, closing quotes or brackets, white space, then a capital or a digit; not after ``ABBREVIATIONS`` or initials."""
    ends = "(?<!\\b(?:" + "|".join(ABBREVIATIONS) + ")\\.)(?<!\\b\\p{Lu}\\.)(?<=[.!?][\"')\\]]{0,2})\\s+(?=[\"'(\\[]{0,2}[\\p{Lu}\\p{Nd}])"
    return F.filter(F.split(_col(c), ends), lambda s: F.trim(s) != "")


def tokenize(c) -> Column:
    """Treebank tokens of a text's sentences, so that every sentence's full stop is a token; null gives null."""
    return F.flatten(F.transform(sentences(c), treebank))


def levenshtein_distance(a, b) -> Column:
    return F.levenshtein(_col(a), _col(b))


def transform_tokens(tokens, lowercase: bool = False, remove_stopwords: bool = False, stem: bool = False, lemmas: dict[str, str] | None = None) -> Column:
    """Token arrays in the fixed order: lower case, stop words (any case), stems, lemmas (of alphabetic tokens, by the given dictionary)."""
    out = _col(tokens)
    if lowercase:
        out = F.transform(out, F.lower)
    if remove_stopwords:
        stop = F.array(*map(F.lit, STOP_WORDS))
        out = F.filter(out, lambda t: ~F.array_contains(stop, F.lower(t)))
    if stem:
        out = stemmed(out)
    if lemmas:
        by = F.create_map(*(F.lit(x) for kv in lemmas.items() for x in kv))
        out = F.transform(out, lambda t: F.when(t.rlike("^\\p{L}+$"), F.coalesce(by[F.lower(t)], t)).otherwise(t))
    return out


@F.pandas_udf(ArrayType(StringType()))
def stemmed(tokens: pd.Series) -> pd.Series:
    """Porter stems of alphabetic tokens; others stay."""
    from .porter import stem

    return tokens.map(lambda ts: None if ts is None else [stem(t) if t.isalpha() else t for t in ts])


def preprocess(c, exact: bool = True, **flags) -> Column:
    return transform_tokens(treebank(clean(c, exact=exact)), **flags)


def restore_case(original, corrected) -> Column:
    """All capitals or a first capital carried over; one capital counts as all."""
    original, corrected = _col(original), _col(corrected)
    return F.when(original.rlike("^[A-Z]+$"), F.upper(corrected)).when(original.rlike("^[A-Z][a-z]*$"), F.initcap(corrected)).otherwise(corrected)


def nearest_word(token, vocabulary: tuple[str, ...] | Column = VOCABULARY) -> Column:
    """struct<distance, word> of the nearest word; ties go to the first in order. The vocabulary is lower-cased and each word counts once; it may be an array column."""
    token = _col(token)
    near = lambda w: F.struct(F.levenshtein(token, w).alias("distance"), w.alias("word"))
    if isinstance(vocabulary, Column):
        return F.array_min(F.transform(F.array_distinct(F.transform(vocabulary, F.lower)), near))
    return F.array_min(F.array(*(near(F.lit(w)) for w in dict.fromkeys(v.lower() for v in vocabulary))))


def correct_token(token, vocabulary: tuple[str, ...] | Column = VOCABULARY, max_distance: int = 2) -> Column:
    """A token of ASCII letters by alias, else by the nearest word within ``max_distance``; all else stays."""
    token = _col(token)
    low = F.lower(token)
    alias = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))[low]
    out = F.when(~token.rlike("^[A-Za-z]+$"), token).when(alias.isNotNull(), restore_case(token, alias))
    if isinstance(vocabulary, Column) or vocabulary:
        best = nearest_word(low, vocabulary)
        out = out.when(best["distance"] <= max_distance, restore_case(token, best["word"]))
    return out.otherwise(token)


def correct_spelling(tokens, vocabulary: tuple[str, ...] | Column = VOCABULARY, max_distance: int = 2) -> Column:
    return F.transform(_col(tokens), lambda t: correct_token(t, vocabulary, max_distance))


#: Shapes of a token, in column order.
ORTHOGRAPHIC = ("ortho:capitalized", "ortho:digit", "ortho:at", "ortho:dot", "ortho:length", "ortho:all_digits")


@functools.cache
def _class(has) -> str:
    """A character class, for Java and RE2, of the characters that ``has`` holds for."""
    points = {i for i in range(0x20000) if has(chr(i))}
    runs = zip(sorted(p for p in points if p - 1 not in points), sorted(p for p in points if p + 1 not in points), strict=True)
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]"


def upper_class() -> str:
    """Capitals: upper-case letters and the letter numbers and circled letters that count as such."""
    return "[\\p{Lu}" + _class(_other_capital)[1:]


def digit_class() -> str:
    """Digits: decimal ones, and those in superscripts, subscripts and circles."""
    return "[\\p{Nd}" + _class(_other_digit)[1:]


def _other_capital(c: str) -> bool:
    return c.isupper() and unicodedata.category(c) != "Lu"


def _other_digit(c: str) -> bool:
    return c.isdigit() and unicodedata.category(c) != "Nd"


def orthographic(token) -> list[Column]:
    """First character a capital; a digit; an at sign; a dot; length over 50, one at most; digits alone."""
    t = _col(token)
    shapes = (
        t.rlike("^" + upper_class()), t.rlike(digit_class()), t.contains("@"), t.contains("."), F.least(F.length(t), F.lit(50)) / 50.0, t.rlike("^" + digit_class() + "+$"),
    )
    return [s.cast("double").alias(n) for s, n in zip(shapes, ORTHOGRAPHIC, strict=True)]


def char_ngrams(token, low: int = 3, high: int = 4) -> Column:
    """Names char<n>=... of all n-grams of ^token$ in lower case, repeats included."""
    x = F.concat(F.lit("^"), F.lower(_col(token)), F.lit("$"))
    return F.concat(*(_grams(x, n) for n in range(low, high + 1)))


def _grams(x: Column, n: int) -> Column:
    starts = F.when(F.length(x) >= n, F.sequence(F.lit(1), F.length(x) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda p: F.concat(F.lit(f"char{n}="), x.substr(p, F.lit(n))))


# Patterns of the rule-based detector, in order of precedence.
SILVER = (
    ("EMAIL", "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"),
    ("PHONE_NUMBER", "^\\+?[0-9()-]*[0-9]{3}-[0-9]{4}[.,]?$"),
    ("ACCOUNT_NUMBER", "^[0-9]{4,}[.,]?$"),
    ("LOCATION", "^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+[.,]?$"),
)


def silver_category(token) -> Column:
    """The category that a token's shape suggests, O if none."""
    t, out = _col(token), None
    for label, pattern in SILVER:
        out = F.when(t.rlike(pattern), label) if out is None else out.when(t.rlike(pattern), label)
    return out.otherwise("O")


def redact(c) -> Column:
    """E-mail addresses, IPv4 addresses and long digit groups replaced by their kind (an extension)."""
    out = F.regexp_replace(_col(c), "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+", "[EMAIL]")
    out = F.regexp_replace(out, "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}", "[IP]")
    return F.regexp_replace(out, "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "[CARD]")
