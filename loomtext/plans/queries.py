"""Queries over whole tables for the library's own operators, each beside its SQL for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, metrics, splits, tagging
from ..operators.features import WindowFeatureBuilder, sentence_rows, token_rows
from ..operators.logistic import sigmoid, sql_steps
from ..operators.naive_bayes import MulticlassNaiveBayes
from ..sources.shared import cut
from . import training

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _tokens(spark, d) -> DataFrame:
    return token_rows(_read(spark, d, "documents"))


def _sentences(spark, d) -> DataFrame:
    return sentence_rows(_read(spark, d, "documents"))


def _hash(*columns):
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns))), 1, 8), 16, 10).cast("long")


# --- SQL pieces

_WORD = r"[^ \t\n\x0B\f\r]+"
_SPACES = r"[\t\n\x0B\f\r \x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_TOK = f"""words AS (SELECT doc_id AS sid, regexp_extract_all(text, '{_WORD}') AS w FROM documents),
tok AS (SELECT sid, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS idx FROM words)"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _clean_sql(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"
    for name, mark in T.ENTITIES:
        out = f"replace({out}, {_quoted(name)}, {_quoted(mark)})"
    out = f"regexp_replace(regexp_replace({out}, {_quoted(T.EMOJI)}, ' ', 'g'), {_quoted(T.JOINERS)}, '', 'g')"
    return f"trim(regexp_replace({out}, {_quoted(_SPACES)}, ' ', 'g'), ' ')"


def _treebank_sql(c: str) -> str:
    out = f"' ' || trim({c}, ' ')"
    for pattern, by in T.TREEBANK:
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
        if pattern.startswith("--"):
            out = f"({out} || ' ')"
    return f"regexp_extract_all({out}, '{_WORD}')"


_SILVER = "CASE " + " ".join(f"WHEN regexp_matches(token, {_quoted(p)}) THEN '{k}'" for k, p in T.SILVER) + " ELSE 'O' END"
_H = "('0x' || substr(md5(sid || '|' || idx), 1, 8))::BIGINT"
_GUESS = f"CASE WHEN category <> 'O' AND {_H} % 10 = 0 THEN 'O' WHEN category <> 'O' AND {_H} % 10 = 1 THEN 'EMAIL' WHEN category = 'O' AND {_H} % 500 = 0 THEN 'LOCATION' ELSE category END"


def _bio_sql(c: str) -> str:
    return f"CASE WHEN {c} = 'O' THEN 'O' WHEN {c} IS NOT DISTINCT FROM lag({c}) OVER (PARTITION BY sid ORDER BY idx) THEN 'I-' || {c} ELSE 'B-' || {c} END"


_GOLD = f"""{_TOK},
cat AS (SELECT *, {_SILVER} AS category FROM tok),
guess AS (SELECT *, {_GUESS} AS guessed FROM cat),
tags AS (SELECT *, {_bio_sql("category")} AS tag, {_bio_sql("guessed")} AS predicted FROM guess)"""


def _spans_sql(tag: str, name: str) -> str:
    return f"""{name}_l AS (SELECT sid, idx, {tag} AS t, CASE WHEN {tag} <> 'O' THEN CASE WHEN contains({tag}, '-') THEN substr({tag}, instr({tag}, '-') + 1) ELSE {tag} END END AS label FROM tags),
{name}_b AS (SELECT *, (label IS NOT NULL AND NOT (t LIKE 'I-%' AND label IS NOT DISTINCT FROM lag(label) OVER (PARTITION BY sid ORDER BY idx)))::INT AS b FROM {name}_l),
{name}_i AS (SELECT *, sum(b) OVER (PARTITION BY sid ORDER BY idx) AS island FROM {name}_b),
{name} AS (SELECT sid, min(idx) AS start_, max(idx) + 1 AS end_, label FROM {name}_i WHERE label IS NOT NULL GROUP BY sid, island, label)"""


def _scores_sql(counts: str) -> str:
    return f"""labels AS (SELECT DISTINCT part, unnest([gold, predicted]) AS label FROM {counts}),
scores AS (SELECT part, label, tp, said, support, CASE WHEN said > 0 THEN tp / said::DOUBLE ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS recall
  FROM (SELECT l.part, l.label, sum(CASE WHEN gold = label AND predicted = label THEN n ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN predicted = label THEN n ELSE 0 END)::BIGINT AS said,
               sum(CASE WHEN gold = label THEN n ELSE 0 END)::BIGINT AS support FROM labels l JOIN {counts} c ON l.part = c.part GROUP BY l.part, l.label)),
f AS (SELECT part, label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM scores)"""


_TAG_COUNTS = """pre AS (SELECT lang AS g, tag AS gold, predicted, count(*) AS n FROM tags JOIN documents ON doc_id = sid GROUP BY ALL),
counts AS (SELECT part, gold, predicted, sum(n) AS n FROM (SELECT unnest(['overall', g]) AS part, gold, predicted, n FROM pre) GROUP BY ALL)"""
_CAT_COUNTS = """counts AS (SELECT 'overall' AS part, category AS gold, guessed AS predicted, count(*) AS n FROM tags GROUP BY ALL)"""


# --- text


@query(f"SELECT doc_id, {_clean_sql('text')} AS cleaned FROM documents")
def clean_documents(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.clean("text", exact=True).alias("cleaned"))


@query(f"SELECT page_id, {_clean_sql('html')} AS cleaned FROM pages")
def clean_pages(spark, d):
    return _read(spark, d, "pages").select("page_id", T.clean("html", exact=True).alias("cleaned"))


@query(f"SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM documents)")
def tokens_ws(spark, d):
    w = T.words("text")
    return _read(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(w, " ")).alias("digest"))


@query(f"SELECT doc_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_treebank_sql('text')} AS w FROM documents)")
def tokens_treebank(spark, d):
    rows = _read(spark, d, "documents").select("doc_id", T.treebank("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


def _offsets_sql(rows: str, key: str) -> str:
    """SQL of (key, idx, token, start_, end_) over a relation ``rows`` (key, text, w): tokens hold all characters but spaces, so a token begins at the space-free place where those before it end."""
    return f"""o_p AS (SELECT {key}, w, list_filter(range(1, len(ch) + 1), lambda i: NOT list_contains([' ', chr(9), chr(10), chr(11), chr(12), chr(13)], ch[i])) AS pos
  FROM (SELECT *, regexp_extract_all(text, '(?s).') AS ch FROM {rows})),
o_t AS (SELECT {key}, pos, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS idx FROM o_p),
o_c AS (SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY {key} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c FROM o_t),
offs AS (SELECT {key}, idx, token, (pos[c + 1] - 1)::INT AS start_, pos[c + length(token)]::INT AS end_ FROM o_c)"""


@query(
    f"""WITH rows_ AS (SELECT conv_id, turn, text, row_number() OVER () AS r, {_treebank_sql("text")} AS w FROM conversations), {_offsets_sql("rows_", "conv_id, turn, r")}
SELECT conv_id, turn, token, start_ AS "start", end_ AS "end" FROM offs"""
)
def token_offsets(spark, d):
    rows = _read(spark, d, "conversations").select("conv_id", "turn", "text", T.treebank("text").alias("w"))
    return rows.select("conv_id", "turn", F.explode(T.offsets("text", "w")).alias("x")).select("conv_id", "turn", "x.*")


@query(
    f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(w, lambda t: lower(t)), lambda t: NOT list_contains([{", ".join(map(_quoted, T.STOP_WORDS))}], t)), ' ') AS kept
FROM (SELECT conv_id, turn, {_treebank_sql("text")} AS w FROM conversations)"""
)
def tokens_lower_stop(spark, d):
    kept = T.transform_tokens(T.treebank("text"), lowercase=True, remove_stopwords=True)
    return _read(spark, d, "conversations").select("conv_id", "turn", F.array_join(kept, " ").alias("kept"))


@query()
def tokens_porter(spark, d):
    return _read(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.transform_tokens(T.treebank("text"), stem=True), " ").alias("stems"))


@query(
    # one mark for each other character: this engine counts bytes
    f"""WITH {_TOK}, t AS (SELECT DISTINCT regexp_replace(lower(token), '[^\\x00-\\x7F]', '?', 'g') AS token FROM tok), v AS (SELECT unnest([{", ".join(map(_quoted, T.VOCABULARY))}]) AS word)
SELECT word, least(levenshtein(token, word), 20)::INT AS distance, count(*) AS n FROM t, v GROUP BY ALL"""
)
def levenshtein_vocab(spark, d):
    tokens = _tokens(spark, d).select(F.regexp_replace(F.lower("token"), "[^\\x00-\\x7F]", "?").alias("token")).distinct()
    each = F.explode(F.array(*(F.struct(F.lit(w).alias("word"), F.least(F.levenshtein("token", F.lit(w)), F.lit(20)).alias("distance")) for w in T.VOCABULARY)))
    return tokens.select(each.alias("x")).groupBy("x.word", "x.distance").agg(F.count("*").alias("n"))


def _restore_sql(token: str, word: str) -> str:
    return f"CASE WHEN regexp_matches({token}, '^[A-Z]+$') THEN upper({word}) WHEN regexp_matches({token}, '^[A-Z][a-z]*$') THEN upper({word}[1]) || {word}[2:] ELSE {word} END"


@query(
    f"""WITH {_TOK}, t AS (SELECT DISTINCT token FROM tok),
a AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in T.ALIASES.items())}) x(low, full_word)),
best AS (SELECT token, list_min(list_transform([{", ".join(map(_quoted, T.VOCABULARY))}], lambda w: {{'d': levenshtein(low, w), 'w': w}})) AS b
  FROM (SELECT token, lower(token) AS low FROM t WHERE regexp_matches(token, '^[A-Za-z]+$')))
SELECT t.token, CASE WHEN best.token IS NULL THEN t.token WHEN full_word IS NOT NULL THEN {_restore_sql("t.token", "full_word")}
  WHEN b.d <= 2 THEN {_restore_sql("t.token", "(b.w)")} ELSE t.token END AS corrected
FROM t LEFT JOIN best ON best.token = t.token LEFT JOIN a ON a.low = lower(t.token)"""
)
def spell_correct(spark, d):
    return _tokens(spark, d).select("token").distinct().select("token", T.correct_token("token").alias("corrected"))


_SHAPES_SQL = f"""(regexp_matches(token, '^{T.upper_class()}'))::INT::DOUBLE AS cap, (regexp_matches(token, '{T.digit_class()}'))::INT::DOUBLE AS digit, (contains(token, '@'))::INT::DOUBLE AS at_sign,
  (contains(token, '.'))::INT::DOUBLE AS dot, least(length(token), 50) / 50.0::DOUBLE AS len, (regexp_matches(token, '^{T.digit_class()}+$'))::INT::DOUBLE AS all_digits"""
_SHAPES = ("cap", "digit", "at_sign", "dot", "len", "all_digits")


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(c.alias(n) for c, n in zip(T.orthographic("token"), _SHAPES, strict=True)))


@query(f"WITH {_TOK} SELECT token, {_SHAPES_SQL} FROM (SELECT DISTINCT token FROM tok)")
def orthographic(spark, d):
    return _shaped(_tokens(spark, d).select("token").distinct())


@query(
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', '[IP]', 'g'), '[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}', '[CARD]', 'g') AS redacted FROM documents"
)
def redact_documents(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.redact("text").alias("redacted"))


# --- features

_NEAR = ", ".join(f"{'lag' if o < 0 else 'lead'}(low, {abs(o)}) OVER w AS o{o + 2}" if o else "low AS o2" for o in range(-2, 3))
_BAG = f"""{_TOK}, near AS (SELECT sid, idx, {_NEAR} FROM (SELECT sid, idx, lower(token) AS low FROM tok) WINDOW w AS (PARTITION BY sid ORDER BY idx)),
bag AS (SELECT sid, idx, unnest(list_filter([{", ".join(f"'word=' || o{o + 2}, 'offset={o:+d}:word=' || o{o + 2}" for o in range(-2, 3))}], lambda x: x IS NOT NULL)) AS feature FROM near),
one AS (SELECT sid, idx, feature, count(*) AS c FROM bag GROUP BY ALL),
df AS (SELECT feature, count(*) AS df, sum(c)::BIGINT AS total FROM one GROUP BY feature HAVING count(*) >= 2),
vocab AS (SELECT *, row_number() OVER (ORDER BY df DESC, feature) - 1 AS col, ln((1.0::DOUBLE + (SELECT count(*) FROM tok)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM df QUALIFY col < 2500)"""


@query(f'WITH {_BAG} SELECT feature, col AS "column", df, round(idf, 6) AS idf FROM vocab')
def vocab_topk(spark, d):
    vocabulary = WindowFeatureBuilder().fit(_sentences(spark, d)).vocabulary
    return vocabulary.where("family <> 'ortho'").select("feature", F.col("column").cast("long").alias("column"), "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BAG} SELECT feature, df FROM df")
def doc_freq(spark, d):
    return WindowFeatureBuilder().document_frequency(_sentences(spark, d)).where("df >= 2")


@query(f"WITH {_BAG} SELECT feature, total::DOUBLE AS total, df AS n_rows FROM vocab")
def features_count(spark, d):
    rows = WindowFeatureBuilder().fit_transform(_sentences(spark, d), shapes=False)
    return rows.groupBy("feature").agg(F.sum("value").alias("total"), F.count("*").alias("n_rows"))


@query(f"WITH {_BAG} SELECT feature, round(total * idf, 4) AS total FROM vocab")
def features_tfidf(spark, d):
    # a feature has few different values: sums of them don't add up the errors of millions of rows
    rows = WindowFeatureBuilder().fit_transform(_sentences(spark, d), "tfidf", shapes=False).groupBy("feature", "value").agg(F.count("*").alias("n"))
    return rows.groupBy("feature").agg(F.round(F.sum(F.col("value") * F.col("n")), 4).alias("total"))


@query(
    f"""WITH {_TOK}, x AS (SELECT '^' || lower(token) || '$' AS x FROM tok),
g AS (SELECT unnest(list_transform(range(1, length(x) - 1), lambda i: 'char3=' || substr(x, i, 3))) AS feature FROM x UNION ALL SELECT unnest(list_transform(range(1, length(x) - 2), lambda i: 'char4=' || substr(x, i, 4))) FROM x)
SELECT feature, count(*) AS n FROM g GROUP BY feature"""
)
def char_ngrams(spark, d):
    return _tokens(spark, d).select(F.explode(T.char_ngrams("token")).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


# --- tags and metrics


def _tagged(spark, d) -> DataFrame:
    rows = _tokens(spark, d).withColumn("category", T.silver_category("token"))
    h, real = _hash("sentence_id", "token_idx"), F.col("category") != "O"
    guessed = F.when(real & (h % 10 == 0), "O").when(real & (h % 10 == 1), "EMAIL").when(~real & (h % 500 == 0), "LOCATION").otherwise(F.col("category"))
    rows = tagging.categories_to_bio(rows.withColumn("guessed", guessed))
    return tagging.categories_to_bio(rows, "guessed", out="predicted")


@query(f"WITH {_GOLD} SELECT category, count(*) AS n FROM cat GROUP BY category")
def silver_tags(spark, d):
    return _tokens(spark, d).groupBy(T.silver_category("token").alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {_GOLD} SELECT tag, CASE WHEN tag = 'O' THEN 'O' ELSE substr(tag, 3) END AS category, count(*) AS n FROM tags GROUP BY ALL")
def base_category(spark, d):
    return _tagged(spark, d).groupBy("tag", tagging.base_category("tag").alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {_GOLD} SELECT sid AS sentence_id, count(*) AS n_tokens, sum((category <> 'O')::INT)::BIGINT AS n_pii FROM tags GROUP BY sid")
def targets(spark, d):
    rows = tagging.unflatten(_tagged(spark, d).withColumn("v", F.struct("token", "tag")), "v")
    sentences = rows.select("sentence_id", F.col("v.token").alias("tokens"), F.col("v.tag").alias("tags"))
    return tagging.flatten_targets(sentences).groupBy("sentence_id").agg(F.count("*").alias("n_tokens"), F.sum("is_pii").alias("n_pii"))


@query(f"WITH {_GOLD} SELECT sid AS sentence_id, md5(string_agg(tag, ' ' ORDER BY idx)) AS digest FROM tags GROUP BY sid")
def bio_rebuild(spark, d):
    return tagging.unflatten(_tagged(spark, d), "tag").select("sentence_id", F.md5(F.array_join("tag", " ")).alias("digest"))


@query(f"WITH {_GOLD} SELECT sid AS sentence_id, md5(string_agg(token, ' ' ORDER BY idx)) AS digest, count(*) AS n FROM tok GROUP BY sid")
def unflatten(spark, d):
    return tagging.unflatten(_tokens(spark, d), "token").select("sentence_id", F.md5(F.array_join("token", " ")).alias("digest"), F.size("token").cast("long").alias("n"))


@query(f'WITH {_GOLD}, {_spans_sql("predicted", "s")} SELECT sid AS sentence_id, start_ AS "start", end_ AS "end", label FROM s')
def spans(spark, d):
    s = tagging.extract_spans(_tagged(spark, d), "predicted")
    return s.select("sentence_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label")


_BROKEN = f"CASE WHEN predicted LIKE 'B-%' AND {_H} % 3 = 0 THEN 'I' || substr(predicted, 2) WHEN predicted LIKE 'B-%' AND {_H} % 3 = 1 THEN 'X' || substr(predicted, 2) WHEN predicted = 'O' AND {_H} % 700 = 0 THEN 'A' ELSE predicted END"


@query(
    f"""WITH {_GOLD}, broken AS (SELECT sid, idx, {_BROKEN} AS t FROM tags), l AS (SELECT *, CASE WHEN contains(t, '-') THEN substr(t, instr(t, '-') + 1) END AS label FROM broken),
e AS (SELECT sid, idx, CASE WHEN t = 'O' THEN NULL WHEN NOT contains(t, '-') THEN 'malformed tag' WHEN t NOT LIKE 'B-%' AND t NOT LIKE 'I-%' THEN 'malformed prefix'
  WHEN t LIKE 'I-%' AND label IS DISTINCT FROM lag(label) OVER (PARTITION BY sid ORDER BY idx) THEN 'orphan' END AS error FROM l)
SELECT sid AS sentence_id, idx AS token_idx, error FROM e WHERE error IS NOT NULL"""
)
def bio_violations(spark, d):
    p, h = F.col("predicted"), _hash("sentence_id", "token_idx")
    begins = p.startswith("B-")
    broken = F.when(begins & (h % 3 == 0), F.concat(F.lit("I"), F.expr("substring(predicted, 2)"))).when(begins & (h % 3 == 1), F.concat(F.lit("X"), F.expr("substring(predicted, 2)"))).when((p == "O") & (h % 700 == 0), "A").otherwise(p)
    return tagging.bio_violations(_tagged(spark, d).withColumn("t", broken), "t").select("sentence_id", F.col("token_idx").cast("long").alias("token_idx"), "error")


def _by_lang(spark, d) -> DataFrame:
    rows = _tagged(spark, d).join(_read(spark, d, "documents").select(F.col("doc_id").alias("sentence_id"), "lang"), "sentence_id")
    return metrics.counted(rows, "tag", "predicted", "lang")


@query(f"WITH {_GOLD}, {_TAG_COUNTS}, {_scores_sql('counts')} SELECT part, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def label_prf(spark, d):
    s = metrics.label_scores(_by_lang(spark, d))
    return s.select("part", "label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query(
    f"""WITH {_GOLD}, {_TAG_COUNTS}, {_scores_sql('counts')}, acc AS (SELECT part, sum(CASE WHEN gold = predicted THEN n ELSE 0 END) / sum(n)::DOUBLE AS accuracy FROM counts GROUP BY part)
SELECT part, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support)::DOUBLE, 6) AS weighted_f1, round(any_value(accuracy), 6) AS accuracy
FROM f JOIN acc USING (part) GROUP BY part"""
)
def averages_by_group(spark, d):
    a = metrics.averages(_by_lang(spark, d))
    return a.select("part", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "macro_f1", "weighted_f1", "accuracy")))


@query(f"WITH {_GOLD}, {_CAT_COUNTS}, {_scores_sql('counts')} SELECT label, round(f1, 6) AS f1 FROM f WHERE label <> 'O'")
def category_f1(spark, d):
    return metrics.label_scores(metrics.counted(_tagged(spark, d), "category", "guessed")).where("label <> 'O'").select("label", F.round("f1", 6).alias("f1"))


@query(
    f"""WITH {_GOLD}, {_CAT_COUNTS}, l AS (SELECT DISTINCT unnest(['O', gold, predicted]) AS l FROM counts)
SELECT 'overall' AS part, a.l AS gold, b.l AS predicted, coalesce(n, 0)::BIGINT AS n FROM l a CROSS JOIN l b LEFT JOIN counts c ON c.gold = a.l AND c.predicted = b.l"""
)
def confusion(spark, d):
    return metrics.confusion(metrics.counted(_tagged(spark, d), "category", "guessed"))


@query(
    f"""WITH {_GOLD}, {_spans_sql("predicted", "p")}, {_spans_sql("tag", "g")}, c AS (SELECT (SELECT count(*) FROM p JOIN g USING (sid, start_, end_, label)) AS correct, (SELECT count(*) FROM p) AS predicted, (SELECT count(*) FROM g) AS gold)
SELECT correct, predicted, gold, round(correct / predicted::DOUBLE, 6) AS precision, round(correct / gold::DOUBLE, 6) AS recall, round(2.0 * correct / (predicted + gold)::DOUBLE, 6) AS f1 FROM c"""
)
def span_prf(spark, d):
    rows = _tagged(spark, d)
    s = metrics.span_scores(tagging.extract_spans(rows, "predicted"), tagging.extract_spans(rows, "tag"))
    return s.select("correct", "predicted", "gold", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(
    f"""WITH {_GOLD}, b AS (SELECT (category <> 'O') AS g, (guessed <> 'O') AS p, count(*) AS n FROM tags GROUP BY ALL)
SELECT round(sum(n) FILTER (g = p) / sum(n)::DOUBLE, 6) AS accuracy, round(2.0 * sum(n) FILTER (g AND p) / (sum(n) FILTER (g) + sum(n) FILTER (p))::DOUBLE, 6) AS f1 FROM b"""
)
def binary_scores(spark, d):
    rows = _tagged(spark, d).select((F.col("category") != "O").cast("int").alias("g"), (F.col("guessed") != "O").cast("int").alias("p"))
    s = metrics.classification_scores(rows, "g", "p", positive=1)
    return s.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query(
    f"""WITH {_GOLD}, {_CAT_COUNTS}, {_scores_sql('counts')}, l AS (SELECT unnest([{", ".join(map(_quoted, metrics.STRUCTURED))}]) AS label),
r AS (SELECT l.label, CASE WHEN f.label IS NULL THEN 0 ELSE 1 END AS f1_first, coalesce(f.f1, 0) AS f1_second FROM l LEFT JOIN (SELECT * FROM f WHERE support > 0) f USING (label)),
a AS (SELECT * FROM r UNION ALL SELECT 'macro mean', avg(f1_first), avg(f1_second) FROM r)
SELECT label, round(f1_first, 6) AS f1_first, round(f1_second, 6) AS f1_second, round(f1_second - f1_first, 6) AS delta FROM a"""
)
def ablation_delta(spark, d):
    rows = _tagged(spark, d)
    first = metrics.label_scores(metrics.counted(rows, "category", "category"))
    second = metrics.label_scores(metrics.counted(rows, "category", "guessed")).where("support > 0")
    return metrics.ablation(first, second).select("label", *(F.round(c, 6).alias(c) for c in ("f1_first", "f1_second", "delta")))


# --- models

_DOCS_BAG = f"""{_TOK}, one AS (SELECT sid, lower(token) AS feature, count(*) AS c FROM tok GROUP BY ALL),
vocab AS (SELECT feature, row_number() OVER (ORDER BY count(*) DESC, feature) - 1 AS col FROM one GROUP BY feature QUALIFY col < 2500),
x AS (SELECT sid, col, c FROM one JOIN vocab USING (feature)), y AS (SELECT doc_id AS sid, lang FROM documents WHERE lang IS NOT NULL),
priors AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM y)::DOUBLE) AS log_prior FROM y GROUP BY lang),
s AS (SELECT lang, col, sum(c)::DOUBLE AS s FROM x JOIN y USING (sid) GROUP BY ALL),
grid AS (SELECT p.lang, v.col, coalesce(s.s, 0) + 1.0::DOUBLE AS s FROM priors p CROSS JOIN vocab v LEFT JOIN s ON s.lang = p.lang AND s.col = v.col),
lik AS (SELECT lang, col, ln(s / sum(s) OVER (PARTITION BY lang)) AS log_prob FROM grid)"""


def _bag_of_documents(spark, d):
    """Words of whole documents, as many as the feature builder takes by default; all documents with a language train."""
    # the vocabulary, both checks, the sums and the scores all read the counts
    counts = cut(_tokens(spark, d).groupBy("sentence_id", F.lower("token").alias("feature")).agg(F.count("*").cast("double").alias("value")))
    top = counts.groupBy("feature").agg(F.count("*").alias("df")).orderBy(F.col("df").desc(), "feature").limit(WindowFeatureBuilder.max_word_features)
    order = F.row_number().over(Window.orderBy(F.col("df").desc(), "feature"))
    vocab = top.withColumn("column", (order - 1).cast("long")).select("feature", "column")
    features = counts.join(F.broadcast(vocab), "feature").select("sentence_id", "column", "value")
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("sentence_id"), F.col("lang").alias("category"))
    model = MulticlassNaiveBayes().fit(features, docs.where("category is not null"), ["sentence_id"], vocab)
    return model, features, docs


@query(f"WITH {_DOCS_BAG} SELECT lang AS category, round(log_prior, 6) AS log_prior FROM priors")
def nb_priors(spark, d):
    return _bag_of_documents(spark, d)[0].priors.select("category", F.round("log_prior", 6).alias("log_prior"))


@query(f'WITH {_DOCS_BAG} SELECT lang AS category, col AS "column", round(log_prob, 6) AS log_prob FROM lik')
def nb_likelihood(spark, d):
    return _bag_of_documents(spark, d)[0].likelihoods.select("category", "column", F.round("log_prob", 6).alias("log_prob"))


_NB = f"""{_DOCS_BAG}, part AS (SELECT sid, lang, sum(c * log_prob) AS s FROM x JOIN lik USING (col) GROUP BY ALL),
score AS (SELECT d.doc_id AS sid, p.lang, log_prior + coalesce(s, 0) AS score FROM documents d CROSS JOIN priors p LEFT JOIN part ON part.sid = d.doc_id AND part.lang = p.lang)"""


@query(f"WITH {_NB} SELECT sid AS sentence_id, lang AS category, round(score, 4) AS score FROM score")
def nb_scores(spark, d):
    model, features, docs = _bag_of_documents(spark, d)
    return model.joint_log(features, docs, ["sentence_id"]).select("sentence_id", "category", F.round("score", 4).alias("score"))


@query(f"WITH {_NB} SELECT sid AS sentence_id, lang AS predicted FROM score QUALIFY row_number() OVER (PARTITION BY sid ORDER BY score DESC, lang) = 1")
def nb_predict(spark, d):
    model, features, docs = _bag_of_documents(spark, d)
    return model.predict(features, docs, ["sentence_id"])


def _gd_sql(steps: int = 3, rate: float = 0.15) -> str:
    out = [f"{_TOK}, r AS (SELECT {_SHAPES_SQL}, ({_SILVER} <> 'O')::INT::DOUBLE AS y FROM tok)", "s0 AS (SELECT 0.0::DOUBLE AS bias, " + ", ".join(f"0.0::DOUBLE AS w_{i}" for i in range(6)) + ")"]
    for k in range(1, steps + 1):
        z = "bias + " + " + ".join(f"{c} * w_{i}" for i, c in enumerate(_SHAPES))
        out.append(f"p{k} AS (SELECT r.*, s.*, 1 / (1 + exp(-({z}))) AS p FROM r CROSS JOIN s{k - 1} s)")
        ws = ", ".join(f"any_value(w_{i}) - {rate}::DOUBLE * avg({c} * (p - y)) AS w_{i}" for i, c in enumerate(_SHAPES))
        out.append(f"s{k} AS (SELECT {ws}, any_value(bias) - {rate}::DOUBLE * avg(p - y) AS bias, avg(-(y * ln(greatest(least(p, 1 - 1e-12), 1e-12)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)))) AS loss FROM p{k})")
    return ",\n".join(out)


_COLS = ", ".join(f"round({c}, 6) AS {c}" for c in (*(f"w_{i}" for i in range(6)), "bias", "loss"))


@query(f"WITH {_gd_sql()} " + " UNION ALL ".join(f"SELECT {k} AS step, {_COLS} FROM s{k}" for k in (1, 2, 3)))
def lr_gd_steps(spark, d):
    rows = _shaped(_tokens(spark, d)).withColumn("y", (T.silver_category("token") != "O").cast("double"))
    return sql_steps(rows, list(_SHAPES), "y")


_FIXED = (-0.2, 2.0, 1.5, 0.5, -1.0, 1.0, -1.25)  # weights of the shapes and a bias, to be applied


@query(
    f"WITH {_TOK}, t AS (SELECT DISTINCT token FROM tok), r AS (SELECT token, {_SHAPES_SQL} FROM t) SELECT token, round(1 / (1 + exp(-({_FIXED[-1]} + "
    + " + ".join(f"{c} * {w}" for c, w in zip(_SHAPES, _FIXED, strict=False))
    + "))), 6) AS probability FROM r"
)
def lr_predict(spark, d):
    z = F.lit(_FIXED[-1])
    for c, w in zip(_SHAPES, _FIXED, strict=False):
        z = z + F.col(c) * w
    return _shaped(_tokens(spark, d).select("token").distinct()).select("token", F.round(sigmoid(z), 6).alias("probability"))


# --- corpus and splits


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_first(spark, d):
    return splits.keep_first(_read(spark, d, "documents").select("doc_id", "text"), key="doc_id").select("doc_id")


_SPLIT = """u AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text), g AS (SELECT u.doc_id, d.lang, u.text FROM u JOIN documents d USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS at_, count(*) OVER (PARTITION BY lang) AS n FROM g),
split AS (SELECT doc_id, lang, text, CASE WHEN at_ <= round_even(n * 0.70::DOUBLE, 0) THEN 'train' WHEN at_ <= round_even(n * 0.70::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'val' ELSE 'test' END AS split FROM r)"""


def _splits(spark, d):
    return splits.split(splits.keep_first(_read(spark, d, "documents").select("doc_id", "lang", "text"), key="doc_id"), by="lang", key="doc_id")


@query(f"WITH {_SPLIT} SELECT doc_id, lang, split FROM split")
def stratified_split(spark, d):
    return _splits(spark, d).select("doc_id", "lang", "split")


@query(f"WITH {_SPLIT} SELECT split, lang, count(*) AS n, sum(len(regexp_extract_all(text, '{_WORD}')))::BIGINT AS tokens FROM split GROUP BY ALL")
def split_counts(spark, d):
    rows = _splits(spark, d).withColumn("n_tokens", F.size(T.words("text")))
    return rows.groupBy("split", "lang").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"))


@query("SELECT text, count(DISTINCT (doc_id % 3)) AS splits, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def split_leakage(spark, d):
    return splits.leakage(_read(spark, d, "documents").withColumn("split", F.col("doc_id") % 3))


def _corpus_sql() -> str:
    k = corpus.Dialect(duck=True)
    rows = ", ".join(f"('{g}', {t}, {s}, {_quoted(kind) if kind else 'NULL'}, {_quoted(lit) if lit is not None else 'NULL'})" for g, t, s, kind, lit in corpus.segments())
    return f"""ids AS (SELECT DISTINCT doc_id AS row_id FROM documents), ex AS ({corpus._examples(k, "ids")}),
parts AS (SELECT * FROM (VALUES {rows}) v(grp, template, slot, kind, literal)),
drawn AS (SELECT *, {", ".join(k.draws())} FROM ex JOIN parts USING (grp, template)),
filled AS (SELECT row_id, grp, slot, kind, {k.value()} AS value FROM drawn),
placed AS (SELECT *, coalesce(sum(length(value)) OVER (PARTITION BY row_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ FROM filled)"""


def _corpus(spark, d):
    return corpus.generate(_read(spark, d, "documents").select(F.col("doc_id").alias("row_id")).distinct())


@query(f'WITH {_corpus_sql()} SELECT row_id AS sentence_id, grp AS "group", string_agg(value, \'\' ORDER BY slot) AS text FROM placed GROUP BY ALL')
def corpus_generate(spark, d):
    return _corpus(spark, d).select("sentence_id", "group", "text")


@query(f'WITH {_corpus_sql()} SELECT row_id AS sentence_id, start_ AS "start", start_ + length(value) AS "end", kind AS label, value FROM placed WHERE kind IS NOT NULL')
def corpus_values(spark, d):
    rows = _corpus(spark, d).select("sentence_id", F.explode("spans").alias("s")).select("sentence_id", "s.*")
    return rows.select("sentence_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "label", "value")


_ALIGNED = f"""{_corpus_sql()}, rows_ AS (SELECT sentence_id, text, {_treebank_sql("text")} AS w FROM (SELECT row_id AS sentence_id, string_agg(value, '' ORDER BY slot) AS text FROM placed GROUP BY row_id)),
{_offsets_sql("rows_", "sentence_id")}, spans AS (SELECT row_id AS sentence_id, start_ AS s0, start_ + length(value) AS s1, kind AS label FROM placed WHERE kind IS NOT NULL)"""


@query(
    f"""WITH {_ALIGNED}, hit AS (SELECT o.*, s0, label, row_number() OVER (PARTITION BY o.sentence_id, s0 ORDER BY idx) AS nth FROM offs o LEFT JOIN spans s ON o.sentence_id = s.sentence_id AND start_ < s1 AND end_ > s0)
SELECT sentence_id, idx::INT AS token_idx, token, start_ AS "start", end_ AS "end", CASE WHEN label IS NULL THEN 'O' WHEN nth = 1 THEN 'B-' || label ELSE 'I-' || label END AS tag FROM hit"""
)
def span_overlap_align(spark, d):
    return corpus.tagged_tokens(_corpus(spark, d))


@query(
    f"""WITH {_ALIGNED}, broken AS (SELECT * FROM spans UNION ALL SELECT * FROM spans WHERE sentence_id % 7 = 0 UNION ALL SELECT DISTINCT sentence_id, 0, 0, 'PERSON' FROM spans WHERE sentence_id % 7 = 1),
lone AS (SELECT sentence_id, 'entity without token' AS error FROM broken b WHERE NOT EXISTS (SELECT 1 FROM offs o WHERE o.sentence_id = b.sentence_id AND start_ < s1 AND end_ > s0)),
twice AS (SELECT o.sentence_id, 'overlapping entities' AS error FROM offs o JOIN broken b ON o.sentence_id = b.sentence_id AND start_ < s1 AND end_ > s0 GROUP BY o.sentence_id, idx HAVING count(*) > 1)
SELECT * FROM lone UNION ALL SELECT * FROM twice"""
)
def corpus_errors(spark, d):
    """Errors planted by rule: all spans of every seventh sentence twice, a span without characters in every seventh after it."""
    empty = F.expr("named_struct('start', 0, 'end', 0, 'label', 'PERSON', 'value', '')")
    spans = F.when(F.col("sentence_id") % 7 == 0, F.concat("spans", "spans")).when(F.col("sentence_id") % 7 == 1, F.concat("spans", F.array(empty))).otherwise(F.col("spans"))
    return corpus.tagging_errors(_corpus(spark, d).withColumn("spans", spans))


# --- the whole job


def _job(spark, total: int = 1200, max_iter: int = 600, chars: bool = True):
    _, tokens = training.labelled_corpus(spark, total)
    return training.train_configuration(tokens, chars, max_iter=max_iter), tokens


@query()
def lr_full(spark, d):
    """The loss of each step over the generated corpus."""
    fitted, _ = _job(spark)
    return spark.createDataFrame(list(enumerate(fitted["gate"].history, 1)), "iteration int, loss double")


@query()
def cascade_predict(spark, d):
    return _job(spark)[0]["predicted"].select("sentence_id", "token_idx", "token", "tag", "predicted", "split", "group")


@query()
def training_report(spark, d):
    fitted, _ = _job(spark)
    return training.breakdown(fitted["predicted"])["tokens"]


@query()
def library_comparison(spark, d):
    fitted, tokens = _job(spark)
    return training.library_comparison(spark, fitted, tokens)
