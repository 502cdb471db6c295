"""The library's own operators: worked cases, invariants, and SQL of another engine."""

import json
import math
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomtext.functions import text as T
from loomtext.functions.porter import stem
from loomtext.operators import corpus, metrics, splits, tagging
from loomtext.operators.features import WindowFeatureBuilder, sentence_rows, token_rows
from loomtext.operators.logistic import BinaryLogisticRegression, sparse_rows
from loomtext.operators.naive_bayes import MulticlassNaiveBayes
from loomtext.plans import jobs, training
from loomtext.plans import queries as own
from loomtext.sources.jsonl import read_sentences, read_splits, write_document, write_report, write_sentences
from loomtext.streaming.stateless import cleaned_stream

SMALL = "/root/testdata/sf0.001"


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f("t").alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("<p>Call me 😊 at +880-1712-345678 or Test.User@example.com</p>", "Call me at +880-1712-345678 or Test.User@example.com"),
        ("&lt;b&gt;x", "<b>x"), ("&amp;lt;", "&lt;"), ("<script>var a=1;</script>", "var a=1;"), ("ﬁ①&amp;lt;", "fi1&lt;"), ("a \x1cb", "a b"), (None, None), ("", ""),
    ],
)
def test_clean(spark, raw, want):
    assert _one(spark, raw, lambda c: T.clean(c, exact=True)) == want


def test_clean_keeps_emoji_on_request(spark):
    assert _one(spark, "a😊b", lambda c: T.clean(c, remove_emoji=False)) == "a😊b"
    assert _one(spark, "a👩‍🔬b", T.clean) == "a b"


@pytest.mark.parametrize(
    ("raw", "want"),
    [("nmbr", "number"), ("01712345678", "01712345678"), ("fone", "phone"), ("plz", "please"), ("PLZ", "PLEASE"), ("Plz", "Please"), ("and", "bank"), ("a1", "a1"), ("x@y", "x@y"), ("don't", "don't"), ("zzzzzzz", "zzzzzzz")],
)
def test_spelling(spark, raw, want):
    assert _one(spark, raw, T.correct_token) == want


def test_spelling_without_vocabulary(spark):
    assert _one(spark, "nmbr", lambda c: T.correct_token(c, vocabulary=())) == "nmbr"


def test_treebank_and_offsets(spark):
    text = 'mail a.b12@x.com, "now" (don\'t) for BDT 12,300.'
    got = spark.createDataFrame([(text,)], "t string").select(T.offsets("t", T.treebank("t")).alias("x")).first().x
    assert [r.token for r in got] == ["mail", "a.b12", "@", "x.com", ",", '"', "now", '"', "(", "do", "n't", ")", "for", "BDT", "12,300", "."]
    assert all(text[r.start : r.end] == r.token for r in got)


def test_token_transforms(spark):
    df = spark.createDataFrame([(["The", "Ponies", "and", "42", "relational"],)], "w array<string>")
    assert df.select(T.transform_tokens("w", lowercase=True, remove_stopwords=True, stem=True).alias("x")).first().x == ["poni", "42", "relat"]
    assert df.select(T.transform_tokens("w", lemmas={"ponies": "pony"}).alias("x")).first().x[1] == "pony"


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("digitizer", "digit"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll")],
)
def test_porter(word, want):
    assert stem(word) == want


def _rows(spark, tags, name="tag"):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(tags)], f"sentence_id long, token_idx int, {name} string")


def test_bio_rebuild(spark):
    cats = ["PERSON", "PERSON", "O", "PERSON", "EMAIL", "EMAIL", "PHONE_NUMBER", "PHONE_NUMBER"]
    out = tagging.categories_to_bio(_rows(spark, cats, "category"))
    assert [r.tag for r in out.orderBy("token_idx").collect()] == ["B-PERSON", "I-PERSON", "O", "B-PERSON", "B-EMAIL", "I-EMAIL", "B-PHONE_NUMBER", "I-PHONE_NUMBER"]
    assert tagging.bio_violations(out).count() == 0


def test_spans_and_violations(spark):
    got = tagging.extract_spans(_rows(spark, "I-A I-A B-A X-A O I-B Z".split())).orderBy("start").collect()
    assert [(r.start, r.end, r.label) for r in got] == [(0, 2, "A"), (2, 3, "A"), (3, 4, "A"), (5, 6, "B"), (6, 7, "Z")]
    for tags, want in (("B-A I-B", "orphan"), ("I-A", "orphan"), ("A", "malformed tag"), ("X-A", "malformed prefix")):
        assert [r.error for r in tagging.bio_violations(_rows(spark, tags.split())).collect()] == [want]


def test_window_features(spark):
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b", "a"])], "sentence_id long, token_idx int, token string")
    names = WindowFeatureBuilder().names(tokens).where("token_idx = 0").first().names
    assert sorted(names) == sorted(["word=a", "word=b", "word=a", "offset=+0:word=a", "offset=+1:word=b", "offset=+2:word=a"])
    b = WindowFeatureBuilder(min_frequency=1, use_char_ngrams=True).fit(tokens)
    vocabulary = b.vocabulary.orderBy("column").collect()
    assert [r.column for r in vocabulary] == list(range(len(vocabulary))) and [r.feature for r in vocabulary[-6:]] == list(T.ORTHOGRAPHIC)
    assert math.isclose(next(r.idf for r in vocabulary if r.feature == "word=b"), math.log(4 / 4) + 1)
    assert b.transform(tokens, "tfidf").where("value = 0").count() == 0


def _bags(sentences, window):
    low = [[t.lower() for t in s] for s in sentences]
    for s, own in enumerate(low):
        for i, token in enumerate(own):
            bag = Counter(f"char{n}={x[p : p + n]}" for x in [f"^{token}$"] for n in (3, 4) for p in range(len(x) - n + 1))
            for o in range(-window, window + 1):
                if 0 <= i + o < len(own):
                    bag.update([f"word={own[i + o]}", f"offset={o:+d}:word={own[i + o]}"])
            yield (s, i), bag


@pytest.mark.parametrize("window", [0, 1, 2, 3])
def test_features_by_brute_force(spark, window):
    draw = random.Random(window)
    sentences = [[draw.choice(["a", "B", "b", "word=a", "offset=+1:word=b", "\u0130\u2028x", "aaaaa"]) for _ in range(n)] for n in (0, 1, 2, 3, 5, 8, 13, 21)]
    tokens = spark.createDataFrame([(s, 7 * i, t) for s, own in enumerate(sentences) for i, t in enumerate(own)], "sentence_id long, token_idx int, token string").repartition(3)
    bags = {(s, 7 * i): bag for (s, i), bag in _bags(sentences, window)}
    df = Counter(x for bag in bags.values() for x in bag)
    b = WindowFeatureBuilder(window_size=window, use_char_ngrams=True, min_frequency=2)
    got = b.document_frequency(tokens).collect()
    assert len(got) == len(df) and {r.feature: r.df for r in got} == df
    rows = b.fit(tokens).transform(tokens, shapes=False).collect()
    want = {(*at, x): c for at, bag in bags.items() for x, c in bag.items() if df[x] >= 2}
    assert len(rows) == len(want) and {(r.sentence_id, r.token_idx, r.feature): r.value for r in rows} == want
    names = {r.column: (r.feature, r.idf) for r in b.vocabulary.collect()}
    assert all(names[r.column][0] == r.feature for r in rows)
    shaped = b.transform(tokens, "tfidf")
    assert {(r.sentence_id, r.token_idx, r.feature): r.value for r in shaped.collect() if not r.feature.startswith("ortho:")} == {k: c * next(i for f, i in names.values() if f == k[2]) for k, c in want.items()}


def test_features_of_sentences_are_those_of_rows(spark):
    docs = spark.createDataFrame([(1, "A b\ta  b"), (2, None), (3, " \n"), (4, "b"), (5, "\u0391\u03a3 x \u0130")], "doc_id long, text string")
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = []
        for tokens in (sentence_rows(docs), token_rows(docs), sentence_rows(docs).drop("low")):
            b = WindowFeatureBuilder(min_frequency=1, use_char_ngrams=True)
            rows = b.fit_transform(tokens, "tfidf").collect()
            got.append((sorted(b.vocabulary.collect()), sorted((r.sentence_id, r.token_idx, r.column, r.feature, round(r.value, 9)) for r in rows)))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
    assert got[0] == got[1] == got[2] and len(got[0][1]) > 50


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_named_once_a_word(spark):
    tokens = spark.createDataFrame([(1, 0, "a")], "sentence_id long, token_idx int, token string")
    plan = _plan(WindowFeatureBuilder().document_frequency(tokens))
    assert plan.index("Generate") < plan.index("HashAggregate")


def test_feature_rows_are_not_shuffled(spark):
    tokens = spark.createDataFrame([(1, 0, "a")] * 2, "sentence_id long, token_idx int, token string")
    b = WindowFeatureBuilder(use_char_ngrams=True).fit(tokens)
    b.vocabulary = spark.createDataFrame(b.vocabulary.collect(), b.vocabulary.schema)
    shuffles = re.findall(r"Exchange hashpartitioning\(.*", _plan(b.transform(tokens)))
    assert shuffles and not any("feature" in x or "token_idx" in x for x in shuffles)


def test_feature_errors(spark):
    for bad in ({"window_size": -1}, {"char_ngram_range": (0, 2)}, {"char_ngram_range": (4, 3)}):
        with pytest.raises(ValueError):
            WindowFeatureBuilder(**bad)
    with pytest.raises(RuntimeError):
        WindowFeatureBuilder().transform(None)


def test_shapes_and_ngrams(spark):
    row = spark.createDataFrame([("A.1@",)], "t string").select(*T.orthographic("t")).first()
    assert tuple(row) == (1.0, 1.0, 1.0, 1.0, 0.08, 0.0)
    assert _one(spark, "ab", T.char_ngrams) == ["char3=^ab", "char3=ab$", "char4=^ab$"] and _one(spark, "a", T.char_ngrams) == ["char3=^a$"]


def test_naive_bayes(spark):
    f = spark.createDataFrame([(i, 0, 1.0) for i in range(3)] + [(3, 1, 2.0)], "id long, column long, value double")
    y = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "b")], "id long, category string")
    m = MulticlassNaiveBayes().fit(f, y, ["id"], spark.createDataFrame([(0,), (1,)], "column long"))
    priors = {r.category: r.log_prior for r in m.priors.collect()}
    assert math.isclose(priors["a"], math.log(0.75)) and math.isclose(priors["b"], math.log(0.25))
    assert all(math.isclose(r.s, 1) for r in m.likelihoods.groupBy("category").agg(F.sum(F.exp("log_prob")).alias("s")).collect())
    assert {r.id: r.predicted for r in m.predict(f, y, ["id"]).collect()} == {0: "a", 1: "a", 2: "a", 3: "b"}
    with pytest.raises(ValueError):
        MulticlassNaiveBayes(alpha=0)
    with pytest.raises(ValueError):
        MulticlassNaiveBayes().fit(f.withColumn("value", -F.col("value")), y, ["id"], y)


def test_logistic_first_step(spark):
    f = spark.createDataFrame([(0, 0, 1.0)], "id long, column int, value double")
    y = spark.createDataFrame([(0, 1), (1, 0)], "id long, y int")
    rows = sparse_rows(f, y, ["id"], "y")
    m = BinaryLogisticRegression(max_iter=1).fit(rows, 1)
    assert math.isclose(m.weights[0], 0.0375) and abs(m.bias) < 1e-12 and math.isclose(m.history[0], math.log(2))
    m = BinaryLogisticRegression(max_iter=30).fit(rows, 1)
    assert m.history == sorted(m.history, reverse=True)
    assert {r.id: r.pred for r in m.predict(rows).collect()} == {0: 1, 1: 0}
    with pytest.raises(ValueError):
        m.predict(rows, threshold=1)
    with pytest.raises(ValueError):
        BinaryLogisticRegression().fit(rows.withColumn("label", F.lit(2)), 1)


def test_metrics_invariants(spark):
    gold = "B-A I-A O B-B O O".split()
    said = "B-A O O B-B B-A O".split()
    rows = _rows(spark, gold).join(_rows(spark, said, "predicted"), ["sentence_id", "token_idx"])
    r = metrics.evaluate_bio(rows)
    assert r["confusion"].agg(F.sum("n")).first()[0] == 6 and r["confusion"].count() == 9
    s = r["spans"].first()
    assert (s.correct, s.predicted, s.gold) == (1, 3, 2) and math.isclose(s.f1, 0.4)
    assert math.isclose(r["tokens"].first().accuracy, 4 / 6)
    assert metrics.shape_errors(rows, rows.limit(4)).count() == 2
    perfect = metrics.evaluate_bio(rows.withColumn("predicted", F.col("tag")))["tokens"].first()
    assert perfect.macro_f1 == perfect.weighted_f1 == perfect.accuracy == 1


def test_splits(spark):
    rows = spark.range(90).selectExpr("id as sentence_id", "cast(id % 3 as string) `group`", "concat('t', id) text")
    out = splits.split(rows).persist()
    assert {(r.split, r["group"]): r.n for r in splits.group_counts(out).collect()} == {(s, str(g)): n for s, n in (("train", 21), ("val", 4), ("test", 5)) for g in range(3)}
    assert splits.leakage(out).count() == 0
    assert splits.keep_first(rows.union(rows.selectExpr("sentence_id + 100", "`group`", "text"))).agg(F.max("sentence_id")).first()[0] == 89
    with pytest.raises(ValueError):
        splits.split(rows, train=0.9, val=0.2)


def test_corpus_and_job(spark, tmp_path):
    examples, tokens = training.labelled_corpus(spark, 300)
    assert examples.count() == 300 and splits.leakage(examples).count() == 0
    assert tagging.bio_violations(tokens).count() == 0 and corpus.tagging_errors(examples).count() == 0
    assert all(r.text[s.start : s.end] == s.value for r in examples.collect() for s in r.spans)
    tags = {r.tag == "O": r["count"] for r in tokens.withColumn("tag", F.when(F.col("tag") == "O", "O").otherwise("in")).groupBy("tag").count().collect()}
    assert tags[True] > tags[False] > 0 and tokens.where("sentence_id is null").count() == 0  # words outside entities are kept
    seen = {(r["group"], r.tag) for r in tokens.select("group", "tag").distinct().collect()}
    assert {("clean", "I-PERSON"), ("banglish", "I-PHONE_NUMBER"), ("noisy", "I-ADDRESS"), ("clean", "I-EMAIL"), ("noisy", "I-ORGANIZATION")} <= seen
    rows = corpus.sentences(examples, tokens).join(examples.select("sentence_id", "split"), "sentence_id")
    write_sentences(rows.drop("sentence_id"), str(tmp_path / "c"))
    assert read_sentences(spark, str(tmp_path / "c" / "split=train")).where("size(tokens) = size(tags)").count() == 210
    (tmp_path / "bad.jsonl").write_text('{"text":"x","tokens":["x"],"tags":[],"group":"clean"}\n')
    with pytest.raises(Exception, match="differ"):
        read_sentences(spark, str(tmp_path / "bad.jsonl")).collect()
    fitted = training.train_configuration(tokens, use_char_ngrams=True, max_iter=15)
    reports = training.breakdown(fitted["predicted"])
    parts = {r.part: r for r in reports["tokens"].collect()}
    assert set(parts) == {"overall", "clean", "banglish", "noisy"} and parts["overall"].accuracy > 0.5
    write_report(reports["spans"], str(tmp_path / "r"))
    with pytest.raises(ValueError):
        corpus.generate_examples(spark, 0)


def test_stream(spark, tmp_path):
    spark.createDataFrame([("<b>plz</b> mail a@b.example",)], "text string").write.json(str(tmp_path / "in"))
    s = cleaned_stream(spark.readStream.schema("text string").json(str(tmp_path / "in")), spell=True)
    q = s.writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    row = spark.table("cleaned").first()
    assert row.redacted == "plz mail [EMAIL]" and row.tokens[0] == "please"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want, got = con.execute(own.ORACLES[name]).df(), own.QUERIES[name](spark, SMALL).toPandas()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    got, want = (x[names].sort_values(names).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and all((got[c] == want[c]).all() for c in names)


def test_job_trains_to_the_end(spark, monkeypatch):
    """The registered queries take the operator's own number of steps."""
    asked = {}
    monkeypatch.setattr(training, "labelled_corpus", lambda *a, **k: (None, None))
    monkeypatch.setattr(training, "train_configuration", lambda tokens, chars, **how: asked.update(how))
    own._job(spark)
    assert asked.get("max_iter", BinaryLogisticRegression().max_iter) == BinaryLogisticRegression().max_iter == 600


def test_library_comparison_has_both_models(spark, monkeypatch):
    _, tokens = training.labelled_corpus(spark, 60)
    fitted = training.train_configuration(tokens, True, max_iter=3)
    asked = {}
    monkeypatch.setattr(own, "_job", lambda spark, **how: (asked.update(how), (fitted, tokens))[1])
    rows = {r.model: r for r in own.library_comparison(spark, "").collect()}
    assert asked.get("chars", True) and set(rows) == {"logistic_regression_binary", "naive_bayes_category"}
    assert rows["naive_bayes_category"].accuracy_difference < 0.1 and rows["naive_bayes_category"].f1_own > 0


def test_clean_queries_are_exact(spark, tmp_path):
    raw = "\ufb01x &#39;caf&eacute;&#39; \uff21"
    spark.createDataFrame([(1, raw)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, raw)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    for query in (own.clean_documents, own.clean_pages):
        assert query(spark, str(tmp_path)).first().cleaned == "fix 'caf\u00e9' A"


def test_text_must_be_text(spark):
    with pytest.raises(Exception, match="must be a string"):
        spark.range(1).select(T.clean("id")).collect()
    assert spark.range(1).select(T.clean(F.lit(None)).alias("x")).first().x is None


def test_sentences_and_tokens(spark):
    text = 'Dr. Rahman called. He asked: "Is it late?" No. 5 is fine. J. Smith left.'
    assert _one(spark, text, T.sentences) == ["Dr. Rahman called.", 'He asked: "Is it late?"', "No. 5 is fine.", "J. Smith left."]
    assert _one(spark, "One. Two.", T.tokenize) == ["One", ".", "Two", "."] and _one(spark, None, T.tokenize) is None


def test_offsets_of_long_texts(spark):
    text = "  ".join(f"w{i}" for i in range(20_000))
    got = _one(spark, text, lambda c: T.offsets(c, T.words(c)))
    assert len(got) == 20_000 and all(text[r.start : r.end] == r.token for r in got[::997])
    assert _one(spark, None, lambda c: T.offsets(c, T.words(c))) is None


def test_offsets_make_no_object_for_each_token():
    texts = pa.array(["a bb  a", None, "x", "", "\U0001f600 a b"] + ["ab " * 20] * 20_000)
    tokens = pa.array([["a", "bb", "a"], ["z"], None, [], ["\U0001f600", "b"]] + [["ab"] * 20] * 20_000)
    tracemalloc.start()
    got = T._offsets.func(texts, tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = lambda row: row and [(x["token"], x["start"], x["end"]) for x in row]
    assert [at(x) for x in got[:5].to_pylist()] == [[("a", 0, 1), ("bb", 2, 4), ("a", 6, 7)], None, None, [], [("\U0001f600", 0, 1), ("b", 4, 5)]]
    assert at(got[-1].as_py()) == [("ab", 3 * i, 3 * i + 2) for i in range(20)]
    assert peak < 40 * 400_000  # bytes for each token; a dict of each takes some hundreds


def test_vocabulary_as_a_column(spark):
    df = spark.createDataFrame([("fone", ["PHONE", "Phone", "bone"])], "t string, v array<string>")
    assert df.select(T.correct_token("t", F.col("v")).alias("x")).first().x == "bone"
    assert df.select(T.levenshtein_distance("t", F.lit("phone")).alias("x")).first().x == 2


def test_lemmas_of_letters_only(spark):
    df = spark.createDataFrame([(["Mice", "mice2"],)], "w array<string>")
    assert df.select(T.transform_tokens("w", lemmas={"mice": "mouse", "mice2": "no"}).alias("x")).first().x == ["mouse", "mice2"]


@pytest.mark.parametrize("token", ["Ⅷ", "ⓐⒶ", "²", "①a", "٣", "Ǆ", "ǅ", "a", "7"])
def test_shapes_of_odd_characters(spark, token):
    row = spark.createDataFrame([(token,)], "t string").select(*T.orthographic("t")).first()
    assert (row[0], row[1], row[5]) == (float(token[0].isupper()), float(any(c.isdigit() for c in token)), float(token.isdigit()))


def test_reports_by_group_and_order(spark):
    rows = [(1, 0, "B-A", "B-A", "x"), (1, 1, "I-A", "O", "x"), (2, 0, "B-B", "B-B", "y"), (2, 1, "O", "O", "y")]
    df = spark.createDataFrame(rows, "sentence_id long, token_idx int, tag string, predicted string, `group` string")
    r = metrics.evaluate_bio(df, by="group")
    assert {x.part: (x.correct, x.predicted, x.gold) for x in r["spans"].collect()} == {"overall": (1, 2, 2), "x": (0, 1, 1), "y": (1, 1, 1)}
    assert [(x.part, x.label) for x in metrics.in_order(r["labels"], "label").collect()] == [("overall", "B-A"), ("overall", "B-B"), ("overall", "I-A"), ("overall", "O"), ("x", "B-A"), ("x", "I-A"), ("x", "O"), ("y", "B-B"), ("y", "O")]
    assert [x.gold for x in metrics.in_order(r["confusion"].where("part = 'x'"), "gold", "predicted", outside="first").collect()] == ["O", "O", "A", "A"]
    said = df.select("sentence_id", "token_idx", F.col("predicted").alias("tag"))
    assert metrics.evaluate_sequences(said, df, by="group")["spans"].count() == 3
    with pytest.raises(ValueError):
        metrics.evaluate_sequences(said.limit(3), df)
    none = metrics.evaluate_bio(df.limit(0), by="group")
    assert [tuple(x) for x in none["tokens"].collect()] == [("overall", 0, 0, 0, 0, 0)] and none["spans"].first().f1 == 0


def test_alignment_fails_on_bad_spans(spark):
    tokens = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 3, 5)], "sentence_id long, token_idx int, start int, end int")
    spans = lambda *s: spark.createDataFrame([(1, *x) for x in s], "sentence_id long, start int, end int, label string")
    assert [x.tag for x in tagging.aligned(tokens, spans((0, 5, "A"))).orderBy("token_idx").collect()] == ["B-A", "I-A"]
    for bad, what in ((((2, 3, "A"),), "without token"), (((0, 2, "A"), (1, 5, "B")), "overlapping")):
        with pytest.raises(ValueError, match=what):
            tagging.aligned(tokens, spans(*bad))


def test_splits_without_validation(spark):
    rows = spark.range(100).selectExpr("id as sentence_id", "if(id < 90, 'a', null) `group`", "concat('t', id) text")
    got = {(r.split, r["group"]): r.n for r in splits.group_counts(splits.split(rows, train=0.8, val=0.0)).collect()}
    assert got == {("train", "a"): 72, ("test", "a"): 18, ("train", None): 8, ("test", None): 2}


def test_model_shapes(spark):
    f = spark.createDataFrame([(0, 5, 1.0)], "id long, column long, value double")
    y = spark.createDataFrame([(0, "a")], "id long, category string")
    with pytest.raises(ValueError):
        MulticlassNaiveBayes().fit(f, y, ["id"], spark.createDataFrame([(0,)], "column long"))
    with pytest.raises(RuntimeError):
        MulticlassNaiveBayes().joint_log(f, y, ["id"])
    rows = spark.createDataFrame([([7], [1.0], 1), ([0], [1.0], 0)], "columns array<int>, values array<double>, label int")
    with pytest.raises(ValueError):
        BinaryLogisticRegression(max_iter=1).fit(rows, 3)
    with pytest.raises(RuntimeError):
        BinaryLogisticRegression().decision(rows)


def test_gradients_are_summed_in_tasks(spark):
    r = [([i % 3], [1.0], i % 2) for i in range(300)]
    rows = spark.createDataFrame(r, "columns array<int>, values array<double>, label int")
    few, many = (BinaryLogisticRegression(max_iter=2).fit(rows.repartition(n), 3) for n in (1, 90))
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(few.weights, many.weights, strict=True)) and math.isclose(few.history[1], many.history[1])


def test_corpus_parts(spark):
    assert corpus.generate_group_example(spark, "noisy", 4).select("group").distinct().collect() == [("noisy",)]
    values = corpus.generate_values(spark.range(50).withColumnRenamed("id", "row_id"), "PHONE_NUMBER").collect()
    assert all(v.value.startswith("01") and len(v.value) == 11 for v in values)
    for bad in (lambda: corpus.generate_group_example(spark, "loud"), lambda: corpus.generate_values(spark.range(1), "AGE")):
        with pytest.raises(ValueError):
            bad()
    assert all(len(corpus.OPENINGS[g]) * len(corpus.CONTINUATIONS[g]) == corpus.n_templates() for g in corpus.GROUPS)


def test_jobs(spark, tmp_path):
    """The corpus job, the acceptance checks and the training job with its report."""
    data, out = str(tmp_path / "data"), str(tmp_path / "results" / "report.json")
    with pytest.raises(ValueError):
        jobs.build_corpus(spark, data, 999)
    with pytest.raises(SystemExit):
        jobs.main(["corpus", "--num-examples", "10"])
    counts = jobs.build_corpus(spark, data, 1000).collect()
    assert sum(r.n for r in counts) == 1000 and {r.split for r in counts} == {"train", "val", "test"}
    said = jobs.check(spark, data)
    assert len(said) == 5 + len(jobs.COVERED)
    rows = read_splits(spark, data)
    assert rows.count() == rows.select("sentence_id").distinct().count() == 1000
    assert tagging.sample(rows, "clean", "I-EMAIL").first()["group"] == "clean" and tagging.sample(rows, "clean", "I-NONE").count() == 0
    report = jobs.train(spark, data, out, max_iter=12)
    text = open(out, encoding="utf-8").read()
    assert json.loads(text) == json.loads(json.dumps(report)) and text.startswith('{\n  "stage"') and text.endswith("}\n")
    assert report["dataset"]["train_sentences"] + report["dataset"]["validation_sentences"] + report["dataset"]["test_sentences"] == 1000
    for c in report["configurations"].values():
        assert c["models"]["logistic_regression"]["iterations"] == 12 and set(c["test"]["by_group"]) == set(corpus.GROUPS)
        m = c["test"]["overall"]["confusion_matrix"]
        assert m["labels"][0] == "O" and m["labels"][1:] == sorted(m["labels"][1:]) and all(len(row) == len(m["labels"]) for row in m["matrix"])
    assert report["configurations"]["word_only"]["features"]["character_ngrams"] is None
    assert set(report["library_validation"]) == {"matrix_config", "logistic_regression_binary", "naive_bayes_category"}
    assert set(report["structured_category_ablation"]["per_category"]) == set(metrics.STRUCTURED)
    assert "macro mean" in jobs.report_tables(report)
    broken = rows.withColumn("tags", F.when(F.col("split") == "val", F.transform("tags", lambda t: F.lit("X"))).otherwise(F.col("tags")))
    from loomtext.sources.jsonl import write_splits

    write_splits(broken, str(tmp_path / "broken"))
    with pytest.raises(AssertionError, match="grammar"):
        jobs.check(spark, str(tmp_path / "broken"))
    write_document(spark, {"é": 1}, str(tmp_path / "a" / "b.json"))
    assert (tmp_path / "a" / "b.json").read_text(encoding="utf-8") == '{\n  "é": 1\n}\n'


def test_public_names():
    import loomtext

    assert all(hasattr(loomtext, n) for n in loomtext.__all__)
