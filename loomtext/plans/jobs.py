"""The jobs: make the corpus, train and report, check a corpus. Also ``python -m loomtext.plans.jobs corpus|train|check``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, metrics, splits, tagging
from ..sources.jsonl import SPLITS, read_splits, write_document, write_splits
from . import training

#: The smallest corpus that the job makes.
LEAST = 1000
CONFIGURATIONS = (("word_only", False), ("word_plus_char_ngrams", True))
#: (group, tag) that a corpus must have a sentence of.
COVERED = (("clean", "I-PERSON"), ("banglish", "I-PHONE_NUMBER"), ("noisy", "I-ADDRESS"), ("clean", "I-EMAIL"), ("noisy", "I-ORGANIZATION"))


def build_corpus(spark: SparkSession, folder: str, total: int = 1200, seed: int = 42) -> DataFrame:
    """Makes, splits and writes a corpus of ``total`` sentences, and returns how many each split and group has. Fewer than ``LEAST`` raise ValueError."""
    if total < LEAST:
        raise ValueError(f"a corpus has {LEAST} sentences or more")
    examples, tokens = training.labelled_corpus(spark, total, seed)
    rows = corpus.sentences(examples, tokens).join(examples.select("sentence_id", "split"), "sentence_id")
    write_splits(rows, folder)
    return splits.group_counts(rows)


def _scores(row, *names: str) -> dict:
    return {n: row[n] for n in names}


def evaluation(reports: dict[str, DataFrame]) -> dict:
    """Reports of ``metrics.evaluate_bio`` with groups as one nested document: overall and by_group, labels in order. All of it is of the size of the label set."""
    parts: dict[str, dict] = {}
    of = lambda r: parts.setdefault(r["part"], {"token_level": {}, "per_category_f1": {}, "exact_span": {}, "confusion_matrix": {"labels": [], "matrix": []}})
    for r in metrics.in_order(reports["tokens"]).collect():
        of(r)["token_level"] = _scores(r, "precision", "recall", "macro_f1", "weighted_f1", "accuracy")
    for r in metrics.in_order(reports["categories"], "label").collect():
        of(r)["per_category_f1"][r["label"]] = r["f1"]
    for r in metrics.in_order(reports["spans"]).collect():
        of(r)["exact_span"] = _scores(r, "precision", "recall", "f1", "correct", "predicted", "gold")
    for r in metrics.in_order(reports["confusion"], "gold", "predicted", outside="first").collect():
        m = of(r)["confusion_matrix"]
        if r["gold"] not in m["labels"]:
            m["labels"].append(r["gold"])
            m["matrix"].append([])
        m["matrix"][-1].append(r["n"])
    return {"overall": parts.pop("overall"), "by_group": {k: parts[k] for k in sorted(parts)}}


def _configuration(fitted: dict, window_size: int) -> dict:
    gate, classes = fitted["gate"], [r["category"] for r in fitted["bayes"].priors.orderBy("category").collect()]
    return {
        "features": {
            "window_size": window_size, "weighting": {"logistic_regression": "tfidf", "naive_bayes": "count"},
            "character_ngrams": list(fitted["builder"].char_ngram_range) if fitted["builder"].use_char_ngrams else None, "feature_count": fitted["n_columns"],
        },
        "models": {
            "logistic_regression": {"implementation": "full_batch_gradient_descent", "iterations": len(gate.history), "final_log_loss": gate.history[-1], "parameters": fitted["n_columns"] + 1},
            "naive_bayes": {"implementation": "multinomial", "alpha": fitted["bayes"].alpha, "classes": classes, "parameters": len(classes) * fitted["n_columns"]},
        },
        "training_seconds": fitted["training_seconds"],
        "validation": evaluation(training.breakdown(fitted["predicted"], "val")),
        "test": evaluation(training.breakdown(fitted["predicted"], "test")),
    }


def _ablation(spark: SparkSession, configurations: dict[str, dict]) -> dict:
    side = lambda name: spark.createDataFrame([("overall", k, v) for k, v in configurations[name]["test"]["overall"]["per_category_f1"].items()], "part string, label string, f1 double")
    rows = metrics.ablation(*(side(name) for name, _ in CONFIGURATIONS)).collect()
    scores = {r["label"]: {"word_only_f1": r["f1_first"], "word_plus_char_f1": r["f1_second"], "delta": r["delta"]} for r in rows}
    macro = scores.pop("macro mean")
    names = ("word_only", "word_plus_char_ngrams", "delta")
    return {"categories": list(metrics.STRUCTURED), "per_category": {k: scores[k] for k in metrics.STRUCTURED}, "macro_f1": dict(zip(names, macro.values(), strict=True))}


def _comparison(rows: DataFrame) -> dict:
    out = {"matrix_config": CONFIGURATIONS[1][0]}
    average = {"logistic_regression_binary": "positive_class_PII", "naive_bayes_category": "macro_over_PII_categories"}
    for r in rows.collect():
        side = lambda end: {m: r[f"{m}_{end}"] for m in ("accuracy", "f1")}  # noqa: B023, E731
        out[r["model"]] = {"f1_average": average[r["model"]], "own": side("own"), "library": side("library"), "absolute_difference": side("difference")}
    return out


def train(spark: SparkSession, folder: str, output: str | None = None, window_size: int = 2, max_iter: int = 600, learning_rate: float = 0.15) -> dict:
    """Trains both configurations on the corpus in ``folder``, compares them with each other and with the library's models, and returns the report; with ``output``, writes it there."""
    sentences = read_splits(spark, folder)
    tokens = training.tokens_of(sentences)
    counts = {r["split"]: r for r in splits.sizes(sentences).collect()}
    fitted, found = None, {}
    for name, chars in CONFIGURATIONS:
        fitted = training.train_configuration(tokens, chars, window_size, max_iter, learning_rate)
        found[name] = _configuration(fitted, window_size)
    size = lambda what: {f"{long}_{what}": counts[s][what] for s, long in zip(SPLITS, ("train", "validation", "test"), strict=True)}
    report = {
        "stage": 2, "evaluation_backend": "exact_BIO_metrics_from_confusion_counts", "dataset": size("sentences") | size("tokens"), "configurations": found,
        "library_validation": _comparison(training.library_comparison(spark, fitted, tokens)), "structured_category_ablation": _ablation(spark, found),
    }
    if output:
        write_document(spark, report, output)
    return report


def report_tables(report: dict) -> str:
    """The report's tables as text, four decimals: test scores by group, comparison with the library, ablation."""
    test = report["configurations"][CONFIGURATIONS[1][0]]["test"]
    parts = {"overall": test["overall"], **test["by_group"]}
    lines = ["Test scores by group (words and character n-grams)", f"{'subset':<12} {'macro_f1':>10} {'weighted_f1':>12} {'span_f1':>10}"]
    lines += [f"{k:<12} {p['token_level']['macro_f1']:>10.4f} {p['token_level']['weighted_f1']:>12.4f} {p['exact_span']['f1']:>10.4f}" for k, p in parts.items()]
    lines += [f"  {k}: " + ", ".join(f"{label}={f1:.4f}" for label, f1 in p["per_category_f1"].items()) for k, p in parts.items()]
    lines += ["", "Own models and the library's, on the same matrices", f"{'model':<30} {'implementation':<14} {'accuracy':>10} {'f1':>10}"]
    for model, sides in report["library_validation"].items():
        if isinstance(sides, dict):
            lines += [f"{model:<30} {side:<14} {sides[side]['accuracy']:>10.4f} {sides[side]['f1']:>10.4f}" for side in ("own", "library")]
    lines += ["", "Structured categories: f1 without and with character n-grams", f"{'category':<28} {'word':>10} {'word+char':>12} {'delta':>10}"]
    ablation = report["structured_category_ablation"]
    for name, s in [*ablation["per_category"].items(), ("macro mean", ablation["macro_f1"])]:
        word, char, delta = s.values()
        lines.append(f"{name:<28} {word:>10.4f} {char:>12.4f} {delta:>+10.4f}")
    return "\n".join(lines)


def check(spark: SparkSession, folder: str) -> list[str]:
    """Acceptance checks of a corpus and of the text functions; returns what passed, raises AssertionError on the first that doesn't."""
    rows = read_splits(spark, folder, check_lengths=False)
    total = rows.count()
    if total < LEAST:
        raise AssertionError(f"{total} sentences, {LEAST} are needed")
    if splits.leakage(rows).limit(1).count():
        raise AssertionError("a text is in two splits, or twice in one")
    if rows.where("size(tokens) <> size(tags)").limit(1).count():
        raise AssertionError("tokens and tags differ in number")
    if bad := tagging.bio_violations(tagging.flatten_targets(rows)).limit(1).collect():
        raise AssertionError(f"a tag breaks the grammar: {bad[0]['error']}")
    said = [f"{total} different sentences: {dict(sorted((r['group'], r['count']) for r in rows.groupBy('group').count().collect()))}", "no text in two splits", "all tags valid"]
    dirty, keep = "<p>Call me \U0001f60a at +880-1712-345678 or Test.User@example.com</p>", ("+880-1712-345678", "Test.User@example.com")
    one = spark.range(1).select(T.clean(F.lit(dirty), exact=True).alias("c"), T.correct_spelling(F.array(*map(F.lit, ("nmbr", "01712345678", "fone")))).alias("s")).first()
    if "<p>" in one["c"] or "\U0001f60a" in one["c"] or not all(k in one["c"] for k in keep):
        raise AssertionError(f"cleaning gave {one['c']}")
    if one["s"] != ["number", "01712345678", "phone"]:
        raise AssertionError(f"spelling gave {one['s']}")
    said += [f"cleaning: {one['c']}", f"spelling: {' '.join(one['s'])}"]
    for group, tag in COVERED:
        got = tagging.sample(rows, group, tag).collect()
        if not got:
            raise AssertionError(f"no sentence of {group} has {tag}")
        said.append(f"[{group}] {got[0]['text']} {list(zip(got[0]['tokens'], got[0]['tags'], strict=True))}")
    return said


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    job = p.add_subparsers(dest="job", required=True)
    made, trained, checked = (job.add_parser(name) for name in ("corpus", "train", "check"))
    made.add_argument("--num-examples", type=int, default=1200)
    made.add_argument("--seed", type=int, default=42)
    made.add_argument("--output-dir", default="data")
    trained.add_argument("--data-dir", default="data")
    trained.add_argument("--output", default="results/report.json")
    trained.add_argument("--window-size", type=int, default=2)
    trained.add_argument("--max-iter", type=int, default=600)
    trained.add_argument("--learning-rate", type=float, default=0.15)
    checked.add_argument("--data-dir", default="data")
    a = p.parse_args(argv)
    if a.job == "corpus" and a.num_examples < LEAST:
        p.error(f"--num-examples must be {LEAST} or more")
    spark = SparkSession.builder.appName("loomtext").getOrCreate()
    if a.job == "corpus":
        metrics.in_order(build_corpus(spark, a.output_dir, a.num_examples, a.seed), "split", "group").show()
    elif a.job == "train":
        print(report_tables(train(spark, a.data_dir, a.output, a.window_size, a.max_iter, a.learning_rate)))
    else:
        print("\n".join(check(spark, a.data_dir)))


if __name__ == "__main__":
    main()
