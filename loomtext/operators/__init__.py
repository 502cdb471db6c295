"""Operators over DataFrames: corpus, features, models, tags, evaluation, splits."""

from .corpus import generate_examples, generate_group_example
from .features import WindowFeatureBuilder
from .logistic import BinaryLogisticRegression
from .metrics import evaluate_bio, evaluate_sequences
from .naive_bayes import MulticlassNaiveBayes
from .splits import split as split_examples
from .tagging import categories_to_bio

__all__ = [
    "BinaryLogisticRegression", "MulticlassNaiveBayes", "WindowFeatureBuilder", "categories_to_bio", "evaluate_bio", "evaluate_sequences", "generate_examples",
    "generate_group_example", "split_examples",
]
