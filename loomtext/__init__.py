"""PII text analytics and corpus processing on Spark DataFrames."""

from .functions import clean, correct_spelling, correct_token, levenshtein_distance, preprocess, tokenize
from .operators import BinaryLogisticRegression, MulticlassNaiveBayes, WindowFeatureBuilder, categories_to_bio, evaluate_bio, evaluate_sequences, generate_examples, generate_group_example, split_examples

__all__ = [
    "BinaryLogisticRegression", "MulticlassNaiveBayes", "WindowFeatureBuilder", "categories_to_bio", "clean", "correct_spelling", "correct_token", "evaluate_bio",
    "evaluate_sequences", "generate_examples", "generate_group_example", "levenshtein_distance", "preprocess", "split_examples", "tokenize",
]
