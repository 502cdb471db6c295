"""Text functions over columns."""

from .text import clean, correct_spelling, correct_token, levenshtein_distance, preprocess, tokenize, transform_tokens, treebank

__all__ = ["clean", "correct_spelling", "correct_token", "levenshtein_distance", "preprocess", "tokenize", "transform_tokens", "treebank"]
