"""Column-level functions (text, scores, paths)."""

from prodlens.functions.paths import (first_image_url, first_image_url_by_size,
                                      image_path, normalize_path)
from prodlens.functions.scores import (argmax, entropy, least_confidence, margin,
                                       softmax, uncertainty)
from prodlens.functions.text import (clean_pair, clean_text, combined_text,
                                     join_description, min_length, ngrams,
                                     review_text, strip, tokens)

__all__ = [
    "argmax", "clean_pair", "clean_text", "combined_text", "entropy",
    "first_image_url", "first_image_url_by_size", "image_path",
    "join_description", "least_confidence", "margin", "min_length", "ngrams",
    "normalize_path", "review_text", "softmax", "strip", "tokens", "uncertainty",
]
