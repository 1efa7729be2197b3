"""Column functions and the fixed word lists behind them."""

from .text import hits, matches, occurrences, population_deviation, sentences, stripped, words

__all__ = ["hits", "matches", "occurrences", "population_deviation", "sentences", "stripped", "words"]
