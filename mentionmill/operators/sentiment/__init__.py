"""Rule-based lexicon sentiment for German text, as DataFrame operations."""

from .score import score_columns, score_sentiment

__all__ = ["score_columns", "score_sentiment"]
