"""Written text to phonemes: normalisation, then pronunciation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .g2p import phonemize
from .normalize import normalize


def text_to_phonemes(df: DataFrame, lexicon: DataFrame, text_col: str = "text", id_col: str = "id", out_col: str = "phonemes") -> DataFrame:
    """(id, phonemes) of each row, in one pass over the texts."""
    spoken = normalize(df.select(id_col, text_col), text_col, "_normalized").select(id_col, "_normalized")
    return phonemize(spoken, lexicon, "_normalized", id_col, out_col)
