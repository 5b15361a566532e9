"""Streams of written text: normalised, or turned into phonemes, as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loquat.operators.g2p import held
from loquat.operators.normalize import normalize
from loquat.operators.pipeline import text_to_phonemes
from loquat.sources.lexicon import overlay


def normalize_stream(stream: DataFrame, text_col: str = "text", out_col: str = "normalized") -> DataFrame:
    """The rules have no state, so a stream needs no watermark and any output mode that appends."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return normalize(stream, text_col, out_col)


def phoneme_stream(stream: DataFrame, lexicon: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, text_col: str = "text", id_col: str = "id", **trigger) -> StreamingQuery:
    """Starts a query that gives each batch's (id, phonemes) to ``sink(batch, batch_id)``; a batch that is run again gets the same number.

    With a lexicon that workers hold, the rules are part of the stream's own plan, which is analysed once. A larger one
    is joined, which needs the whole batch, so each batch has a plan of its own.
    """
    speak = sink
    if held(overlay(lexicon)):
        stream = text_to_phonemes(stream, lexicon, text_col, id_col)
    else:

        def speak(batch: DataFrame, batch_id: int) -> None:
            sink(text_to_phonemes(batch, lexicon, text_col, id_col), batch_id)

    return stream.writeStream.foreachBatch(speak).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
