"""Overlapping chunks of long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podspark import schemas


def chunks(rows: DataFrame, text: str, keep: list[str], size: int = schemas.CHUNK_SIZE, overlap: int = schemas.CHUNK_OVERLAP) -> DataFrame:
    """``keep``, ``chunk_no`` and ``chunk``: pieces of ``size`` code points that share ``overlap``; none of an empty text.

    Raises ValueError unless 0 <= overlap < size.  The parent text is dropped before anything is shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    stride = size - overlap
    n = F.length(text)
    last = F.ceil(F.greatest(n - size, F.lit(0)) / stride).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col(text), i * stride + 1, F.lit(size)))
    return rows.filter(n > 0).select(*keep, F.posexplode(pieces).alias("chunk_no", "chunk"))
