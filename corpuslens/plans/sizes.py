"""Joins that broadcast one side only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow side (a few short columns) is broadcast: at most about 32 MB.
BROADCAST_ROWS = 250_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows, else as it is, for a shuffled join.

    `df` should be cheap to count (a written table, of which only the files' footers are read).
    """
    return F.broadcast(df) if df.count() <= rows else df
