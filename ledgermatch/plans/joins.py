"""Join helpers with explicit size checks.

``join_small`` broadcasts a side only after counting it (the side is written to
the shared work folder, so the count and the join share one computation and
nothing stays cached); above ``max_rows`` it falls back to a shuffle join, where
AQE still may pick a broadcast from exact sizes and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# Rows of a per-country (or per-domain) side that are always safe to ship to
# every executor; bounds and rollups keyed by country stay far below this.
SMALL_SIDE_MAX_ROWS = 200_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once: written to the shared work folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",
               max_rows: int = SMALL_SIDE_MAX_ROWS) -> DataFrame:
    """Join with a side that is broadcast when counted small. ``on`` names columns
    (a Column built with ``F.col``, or names), as the side is read back."""
    small = written(small, "side")
    if small.count() <= max_rows:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def split_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join on ``left.a = right.b`` (names of the two sides differ) whose hot keys can be split.

    A side that comes straight from an aggregate on the join keys keeps its
    partitioning, and AQE cannot split a partition without an exchange of its
    own. A derived key more makes both sides exchange."""
    left = left.withColumn("_lk", F.xxhash64(*[F.col(a) for a, _ in pairs]))
    right = right.withColumn("_rk", F.xxhash64(*[F.col(b) for _, b in pairs]))
    on = left["_lk"] == right["_rk"]
    for a, b in pairs:
        on = on & (left[a] == right[b])
    return left.join(right, on, how).drop("_lk", "_rk")
