"""What the llm operators share: input columns, written cuts, joins that can be split, running sums.

Conventions of every operator:

* Input columns are found by exact name, else by the only name that matches without case.
  All other columns ride along by position, so clashing or repeated names never meet.
* Where an operator returns the input's columns, an input column named like one of its
  outputs gives way to the output.
* Texts: NULL counts as empty. White space is ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermatch.session import scratch_path, ship  # noqa: F401 (the operators take it from here)

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"

#: Rows of a hash bucket in which a window sorts; a source's buckets follow its row count.
BUCKET_ROWS = 4096

_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def find(df: DataFrame, name: str) -> int:
    """Position of the column called ``name`` (exactly, else the only one without case)."""
    exact = [i for i, c in enumerate(df.columns) if c == name]
    loose = exact or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not exact and len(loose) > 1:
        raise ValueError(f"column {name!r} is ambiguous among {df.columns}")
    if not loose:
        raise ValueError(f"column {name!r} is missing; there are {df.columns}")
    return loose[0]


def _by_position(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named input columns, under the keywords' names."""
    spots = {new: find(df, old) for new, old in cols.items()}
    return _by_position(df).select(*[F.col(f"__c{i}").alias(new) for new, i in spots.items()])


def carry(df: DataFrame, **cols: str) -> tuple[DataFrame, Callable[[DataFrame, list[str]], DataFrame]]:
    """The named columns under the keywords' names, plus all input columns by position.

    The second result puts a later frame's carried columns back under their old names,
    followed by the given output columns (which replace input columns of that name).
    """
    spots = {new: find(df, old) for new, old in cols.items()}
    names = df.columns
    frame = _by_position(df).select("*", *[F.col(f"__c{i}").alias(new) for new, i in spots.items()])

    def restore(later: DataFrame, outputs: list[str]) -> DataFrame:
        taken = {o.lower() for o in outputs}
        kept = [F.col(f"__c{i}").alias(n) for i, n in enumerate(names) if n.lower() not in taken]
        return later.select(*kept, *[F.col(o) for o in outputs])

    return frame, restore


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, rows are fixed."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    made = _MADE.get()
    if made is not None:
        made.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def cuts_made() -> Iterator[list[str]]:
    """The list fills with the folders that ``cut`` writes inside the block (in this thread)."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete folders that ``cut`` wrote, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once with a ``row_id`` (unique; it stays as the rows are fixed)."""
    return cut(df.withColumn("row_id", F.monotonically_increasing_id()), name)


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a hot key can be split.

    A side that comes straight from an aggregate on the same keys would keep its
    partitioning, and AQE cannot split a partition without an exchange of its own. One more
    derived key makes both sides exchange, so AQE splits the hot side (or broadcasts a side
    that it has measured as small).
    """
    key = F.xxhash64(*[F.col(c) for c in on]).alias("__k")
    return left.select("*", key).join(right.select("*", key), ["__k", *on], how).drop("__k")


def text_or_empty(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffle_key(seed: str, *cols: str) -> Column:
    """Seeded pseudo-random order of rows, the same in every run: an md5 in hex."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))


def unit_interval(md5_hex: Column) -> Column:
    """The md5's first 52 bits as a double in [0, 1); it grows with the text order."""
    return F.conv(F.substring(md5_hex, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def running_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one, in its group.

    Two levels instead of one window over a group: sums of buckets (map-side combined, one
    row each) give every bucket's start; a window then sorts within a bucket only. Buckets
    must follow ``order``.
    """
    keys = [*group, bucket]
    df = df.withColumn("__v", value)
    starts = df.groupBy(*keys).agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*keys, F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__s"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("__v").over(inner), F.lit(0))
    return df.join(starts, keys).withColumn(out, (F.col("__s") + local).cast("long")).drop("__s", "__v")
