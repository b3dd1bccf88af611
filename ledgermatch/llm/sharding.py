"""Sharding by proportional stratified interleaving.

Within each source rows are put into a seeded shuffle and numbered; row r of n gets the
fraction (r + 0.5) / n. Sorted by fraction, every stretch of the whole order holds the
sources in proportion, so equal cuts of that order give shards of equal row counts whose
mixture matches the corpus (each source is within one row of its share, up to rounding at
the cuts). The law is ``rows``: counts differ by one at most.

Both numberings are two-level prefix counts over buckets (hash buckets in proportion to a
source's rows, then stretches of the fraction), never one window over a source or the table.

Defined cases: a NULL source is a source of its own, last; NULL and empty texts have size 1;
repeated rows and ids are rows of their own; equal shuffle keys fall back on the text's CRC,
then the row read first; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import BUCKET_ROWS, carry, cut, pick, running_before, shuffle_key, text_or_empty, unit_interval

SEED = "shard"


def _numbered(rows: DataFrame, seed: str) -> tuple[DataFrame, int]:
    """Rows (row_id, doc_id, source, size, text_crc32) with their place in the interleaved order."""
    docs = cut(rows.withColumn("key", shuffle_key(seed, "doc_id", "text_crc32")), "shard-rows")
    sources = docs.groupBy("source").agg(F.count("*").alias("source_rows")).withColumn(
        "sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    total = docs.count()
    known = sources.withColumnRenamed("source", "__source")
    docs = docs.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    docs = docs.withColumn("bucket", F.floor(unit_interval(F.col("key")) * F.ceil(F.col("source_rows") / BUCKET_ROWS)))
    docs = running_before(docs, ["sid"], "bucket", [F.col("key"), F.col("row_id")], F.lit(1), "rank")
    docs = docs.withColumn("fraction", (F.col("rank") + 0.5) / F.col("source_rows"))
    stretches = max(1, -(-total // (16 * BUCKET_ROWS)), min(4096, total // 1024))
    docs = docs.withColumn("stretch", F.floor(F.col("fraction") * stretches))
    order = [F.col("fraction"), F.col("sid"), F.col("rank")]
    return running_before(docs, [], "stretch", order, F.lit(1), "place"), total


def place_rows(rows: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """Rows (row_id, doc_id, source, size, text_crc32) with shard and slot (gapless from 0)."""
    docs, total = _numbered(rows, seed)
    if not total:
        return docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    docs = docs.withColumn("shard", F.expr(f"place * {shards} div {total}").cast("int"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return docs.withColumn("slot", F.col("place") - first)


def measured(frame: DataFrame) -> DataFrame:
    """Adds row_id, size (UTF-8 bytes and one for the separator) and text_crc32."""
    text = text_or_empty("text")
    return frame.withColumns({"row_id": F.monotonically_increasing_id(),
                              "size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)})


def assign(df: DataFrame, *, shards: int = 8, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           seed: str = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, text_crc32, law, shard, slot, grown_shard."""
    rows = measured(pick(df, doc_id=doc_id, text=text, source=source)).drop("text")
    return place_rows(rows, shards, seed).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, *, shards: int = 8, doc_id: str = "doc_id", text: str = "text",
                 source: str = "source", seed: str = SEED, files_per_shard: int = 1) -> None:
    """Write the input's columns below ``path/shard=N/part=M``, each file in slot order."""
    frame, restore = carry(df, doc_id=doc_id, text=text, source=source)
    rows = cut(measured(frame), "shard-input")
    placed, total = place_rows(rows.select("row_id", "doc_id", "source", "size", "text_crc32"), shards, seed), rows.count()
    full = rows.join(placed.select("row_id", "shard", "slot"), "row_id")
    per_file = max(1, -(-total // (shards * files_per_shard)))
    full = full.withColumn("part", F.expr(f"cast(slot div {per_file} as int)"))
    out = restore(full, ["shard", "part", "slot"])
    out.repartition(shards * files_per_shard, "shard", "part").sortWithinPartitions("shard", "part", "slot").drop(
        "slot").write.partitionBy("shard", "part").parquet(path)
