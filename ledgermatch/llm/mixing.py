"""Mixing sources to target weights by a low-discrepancy schedule (native).

Each source's documents, in a seeded shuffle, form a stream of words that is cut into blocks
of equal size. A target is the source's share of the mix, at most ``cap`` times its size; what a
capped source leaves is shared again by weight. Targets become slots (one block each).
Slots are dealt by the van der Corput sequence: point i of a power-of-two grid, its bits reversed, falls
into the sources' cumulative slot counts, so each source gets exactly its slots and any
stretch of the schedule has nearly the mix's proportions. The k-th slot of a source takes
block k, starting over after the last one; a source's last slot ends at its target.

Prefix sums and ranks use seeded hash buckets in proportion to a source's rows (or to the
schedule's length), so a source with a third of all rows is spread like the others.

Defined cases: a NULL source is one source, last in order; NULL and empty texts have size 0
and are never taken; repeated rows and ids are rows of their own; equal order keys fall back
on doc_id, then on the row read first; an empty table (or one without words) has an empty
mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import (BUCKET_ROWS, carry, cut, pick, running_before, shuffle_key, split_join, text_or_empty,
                                    unit_interval, with_row_id, word_count)

SEED = "mix"
#: The schedule's grid is split into at most so many cells to look up a point's source.
CELLS = 4096
#: Slots that one window sorts to rank them within a source.
SLOT_BUCKET = 16384


def sized(rows: DataFrame, seed: str = SEED) -> DataFrame:
    """(row_id, doc_id, source, size, key): what the schedule needs of a row."""
    return cut(rows.select("row_id", "doc_id", "source", word_count(text_or_empty("text")).alias("size"),
                           shuffle_key(seed, "doc_id").alias("key")), "sizes")


def targets(docs: DataFrame, weights: Sequence[float], share: float, cap: float, block: int) -> DataFrame:
    """One row per source: sid, source, source_size, target, quota (words), blocks, slots, first_slot.

    A source is capped when raising all targets in proportion to weight reaches its cap
    before the whole mix is dealt; the others share the rest by weight.
    """
    by = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    everything = Window.partitionBy()
    ranked = by.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "most": F.col("source_size") * F.lit(float(cap))})
    ranked = ranked.withColumns({"level": F.col("most") / F.col("weight"),
                                 "mix": F.sum("source_size").over(everything) * F.lit(float(share))})
    upto = Window.orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum("most").over(upto) + F.col("level") * (F.sum("weight").over(everything) - F.sum("weight").over(upto))
    ranked = ranked.withColumn("capped", used <= F.col("mix"))
    free = F.col("mix") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.try_divide(free * F.col("weight"), open_weight))
    out = ranked.withColumn("target", target.cast("double"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    out = out.withColumn("quota", F.least(F.round("target"), F.floor(F.col("most"))).cast("long"))
    out = out.withColumns({"blocks": F.ceil(F.col("source_size") / block).cast("long"),
                           "epochs": F.expr("quota div greatest(source_size, 1)"), "rest": F.col("quota") % size})
    out = out.withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    before = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("first_slot", F.coalesce(F.sum("slots").over(before), F.lit(0))).select(
        "sid", "source", "source_size", "source_rows", "target", "quota", "blocks", "epochs", "rest", "slots", "first_slot")


def block_pieces(docs: DataFrame, plan: DataFrame, block: int) -> DataFrame:
    """Documents cut at the borders of their source's blocks: sid, number, row_id, doc_id, begin, end, at."""
    known = plan.select(F.col("source").alias("__source"), "sid", "source_rows")
    docs = docs.where("size > 0").join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    many = F.ceil(F.col("source_rows") / BUCKET_ROWS)
    docs = docs.withColumn("bucket", F.floor(unit_interval(F.col("key")) * many))
    order = [F.col("key"), F.col("doc_id"), F.col("row_id")]
    docs = running_before(docs, ["sid"], "bucket", order, F.col("size"), "begin")
    docs = docs.withColumn("end", F.col("begin") + F.col("size"))
    numbers = F.sequence(F.expr(f"begin div {block}"), F.expr(f"(end - 1) div {block}"))
    cuts = docs.select("sid", "row_id", "doc_id", F.col("begin").alias("doc_begin"), "end", F.explode(numbers).alias("number"))
    return cuts.select(
        "sid", "number", "row_id", "doc_id", F.greatest("doc_begin", F.col("number") * block).alias("begin"),
        F.least("end", (F.col("number") + 1) * block).alias("end"), "doc_begin")


def schedule(plan: DataFrame, total: int, block: int) -> DataFrame:
    """Slots in dealt order: slot, sid, epoch, number (of the block), rest (0: the whole block)."""
    spark = plan.sparkSession
    bits = max(1, (max(total, 1) - 1).bit_length())
    cell_bits = max(0, bits - (CELLS.bit_length() - 1))
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), bits, "0")), 2, 10).cast("long")
    dealt = spark.range(2**bits).select(F.col("id").alias("slot"))
    dealt = dealt.withColumn("point", point).where(F.col("point") < total)
    dealt = dealt.withColumn("cell", F.shiftright("point", cell_bits))
    owners = plan.where("slots > 0").withColumn("last_slot", F.col("first_slot") + F.col("slots") - 1)
    cells = owners.withColumn("cell", F.explode(F.sequence(F.shiftright("first_slot", cell_bits),
                                                           F.shiftright("last_slot", cell_bits))))
    owned = dealt.join(cells, "cell").where(F.col("point").between(F.col("first_slot"), F.col("last_slot")))
    owned = owned.select("slot", "sid", "blocks", "epochs", "rest")
    owned = owned.withColumn("bucket", F.expr(f"slot div {SLOT_BUCKET}"))
    ranked = running_before(owned, ["sid"], "bucket", [F.col("slot")], F.lit(1), "k")
    ranked = ranked.withColumns({"epoch": F.expr("k div blocks"), "number": F.col("k") % F.col("blocks")})
    return ranked.select("slot", "sid", "epoch", "number", F.when(F.col("epoch") < F.col("epochs"), F.lit(None)).otherwise(
        F.col("rest")).alias("until"))


def mix(docs: DataFrame, *, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
        block: int = 256) -> tuple[DataFrame, DataFrame]:
    """(plan by source, the mix) of ``sized`` rows.

    The mix has a row per piece: slot, sid, epoch, row_id, doc_id, start and length in words
    of the document. Ordered by (slot, start of the block) it is the training order.
    """
    plan = cut(targets(docs, weights, share, cap, block), "mix-plan")
    total = plan.agg(F.sum("slots")).first()[0] or 0
    slots = schedule(plan, total, block)
    pieces = block_pieces(docs, plan, block)
    met = split_join(slots, pieces, ["sid", "number"])
    end = F.least("end", F.coalesce("until", "end"))
    met = met.withColumn("length", end - F.col("begin")).where("length > 0")
    return plan, met.select("slot", "sid", "epoch", "row_id", "doc_id",
                            (F.col("begin") - F.col("doc_begin")).alias("start"), "length")


def taken(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **params) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken."""
    rows = pick(df, doc_id=doc_id, text=text, source=source).withColumn("row_id", F.monotonically_increasing_id())
    docs = sized(rows)
    plan, pieces = mix(docs, **params)
    sums = pieces.groupBy("row_id").agg(F.sum("length").alias("taken"))
    known = plan.select(F.col("source").alias("__source"), "source_size", "target")
    out = docs.join(known, F.col("source").eqNullSafe(F.col("__source"))).join(sums, "row_id", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **params) -> DataFrame:
    """The input's columns in training order; one row per document and pass through its source that takes it.

    Documents stay whole: the one in which a source's target ends is taken if at least half of it
    lies before the target, else left. Rows are range-partitioned and sorted by the slot that a
    document's first word has in the schedule, so any stretch of them has nearly the mix's shares.
    """
    frame, restore = carry(df, doc_id=doc_id, text=text, source=source)
    rows = with_row_id(frame, "mix-rows")
    docs = sized(rows)
    _, pieces = mix(docs, **params)
    takes = pieces.groupBy("row_id", "epoch").agg(F.sum("length").alias("words"), F.min("slot").alias("__slot"))
    takes = takes.join(docs.select("row_id", "size"), "row_id").where("2 * words >= size")
    # the first word's slot; documents that begin in one slot keep the order of their source's stream
    first = takes.select("row_id", "__slot", "epoch")
    order = [F.col("__slot"), F.col("epoch"), F.col("row_id")]
    out = rows.join(cut(first, "mix-takes"), "row_id").repartitionByRange(*order).sortWithinPartitions(*order)
    return restore(out, [])
