"""Exact dedup by content-defined chunk recipes (native).

Texts are equal when they agree after deleting white space. A text's recipe is the ordered
list of its chunks' identifiers. Chunk borders depend on content only (a sentence end after
at least ``MIN_CHUNK`` code points, else ``MAX_CHUNK``), so equal texts have equal recipes
and edited copies share most chunks.

Identifiers are 64-bit hashes, verified: distinct chunks are gathered once (map-side
combined, so a chunk that a third of the texts share moves as one row per task), and where
one hash has several chunks, each gets an ordinal that completes its identifier. Texts are
then compared by recipe, a list of about two bytes per hundred of text; long texts do not
move again.

Of equal texts the row with the most code points in the original text stays, then the
smallest doc_id (NULL last), then the first row read. Defined cases: NULL counts as empty;
all empty texts are equal; repeated rows and repeated ids are rows of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import SPACES, carry, cut, pick, split_join, text_or_empty

MIN_CHUNK, MAX_CHUNK = 256, 4096
_ENDS = r"[.!?。！？]"
CHUNK = rf"(?s).{{{MIN_CHUNK - 1},{MAX_CHUNK - 1}}}?{_ENDS}|.{{1,{MAX_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def chunks(norm: Column) -> Column:
    """The normalised text in pieces; joined, they are the text again."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def recipes(rows: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Rows (row_id, doc_id, text, ...) written with n_chars, text_sha256, ids and fixes.

    ``ids`` are the chunks' hashes in order; ``fixes`` is NULL, or lists (position, ordinal)
    of chunks whose hash another chunk has too. (ids, fixes) is equal for equal texts only.
    """
    text = text_or_empty("text")
    base = rows.withColumns({"n_chars": F.length(text).cast("long"), "__n": normalised(text)})
    base = base.withColumn("text_sha256", F.sha2("__n", 256))
    base = base.withColumn("ids", F.transform(chunks(F.col("__n")), lambda c: chunk_hash(c)))
    base = cut(base.drop("__n"), "recipes")

    def pieces() -> DataFrame:
        return base.select("row_id", F.posexplode(chunks(normalised(text_or_empty("text")))).alias("at", "chunk")).withColumn(
            "id", chunk_hash(F.col("chunk")))

    store = pieces().groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    clashing = cut(store.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), "clashes")
    if clashing.isEmpty():
        return base.withColumn("fixes", F.lit(None).cast("array<struct<at:int,ordinal:int>>"))
    spoiled = pieces().join(clashing, "id", "left_semi")
    ordinals = spoiled.select("id", "chunk").distinct().withColumn(
        "ordinal", F.row_number().over(Window.partitionBy("id").orderBy("chunk")))
    fixes = split_join(spoiled, ordinals, ["id", "chunk"]).groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "ordinal"))).alias("fixes"))
    return base.join(fixes, "row_id", "left")


def decide(base: DataFrame) -> DataFrame:
    """Every row with keep_row, keep_id and group_size of its group of equal recipes."""
    order = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    base = base.withColumn("fixes", F.coalesce("fixes", F.array()))
    groups = base.groupBy("ids", "fixes").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    return split_join(base, groups, ["ids", "fixes"]).withColumns(
        {"keep_id": F.col("first.doc_id"), "kept": F.col("first.row_id") == F.col("row_id")}).drop("first")


def dedup(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars, n_chunks."""
    rows = pick(df, doc_id=doc_id, text=text).withColumn("row_id", F.monotonically_increasing_id())
    base = recipes(rows).drop("text")
    return decide(base).select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chars",
                               F.size("ids").alias("n_chunks"))


def drop_copies(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The input's columns and the rows that stay."""
    frame, restore = carry(df, doc_id=doc_id, text=text)
    base = recipes(frame.withColumn("row_id", F.monotonically_increasing_id()))
    kept = decide(base.select("row_id", "doc_id", "n_chars", "ids", "fixes")).where("kept").select("row_id")
    return restore(base.join(kept, "row_id", "left_semi"), [])
