"""Document fingerprints: a Merkle tree over blocks, paragraphs and sections (native).

A text is cut, without loss, into paragraphs (a line with the line breaks after it) and these into
blocks of words. A block's digest is the SHA-256 of its text, a paragraph's that of its blocks'
digests, a section's that of its paragraphs', the root that of the sections'. All borders but
those of lines are content-defined: a block ends after a word whose last character is an ASCII sign
with a code divisible by four (after ``BLOCK_WORDS`` words at the latest), a section after a paragraph
whose digest ends in 0 to 3 (after ``SECTION_PARAGRAPHS`` at the latest). So an inserted word or
line changes the block, paragraph and section around it, and the next ones begin as before.

Equal roots mean equal texts. Where roots differ, two trees are walked from the sections down:
sections that both have are closed, with all their blocks in common; the others are opened, and
their blocks (64-bit hashes) are compared. ``likeness`` is the share of blocks in common that the
walk finds (Dice), ``changed`` locates the paragraphs that differ.

A walk compares every paragraph's section with the common ones, so its time grows with paragraphs
times common sections of one pair of texts; blocks are compared by hashing.

Defined cases: NULL counts as empty; an empty text has no sections and its own root; two
texts without blocks have likeness 1, one with and one without 0; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermatch.llm.common import carry, cut, pick, text_or_empty

BLOCK_WORDS = 12
SECTION_PARAGRAPHS = 16
#: A word that ends in one of these ends a block.
BORDERS = "".join(chr(c) for c in range(33, 127) if c % 4 == 0)
PARAGRAPH = r"\n+|[^\n]+\n*"
BLOCK = (rf"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D{BORDERS}][\x20\x09-\x0D]+){{0,{BLOCK_WORDS - 1}}}"
         r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+")
#: Over the paragraphs' digests in hex, one after the other.
SECTION = rf"(?:[0-9a-f]{{63}}[^0-3]){{0,{SECTION_PARAGRAPHS - 1}}}[0-9a-f]{{64}}"
LEAVES = "array<struct<s:bigint,b:array<bigint>>>"


def _pieces(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _joined(tag: str, digests: Column) -> Column:
    return F.sha2(F.concat(F.lit(tag), F.array_join(digests, "")), 256)


def paragraphs(text: Column) -> Column:
    """Array of (digest, blocks: array of 64-bit hashes)."""
    blocks = F.transform(_pieces(text, PARAGRAPH), lambda p: _pieces(p, BLOCK))
    return F.transform(blocks, lambda bs: F.struct(
        _joined("p", F.transform(bs, lambda b: F.sha2(b, 256))).alias("digest"),
        F.transform(bs, lambda b: F.xxhash64(b)).alias("blocks")))


def sections(cut_paragraphs: Column) -> Column:
    """The sections, each as its paragraphs' digests in one string."""
    return _pieces(F.array_join(F.transform(cut_paragraphs, lambda p: p["digest"]), ""), SECTION)


def root(cut_sections: Column) -> Column:
    return _joined("r", F.transform(cut_sections, lambda s: F.sha2(F.concat(F.lit("s"), s), 256)))


def leaves(cut_paragraphs: Column, cut_sections: Column) -> Column:
    """Of every paragraph: the hash of its section, and its blocks."""
    whose = F.flatten(F.transform(cut_sections, lambda s: F.array_repeat(F.xxhash64(s), (F.length(s) / 64).cast("int"))))
    return F.arrays_zip(whose, F.transform(cut_paragraphs, lambda p: p["blocks"])).cast(LEAVES)


def tree(text: Column) -> Column:
    """Array of sections: (digest, paragraphs: array of digests)."""
    return F.transform(sections(paragraphs(text)), lambda s: F.struct(
        F.sha2(F.concat(F.lit("s"), s), 256).alias("digest"), _pieces(s, ".{64}").alias("paragraphs")))


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """Adds the columns, computed once per row: a generated row is not merged into what reads it."""
    held = F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))).alias("__once")
    return df.select("*", held).select("*", *[F.col(f"__once.{k}").alias(k) for k in values]).drop("__once")


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the root ``<name>_root`` and the leaves ``<name>_leaves`` of a text column's trees."""
    df = _once(df, __p=paragraphs(F.col(text)))
    df = _once(df, __s=sections(F.col("__p")))
    return _once(df, **{f"{name}_root": root(F.col("__s")), f"{name}_leaves": leaves(F.col("__p"), F.col("__s"))}).drop("__p", "__s")


def with_likeness(df: DataFrame, a: str, others: dict[str, str]) -> DataFrame:
    """Adds the likeness of the leaves ``a`` to each other leaves column, under its key."""
    whose = lambda c: F.transform(F.col(c), lambda x: x["s"])
    df = _once(df, **{f"__common_{k}": F.array_intersect(whose(a), whose(c)) for k, c in others.items()})

    def opened(c: str, k: str) -> Column:
        return F.flatten(F.transform(F.filter(F.col(c), lambda x: ~F.array_contains(F.col(f"__common_{k}"), x["s"])), lambda x: x["b"]))

    df = _once(df, **{f"__{side}_{k}": opened(c, k) for k, other in others.items() for side, c in (("a", a), ("b", other))})
    for k, other in others.items():
        mine, theirs = F.col(f"__a_{k}"), F.col(f"__b_{k}")
        total = lambda c: F.aggregate(F.col(c), F.lit(0), lambda n, x: n + F.size(x["b"]))
        closed = total(a) + total(other) - F.size(mine) - F.size(theirs)
        both = closed + F.size(F.array_distinct(mine)) + F.size(F.array_distinct(theirs))
        df = df.withColumn(k, F.when(both == 0, F.lit(1.0)).otherwise(
            (closed + 2.0 * F.size(F.array_intersect(mine, theirs))) / both))
    return df.drop(*[c for k in others for c in (f"__common_{k}", f"__a_{k}", f"__b_{k}")])


def changed(old: Column, new: Column) -> Column:
    """Where ``new`` (a tree) differs from ``old``: array of (section, paragraph), from 0.

    Equal sections are not opened; a paragraph counts when no differing section of ``old``
    has it.
    """
    digests = F.transform(old, lambda s: s["digest"])
    news = F.transform(new, lambda s: s["digest"])
    lost = F.flatten(F.transform(F.filter(old, lambda s: ~F.array_contains(news, s["digest"])), lambda s: s["paragraphs"]))
    found = F.transform(new, lambda s, i: F.when(
        F.array_contains(digests, s["digest"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
        F.filter(F.transform(s["paragraphs"], lambda p, j: F.when(
            ~F.array_contains(lost, p), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())))
    return F.flatten(found)


def fingerprint(df: DataFrame, *, text: str = "text") -> DataFrame:
    """The input's columns plus fingerprint (root), sections (the tree) and leaves (for likeness)."""
    frame, restore = carry(df, text=text)
    frame = with_tree(frame.withColumn("text", text_or_empty("text")), "text", "t").withColumn("sections", tree(F.col("text")))
    return restore(frame.withColumnsRenamed({"t_root": "fingerprint", "t_leaves": "leaves"}), ["fingerprint", "sections", "leaves"])


def _successors(keys: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_chars) -> doc_id, p1, p2, k, k1, k2: each document, and what its next one gives.

    Distinct keys are range-partitioned and written; a window runs within a partition, and a
    table of one row per partition joins the ends.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("k1"), F.col("k2")]
    ranged = cut(keys.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy(*order)
    here = F.struct("k1", "k2")
    ranged = ranged.withColumns({"next": F.lead(here).over(inside), "at": F.row_number().over(inside)})
    firsts = ranged.where("at = 1").select("part", here.alias("first"))
    ends = Window.orderBy("part")
    around = firsts.select("part", F.coalesce(F.lead("first").over(ends), F.first("first").over(
        ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    linked = ranged.join(around, "part").withColumn("next", F.coalesce("next", "after"))
    return linked.select("doc_id", F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.expr("n_chars div 4").alias("k"),
                         F.col("next.k1").alias("k1"), F.col("next.k2").alias("k2"))


def compare_edited(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every text, its edited text and the likeness to it and to the next text.

    The edited text's last quarter (code points, rounded down) is replaced by as many first
    code points of the next document by doc_id (NULL last; ties by content; after the last
    the first). Rows equal in doc_id and text are one document; each gets its result.
    A text moves once; only the head and the block set of the next document join it.
    """
    t = text_or_empty("text")
    rows = pick(df, doc_id=doc_id, text=text).withColumn("text", t)
    rows = rows.withColumns({"k1": F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"),
                             "k2": F.xxhash64(F.lit("second"), "text", "doc_id")})
    links = _successors(rows.select("doc_id", "k1", "k2", F.length("text").alias("n_chars")))
    texts = rows.select("k1", "k2", "text")  # the same columns in both joins, so that one exchange serves them
    heads = with_tree(texts.join(links, ["k1", "k2"]), "text", "next").select(
        "doc_id", "p1", "p2", F.left("text", F.col("k")).alias("head"), "next_leaves")
    heads = heads.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.first("doc_id").alias("doc_id"), F.first("head").alias("head"), F.first("next_leaves").alias("next_leaves"))
    pairs = texts.join(heads, ["k1", "k2"])
    n = F.length("text")
    pairs = _once(pairs, n_chars=n.cast("long"),
                  edited=F.concat(F.left("text", n - F.expr("length(text) div 4").cast("int")), "head"))
    pairs = with_tree(with_tree(pairs, "text", "own"), "edited", "edited")
    pairs = with_likeness(pairs, "own_leaves", {"near_edited": "edited_leaves", "near_next": "next_leaves"})
    return pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("own_root").alias("fingerprint"),
                        F.col("edited_root").alias("edited_fingerprint"), "near_edited", "near_next")
