"""Corpus pipeline: from raw documents to packed training sequences.

Each stage works on all that the one before kept, written as Parquet and read again. All
stages but the last return the columns of ``documents``:

1. quality classifier: documents scored below the threshold go;
2. exact dedup: of equal texts one stays;
3. near dedup: of each group of near copies (five-word shingles, similarity 0.8) one stays;
4. mixing: each source gives its share of words; documents repeat or are left out, but stay whole,
   and their rows are in the order of the mixing schedule;
5. packing: the words' tokens, in that order, in sequences of 4096.

Working tables of a stage belong to the frame it returned. Their key travels with that frame as
column metadata, through the written Parquet too: a stage that gets the reread result of another
discards the tables of just that result, which nothing needs any more. Frames of other runs, and
results that are not written yet, keep theirs.

Defined cases: NULL texts count as empty; an empty or repeated row is judged like any other (the
classifier scores empty texts, exact dedup leaves one of them, mixing takes no text without
words); columns besides doc_id, text and source ride along whatever their names; without two labelled
documents of each class nothing is rejected; an empty table passes through every stage.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ledgermatch.llm import exact_dedup, mixing, near_dedup, packing, quality
from ledgermatch.llm.common import cuts_made, discard
from ledgermatch.llm.registry import QUALITY_THRESHOLD, table, tokenizer_path
from ledgermatch.session import scratch_path

#: Stages like the classifier and the packing have no SQL form.
ORACLE_SQL = None

#: Column metadata that names the stage call whose working tables the rows came from.
WORK = "corpus_pipeline_work"
#: Working folders by that name.
_FOLDERS: dict[str, list[str]] = {}


def _release(spark: SparkSession, docs: DataFrame) -> None:
    """Discard what the call that made ``docs`` left, unless ``docs`` still reads it."""
    name = next((f.metadata[WORK] for f in docs.schema.fields if WORK in f.metadata), None)
    folders = _FOLDERS.get(name, [])
    read = docs.inputFiles() if folders else []
    if not any(folder.rsplit("/", 1)[-1] in f for folder in folders for f in read):  # the names are unique
        discard(spark, _FOLDERS.pop(name, []))


def _marked(kept: DataFrame, folders: list[str]) -> DataFrame:
    """``kept`` with the key of its working folders on a column that can be told from the others."""
    lower = [c.lower() for c in kept.columns]
    column = next((c for c in kept.columns if lower.count(c.lower()) == 1), None)
    if column is None:
        return kept
    name = uuid.uuid4().hex
    _FOLDERS[name] = folders
    return kept.withMetadata(column, kept.schema[column].metadata | {WORK: name})


def _stage(work):
    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release(spark, docs)
        with cuts_made() as made:
            kept = work(spark, docs, sf_dir)
        return _marked(kept, made)

    return stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=QUALITY_THRESHOLD)


@_stage
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs, words=5, percent=80)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def _reads_files(docs: DataFrame) -> bool:
    """The rows have a place in files (a frame made in memory or by a join has none)."""
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        return False
    return True


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer=tokenizer_path("word_bpe_49k.json"), length=4096, end_id=2,
                        file_order=_reads_files(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. What stays is the last stage's result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        kept = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{name}")
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            discard(spark, [before])
        before = path
    _release(spark, docs)
    return docs
