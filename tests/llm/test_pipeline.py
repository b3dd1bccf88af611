"""The pipeline's stages on the smallest tables, against brute force on each stage's own input."""

from __future__ import annotations

import math
import zlib

import corpus_pipeline
import numpy as np
from test_operators import brute_components, expected_copies
from tokenizers import Tokenizer

from ledgermatch.llm import mixing, packing, quality, registry
from ledgermatch.llm.common import cut

SF = "/root/testdata/sf0.001"


def brute_quality(rows, labels, shrink=0.1, ridge=0.01, temper=4.0, threshold=0.3):
    """Ids that the same discriminant keeps, from numpy's own covariances and densities."""
    x = {r["doc_id"]: np.array(quality.statistics(r["text"])) for r in rows}
    learned = [i for i in labels if i in x and zlib.crc32(str(i).encode()) % 5]
    every = np.array([x[i] for i in learned])
    centre, scale = every.mean(axis=0), np.sqrt(np.maximum(every.var(axis=0), 1e-12))
    pooled, log_density = np.cov(((every - centre) / scale).T, bias=True), {}
    for k in (0, 1):
        own = (np.array([x[i] for i in learned if labels[i] == k]) - centre) / scale
        cov = (1 - shrink) * np.cov(own.T, bias=True) + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
        inverse, log_det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        for i, v in x.items():
            d = (v - centre) / scale - own.mean(axis=0)
            log_density[i, k] = math.log(len(own) / len(learned)) - log_det / 2 - d @ inverse @ d / 2
    return {i for i in x if (log_density[i, 1] - log_density[i, 0]) / temper >= math.log(threshold / (1 - threshold))}


def test_stages_follow_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, frames[-1], SF)
        path = f"{registry.cut(kept, f'test-stage-{k}').inputFiles()[0].rsplit('/', 1)[0]}"
        frames.append(spark.read.parquet(path))
        if k < 4:
            assert kept.columns == columns
    rows = [sorted((r.asDict() for r in f.collect()), key=lambda r: r["doc_id"]) for f in frames]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert {r["doc_id"] for r in rows[1]} == brute_quality(rows[0], labels)
    copies = expected_copies([r["text"] for r in rows[1]])
    assert [r["doc_id"] for r in rows[2]] == [rows[1][i]["doc_id"] for i, (k, _) in copies.items() if i == k] or (
        {r["doc_id"] for r in rows[2]} == {rows[1][i]["doc_id"] for i, (k, _) in copies.items() if i == k})
    _, roots = brute_components([r["text"] for r in rows[2]], 5, 80)
    assert [r["doc_id"] for r in rows[3]] == [rows[2][i]["doc_id"] for i in range(len(roots)) if roots[i] == i]
    size = lambda r: len((r["text"] or "").encode().split())
    texts = {r["doc_id"]: r["text"] for r in rows[3]}
    assert all(texts[r["doc_id"]] == r["text"] for r in rows[4])  # whole documents only
    plan = {r.source: r.target for r in mixing.taken(frames[3]).select("source", "target").distinct().collect()}
    for source, target in plan.items():  # a source's last document is taken or left, whichever is nearer
        words = sum(size(r) for r in rows[4] if r["source"] == source)
        assert abs(words - target) <= max(size(r) for r in rows[3] if r["source"] == source) / 2 + 1
    tokens = Tokenizer.from_file(registry.tokenizer_path("word_bpe_49k.json"))
    want = sum(len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1 for r in rows[4])
    assert sum(len(np.frombuffer(r["ids"], "<u4")) for r in rows[5]) == want


def test_results_of_interleaved_runs_stay_readable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        a = stage(spark, docs.where("doc_id % 2 = 0"), SF)
        b = stage(spark, docs.where("doc_id % 2 = 1"), SF)
        assert a.count() >= 1 and b.count() >= 1 and a.columns == b.columns == docs.columns
    first = corpus_pipeline.exact_copies(spark, docs, SF)
    folders = list(corpus_pipeline._FOLDERS[first.schema["doc_id"].metadata[corpus_pipeline.WORK]])
    written = cut(first, "test-stage")
    second = corpus_pipeline.near_copies(spark, written, SF)  # what the first call left goes, its result is written
    assert folders and second.count() and written.count()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in folders:
        path = hadoop.Path(folder)
        assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_mix_is_in_training_order_and_packed_so(spark):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(rng.integers(5, 40))), "abcc"[k % 4]) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = cut(mixing.mixed_documents(docs), "test-mix")
    spots = mixed.select("doc_id", "source", "text", "_metadata.file_path", "_metadata.row_index")
    order = [(r.doc_id, r.source, len(r.text.split())) for r in spots.orderBy("file_path", "row_index").collect()]
    total = sum(n for *_, n in order)
    share = {s: sum(n for _, t, n in order if t == s) / total for s in "abc"}
    stretch = len(order) // 8
    for k in range(0, stretch * 8, stretch):
        part = order[k:k + stretch]
        words = sum(n for *_, n in part)
        assert all(abs(sum(n for _, t, n in part if t == s) / words - share[s]) < 0.06 for s in "abc")
    pieces = packing.pack(mixed, tokenizer=registry.tokenizer_path("word_bpe_49k.json"), file_order=True).collect()
    packed = [p.doc_id for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    assert packed == [i for i, *_ in order]


def test_odd_rows_pass_every_stage(spark):
    docs = spark.createDataFrame(
        [(0, None, "en", "a", None, "x"), (1, "", "en", "a", 0, "x"), (2, "one two three.", "en", None, 9, "x"), (2, "one two three.", "en", None, 9, "x"),
         (3, " \n\t ", None, "b", 4, None), (None, "words of a row without id. " * 40, "en", "b", 5, "y"),
         (4, "word " * 60_000, "de", "b", 300_000, "z")],
        "doc_id long, text string, lang string, source string, n_chars long, KEPT string")
    for start in (docs, docs.limit(0)):
        frame = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            kept = stage(spark, frame, SF)
            if k < 4:
                assert kept.columns == docs.columns
            frame = cut(kept, f"test-odd-{k}")
        assert (frame.count() > 0) == (start is docs)
