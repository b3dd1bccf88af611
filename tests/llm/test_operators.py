"""Small cases of the llm operators against brute force: nulls, empty texts, ties, repeats, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermatch.llm import (chat_format, common, exact_dedup, fingerprints, license_scan, mixing, near_dedup, packing,
                             quality, registry, sharding, url_filters)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, KEPT string, size string"


def documents(spark, texts, source=lambda i: f"s{i % 3}"):
    rows = [(i, t, "en", source(i), len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, vocabulary=200):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", "  \n\t", "a", "a ", "A", "x" * 30000, prose(1, 3000), "ß É\u00a0 日本。", "a", prose(2, 40), prose(2, 40)]


# --- 1 url filters ---------------------------------------------------------------------------

def test_url_rules(spark):
    urls = [None, "", "no-scheme.org/x", "http://a.ORG", "http://a.org/", "http://xorg/", "http://x.example.org/en/1?q",
            "http://example.org/en/2#f", "ftp://example.org/es/a://b", "http://.org//", "http://a.b.c.org/" + "p" * 9000,
            "http://Com/de/", "http://com/de/", "http://com.au/de/"]
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(urls)], "page_id long, url string, RULE string, verdict string")
    got = {r.page_id: r for r in url_filters.judge(pages, url_filters.rule_frame(spark, registry.URL_RULES)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in registry.URL_RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[1], best[2]), u


def test_url_rules_contradicting_or_none(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x")], "page_id long, url string")
    both = url_filters.rule_frame(spark, [("allow", "org", "/"), ("block", "ORG", "/"), ("block", None, None)])
    assert [r.verdict for r in url_filters.judge(pages, both).collect()] == ["block", "block"]
    assert [r.rule for r in url_filters.judge(pages, url_filters.rule_frame(spark, [])).collect()] == [None, None]


# --- 2 quality ---------------------------------------------------------------------------

def test_quality_learns_and_scores_odd_texts(spark):
    texts = [prose(i, 30 + i, 5000) if i % 2 else f"W{i}!! " * 40 for i in range(200)] + ODD
    docs = documents(spark, texts).select("doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    measured = common.cut(quality.with_statistics(docs), "t")
    model = quality.learn(measured, labels)
    scores = {r.doc_id: r.score for r in quality.score(measured, model).collect()}
    assert len(scores) == len(texts) and all(0 <= s <= 1 for s in scores.values())
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((scores[i] >= 0.3) == bool(i % 2) for i in held)
    x = np.array([quality.statistics(texts[i]) for i in range(200) if zlib.crc32(str(i).encode()) % 5])
    assert np.allclose(model.centre, x.mean(axis=0))
    kept = quality.keep_good(documents(spark, texts), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= 0.3}


def test_quality_learns_nothing_without_both_classes(spark):
    docs = documents(spark, ODD)
    labels = "doc_id long, quality int"
    for marks in ([], [(3, 1), (4, 1), (6, 1)], [(None, 0), (3, None), (5, 7)]):
        measured = common.cut(quality.with_statistics(docs.select("doc_id", "text")), "t")
        model = quality.learn(measured, spark.createDataFrame(marks, labels))
        assert [r.score for r in quality.score(measured, model).collect()] == [0.5] * len(ODD)
        assert quality.keep_good(docs, spark.createDataFrame(marks, labels)).count() == len(ODD)
    assert quality.keep_good(documents(spark, []), spark.createDataFrame([(3, 1)], labels)).count() == 0


def test_quality_carries_columns_of_any_type(spark):
    docs = documents(spark, ODD).withColumns({
        "nested": F.struct(F.col("doc_id").alias("odd name"), F.lit(1.5).alias("b`c")), "statistics": F.lit("own"),
        "score": F.array(F.lit(None).cast("date")), "many": F.create_map(F.lit("k"), F.lit(1))})
    kept = quality.keep_good(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


# --- 3 exact dedup ---------------------------------------------------------------------------

def expected_copies(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault("".join(c for c in t or "" if c not in common.SPACES), []).append(i)
    return {i: (min(g, key=lambda j: (-len(texts[j] or ""), j)), len(g)) for g in groups.values() for i in g}


def test_exact_dedup_matches_brute_force_even_with_colliding_hashes(spark):
    texts = ODD + [ODD[7][:900] + "." + ODD[7][900:], ODD[7].replace(" ", "  "), "." * 9000, "." * 8999]
    want = expected_copies(texts)
    got = {r.doc_id: r for r in exact_dedup.dedup(documents(spark, texts)).collect()}
    assert {i: (r.keep_id, r.group_size) for i, r in got.items()} == want
    assert got[7].text_sha256 == hashlib.sha256("".join(texts[7].split()).encode()).hexdigest()
    rows = common.pick(documents(spark, texts), doc_id="doc_id", text="text").withColumn("row_id", F.monotonically_increasing_id())
    weak = exact_dedup.decide(exact_dedup.recipes(rows, lambda c: F.length(c).cast("long") % 3))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in weak.collect()} == want
    kept = exact_dedup.drop_copies(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (k, _) in want.items() if i == k}


# --- 4 mixing, 5 sharding ------------------------------------------------------------------------

def test_mixing_hits_targets_and_caps(spark):
    texts = ODD + [prose(i, 20 + i * 3) for i in range(60)]
    docs = documents(spark, texts, lambda i: None if i % 11 == 0 else f"s{i % 4}")
    got = mixing.taken(docs, block=16).collect()
    size = {r.doc_id: r["size"] for r in got}
    assert size == {i: len((t or "").encode().split()) for i, t in enumerate(texts)}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
    by = {}
    for r in got:
        source = "~" if r.doc_id % 11 == 0 else f"s{r.doc_id % 4}"
        by.setdefault(source, [0, r.target, r.source_size])[0] += r.taken
    weights, mix = dict(zip(sorted(by), itertools.cycle((5, 2, 1)))), 1.5 * sum(size.values())
    capped = set()
    while True:
        free, open_weight = mix - sum(2 * by[s][2] for s in capped), sum(weights[s] for s in by if s not in capped)
        over = {s for s in by if s not in capped and free * weights[s] / open_weight > 2 * by[s][2]}
        if not over:
            break
        capped |= over
    for s, (taken, target, own) in by.items():
        assert target == pytest.approx(2 * own if s in capped else free * weights[s] / open_weight)
        assert abs(taken - target) <= 1
    mixed = mixing.mixed_documents(docs, block=16).collect()
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
        assert texts[r.doc_id] == r.text
    # a pass that takes at least half of a document takes it whole, else it leaves it
    whole = {r.doc_id: r["size"] * ((2 * r.taken + r["size"]) // (2 * r["size"])) for r in got if r["size"]}
    assert words == {i: n for i, n in whole.items() if n}


def test_sharding_is_even_gapless_and_proportional(spark):
    texts = ODD + [prose(i, 5) for i in range(188)]
    docs = documents(spark, texts, lambda i: None if i < 70 else f"s{i % 3}")
    rows = sharding.assign(docs, shards=8).collect()
    counts = [sorted(r.slot for r in rows if r.shard == s) for s in range(8)]
    assert all(c == list(range(25)) for c in counts)
    for s in range(8):
        assert abs(sum(r.source is None for r in rows if r.shard == s) - 70 / 8) <= 2
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "rows")
    assert sorted(map(tuple, sharding.assign(docs.repartition(5)).select("doc_id", "shard", "slot").collect())) == sorted(
        (r.doc_id, r.shard, r.slot) for r in rows)


# --- 6 licences ----------------------------------------------------------------------------

def test_licence_headers_files_and_inheritance(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "some prose about nothing much"),
             ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/y", None),
             ("z/q", prose(1, 50) + "\nLicensed under CC BY-NC 4.0.\n" + prose(2, 50)), ("z/r", ""), (None, "prose"), ("top", "prose"),
             ("z/s", "The license of this poem is a licence to dream of versions and works.")]
    got = {r.path: r for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert (got["a/b/x.txt"].licence, got["a/b/x.txt"].licence_from, got["a/b/x.txt"].licence_path) == ("MIT", "directory", "a/LICENSE")
    assert (got["a/b/c/y"].licence, got["a/b/c/y"].licence_path) == ("GPL-3.0", "a/b/c/COPYING")
    assert (got["z/q"].licence, got["z/q"].licence_from) == ("CC-BY-NC-4.0", "header")
    assert got["a/LICENSE"].licence_from == "file"
    assert [got[p].licence for p in ("z/r", "z/s", None, "top")] == [None] * 4
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def wrapped(text, width, mark):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_licences_of_wrapped_headers(spark):
    notices = {
        "mit": ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
        "bsd": ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                "provided that the following conditions are met: 1. Redistributions of source code must retain the above notice."),
        "cc": ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        "cc-by": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.")}
    for licence, kind, version in (("GPL-3.0", "", "3"), ("GPL-2.0", "", "2"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")):
        notices[licence] = (licence, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                            f"{kind}General Public License as published by the Free Software Foundation, either version {version} of "
                            "the License, or (at your option) any later version. This program is distributed in the hope that it will "
                            "be useful, but WITHOUT ANY WARRANTY.")
    code = "\n".join(f"def f{i}(a):\n    return a + {prose(i, 6)}" for i in range(200))
    files = [(f"{width}/{mark.strip()}/{name}", "\n".join([f"{mark}Copyright (c) 2020 A. Person", wrapped(text, width, mark), code]))
             for name, (_, text) in notices.items() for width in (40, 55, 72) for mark in ("# ", " * ", "")]
    files += [(f"plain/{i}", f"{prose(i, 50)}\n{prose(i + 1, 60)}") for i in range(300)]
    got = {r.path: r for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for path, _ in files:
        want = (None, None) if path.startswith("plain/") else (notices[path.split("/")[-1]][0], "header")
        assert (got[path].licence, got[path].licence_from) == want, path


def test_whole_licence_files_cover_their_directory(spark):
    texts = dict(license_scan.licence_texts())
    files = []
    for licence, text in texts.items():
        rewrapped = "\n\n".join(textwrap.fill(p, 60) for p in text.split("\n\n"))
        files += [(f"{licence}/TERMS.md", f"Copyright (c) 2020 A. Person\n\n{rewrapped}"), (f"{licence}/src/a.c", "int main;")]
    files += [(f"plain/{i}", prose(i, 300)) for i in range(300)]
    got = {r.path: r for r in license_scan.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    for licence in texts:
        assert (got[f"{licence}/TERMS.md"].licence, got[f"{licence}/TERMS.md"].licence_from) == (licence, "file")
        assert (got[f"{licence}/src/a.c"].licence, got[f"{licence}/src/a.c"].licence_path) == (licence, f"{licence}/TERMS.md")


@pytest.mark.parametrize("seed", range(2))
def test_licence_runs_match_brute_force(spark, seed):
    r = random.Random(seed)
    notices = [("A", "Alpha beta gamma delta epsilon."), ("B", "Beta zeta eta, theta iota kappa lambda.")]
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split() + ["x", "y", "z"]
    split = [[[r.choice(words) for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(1, 9))] for _ in range(150)]
    texts = ["\n".join(" ".join(p) for p in ps) for ps in split]
    n = sum(map(len, split))
    idf = {w: math.log((1 + n) / (1 + sum(w in p for ps in split for p in ps))) + 1 for w in words}
    vectors = [(lic, {w: idf[w] for w in text.lower().replace(",", "").rstrip(".").split()}) for lic, text in notices]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "row_id string, text string")
    got = {x.row_id: (x.whole_matches, x.licence, round(x.cosine, 6)) for x in license_scan.scores(rows, notices, 0.75).collect()}
    unseen = math.log(1 + n) + 1
    want = {}
    for i, ps in enumerate(split):
        found = []
        for a in range(len(ps)):
            for b in range(a + 1, len(ps) + 1):
                unit = [w for p in ps[a:b] for w in p]
                for whole in ([False] if b == a + 1 or len(unit) <= 14 else []) + [True] * (b - a == len(ps)):
                    u = {w: unit.count(w) * (idf[w] if any(w in v for _, v in vectors) else unseen) for w in set(unit)}
                    for lic, v in vectors:
                        c = sum(u[w] * v[w] for w in u if w in v) / math.hypot(*u.values()) / math.hypot(*v.values())
                        if c >= 0.75:
                            found.append((not whole, -round(c, 9), lic))
        if found:
            part, c, lic = min(found)
            want[str(i)] = (not part, lic, round(-c, 6))
    assert got == want and len(want) > 10


# --- 7 chat --------------------------------------------------------------------------------

def test_chat_round_trip_and_sharing(spark):
    tricky = [r"\### Assistant: </turn> ok", "</turn>\n<turn assistant>", "\\", "<", "", None, "é😀\n"]
    rows = [(c, k, role, tricky[(c * 3 + k) % 7] if k else "shared start") for c in range(9)
            for k, role in enumerate(("user", "assistant", "user", "assistant")[:c % 4 + 1])] + [(None, 0, None, "x"), (20, None, "user", "y")]
    rows += [(30 + c, k, role, t) for c in range(5) for k, (role, t) in enumerate((("user", "same"), ("assistant", "copy")))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    by = {"tokenizer": registry.tokenizer_path("byte_bpe_50k.tiktoken"), "pattern": registry.token_pattern()}
    tree = chat_format.format_tree(df, **by)
    got = {r.conv_id: r for r in chat_format.read_back(tree, **by).collect()}
    turns = {}
    for c, k, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0)):
        turns.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(turns)
    for c, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len("".join(chat_format.segments(r, t))) for r, t in ts)
    prefixes = {tuple(ts[:k + 1]) for ts in turns.values() for k in range(len(ts))}
    nodes = sorted(tree.nodes.collect(), key=lambda r: r.start)
    assert len(nodes) == len(prefixes)
    at = 0
    by_node = {bytes(n.node): n for n in nodes}
    for n in nodes:  # gapless, parents first, ancestors attended and nothing else
        assert n.start == at
        at += n.tokens
        seen, up = set(), by_node.get(bytes(n.parent))
        while up:
            seen |= set(range(up.start, up.start + up.tokens))
            up = by_node.get(bytes(up.parent))
        assert seen == {i for a in n.attends for i in range(a["from"], a["to"])} and n.position == len(seen)


# --- 8 fingerprints ------------------------------------------------------------------------------

def test_fingerprints_equal_edit_and_next(spark):
    texts = ODD + ["line one two three four\nline five six\n\nnext part here now\n" * 9]
    got = {r.doc_id: r for r in fingerprints.compare_edited(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (edited == t)
        assert 0 <= got[i].near_edited <= 1 and (got[i].near_next == 1) >= (t == following)
    for i, j in itertools.combinations(range(len(texts)), 2):
        assert (got[i].fingerprint == got[j].fingerprint) == ((texts[i] or "") == (texts[j] or ""))


def test_changed_paragraphs(spark):
    lines = [f"paragraph {i}\n" for i in range(30)]
    other = lines[:11] + ["edited\n"] + lines[12:]
    df = spark.createDataFrame([("".join(lines), "".join(other))], "a string, b string")
    old, new = fingerprints.tree(F.col("a")), fingerprints.tree(F.col("b"))
    r = df.select(fingerprints.changed(old, new).alias("c"), new.alias("t")).first()
    assert [sum(len(s.paragraphs) for s in r.t[:x.section]) + x.paragraph for x in r.c] == [11]


def test_small_edits_keep_likeness_and_far_sections(spark):
    """One word or line more changes what is around it; everything else keeps its digests."""
    r = random.Random(9)
    line = " ".join("".join(r.choice("abcdefghilmnopqrstu") for _ in range(r.randrange(2, 9))) for _ in range(400))
    lines = [" ".join(f"{r.choice(['plain', 'word', 'text', 'of', 'a'])}{r.randrange(99)}" for _ in range(9)) for _ in range(80)]
    words = line.split()
    cases = [(line, "new " + line), (line, " ".join([*words[:200], "new", *words[200:]])), (line, " ".join(words[:90] + words[91:])),
             ("\n".join(lines), "\n".join(["an inserted line", *lines])), ("\n".join(lines), "\n".join(lines[:40] + lines[41:])),
             (line, line), ("", ""), ("", line), (line, " ".join(reversed(words)))]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, a string, b string")
    pairs = fingerprints.with_tree(fingerprints.with_tree(df, "a", "a"), "b", "b")
    got = [r.near for r in fingerprints.with_likeness(pairs, "a_leaves", {"near": "b_leaves"}).orderBy("k").collect()]
    assert all(0.9 < x < 1 for x in got[:5]) and got[5:8] == [1.0, 1.0, 0.0] and got[8] < 0.9
    trees = df.where("k in (3, 4)").select(fingerprints.tree(F.col("a")).alias("a"), fingerprints.tree(F.col("b")).alias("b")).collect()
    for t in trees:
        a, b = {s.digest for s in t.a}, {s.digest for s in t.b}
        assert len(a) >= 5 and len(a - b) <= 2 and len(b - a) <= 2


# --- 9 packing ------------------------------------------------------------------------------

def test_packing_restores_every_id(spark):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = ODD + ["Don't STOP 'tis we'll", "<|endoftext|> a<|startoftext|>b", "İstanbul ΣΑΣ e\u0301 \x1c\x0b nb", "!!!..., ##"]
    pieces = packing.pack(documents(spark, texts), tokenizer=path, length=256)
    rows = pieces.collect()
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
        assert ids == [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        assert all(r.doc_tokens == len(ids) and len(r.ids) == 4 * r.length for r in own)
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert sorted(by) == list(range(len(by))) and all(by[s] == 256 for s in range(len(by) - 1))
    assert all(len(r.ids) == 1024 for r in packing.sequences(pieces, length=256).collect())


# --- 10 near dedup ---------------------------------------------------------------------------

def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        common_ = len(sets[i] & sets[j])
        if common_ and 100 * common_ >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_group(seed, n):
    """Copies of one text with more and more edits: many links, many close misses."""
    r, base = random.Random(seed), prose(seed, 150, 10_000).split()
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(i // 6 + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_matches_brute_force(spark, words, percent):
    texts = ODD + near_group(5, 90) + [prose(i, 60, 40) for i in range(30)] + ["one two", "ONE\ntwo", "one"]
    sizes, roots = brute_components(texts, words, percent)
    assert 3 < len(set(roots[len(ODD):len(ODD) + 90])) < 80
    got = {r.doc_id: r for r in near_dedup.near_copies(documents(spark, texts), words=words, percent=percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert [got[i].kept for i in range(len(texts))] == [i == c for i, c in enumerate(roots)]


# --- empty tables, repeated and null ids -----------------------------------------------------------

def test_empty_and_repeated_rows(spark):
    none, twice = documents(spark, []), documents(spark, [prose(3, 30)] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    path = registry.tokenizer_path("word_bpe_49k.json")
    for rows, df in ((0, none), (2, twice)):
        assert exact_dedup.dedup(df).count() == rows
        assert mixing.taken(df).count() == rows
        assert sharding.assign(df).count() == rows
        assert fingerprints.compare_edited(df).count() == rows
        assert packing.pack(df, tokenizer=path).count() == rows
        assert near_dedup.near_copies(df).count() == rows
        assert exact_dedup.drop_copies(df).count() == min(rows, 1)
        assert near_dedup.drop_near_copies(df).count() == min(rows, 1)
        assert license_scan.scan(df.withColumn("path", F.lit(None).cast("string"))).count() == rows


def test_empty_tables_of_pages_and_conversations(spark):
    rules = url_filters.rule_frame(spark, registry.URL_RULES)
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    by = {"tokenizer": registry.tokenizer_path("byte_bpe_50k.tiktoken"), "pattern": registry.token_pattern()}
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    tree = chat_format.format_tree(empty, **by)
    assert tree.nodes.count() == 0 and chat_format.read_back(tree, **by).count() == 0
    assert mixing.mixed_documents(documents(spark, [])).count() == 0
    assert mixing.mixed_documents(documents(spark, [None, "", " "])).count() == 0
    assert fingerprints.fingerprint(documents(spark, [])).count() == 0


def labelled_texts(spark, texts_by_class):
    rows = [(k, t, c) for k, (t, c) in enumerate(texts_by_class)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")


@pytest.mark.parametrize("case", ["one text", "constant statistics", "two rows a class", "three equal statistics"])
def test_classifier_without_variance(spark, case):
    """Constant statistics have no weight; the factor exists whatever the labelled rows are."""
    if case == "one text":
        pairs = [("The same text.", k % 2) for k in range(40)]
    elif case == "constant statistics":  # neither signs nor digits nor capitals anywhere
        pairs = [("plain words " * (3 + k % 5) + ("and " * (k % 7) if k % 2 else "or so it goes on"), k % 2) for k in range(60)]
    elif case == "two rows a class":
        pairs = [("one", 0), ("two three", 0), ("four five six", 1), ("seven", 1), ("eight", 0), ("nine ten", 1)] * 2
    else:
        pairs = [(("spam " * 30 if k % 2 else "a b c d e f g h i j"), k % 2) for k in range(40)]
    docs, labels = labelled_texts(spark, pairs)
    measured = quality.with_statistics(docs)
    model = quality.learn(measured, labels)
    scores = [r.score for r in quality.score(measured, model).collect()]
    assert len(scores) == len(pairs) and all(0 <= s <= 1 for s in scores)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.3 for s in scores)
    if case == "three equal statistics":
        assert all((s >= 0.5) == (c == 1) for s, (_, c) in zip(
            [r.score for r in quality.score(measured, model).orderBy("doc_id").collect()], pairs, strict=True))


@pytest.mark.parametrize("half", [0, 1])
def test_classifier_on_halves_of_the_smallest_table(spark, half):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") % 2 == half)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    known = [r.doc_id for r in docs.select("doc_id").collect() if r.doc_id in marks]
    assert sum((i in kept) == (marks[i] == 1) for i in known) >= 0.9 * len(known)


def test_classifier_ranks_held_out_rows(spark):
    """Held-out AUC over the labels that are never learned."""
    sf = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, marks[r.doc_id]) for r in registry.op2_quality_classifier(spark, sf).where("held_out").collect()
            if r.doc_id in marks]
    good, bad = [s for s, k in rows if k == 1], [s for s, k in rows if k == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.95


def framed(count, frame=160, own=20, jitter=0):
    """Texts that share a frame of words and have some of their own: three-word shingles, similarity about 0.8."""
    rnd = random.Random(11)
    shared = " ".join(f"f{k}" for k in range(frame))
    return [shared + " " + " ".join(f"o{i}x{k}" for k in range(own + rnd.randint(-jitter, jitter))) for i in range(count)]


def test_pairs_of_a_page_frame_grow_with_the_texts(spark):
    """Texts just below the threshold share their rarest common shingles, but do not meet."""
    met = {}
    for count in (500, 1000, 2000):
        texts = framed(count)
        sets = [near_dedup.shingle_set(t, 3).view(np.int64).tolist() for t in texts]
        a, b = set(sets[0]), set(sets[1])
        assert 0.76 < len(a & b) / len(a | b) < 0.85
        frame = spark.createDataFrame(list(enumerate(sets)), "node long, set array<long>")
        ranked = near_dedup._rarest(frame, 85).withColumn("comp", F.col("node"))
        hot = ranked.groupBy("shingle").count().where(F.col("count") == count).count()
        met[count] = near_dedup._meeting(ranked, 85).count()
        assert hot > 0 and met[count] <= 4 * count
    docs = documents(spark, framed(300, jitter=6) + framed(40)[:20])
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    _, roots = brute_components(texts, 3, 85)
    got = {r.doc_id: r.component_id for r in near_dedup.near_copies(docs, words=3, percent=85).collect()}
    assert got == dict(enumerate(roots))
