"""CSV records from split files, header reads and file digests against Python's csv and hashlib."""

from __future__ import annotations

import csv
import hashlib
import io
import random

import pytest

from ledgermatch.sources import csv_ingest, records

from test_ingest import WALLET, write_csv

PIECES = ["a", "", " ", '"x"', '"x,y"', '"l1\nl2"', '"l1\r\n\r\nl3"', '"say ""hi"""', '5" wide', '"ab"cd', '""', "é漢", '"\n"', 'x""y',
          '"""', '"", "']


def odd_csv(seed, rows, ending):
    rnd = random.Random(seed)
    lines = []
    for _ in range(rows):
        lines.append(",".join(rnd.choice(PIECES[:-2]) for _ in range(rnd.randint(1, 4))))
        if rnd.random() < 0.1:
            lines.append("")
    return ending.join(["h1,h2,\"h\n3\""] + lines) + (ending if seed % 2 else "")


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def parsed(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_records_of_split_files(spark, tmp_path, small_splits, ending):
    """Many splits, line breaks in fields across them, stray quotes, blank lines, marks, an open quote at the end."""
    texts = {f"f{k}.csv": odd_csv(k, 120, ending) for k in range(4)}
    texts["mark.csv"] = "﻿" + odd_csv(9, 30, ending)
    texts["open.csv"] = "a,b" + ending + '1,"never closed' + ending + "2,3" + ending
    texts["long.csv"] = 'a,b' + ending + '1,"' + ("y" * 90 + ending) * 40 + '"' + ending + "2,z" + ending
    texts["one.csv"] = "a,b"
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    found = records.records(spark, [str(tmp_path)])
    assert records._lines(spark, [str(tmp_path)]).rdd.getNumPartitions() > 40
    got = {}
    for r in found.collect():
        got.setdefault(r.name, {})[r.record] = r.text
    for name, text in texts.items():
        want = parsed(text.removeprefix("﻿"))
        assert sorted(got[name]) == list(range(len(want))), name
        for k, fields in enumerate(want):
            record = got[name][k].removeprefix("﻿")
            again = parsed(record)
            if name == "open.csv" and k == len(want) - 1:
                assert again[0][0] == fields[0] and again[0][1].rstrip("\r\n") == fields[1].rstrip("\r\n")
            else:
                assert again == [fields], (name, k)


def test_range_states_follow_a_reader():
    rnd = random.Random(3)
    for _ in range(400):
        lines = ",".join(rnd.choice(PIECES) for _ in range(5)).split("\n")
        inside = False
        for k, line in enumerate(lines):
            inside = records.ends_inside(line, inside)
            text = "\n".join(lines[:k + 1]) + "\n"
            rows = list(csv.reader(io.StringIO(text + "@END@\n", newline="")))
            assert inside == (rows[-1] != ["@END@"]), text


def test_typed_read_is_the_same_for_any_split(spark, tmp_path, small_splits):
    rows = [dict(WALLET, **{"Record Id": f"r{k}", "Narration": 'two\nlines, "quoted"' if k % 3 else "plain", "Amount": f"{k}.50"})
            for k in range(60)]
    path = write_csv(str(tmp_path), "w.csv", "wallet", rows)
    got = csv_ingest.ingest(spark, path)["wallet"].rows.select("zoho_record_id", "source_row_number", "narration", "amount").collect()
    assert {(r.zoho_record_id, r.source_row_number, r.narration, str(float(r.amount))) for r in got} == {
        (f"r{k}", k + 1, 'two\nlines, "quoted"' if k % 3 else "plain", str(k + 0.5)) for k in range(60)}


def test_oversize_fields_are_rejected(spark, tmp_path):
    long = "x" * (records.MAX_FIELD + 1)
    rows = [dict(WALLET, **{"Record Id": "r1", "Narration": long[:-1]}), dict(WALLET, **{"Record Id": "r2", "Narration": long}),
            dict(WALLET, **{"Record Id": "r3"})]
    path = write_csv(str(tmp_path), "w.csv", "wallet", rows)
    with open(path, "a", encoding="utf-8") as f:  # a quote that is never closed swallows the rest of the file
        f.write('r4,"' + ("y" * 1000 + "\n") * 6_000)
    res = csv_ingest.ingest(spark, path)["wallet"]
    assert {r.zoho_record_id for r in res.rows.collect()} == {"r1", "r3"}
    assert {r.source_row_number: r.reject_message for r in res.rejects.collect()} == {
        k: f"has a field of more than {records.MAX_FIELD} characters" for k in (2, 4)}


def test_heads_hold_line_breaks_and_stop_early(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbf\r\n"one\r\ntwo","x ""y""",z\r\n1,2,3\r\n')
    (tmp_path / "b.csv").write_bytes(b"p,q")
    (tmp_path / "empty.csv").write_bytes(b"")
    with open(tmp_path / "big.csv", "wb") as f:
        f.write(b"c,d\n")
        for _ in range(30):
            f.write(b"1,2\n" * 250_000)
    got = {r.file_name: r.headers for r in records.heads(spark, [str(tmp_path)]).collect()}
    assert got == {"a.csv": ["one\r\ntwo", 'x "y"', "z"], "b.csv": ["p", "q"], "big.csv": ["c", "d"]}


@pytest.mark.parametrize("content", [b"", b"a", b"a\n", b"\n", b"\xef\xbb\xbfa\r\nb", b"\xef\xbb\xbfa\r\nb\n", b"\xff\xfe bytes\n\n\n", b"x" * 300_000 + b"\n" + b"y"])
def test_digests_are_of_the_bytes(spark, tmp_path, content):
    (tmp_path / "f.csv").write_bytes(content)
    (tmp_path / "g.csv").write_bytes(b"other\n" * 5)
    got = {r.source_file: (r.sha256, r.bytes) for r in records.digests(spark, [str(tmp_path)]).collect()}
    assert got.get("f.csv") == ((hashlib.sha256(content).hexdigest(), len(content)) if content else None)
    assert got["g.csv"] == (hashlib.sha256(b"other\n" * 5).hexdigest(), 30)
