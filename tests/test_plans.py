"""What plans read: one scan for lines and fold, byte ranges and row groups for time windows."""

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from samples import T0, minutes, timed
from tracewright.functions.criteria import Criteria
from tracewright.operators import paging, timeindex as T
from tracewright.operators.fold import fold_records, record_bounds
from tracewright.plans import views as V
from tracewright.plans.catalog import QUERIES
from tracewright.sources import files as X, ranges
from tracewright.sources.lines import read_lines
from tracewright.sources.stores import sizes


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def scans(df):
    return len(re.findall(r"FileScan|BatchScan", final_plan(df)))


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    """Two logs of a record a minute, each with a trace in every fifth."""
    folder = tmp_path_factory.mktemp("logs")
    for name, n in (("a.log", 4000), ("b.log", 2500)):
        (folder / name).write_bytes(timed(minutes(n), 5)[0].encode())
    return str(folder)


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def test_fold_reads_its_source_once(spark, sf_dir, logs):
    for df in (V.event_records(spark, sf_dir), fold_records(read_lines(spark, f"{logs}/*.log", headers=True)), V.event_records(spark, sf_dir).filter("level = 'error'").groupBy("file").count()):
        plan = final_plan(df)
        assert scans(df) == 1 and "ReusedExchange" in plan


def test_tails_and_pages_read_their_source_once(spark, sf_dir):
    lines = V.event_lines(spark, sf_dir, headers=True)
    for df in (paging.tail(lines, 40), paging.page(lines, 2500, 30)):
        assert scans(df) == 1 and "WindowGroupLimit" in final_plan(df)
    most = paging.GROUP_LIMIT + 1  # behind Spark's limit of a group the same rows come by their numbers
    by_number = paging.last_lines(lines, most)
    ranked = paging._ranked(lines, F.desc("line_no"), most)
    assert by_number.exceptAll(ranked).count() == ranked.exceptAll(by_number).count() == 0


def test_folded_alike_with_and_without_headers(spark, logs):
    columns = ["file", "offset", "end_offset", "raw", "n_lines", "level"]
    for limit in (3, None):
        one = fold_records(read_lines(spark, f"{logs}/*.log", headers=True), max_continuation=limit).select(columns)
        other = fold_records(read_lines(spark, f"{logs}/*.log"), max_continuation=limit).select(columns)
        assert one.exceptAll(other).count() == other.exceptAll(one).count() == 0


@pytest.mark.parametrize("slice_bytes", [50, 4096, 1 << 26])
def test_ranges_are_the_lines_between(spark, tmp_path, slice_bytes):
    data = b"".join(b"line %d %s\r\n" % (i, b"x" * (i % 90)) for i in range(300)) + b"\n\nopen \xff end"
    (tmp_path / "a.log").write_bytes(data)
    path = str(tmp_path / "a.log")
    every = read_lines(spark, path, max_line_length=40).select("offset", "end_offset", "raw", "truncated").orderBy("offset").collect()
    starts = [r["offset"] for r in every]
    cut = [(path, starts[10], starts[60]), (path, starts[61], starts[200]), (path, starts[290], len(data))]
    got = ranges.read_ranges(ranges.ranges_of(spark, cut), max_line_length=40, slice_bytes=slice_bytes).orderBy("offset").collect()
    wanted = every[10:60] + every[61:200] + every[290:]
    assert [(r["offset"], r["end_offset"], r["raw"], r["truncated"]) for r in got] == [tuple(r) for r in wanted]
    numbers = [r["line_no"] for r in got]
    assert all(b - a == 1 or i in (49, 188) and b > a for i, (a, b) in enumerate(zip(numbers, numbers[1:])))


def test_tails_are_read_from_the_end(spark, tmp_path):
    texts = {"a.log": b"".join(b"line %d %s\n" % (i, b"y" * 200) for i in range(2000)), "b.log": b"one\ntwo", "c.log": b"\n\n", "d.log": b""}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    for n in (1, 3, 900):
        got = ranges.read_tails(spark, str(tmp_path), n)
        own = paging.last_lines(read_lines(spark, f"{tmp_path}/*.log"), n)
        pick = lambda df: sorted((r["file"].rpartition("/")[2], r["offset"], r["end_offset"], r["raw"]) for r in df.collect())
        assert pick(got) == pick(own)


def test_window_reads_what_the_index_names(spark, logs, tmp_path, monkeypatch):
    lines = read_lines(spark, f"{logs}/*.log", headers=True)
    files, records = V.files_of(lines).cache(), fold_records(lines).cache()
    index = T.time_index(records, 4096).cache()
    X.write_records(records, str(tmp_path / "kept"))
    total = sum(n for n, _ in sizes(logs).values())
    for criteria in (Criteria(date_from=at(100), date_to=at(160)), Criteria("Handler.php", date_from=at(2400))):
        expected = records.filter(criteria.predicate())
        asked = [tuple(r) for r in T.matching_ranges(index, files, criteria, 300).select("file", "start", "end").collect()]
        share = (expected.agg(F.max("ts").cast("long") - F.min("ts").cast("long")).first()[0] + 1200) / (4000 * 60)
        assert sum(b - a for _, a, b in asked) < total * share * 2.2 and len(asked) <= 2
        for margin_of in (300, 0):
            assert number(T.search_text(spark, index, files, criteria, margin=margin_of)) == number(expected)
            kept = T.search_kept(spark, str(tmp_path / "kept"), index, files, criteria, margin_of)
            assert number(kept) == number(expected)
        plan = final_plan(kept)
        assert "PartitionFilters: [(" in plan and "GreaterThanOrEqual(offset" in plan
        days = kept.select("_metadata.file_path").distinct().count()
        assert days < spark.read.parquet(str(tmp_path / "kept")).select("_metadata.file_path").distinct().count()
    monkeypatch.setattr(T, "MOST_PREDICATES", 0)
    assert number(T.search_kept(spark, str(tmp_path / "kept"), index, files, criteria)) == number(expected)


def number(df):
    return sorted((r["file"].rpartition("/")[2], json.loads(r["context"])["i"]) for r in df.collect())


def test_listing_with_dotfiles(spark, tmp_path):
    for name in ("a.log", ".hidden.log", "sub/.x.txt", "sub/_y.log", "secret.key"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 10)
    found = X.list_files(spark, [str(tmp_path), str(tmp_path / "sub")], dotfiles=True).collect()
    assert sorted(r["name"] for r in found) == [".hidden.log", ".x.txt", "_y.log", "a.log"]  # a file below two roots counts once
    assert [r["name"] for r in X.list_files(spark, str(tmp_path)).collect()] == ["a.log"]


def test_a_deep_tree_is_listed_by_levels(spark, tmp_path):
    wanted = set()
    for i in range(60):
        folder = tmp_path / "/".join(f"d{i % k}" for k in range(2, 2 + i % 6)) / f"leaf{i}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f".x{i}.log").write_bytes(b"x" * i)
        wanted.add((str(folder / f".x{i}.log"), str((folder / f".x{i}.log").relative_to(tmp_path)), i))
    (tmp_path / "empty").mkdir()
    found = X.list_files(spark, f"file://{tmp_path}", dotfiles=True).collect()
    assert {(r["path"], r["relative_path"], r["size"]) for r in found} == wanted and len(found) == 60
    one = X.list_files(spark, next(iter(wanted))[0], dotfiles=True).collect()
    assert [(r["name"], r["relative_path"]) for r in one] == [(one[0]["name"], one[0]["name"])]
    assert X.list_files(spark, f"{tmp_path}/no-such", dotfiles=True).count() == 0


def test_sizes_by_glob_and_address(tmp_path):
    for name in ("a.log", "b.txt"):
        (tmp_path / name).write_bytes(b"12345")
    assert list(sizes(f"{tmp_path}/*.log")) == [f"{tmp_path}/a.log"] and len(sizes(str(tmp_path))) == 2
    assert [n for n, _ in sizes(f"file://{tmp_path}/b.txt").values()] == [5]
    with open(tmp_path / "a.log", "rb") as f:
        assert ranges.line_start(f, 5) == 0


def test_text_logs_cost_no_records_and_no_index(spark, sf_dir):
    path = V.event_logs(spark, sf_dir)
    assert os.listdir(path) == ["logs"]
    read = read_lines(spark, f"{path}/logs/*/*.txt").select(V.log_name(F.col("file")).alias("file"), "offset", "raw")
    lines = V.event_lines(spark, sf_dir).select("file", "offset", "raw")
    assert read.exceptAll(lines).count() == lines.exceptAll(read).count() == 0
    files, index = V.event_files(spark, sf_dir), V.event_index(spark, sf_dir)
    assert files.count() == 8 and files.join(index, "file", "left_anti").count() == index.join(files, "file", "left_anti").count() == 0


@pytest.mark.parametrize("limit", [2, 200, None])
def test_an_index_of_lines_is_that_of_their_records(spark, tmp_path, limit):
    undated = b'{"level":"info","message":"undated"}\n' * 3
    data = b"above\n" * 7 + timed(minutes(60), 4)[0].encode() + undated + b"  at x\n" * 450 + b'{"level":"info","time":"2026-03-01 10:00:00","message":1}\n  at y'
    (tmp_path / "a.log").write_bytes(data)
    (tmp_path / "b.log").write_bytes(b"no header\n" * 300)
    for lines in (read_lines(spark, f"{tmp_path}/*.log", headers=True), read_lines(spark, f"{tmp_path}/*.log")):
        index, wanted = T.index_lines(lines, 512, max_continuation=limit), T.time_index(fold_records(lines, max_continuation=limit), 512)
        assert index.columns == wanted.columns and wanted.count() > 8
        assert index.exceptAll(wanted).count() == wanted.exceptAll(index).count() == 0
        plan = final_plan(index)
        assert "collect_list" not in plan and scans(index) <= scans(wanted)


def test_records_are_placed_without_their_texts(spark, sf_dir, tmp_path):
    (tmp_path / "a.log").write_bytes(b"above\n" * 7 + timed(minutes(30), 4)[0].encode() + b"  at x\n" * 450)
    lines = read_lines(spark, f"{tmp_path}/a.log", headers=True)
    bounds, records = record_bounds(lines), fold_records(lines).select("file", "offset", "end_offset")
    assert bounds.exceptAll(records).count() == records.exceptAll(bounds).count() == 0 < records.count()
    assert "collect_list" not in final_plan(QUERIES["record_at"](spark, sf_dir))
