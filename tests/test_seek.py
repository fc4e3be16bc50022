"""Searches, pages, cursors and time windows of text logs against the same over all records, and how many bytes they read."""

import datetime as dt
import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from samples import T0, minutes, timed
from tracewright.functions.criteria import Criteria
from tracewright.operators import paging, search as Q, seek, timeindex as T
from tracewright.operators.fold import fold_records, record_at
from tracewright.sources import files as X, ranges
from tracewright.sources.lines import read_lines

COLUMNS = ["file", "offset", "end_offset", "raw", "truncated", "n_lines", "parser", "level"]


def shown(df):
    return [tuple(r) for r in df.withColumn("file", F.substring_index("file", "/", -1)).select(COLUMNS).collect()]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Logs with a top without header, traces beyond the limit of lines, no header at all, undated headers, nothing, and no last line break."""
    folder = tmp_path_factory.mktemp("odd")
    text = timed(minutes(60), 7)[0]
    undated = "".join(f'{{"level":"info","message":"undated {i}"}}\n' for i in range(5))
    long = "[2026-03-01 02:00:00] testing.ERROR: long\n" + "".join(f"#{i} frame of it\n" for i in range(450))
    texts = {
        "a.log": "no header yet\n" * 230 + text + long + text + "open end",
        "b.log": "".join(f"plain line {i}\r\n" for i in range(500)),
        "c.log": undated + text[: len(text) // 2] + undated + text,
        "d.log": "",
        "e.log": long,
        "f.log": "one line",
    }
    for name, data in texts.items():
        (folder / name).write_bytes(data.encode())
    lines = read_lines(spark, f"{folder}/*.log", headers=True).withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
    return ranges.files_in(spark, str(folder)), fold_records(lines).cache(), lines.cache()


CASES = [
    Criteria("number 1"), Criteria(limit=7), Criteria("frame", limit=3, direction="backward"), Criteria(direction="backward", limit=40), Criteria(level="error", limit=1000), Criteria("nothing of this"),
    Criteria(from_offset=3000, limit=20), Criteria(from_offset=3001, direction="backward", limit=20), Criteria(from_offset=9_999_999), Criteria(end_offset=5000, from_offset=700), Criteria(direction="backward", end_offset=4321), Criteria("undated", direction="backward"),
]


@pytest.mark.parametrize("wave, criteria", [(4000, CASES[i]) for i in (0, 3, 6, 7, 9, 10)] + [(1 << 22, x) for x in CASES[1:9:2]])
def test_waves_find_what_a_search_of_all_finds(odd, monkeypatch, criteria, wave):
    files, records, _ = odd
    monkeypatch.setattr(seek, "STEP_BYTES", 300)
    order = [f"{c}.log" for c in "cabdfe"]
    place = F.array_position(F.array(*map(F.lit, order)), F.substring_index("file", "/", -1))
    named = records.withColumn("file", F.substring_index("file", "/", -1))
    got = shown(seek.search_files(files.withColumn("file_ord", place), criteria, wave_bytes=wave))
    assert got == shown(Q.search(named, criteria, order))


def test_pages_of_a_search_meet(odd, monkeypatch):
    """Each match once, page by page from cursors of their own."""
    files, records, _ = odd
    monkeypatch.setattr(seek, "STEP_BYTES", 300)
    one = files.filter(F.col("file").endswith("a.log"))
    for direction in ("forward", "backward"):
        cursor, seen = 0, []
        while page := seek.search_files(one, Criteria("testing", limit=50, direction=direction, from_offset=cursor), wave_bytes=9000).collect():
            seen += [r["offset"] for r in page]
            cursor = page[-1]["end_offset" if direction == "forward" else "offset"]
        wanted = [r["offset"] for r in records.filter(F.col("file").endswith("a.log") & F.col("raw").contains("testing")).orderBy("offset").collect()]
        assert seen == (wanted if direction == "forward" else wanted[::-1])
    each = files.withColumn("cursor", F.when(F.col("file").endswith("a.log"), 6000).otherwise(0))
    found = seek.search_files(each, Criteria(limit=1000))
    assert found.filter(F.col("file").endswith("a.log")).agg(F.min("offset")).first()[0] >= 6000 and found.filter(F.col("file").endswith("c.log") & (F.col("offset") == 0)).count() == 1


def test_records_around_bytes(odd, monkeypatch):
    files, records, _ = odd
    monkeypatch.setattr(seek, "STEP_BYTES", 200)
    rng = random.Random(1)
    sizes = {r["file"]: r["size"] for r in files.collect()}
    probes = files.sparkSession.createDataFrame([(f, b, n) for f, n in sizes.items() for b in {0, max(0, n - 1), n, *(rng.randrange(n + 1) for _ in range(40))}], "file string, byte long, size long")
    key = lambda df: sorted(map(tuple, df.select("file", "byte", "offset", "end_offset").collect()), key=str)
    wanted = record_at(records, probes.select("file", "byte"))
    assert key(seek.records_near(probes)) == key(wanted)


def test_pages_read_their_lines(odd):
    files, _, lines = odd
    for cursor, limit in ((None, 20), (3220, 15)):
        own = files.withColumn("cursor", F.lit(cursor).cast("long"))
        starts = lines.groupBy("file").agg(F.coalesce(F.min(F.when(F.col("offset") >= (cursor or 0), F.col("offset"))), F.max("end_offset")).alias("cursor"))
        got = shown(paging.page_text(own, limit))
        assert sorted(got) == sorted(shown(paging.page(lines, cursor or 0, limit)))
        back = files.join(starts, "file") if cursor is not None else own
        assert sorted(shown(paging.page_text(back, limit, "previous"))) == sorted(shown(paging.page(lines, cursor, limit, "previous")))
    index = paging.line_index(lines, 512)
    for number in (0, 11, 400):
        got = paging.numbered_page(index, files, number, 20).select("file", "line_no", "offset", "raw")
        wanted = lines.filter((F.col("line_no") > 20 * number) & (F.col("line_no") <= 20 * number + 20)).select("file", "line_no", "offset", "raw")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("slice_bytes", [100, 1 << 26])
def test_bounded_lines_are_the_lines(odd, slice_bytes):
    files, _, lines = odd
    got = ranges.read_bounded(files, slice_bytes=slice_bytes, headers=True)
    assert shown_lines(got) == shown_lines(lines) and shown(fold_records(got).orderBy("file", "offset")) == shown(odd[1].orderBy("file", "offset"))


def shown_lines(df):
    return sorted(map(tuple, df.select("file", "line_no", "offset", "end_offset", "raw", "truncated", "header_line").collect()), key=str)


def test_a_byte_order_mark_and_caps(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"\xef\xbb\xbf" + b"0123456789\r\n" + b"01234567\n" + b"0123456789ab\n" + b"0123456789")
    key = lambda df: [tuple(r) for r in df.select("offset", "end_offset", "raw", "truncated").orderBy("offset").collect()]
    assert key(ranges.read_bounded(ranges.files_in(spark, str(tmp_path)), 10)) == key(read_lines(spark, str(tmp_path), 10))


def test_a_line_of_any_length_costs_its_cap():
    class Endless:
        """A line of 400 MB between two short ones."""

        at, length = 0, 400 << 20

        def seek(self, at):
            self.at = at

        def read(self, n):
            whole, a = self.length + 8, self.at
            b = min(a + n, whole)
            self.at = b
            out = bytearray(b"x" * (b - a))
            for place, byte in ((3, 10), (self.length + 4, 10)):
                if a <= place < b:
                    out[place - a] = byte
            return bytes(out)

    f = Endless()
    size = f.length + 8
    tracemalloc.start()
    found = [x for some in ranges.lines_between(f, 0, size, size, 100) for x in some]
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()
    assert [(a, b, len(x), ended) for a, b, x, ended in found] == [(0, 4, 3, True), (4, f.length + 5, 100, True), (f.length + 5, size, 3, False)]
    assert ranges.next_start(f, 10, 1 << 20) is None and ranges.next_start(f, 4, size) == 4 and ranges.next_start(f, 5, size) == f.length + 5


# time windows
def at(minute):
    return T0 + dt.timedelta(minutes=minute)


WINDOWS = [(at(10), at(30)), (at(-500), at(5)), (at(50), at(9000)), (at(-20), at(-10)), (at(900), at(910)), (None, at(30)), (at(30), None), (None, None)]


@pytest.mark.parametrize("edge", [400, 1 << 19])
def test_probed_ranges_equal_the_rule(spark, tmp_path, monkeypatch, edge):
    monkeypatch.setattr(seek, "PROBE_BYTES", 150)
    monkeypatch.setattr(seek, "EDGE_BYTES", edge)
    monkeypatch.setattr(seek, "PROBES", 4)
    skewed = [at(i + (i % 3)) for i in range(60)]  # out of order by less than the margin
    for name, text in (("a.log", timed(minutes(60), 3)[0]), ("b.log", timed(skewed)[0]), ("c.log", "\n".join(f"plain {i}" for i in range(300))), ("d.log", ""), ("e.log", timed(minutes(1))[0]), ("f.log", "x\n" * 50 + timed(minutes(60), 20)[0])):
        (tmp_path / name).write_bytes(text.encode())
    files = ranges.files_in(spark, str(tmp_path))
    records = fold_records(read_lines(spark, f"{tmp_path}/*.log", headers=True).withColumn("file", F.regexp_replace("file", "^file:/+", "/"))).cache()
    for low, high in WINDOWS if edge > 1000 else WINDOWS[:6:2]:
        key = lambda df: {r["file"][-5:]: (r["start"], r["end"]) for r in df.collect()}
        own, wanted = key(seek.time_range_files(files, low, high)), key(T.time_range(files, records, low, high))
        own_skewed, wanted_skewed = own.pop("b.log"), wanted.pop("b.log")
        assert own == wanted, (low, high)
        found = records.filter(F.col("file").endswith("b.log")).filter(Criteria(date_from=low, date_to=high).predicate()).agg(F.min("offset"), F.max("offset")).first()
        assert found[0] is None or own_skewed[0] <= found[0] and found[1] < own_skewed[1], (own_skewed, wanted_skewed)


@pytest.mark.parametrize("most", [200, 0])
def test_undated_records_are_found_with_any_number_of_ranges(spark, odd, tmp_path, monkeypatch, most):
    files, records, _ = odd
    monkeypatch.setattr(T, "MOST_PREDICATES", most)
    X.write_records(records, str(tmp_path / "kept"))
    index = T.time_index(records, 700)
    for criteria in (Criteria(date_from=at(10), date_to=at(12)), Criteria(date_from=at(5000)), Criteria("undated", date_to=at(0))):
        wanted = sorted(shown(records.filter(criteria.predicate())))
        assert wanted and sorted(shown(T.search_kept(spark, str(tmp_path / "kept"), index, files, criteria))) == wanted
        assert sorted(shown(T.search_text(spark, index, files, criteria))) == wanted
        assert sorted(shown(T.search_window(records, index, criteria, 700))) == wanted


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A log of some 50 MB, ten records a second, each tenth an error."""
    folder = tmp_path_factory.mktemp("large")
    with (folder / "big.log").open("wb") as f:
        for i in range(600_000):
            f.write(f"[{T0 + dt.timedelta(seconds=i // 10):%Y-%m-%d %H:%M:%S}] testing.{'ERROR' if i % 10 == 0 else 'INFO'}: Event number {i} {{\"i\":{i}}}\n".encode())
    return ranges.files_in(spark, str(folder))


def test_bytes_read(spark, large):
    file, size = large.first()
    meter = spark.sparkContext.accumulator(0)

    def read():
        n, meter.value = meter.value, 0
        return n

    newest = seek.search_files(large, Criteria(level="error", limit=50, direction="backward"), meter=meter).collect()
    assert [r["message"] for r in newest] == [f"Event number {599_990 - 10 * i}" for i in range(50)]
    assert read() < 6 << 20
    # the next page is read from its cursor on
    second = seek.search_files(large, Criteria(level="error", limit=50, direction="backward", from_offset=newest[-1]["offset"]), meter=meter).collect()
    assert second[0]["message"] == "Event number 599490" and read() < 6 << 20
    resumed = seek.search_files(large, Criteria("number 4", limit=20, from_offset=size * 3 // 4), meter=meter).collect()
    assert len(resumed) == 20 and read() < 6 << 20
    # files behind the budget aren't opened
    many = large.withColumn("file_ord", F.lit(1)).union(spark.createDataFrame([("/no/such/file.log", 1 << 40, 2)], "file string, size long, file_ord int"))
    assert seek.search_files(many, Criteria(limit=500), meter=meter).count() == 500 and read() < 12 << 20
    # the last hour: exactly its errors, a small part of the bytes
    last = T0 + dt.timedelta(seconds=59_999)
    hour = Criteria(level="error", date_from=last - dt.timedelta(hours=1), limit=None)
    assert seek.search_span(large, hour, meter=meter).count() == 3601 and read() < 9 << 20
    span = seek.time_range_files(large, last - dt.timedelta(minutes=2), last - dt.timedelta(minutes=1), 0, meter=meter).first()
    assert span["end"] - span["start"] < 100_000 and read() < 5 << 20
    probes = spark.createDataFrame([(file, size * i // 100, size) for i in range(100)], "file string, byte long, size long")
    assert seek.records_near(probes, meter=meter).filter("offset is null").count() == 0 and read() < 20 << 20
    assert paging.page_text(large.withColumn("cursor", F.lit(size // 2)), 200, meter=meter).count() == 200 and read() < 1 << 20
    assert ranges.read_tails(spark, file, 1000, meter=meter).count() == 1000 and read() < 1 << 20


def test_a_numbered_page_takes_its_index_once(spark, odd):
    files, _, lines = odd
    seen, index = spark.sparkContext.accumulator(0), paging.line_index(lines, 512)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = paging.numbered_page(index.mapInArrow(counted, index.schema), files, 11, 20)
    assert got.count() == lines.filter("line_no > 220 and line_no <= 240").count() and seen.value == index.count()
