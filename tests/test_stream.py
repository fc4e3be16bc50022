import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from samples import minutes, timed
from test_records import lines
from tracewright.functions.criteria import Criteria
from tracewright.operators.fold import fold_records
from tracewright.streaming import follow


def drain(stream, out, state):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_appended_lines_survive_restart_and_rotation(spark, tmp_path):
    log, out, state = tmp_path / "a.log", str(tmp_path / "out"), str(tmp_path / "state")
    log.write_bytes(b"one\ntwo\npart")
    run = lambda: drain(follow.follow_lines(spark, str(log), start="begin"), out, state)
    run()
    with log.open("ab") as f:
        f.write(b"ial\nthree\n")
    run()
    run()
    read = lambda: [tuple(r) for r in spark.read.parquet(out).filter("event = 'append'").select("offset", "raw").orderBy("offset", "raw").collect()]
    assert read() == [(0, "one"), (4, "two"), (8, "partial"), (16, "three")]
    log.write_bytes(b"new\n")
    run()
    assert spark.read.parquet(out).filter("event = 'rotated'").count() == 1 and (0, "new") in read()


@pytest.mark.parametrize("slice_bytes", [64, 1 << 26])
def test_small_ticks_cut_no_line_and_reach_the_end(spark, tmp_path, slice_bytes):
    data = b"".join(b"line %d %s\r\n" % (i, b"z" * (i * 7 % 120)) for i in range(60)) + b"open end"
    (tmp_path / "in").mkdir()
    for name in ("a.log", "b.log"):
        (tmp_path / "in" / name).write_bytes(data)
    out, path = str(tmp_path / "out"), f"{tmp_path}/in/*.log"
    stream = follow.follow_lines(spark, path, start="begin", max_bytes=500, slice_bytes=slice_bytes)  # ranges are shorter than some lines
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
    assert follow.drain(writer, path) == -(-len(data) // 500) and follow.drain(writer, path) <= 1
    found = spark.read.parquet(out)
    starts = [0]
    for line in data.split(b"\n")[:-1]:
        starts.append(starts[-1] + len(line) + 1)
    wanted = [(a, b, data[a:b].decode().rstrip("\r\n")) for a, b in zip(starts, starts[1:])]
    for name in ("a.log", "b.log"):
        own = found.filter(F.col("file").endswith(name)).orderBy("offset").collect()
        assert [(r["offset"], r["end_offset"], r["raw"]) for r in own] == wanted


def test_one_run_takes_all_that_is_there(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"".join(b"line %d\n" % i for i in range(40)))
    drain(follow.follow_lines(spark, str(tmp_path / "a.log"), start="begin", slice_bytes=100), str(tmp_path / "out"), str(tmp_path / "state"))
    assert [r["raw"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("offset").collect()] == [f"line {i}" for i in range(40)]


def test_followed_lines_are_capped(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"[2026-01-01 10:00:00] a.INFO: one\n" + b"x" * 300_000 + b"\nshort\n" + b"y" * 100 + b"\n")
    stream = follow.follow_lines(spark, str(tmp_path / "a.log"), start="begin", max_line_length=100, slice_bytes=1000)
    drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("offset").collect()
    assert [(len(r["raw"]), r["truncated"]) for r in found] == [(33, False), (100, True), (5, False), (100, True)]
    assert [r["offset"] for r in found[1:]] == [r["end_offset"] for r in found[:-1]] and found[1]["end_offset"] == 300_035
    drain(follow.follow_records(stream, max_continuation=2), str(tmp_path / "records"), str(tmp_path / "records-state"))
    assert [(r["n_lines"], r["truncated"]) for r in spark.read.parquet(str(tmp_path / "records")).collect()] == [(3, True)]  # the last one is open


def test_a_batch_folds_as_line_by_line():
    rng = random.Random(1)
    for most in (2, 5):
        expected, got, held, at = [], [], None, 0
        open_record = None
        for _ in range(30):
            rows = []
            for _ in range(rng.randint(1, 9)):
                rows.append((rng.random() < 0.3, at, at + 4, f"l{at}", rng.random() < 0.1))
                at += 4
            frame = pd.DataFrame(rows, columns=["is_header", "offset", "end_offset", "raw", "truncated"])
            done, held = follow._folded_batch(frame, held, most)
            got += done
            for header, a, b, raw, cut in rows:
                if open_record and (header or len(open_record[2]) > most):
                    expected.append(open_record)
                    open_record = None
                open_record = (a, b, [raw], cut) if open_record is None else (open_record[0], b, open_record[2] + [raw], open_record[3] or cut)
        assert got == expected and held == open_record


def test_records_over_batches_equal_the_batch_fold(spark, tmp_path):
    own = lines(spark, timed(minutes(40), 3)[0]).withColumn("event", F.lit("append")).cache()
    n = own.count()
    src = str(tmp_path / "src")
    for a, b in ((0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)):
        own.filter((F.col("line_no") > a) & (F.col("line_no") <= b)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(src)
    drain(follow.follow_records(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    found = [r["raw"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("offset").collect()]
    assert found == [r["raw"] for r in fold_records(own).orderBy("offset").collect()][:-1]  # the last one is still open


@pytest.mark.parametrize("parts", [1, 5])
def test_tasks_finish_records_and_leave_edges(spark, parts):
    own = lines(spark, timed(minutes(200), 3)[0]).withColumn("event", F.lit("append"))
    total = own.count()
    ranged = own.repartitionByRange(parts, "line_no").sortWithinPartitions("line_no").cache()
    done, left = (follow.fragments(ranged, whole).orderBy("offset").collect() for whole in (True, False))
    assert sum(len(r["lines"]) for r in done + left) == total
    assert len(left) <= parts * (1 + 3) and len(done) + len(left) < total  # at most a lead of one record and an open one
    joined, held = follow._joined(((r["begins"], r["offset"], r["end_offset"], r["lines"], r["truncated"]) for r in left), None, 200)
    found = sorted([(r["offset"], "\n".join(r["lines"])) for r in done] + [(r[0], "\n".join(r[2])) for r in [*joined, held]])
    assert found == [(r["offset"], r["raw"]) for r in fold_records(own).orderBy("offset").collect()]


def test_records_of_one_tick_in_small_slices(spark, tmp_path):
    """Slices without a header, runs of continuations above the limit, headless starts, rotation: as the batch fold."""
    rng = random.Random(5)
    texts = [f"[2026-01-01 10:{i // 60 % 60:02d}:{i % 60:02d}] a.INFO: one {i}" if rng.random() < 0.25 else f"    at frame {i}" for i in range(300)]
    log = tmp_path / "a.log"
    log.write_text("".join(x + "\n" for x in texts))
    for slice_bytes in (150, 1 << 20):
        out, state = str(tmp_path / f"out{slice_bytes}"), str(tmp_path / f"state{slice_bytes}")
        drain(follow.follow_records(follow.follow_lines(spark, str(log), start="begin", slice_bytes=slice_bytes), max_continuation=3), out, state)
        found = [(r["offset"], r["n_lines"], r["raw"]) for r in spark.read.parquet(out).orderBy("offset").collect()]
        expected, at, now = [], 0, None
        for x in texts:
            if now is None or x.startswith("[") or len(now[1]) > 3:
                now = (at, [])
                expected.append(now)
            now[1].append(x)
            at += len(x) + 1
        assert found == [(a, len(x), "\n".join(x)) for a, x in expected[:-1]]


def test_rotation_ends_the_open_record(spark, tmp_path):
    log, out, state = tmp_path / "a.log", str(tmp_path / "out"), str(tmp_path / "state")
    head = "[2026-01-01 10:00:00] a.INFO: "
    for text in (f"{head}one\n  more\n{head}two\n  of the old file\n", f"  headless\n{head}new\n"):
        log.write_text(text)
        drain(follow.follow_records(follow.follow_lines(spark, str(log), start="begin", slice_bytes=30)), out, state)
    found = sorted((r["offset"], r["raw"]) for r in spark.read.parquet(out).collect())
    assert found == sorted([(0, f"{head}one\n  more"), (len(head) + 11, f"{head}two\n  of the old file"), (0, "  headless")])


def test_late_records_are_dropped(spark, tmp_path):
    src = str(tmp_path / "src")
    shape = "raw string, level string, ts timestamp, offset long"
    for stamp in ("2026-01-01 10:00:00", "2026-01-01 14:00:00", "2026-01-01 14:10:00", "2026-01-01 10:30:00", "2026-01-01 19:00:00", "2026-01-01 20:00:00"):
        spark.sql(f"select 'x' as raw, 'info' as level, timestamp'{stamp}' as ts, 1L as offset").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(src)
    drain(follow.count_stream(stream, Criteria("x")), str(tmp_path / "out"), str(tmp_path / "state"))
    found = {str(r["bucket_start"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found["2026-01-01 10:00:00"] == 1
    assert found["2026-01-01 14:00:00"] == 2
