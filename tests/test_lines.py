import hashlib
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tracewright.sources import files as X, ranges
from tracewright.sources.lines import lines_from_table, lines_of, read_lines, register_source


def put(folder, name, data: bytes):
    (folder / name).write_bytes(data)
    return str(folder / name)


def rows(df):
    return [tuple(r) for r in df.orderBy("file", "offset").select("offset", "end_offset", "raw", "truncated").collect()]


@pytest.mark.parametrize("split", ["64b", "1k", "128m"])
def test_offsets_do_not_depend_on_splits(spark, tmp_path, split):
    text = "".join(f"line {i} é\r\n" if i % 3 else "\n" for i in range(400)) + "last without break"
    data = text.encode()
    path = put(tmp_path, "a.log", data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = read_lines(spark, path).orderBy("offset").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    at = 0
    for i, line in enumerate(data.split(b"\n")):
        end = min(at + len(line) + 1, len(data))
        assert (found[i]["offset"], found[i]["end_offset"], found[i]["line_no"]) == (at, end, i + 1)
        assert found[i]["raw"] == line.decode().rstrip("\r\n")
        at = end
    assert len(found) == 401 and at == len(data)


def test_small_literals(spark, tmp_path):
    assert rows(read_lines(spark, put(tmp_path, "a.log", b"alpha\nbeta\ngamma\n")))[:2] == [(0, 6, "alpha", False), (6, 11, "beta", False)]
    capped = rows(read_lines(spark, put(tmp_path, "b.log", b"x" * 100 + b"\nshort\n"), max_line_length=8))
    assert capped == [(0, 101, "x" * 8, True), (101, 107, "short", False)]
    exact = rows(read_lines(spark, put(tmp_path, "c.log", b"12345678\n12345678"), max_line_length=8))
    assert exact == [(0, 9, "12345678", True), (9, 17, "12345678", False)]
    assert rows(read_lines(spark, put(tmp_path, "d.log", b""))) == []
    marked = rows(read_lines(spark, put(tmp_path, "e.log", b"\xef\xbb\xbfone\ntwo\n")))
    assert [r[:3] for r in marked] == [(0, 7, "one"), (7, 11, "two")]


def test_lines_from_table_with_blocks(spark):
    df = spark.createDataFrame([("f", i, f"a{i}\nb{i}\r") for i in range(50)] + [("g", 1, None)], "file string, k long, text string")
    one = rows(lines_from_table(df, "file", "text", ["k"]))
    many = rows(lines_from_table(df, "file", "text", ["k"], block=F.floor(F.col("k") / 7)))
    assert one == many and one[1][2] == "b0" and one[-1] == (0, 1, "", False)


def test_list_files(spark, tmp_path):
    for name in ("a.log", "b.TXT", "c.bin", ".hidden.log", "secret.key", "sub/d.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 1536)
    found = X.list_files(spark, str(tmp_path)).collect()
    assert sorted(r["relative_path"] for r in found) == ["a.log", "b.TXT", "sub/d.log"]
    assert {r["size_human"] for r in found} == {"1.5 KB"}
    assert len(X.list_files(spark, str(tmp_path), extensions=()).collect()) == 4


def test_export_policy(spark):
    df = spark.createDataFrame([(1,), (30 << 20,), (200 << 20,)], "size long")
    assert [r["policy"] for r in X.export_policy(df).orderBy("size").collect()] == ["full", "confirm", "blocked"]
    assert [r["policy"] for r in X.export_policy(df, confirm=True).orderBy("size").collect()] == ["full", "full", "blocked"]
    assert {r["policy"] for r in X.export_policy(df, "tail").collect()} == {"tail"}


def test_export_tail_and_text_sink(spark, tmp_path):
    lines = read_lines(spark, put(tmp_path, "a.log", b"".join(b"line%d\n" % i for i in range(500))))
    assert [r["value"] for r in X.export_tail(lines, 3).orderBy("offset").collect()] == ["line497", "line498", "line499"]
    X.write_text(X.export_full(lines).withColumn("file", F.lit("a")), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "file=a")).count() == 500


def test_register_source(spark):
    register_source("numbers", lambda s, config: lines_from_table(s.range(config["n"]), F.lit("n"), F.col("id").cast("string"), ["id"]))
    assert lines_of(spark, "numbers", {"n": 3}).count() == 3
    with pytest.raises(ValueError):
        lines_of(spark, "unknown", {})


def test_short_lines_of_a_large_read_cost_a_piece_at_a_time(tmp_path):
    data = b"event 12345\n" * 400_000 + b"x" * 600_000 + b"\n\nlast"
    (tmp_path / "a.log").write_bytes(data)
    tracemalloc.start()
    with open(tmp_path / "a.log", "rb") as f:
        found, texts = 0, hashlib.sha256()
        for some in ranges.lines_between(f, 0, len(data), len(data)):
            for a, b, line, ended in some:
                assert a == found and b == a + len(line) + ended
                found = b
                texts.update(line + b"\n" * ended)
        peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == len(data) and texts.digest() == hashlib.sha256(data).digest()
    assert peak < 32 << 20
