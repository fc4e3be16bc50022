import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from samples import app_lines, json_lines, minutes, timed, with_stack_trace
from tracewright.functions import parsers as P, scalar as S
from tracewright.operators import fold, paging
from tracewright.sources import files as X
from tracewright.sources.lines import lines_from_table


def lines(spark, text, block=None):
    parts = text if isinstance(text, list) else text.removesuffix("\n").split("\n")
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(parts)], "file string, k long, text string")
    return lines_from_table(df, "file", "text", ["k"], block=None if block is None else F.floor(F.col("k") / block))


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_app_header(spark):
    p = one(spark, P.parse_app, '[2026-01-01 10:00:00] production.ERROR: Payment failed {"order_id":99}')
    assert (p["level"], p["channel"], p["message"], json.loads(p["context"])) == ("error", "production", "Payment failed", {"order_id": 99})
    assert one(spark, P.parse_app, "[2026-01-01 10:00:00] a.b.ERROR: x")["channel"] == "a.b"
    assert one(spark, P.supports_app, "[2026-01-01 10:00:00.123456+00:00] local.DEBUG: hi")
    for text in ("#0 /app/foo.php(10): bar()", "plain text line", "", "[x"):
        assert not one(spark, P.supports_app, text)


def test_json_header(spark):
    p = one(spark, P.parse_json, '{"level":"error","message":"Failed","datetime":"2026-01-01T10:00:00Z","context":{"a":1}}')
    assert (p["level"], p["message"], p["context"]) == ("error", "Failed", '{"a":1}')
    assert not one(spark, P.supports_json, "{not json}")
    assert not one(spark, P.supports_json, '{"a":1} x')
    assert one(spark, P.parse_json, '{"level":null,"severity":3}')["level"] == "3"


def test_trailing_context_keeps_what_is_no_json(spark):
    assert one(spark, P.trailing_context, "bad {x}")["message"] == "bad {x}"
    assert one(spark, P.trailing_context, "list [1, 2] ")["context"] == "[1, 2]"


def test_stack_trace_folds_to_three_records(spark):
    found = fold.fold_records(lines(spark, with_stack_trace())).orderBy("offset").collect()
    assert [r["n_lines"] for r in found] == [1, 7, 1] and len(found[1]["extra"]) == 6


@pytest.mark.parametrize("block", [None, 1, 7, 100, 201, 250])
def test_cap_and_tiling(spark, block):
    own = lines(spark, [f"plain boom line {i}" for i in range(500)], block)
    found = fold.fold_records(own).orderBy("offset").collect()
    assert [r["n_lines"] for r in found] == [201, 201, 98]
    assert found[0]["offset"] == 0 and all(a["end_offset"] == b["offset"] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("block", [1, 5, 13])
def test_fold_does_not_depend_on_blocks(spark, block):
    text, _ = timed(minutes(60), 4)
    text = "orphan 1\norphan 2\n" + text
    whole, cut = (fold.fold_records(lines(spark, text, b), max_continuation=3).orderBy("offset").toPandas() for b in (None, block))
    pd.testing.assert_frame_equal(whole.drop(columns="extra"), cut.drop(columns="extra"))


def test_no_plain(spark):
    found = fold.fold_records(lines(spark, ["x", "y", *app_lines(1), "z"]), plain_records=False).orderBy("offset").collect()
    assert [(r["parser"], r["n_lines"]) for r in found] == [(None, 1), (None, 1), ("app", 2)]


def test_record_at_and_hits(spark):
    own = lines(spark, with_stack_trace())
    records = fold.fold_records(own)
    probes = own.select("file", (F.col("end_offset") - 1).alias("byte"))
    assert sorted(map(tuple, fold.record_at(records, probes, 50).collect())) == sorted(map(tuple, fold.record_at(records, probes).collect()))
    found = fold.record_at(records, probes).collect()
    assert all(r["offset"] <= r["byte"] < r["end_offset"] for r in found) and len(found) == 9
    assert fold.line_hits_to_records(own, F.col("raw").contains("Handler")).count() == 1
    assert fold.record_at(records, spark.createDataFrame([("f", 10**6)], "file string, byte long")).first()["offset"] is None


def test_tail_and_pages(spark):
    own = lines(spark, app_lines(50))
    size = own.agg(F.max("end_offset")).first()[0]
    assert [json.loads(r["context"])["i"] for r in paging.tail(own, 10).orderBy("offset").collect()] == list(range(40, 50))
    cursor, seen = 0, []
    while cursor is not None:
        page = paging.page(own, cursor, 20).orderBy("offset").collect()
        seen.append(len(page))
        cursor = paging.page_status(own, cursor, 20).first()["next_cursor"]
    assert seen == [20, 20, 10]
    assert paging.page_lines(own, None, 3, "previous").agg(F.max("end_offset")).first()[0] == size
    assert paging.page_lines(own, 100, 20, "previous").count() < 20 == paging.page_lines(own, 100, 20, "previous", compat=True).count()
    assert paging.page_index(own, 20).count() == 3
    traced = fold.fold_records(lines(spark, with_stack_trace()))
    assert paging.tail(lines(spark, with_stack_trace()), 3).orderBy("offset").first()["parser"] == "plain" and traced.count() == 3


def test_registry(spark):
    P.register_parser("pipe", lambda c: c.startswith("|"), lambda c: P.parsed("pipe", message=F.substring(c, 2, 100)))
    P.register_pandas_parser("star", lambda c: c.startswith("*"), lambda s: pd.DataFrame({"message": s.str[1:], "level": "info"}))
    try:
        found = fold.fold_records(lines(spark, ["|a", "cont", "*b"])).orderBy("offset").collect()
        assert [(r["parser"], r["message"]) for r in found] == [("pipe", "a"), ("star", "b")]
    finally:
        P.unregister_parser("pipe")
        P.unregister_parser("star")


def test_result_json_and_records_sink(spark, tmp_path):
    records = fold.fold_records(lines(spark, json_lines(5) + ['{"message":"undated"}']))
    first = json.loads(X.to_result_json(records).orderBy("offset").first()["json"])
    assert first["parsed"]["context"] == {"i": 0} and first["parsed"]["level"] == "info" and "truncated" in first
    X.write_records(records, str(tmp_path / "r"))
    assert {r["day"] for r in spark.read.parquet(str(tmp_path / "r")).select(F.col("day").cast("string").alias("day")).collect()} == {"2026-01-01", "undated"}


def test_cursors(spark):
    df = spark.createDataFrame([(12345, 20000, 7)], "o long, s long, m long")
    own = S.cursor_encode(F.col("o"), S.fingerprint(F.col("s"), F.col("m")))
    valid = lambda s, m: S.cursor_valid(S.cursor_decode(own), s, m)
    r = df.select(S.cursor_decode(own)["offset"].alias("o"), valid(F.col("s"), F.col("m")).alias("ok"), valid(F.col("s") + 1, F.col("m")).alias("size"), valid(F.col("s"), F.col("m") + 1).alias("time"), valid(F.lit(100), F.col("m")).alias("beyond")).first()
    assert tuple(r) == (12345, True, False, False, False)
    for bad in ("!!!not-base64!!!@@", "", None):
        assert one(spark, S.cursor_decode, bad) is None
    assert one(spark, S.cursor_decode, "42")["offset"] == 42
    assert one(spark, lambda c: S.identifier_parts(S.file_identifier(F.lit("local"), c)), "/a:b.log")["path"] == "/a:b.log"


def test_scalars(spark):
    for size, shown in ((0, "0 B"), (1536, "1.5 KB"), (100, "100 B"), (1 << 20, "1 MB"), (10 << 40, "10 TB")):
        assert spark.range(1).select(S.size_human(F.lit(size)).alias("x")).first()["x"] == shown
    assert one(spark, S.to_ts, "10:00") is None and one(spark, S.to_ts, " ") is None
    assert one(spark, S.to_ts, "2026-01-01T10:00:00.9+0000").isoformat() == "2026-01-01T10:00:00"
    assert S.clamp_limit(None) == 200 and S.clamp_limit(0) == 1 and S.clamp_limit(10**6) == 5000


def test_bounds():
    import datetime as dt

    now = dt.datetime(2026, 3, 2, 15, 30, tzinfo=dt.timezone.utc)
    assert S.to_bound("today 14:00", now) == now.replace(hour=14, minute=0)
    assert S.to_bound("-24 hours", now) == now - dt.timedelta(hours=24)
    assert S.to_bound("yesterday", now).day == 1 and S.to_bound("nonsense", now) is None and S.to_bound(" ", now) is None
    assert S.to_bound("2026-01-01 10:00", now).hour == 10
