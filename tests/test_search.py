import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from samples import T0, app_lines, minutes, timed
from test_records import lines
from tracewright.functions.criteria import Criteria
from tracewright.operators import count as C, search as Q, timeindex as T
from tracewright.operators.fold import fold_records
from tracewright.plans.views import files_of


def folded(spark, text):
    own = lines(spark, text)
    return own, fold_records(own).cache()


def numbers(df, order="offset"):
    return [json.loads(r["context"])["i"] for r in df.orderBy(order).collect()]


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def test_forward_limits_and_resume(spark):
    _, records = folded(spark, timed(minutes(600), 5)[0])
    seen, cursor = [], 0
    for _ in range(5):
        page = Q.search(records, Criteria(level="error", limit=25, from_offset=cursor))
        got = page.orderBy("offset").collect()
        seen += [json.loads(r["context"])["i"] for r in got]
        cursor = got[-1]["end_offset"]
    assert seen == list(range(3, 600, 5))[:125] and seen[-1] == 598 or len(seen) == 120


def test_backward_drains_once(spark):
    _, records = folded(spark, timed(minutes(300), 4)[0])
    assert [json.loads(r["context"])["i"] for r in Q.search(records, Criteria("Event number", limit=5, direction="backward")).collect()] == [299, 298, 297, 296, 295]
    seen, cursor, pages = [], 0, 0
    while True:
        got = Q.search(records, Criteria("Handler.php", limit=30, from_offset=cursor, direction="backward")).collect()
        if not got:
            break
        pages += 1
        seen += [json.loads(r["context"])["i"] for r in got]
        cursor = got[-1]["offset"]
        if cursor == 0:
            break
    assert seen == list(range(296, -1, -4)) and pages == math.ceil(75 / 30)
    window = Criteria(level="error", date_from=at(100), date_to=at(140), direction="backward")
    assert [json.loads(r["context"])["i"] for r in Q.search(records, window).collect()] == [138, 133, 128, 123, 118, 113, 108, 103]


def test_many_files_share_a_limit(spark):
    a, b = (lines(spark, app_lines(10, s)).withColumn("file", F.lit(f)) for f, s in (("a.log", 0), ("b.log", 100)))
    records = fold_records(a.unionByName(b))
    files = files_of(a.unionByName(b)).withColumn("file_ord", F.when(F.col("file") == "a.log", 1).otherwise(2))
    assert numbers(Q.search(records, Criteria(level="error", limit=3), ["a.log", "b.log"]), "file") in ([3, 8, 103], [8, 3, 103])
    status = [tuple(r)[2:6] for r in Q.search_status(files, records, Criteria(level="error", limit=3)).orderBy("file_ord").collect()]
    assert status[0][:3] == (2, True, False) and status[1][:3] == (1, False, True)
    exact = Q.search_status(files, records, Criteria(level="error", limit=2)).orderBy("file_ord").collect()
    assert (exact[0]["complete"], exact[1]["range_start"], exact[1]["truncated"]) == (False, None, True)
    back = Q.search_status(files, records, Criteria(level="error", limit=2, direction="backward")).orderBy("file_ord").collect()
    assert (back[0]["complete"], back[1]["n"], back[1]["truncated"]) == (True, 0, True)


def test_every_file_resumes_at_its_own_cursor(spark):
    own = [lines(spark, timed(minutes(60), 4)[0]).withColumn("file", F.lit(f)) for f in ("a.log", "b.log", "c.log")]
    every = own[0].unionByName(own[1]).unionByName(own[2]).cache()
    records = fold_records(every).cache()
    for backward in (False, True):
        cursors, seen = {"b.log": 0, "a.log": 0, "c.log": 0}, []
        for _ in range(20):
            names = list(cursors)
            files = files_of(every).withColumn("file_ord", F.array_position(F.array(*map(F.lit, names)), F.col("file")).cast("long")).filter("file_ord > 0")
            criteria = Criteria("Event", limit=25, direction="backward" if backward else "forward")
            got = Q.search(records, criteria, cursors).collect()
            seen += [(r["file"], json.loads(r["context"])["i"]) for r in got]
            past = Q._with_order(records, cursors, backward).drop("file_ord")
            status = {r["file"]: r for r in Q.search_status(files, past, criteria).collect()}
            assert sum(r["n"] for r in status.values()) == len(got)
            left = {f: status[f]["next_cursor"] or cursors[f] for f in names if not status[f]["complete"]}
            cursors = left
            if not cursors:
                break
        order = sorted(range(60), reverse=backward)
        assert seen == [(f, i) for f in ("b.log", "a.log", "c.log") for i in order]


def test_limits_and_repeated_names(spark):
    _, records = folded(spark, app_lines(1200))
    assert Q.search(records, Criteria("message", limit=5000)).count() == 1000 and Q.search(records, Criteria("message", limit=0)).count() == 1
    assert Q.search(records, Criteria("message", limit=None)).count() == 1000
    name = records.first()["file"]
    assert Q.search(records, Criteria("message", limit=7), [name, "none.log", name]).count() == 7
    assert Q.search(records, Criteria("message", limit=7), [f"{i}.log" for i in range(3000)] + [name]).count() == 7


def test_predicates(spark):
    _, records = folded(spark, timed(minutes(50), 5)[0])
    n = lambda **k: records.filter(Criteria(**k).predicate()).count()
    assert n(query="event NUMBER 4") == 11 and n(query="event NUMBER 4", case=True) == 0
    assert n(query="[unclosed", regex=True) == 0 and n(query=" ") == 50
    assert n(query="^#0", regex=True, scope="line") == 10 and n(query="^#0", regex=True) == 0
    assert n(date_from="garbage") == 50 and n(level="ERROR") == 10
    with pytest.raises(ValueError):
        n(query="[unclosed", regex=True, on_bad_regex="error")
    for bad in ({"direction": "up"}, {"scope": "file"}, {"on_bad_regex": "ignore"}):
        with pytest.raises(ValueError):
            Criteria(**bad)


def test_undated_records_pass_bounds(spark):
    _, records = folded(spark, ['{"message":"boom"}', '{"message":"boom 2"}', '{"message":"calm"}'])
    assert C.count_summary(records, Criteria("boom", date_from=at(0))).first().asDict() == {"total": 2, "undated": 2, "first": None, "last": None}
    assert C.count_buckets(records).count() == 0


def test_counts(spark):
    _, records = folded(spark, timed(minutes(180), 5)[0])
    hours = C.count_buckets(records, Criteria(level="error"), "hour").collect()
    assert [r["n"] for r in hours] == [12, 12, 12]
    total = C.count_summary(records, Criteria(level="error")).first()
    assert (total["total"], total["first"], total["last"]) == (36, int(at(3).timestamp()), int(at(178).timestamp()))
    assert C.bucket_map(C.count_buckets(records, Criteria("Handler.php"), "day")).first()["buckets"] == {"2026-03-01": 36}
    assert [r["n"] for r in C.count_buckets(records, Criteria("Event number", date_from=at(118), date_to=at(121)), "minute").collect()] == [1] * 4
    with pytest.raises(ValueError):
        C.count_buckets(records, Criteria(), "week")
    with pytest.raises(ValueError):
        C.count_buckets(records, Criteria(direction="backward", from_offset=5), "hour")


def test_too_many_minutes_become_hours(spark):
    _, records = folded(spark, timed(minutes(1001))[0])
    found = C.count_auto(records, Criteria(), "minute", 1000).collect()
    assert len(found) == math.ceil(1001 / 60) and {r["used"] for r in found} == {"hour"} and sum(r["n"] for r in found) == 1001
    assert {r["used"] for r in C.count_auto(records, Criteria(), "minute", 1001).collect()} == {"minute"}


def test_time_range_and_window(spark):
    text, offsets = timed(minutes(200), 5)
    own, records = folded(spark, text)
    files = files_of(own)
    edge = lambda a, b, m=0: tuple(T.time_range(files, records, a, b, m).first())[1:]
    assert edge(at(30), at(30)) == (offsets[30], offsets[31])
    assert edge(at(30) + dt.timedelta(seconds=1), None)[0] == offsets[31]
    assert edge(T0 - dt.timedelta(hours=9), T0 - dt.timedelta(hours=8)) == (0, 0)
    assert edge(at(9999), at(99999)) == (len(text), len(text))
    index = T.time_index(records, 1024)
    for criteria in (Criteria("number", date_from=at(123)), Criteria(date_to=at(77)), Criteria("Handler.php", date_from=at(41), date_to=at(97))):
        seeked = T.search_window(records, index, criteria, 1024)
        assert sorted(numbers(seeked)) == sorted(numbers(records.filter(criteria.predicate())))
    assert T.matching_blocks(index, Criteria(date_from=at(190)), 0).count() < index.count() / 5
    plain_own, plain_records = folded(spark, ["no stamp"] * 50)
    assert tuple(T.time_range(files_of(plain_own), plain_records, at(0), at(1)).first())[1:] == (0, 450)
