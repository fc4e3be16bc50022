"""Searches of text logs that read no more than they must: from a cursor, from the end, around a byte, around a time.

A file may be entered at any byte. The record that holds it begins with the last header at or before it, which is looked
for in steps that grow; the first header behind a byte ends what begins before it. So cursors are read positions, and a
search goes through files in waves of bytes whose ends are records' ends, and stops when its limit is spent.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracewright.functions.criteria import Criteria
from tracewright.functions.parsers import Parser, is_header, reading
from tracewright.functions.scalar import to_ts
from tracewright.operators.fold import MAX_CONTINUATION, RECORDS, fold_records
from tracewright.operators.timeindex import MARGIN, PROBED_BYTES
from tracewright.sources.ranges import range_lines, read_ranges
from tracewright.sources.stores import held, written

#: The first step's bytes when looking for a header, and how much each step is larger than the one before.
STEP_BYTES, STEP_GROWTH = 16 << 10, 16
#: The first wave's bytes of a search, over all files, and how much each wave is larger than the one before.
WAVE_BYTES, WAVE_GROWTH = 1 << 20, 8
#: A round of a time's bisection puts so many probes of so many bytes into what is left of a file; it ends below so many bytes.
PROBES, PROBE_BYTES, EDGE_BYTES = 16, 8 << 10, 256 << 10


def _headers_near(probes: DataFrame, parsers: Sequence[Parser] | None, behind: bool, meter: Accumulator | None, few: int | None = None) -> DataFrame:
    """Different (file, byte, size) with ``at``: the last header at or before the byte, 0 if there is none; or (``behind``) the first one at or behind it, else the size.

    ``few`` says how many probes there are, if that is known and they are a local table.
    """
    left = probes.select("file", "byte", "size").withColumns({"low": F.col("byte"), "high": F.col("byte")})
    left = held(left, "probes") if few is None else left
    done: list[DataFrame] = []
    step = STEP_BYTES
    while not left.isEmpty():
        # the next step's bytes: behind what was read, or before it (at first with the byte itself)
        if behind:
            span = left.withColumns({"start": F.col("high"), "end": F.least(F.col("high") + step, "size")})
        else:
            span = left.withColumns({"start": F.greatest(F.col("low") - step, F.lit(0)), "end": F.when(F.col("low") == F.col("byte"), F.least(F.col("byte") + 1, "size")).otherwise(F.col("low"))})
        lines = range_lines(span.select("file", F.col("byte").alias("key"), "start", "end"), meter=meter, total=few and few * (step + 1)).filter(is_header(F.col("raw"), None if parsers is None else list(parsers)))
        best = lines.groupBy("file", F.col("key").alias("byte")).agg((F.min if behind else F.max)("offset").alias("found"))
        edge = F.when(F.col("end") >= F.col("size"), F.col("size")) if behind else F.when(F.col("start") <= 0, F.lit(0).cast("long"))
        met = held(span.join(best, ["file", "byte"], "left").withColumn("at", F.coalesce("found", edge)), "headers-near")
        done.append(met.filter("at is not null").select("file", "byte", "size", "at"))
        left = met.filter("at is null").select("file", "byte", "size", F.col("start").alias("low"), F.col("end").alias("high"))
        step *= STEP_GROWTH
    return reduce(DataFrame.unionByName, done) if done else left.select("file", "byte", "size", F.col("byte").alias("at"))


def headers_before(probes: DataFrame, parsers: Sequence[Parser] | None = None, meter: Accumulator | None = None) -> DataFrame:
    """Probes (file, byte, size), each once, with ``at``, the last header that begins at or before the byte; 0 where there is none."""
    return _headers_near(probes, parsers, False, meter)


def headers_behind(probes: DataFrame, parsers: Sequence[Parser] | None = None, meter: Accumulator | None = None) -> DataFrame:
    """Probes (file, byte, size), each once, with ``at``, the first header that begins at or behind the byte; the size where there is none."""
    return _headers_near(probes, parsers, True, meter)


def records_near(probes: DataFrame, parsers: Sequence[Parser] | None = None, max_continuation: int | None = MAX_CONTINUATION, meter: Accumulator | None = None) -> DataFrame:
    """The record that holds each probe's byte (file, byte, size): the probes with offset and end_offset, null behind the file's end.

    Each probe reads its neighbourhood alone: from the last header at or before the byte to the first one behind it.
    """
    inside = probes.select("file", F.col("byte").cast("long").alias("byte"), "size").distinct()
    low = headers_before(inside.filter("byte < size"), parsers, meter).withColumnRenamed("at", "start")
    high = headers_behind(low.select("file", (F.col("byte") + 1).alias("byte"), "size"), parsers, meter).select("file", (F.col("byte") - 1).alias("byte"), F.col("at").alias("end"))
    spans = held(low.join(high, ["file", "byte"]), "neighbourhoods")
    records = fold_records(read_ranges(spans.select("file", "start", "end").distinct(), headers=True, parsers=parsers, meter=meter), parsers, max_continuation)
    # a neighbourhood is one header's records, or those above a file's first header
    own = spans.join(records.select("file", "offset", "end_offset"), "file").filter("offset >= start and offset < end and byte >= offset and byte < end_offset")
    return inside.join(own.select("file", "byte", "offset", "end_offset"), ["file", "byte"], "left").select("file", "byte", "offset", "end_offset")


def _spans(files: DataFrame, criteria: Criteria, parsers: Sequence[Parser] | None, meter: Accumulator | None) -> DataFrame:
    """Per file (file, size, file_ord, cursor): low and top, the bytes of the records it is searched for, both being records' ends or starts."""
    own = files.select("file", F.col("size").cast("long").alias("size"), F.col("file_ord").cast("long").alias("file_ord") if "file_ord" in files.columns else F.lit(0).cast("long").alias("file_ord"), F.least(F.col("cursor").cast("long") if "cursor" in files.columns else F.lit(criteria.from_offset).cast("long"), "size").alias("cursor"))
    own = held(own, "files")
    until = F.col("size") if criteria.end_offset is None else F.least(F.lit(criteria.end_offset).cast("long"), "size")
    if criteria.backward:
        until = F.when(F.col("cursor") > 0, F.least(F.col("cursor"), until)).otherwise(until)
    own = own.withColumn("until", until)
    begun = own.filter("cursor > 0") if not criteria.backward else own.limit(0)
    inner = own.filter("until > 0 and until < size")
    tops = headers_behind(inner.select("file", F.col("until").alias("byte"), "size"), parsers, meter).select("file", F.col("at").alias("top"))
    lows = headers_before(begun.select("file", F.col("cursor").alias("byte"), "size"), parsers, meter).select("file", F.col("at").alias("low"))
    own = own.join(tops, "file", "left").join(lows, "file", "left")
    return own.withColumns({"top": F.coalesce("top", "until"), "low": F.coalesce("low", F.lit(0).cast("long"))})


def _wave_end(spans: DataFrame, total: int, end: int, parsers: Sequence[Parser] | None, backward: bool, meter: Accumulator | None) -> int:
    """The record's end at or behind ``end``, counted along all files in the order of the search."""
    met = spans.filter((F.col("base") < end) & (F.col("base") + F.col("length") > end)).first() if end < total else None
    if met is None:
        return min(end, total)
    into = end - met["base"]
    byte = met["top"] - into if backward else met["low"] + into
    probe = spans.sparkSession.createDataFrame([(met["file"], byte, met["size"])], "file string, byte long, size long")
    at = _headers_near(probe, parsers, not backward, meter, few=1).first()["at"]
    return met["base"] + (met["top"] - max(at, met["low"]) if backward else min(at, met["top"]) - met["low"])


def search_files(files: DataFrame, criteria: Criteria, parsers: Sequence[Parser] | None = None, max_continuation: int | None = MAX_CONTINUATION, wave_bytes: int = WAVE_BYTES, meter: Accumulator | None = None) -> DataFrame:
    """The first matches up to the limit in text files (file, size), as ``search`` over all their records.

    Files are taken by ``file_ord`` (all alike without that column), each from its ``cursor`` on if there is one (else
    the criteria's). Bytes are read in waves, in the order of the search: forward from the cursor, backward from the end
    or the cursor. A wave that spends the limit is the last one, and files behind it aren't opened.
    """
    spans = _spans(files, criteria, parsers, meter).withColumn("length", F.greatest(F.col("top") - F.col("low"), F.lit(0).cast("long")))
    along = Window.orderBy("file_ord", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    spans = held(spans.filter("length > 0").withColumn("base", F.coalesce(F.sum("length").over(along), F.lit(0).cast("long"))), "spans")
    total = spans.agg(F.sum("length")).first()[0] or 0
    order = [F.col("file_ord"), F.col("file"), F.desc("offset") if criteria.backward else F.asc("offset")]
    found: list[DataFrame] = []
    left, at, wave = criteria.most, 0, wave_bytes
    while left > 0 and at < total:
        end = _wave_end(spans, total, at + wave, parsers, criteria.backward, meter)
        own = spans.filter((F.col("base") < end) & (F.col("base") + F.col("length") > at))
        near, far = F.greatest(F.col("base"), F.lit(at)) - F.col("base"), F.least(F.col("base") + F.col("length"), F.lit(end)) - F.col("base")
        start, stop = (F.col("top") - far, F.col("top") - near) if criteria.backward else (F.col("low") + near, F.col("low") + far)
        part = own.select("file", "file_ord", "cursor", start.alias("start"), stop.alias("end"))
        records = fold_records(read_ranges(part.select("file", "start", "end"), headers=True, parsers=parsers, meter=meter, total=end - at), parsers, max_continuation)
        matches = records.filter(criteria.predicate(cursor=False)).join(part.select("file", "file_ord", "cursor"), "file")
        if criteria.end_offset is not None:
            matches = matches.filter(F.col("offset") < criteria.end_offset)
        matches = matches.filter(((F.col("cursor") == 0) | (F.col("offset") < F.col("cursor"))) if criteria.backward else F.col("offset") >= F.col("cursor"))
        matches = matches.orderBy(*order).limit(left)
        if end < total:  # what the last wave finds needs no counting
            matches = written(matches, "matches")
            left -= matches.count()
        found.append(matches)
        at, wave = end, wave * WAVE_GROWTH
    every = reduce(DataFrame.unionByName, found) if found else None
    if every is None:
        nothing = read_ranges(spans.select("file", F.col("low").alias("start"), F.col("top").alias("end")), headers=True, parsers=parsers)
        return fold_records(nothing, parsers).select(RECORDS)
    return every.orderBy(*order).select(RECORDS)


def stamped(lines: DataFrame, parsers: Sequence[Parser] | None = None) -> DataFrame:
    """Headers among lines: key, file, offset and ``t``, their time in seconds (null where they have none)."""
    own = lines.withColumn("_parsed", reading("raw", None if parsers is None else list(parsers))).filter("_parsed is not null")
    return own.select("file", "key", "offset", F.unix_timestamp(to_ts(F.col("_parsed.datetime"))).alias("t"))


def time_range_files(files: DataFrame, date_from: dt.datetime | None, date_to: dt.datetime | None, margin: int = MARGIN, parsers: Sequence[Parser] | None = None, meter: Accumulator | None = None) -> DataFrame:
    """As ``time_range``, of text files (file, size) whose times ascend but for the margin: only probes are read.

    Each round puts probes at equal distances into what is left of every file, on both sides of the window at once, and
    keeps what lies between the last one before the time and the first one behind it; what is left at last is read whole.
    Where times are out of order by more than the margin, ``time_range`` over records has the widest range.
    """
    files = held(files.select("file", F.col("size").cast("long").alias("size")), "files")
    begin = range_lines(files.select("file", F.lit(0).cast("long").alias("start"), F.least("size", F.lit(PROBED_BYTES).cast("long")).alias("end")), meter=meter)
    dated = stamped(begin, parsers).filter("t is not null").select("file").distinct()
    edges = [(e, int(x.timestamp())) for e, x in ((0, date_from and date_from - dt.timedelta(seconds=margin)), (1, date_to and date_to + dt.timedelta(seconds=margin + 1))) if x is not None]
    if not edges:
        return files.select("file", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    sides = F.array(*(F.struct(F.lit(e).cast("long").alias("edge"), F.lit(t).cast("long").alias("goal")) for e, t in edges))
    known = held(files.join(dated, "file").select("*", F.inline(sides)).withColumns({"lo": F.lit(0).cast("long"), "hi": F.col("size"), "step": F.lit(PROBE_BYTES).cast("long")}), "edges")
    ready: list[DataFrame] = []
    while not (open_edges := known.filter(F.col("hi") - F.col("lo") > EDGE_BYTES)).isEmpty():
        ready.append(known.filter(F.col("hi") - F.col("lo") <= EDGE_BYTES))
        at = F.expr(f"transform(sequence(1, {PROBES}), i -> lo + (hi - lo) * i div {PROBES + 1})")
        probes = open_edges.select("file", "edge", "goal", "size", F.explode(at).alias("byte"), "step")
        # the probe's key says which edge it is for
        asked = probes.select("file", (F.col("byte") * 2 + F.col("edge")).alias("key"), F.col("byte").alias("start"), F.least(F.col("byte") + F.col("step"), "size").alias("end"))
        met = stamped(range_lines(asked, meter=meter), parsers).filter("t is not null").groupBy("file", "key").agg(F.min_by("t", "offset").alias("t"), F.min("offset").alias("offset"))
        # a probe is one time, so an edge has at most PROBES of them
        times = met.groupBy("file", (F.col("key") % 2).alias("edge")).agg(F.sort_array(F.collect_list(F.struct("offset", "t"))).alias("times"))
        moved = open_edges.join(times, ["file", "edge"], "left")
        moved = moved.withColumn("_high", F.expr("get(filter(times, x -> x.t >= goal), 0).offset"))
        moved = moved.withColumn("_low", F.expr("try_element_at(filter(times, x -> x.t < goal and (_high is null or x.offset < _high)), -1).offset"))
        moved = moved.withColumns({"_lo": F.greatest("lo", F.coalesce("_low", F.lit(0))), "_hi": F.least("hi", F.coalesce("_high", F.col("hi")))})
        # where no probe met a time, the next ones look further; what they cover then is all that is left
        still = (F.col("_lo") == F.col("lo")) & (F.col("_hi") == F.col("hi"))
        step = F.when(still, F.col("step") * STEP_GROWTH).otherwise(F.col("step"))
        known = held(moved.select("file", "size", "edge", "goal", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), step.alias("step")), "edges")
        spent = (F.col("step") * PROBES > F.col("hi") - F.col("lo")) & (F.col("step") > PROBE_BYTES)
        ready.append(known.filter(spent))
        known = known.filter(~spent)
    ready.append(known)
    last = held(reduce(DataFrame.unionByName, ready), "edges")
    # between the two a line further than what is known to be behind the goal
    spans = last.select("file", F.col("edge").alias("key"), F.col("lo").alias("start"), F.least(F.col("hi") + 1, "size").alias("end"))
    heads = stamped(range_lines(spans, meter=meter), parsers).withColumnRenamed("key", "edge").join(last.select("file", "edge", "goal"), ["file", "edge"])
    heads = held(heads, "edge-headers")
    reached = heads.filter("t >= goal").groupBy("file", "edge").agg(F.min("offset").alias("ge"))
    floors = heads.join(reached, ["file", "edge"], "left").filter("t < goal and offset < coalesce(ge, 9223372036854775807)").groupBy("file", "edge").agg(F.max("offset").alias("floor"))
    after = heads.join(floors, ["file", "edge"]).filter("offset > floor").groupBy("file", "edge").agg(F.min("offset").alias("after"))
    rows = last.join(reached, ["file", "edge"], "left").join(floors, ["file", "edge"], "left").join(after, ["file", "edge"], "left")
    start = F.when(F.col("floor").isNull(), 0).otherwise(F.coalesce("after", "size"))
    both = rows.groupBy("file").agg(F.max(F.when(F.col("edge") == 0, start)).alias("start"), F.max(F.when(F.col("edge") == 1, F.coalesce("ge", "size"))).alias("end"))
    out = files.join(both, "file", "left").withColumns({"end": F.coalesce("end", "size"), "start": F.coalesce("start", F.lit(0).cast("long"))})
    return out.select("file", F.least("start", "end").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def search_span(files: DataFrame, criteria: Criteria, margin: int = MARGIN, parsers: Sequence[Parser] | None = None, meter: Accumulator | None = None) -> DataFrame:
    """Matches of a time window in text files without a kept index: the window's bytes are found by probes and read alone.

    As with any search of a window's bytes, undated records outside them aren't returned.
    """
    low, high = criteria.bounds()
    ranges = time_range_files(files, low, high, margin, parsers, meter).filter("start < end")
    return fold_records(read_ranges(ranges, headers=True, parsers=parsers, meter=meter), parsers).filter(criteria.predicate())
