"""Registered queries of the log library over the views, with SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracewright.functions import parsers as P, scalar as S
from tracewright.functions.criteria import Criteria
from tracewright.operators import count as C, fold, paging, search as Q, seek, timeindex as T
from tracewright.plans import views as V
from tracewright.sources import files as X, lines as L
from tracewright.sources.ranges import files_in, read_after, read_bounded, read_tails
from tracewright.sources.stores import file_system, sizes
from tracewright.streaming import follow

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SHOWN = ["file", "offset", "end_offset", "n_lines", "level", "message"]
SHOWN_SQL = 'file, "offset", end_offset, n_lines, level, message'
LOGS = [f"app-{i}.log" for i in (3, 0, 5, 1)]
TZ = dt.timezone.utc
DAY10, DAY12 = dt.datetime(2024, 1, 10, tzinfo=TZ), dt.datetime(2024, 1, 12, 6, 30, tzinfo=TZ)
WINDOW_SQL = "(ts IS NULL OR ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 06:30:00')"
ZONE_BYTES = V.ZONE_BYTES


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def over_records(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query on the event records; ``sql`` reads them as ``r``."""
    query(name, f"{V.EVENTS_SQL} {sql}")(lambda spark, sf_dir: make(V.event_records(spark, sf_dir)))


def matching(name: str, criteria: Criteria, where: str) -> None:
    """A query that returns the records matching the criteria."""
    query(name, f"{V.EVENTS_SQL} SELECT {SHOWN_SQL} FROM r WHERE {where}")(lambda spark, sf_dir: V.event_records(spark, sf_dir).filter(criteria.predicate()).select(SHOWN))


# sources and sinks
_NAME = "CASE doc_id % 4 WHEN 0 THEN 'app-' WHEN 1 THEN '.app-' WHEN 2 THEN '.env' ELSE 'key' END || CAST(doc_id AS STRING) || CASE doc_id % 7 WHEN 0 THEN '.log' WHEN 1 THEN '.TXT' WHEN 2 THEN '.key' WHEN 3 THEN '' WHEN 4 THEN '.log.gz' ELSE '.Log' END"


@query("list_files", f"WITH n AS (SELECT {_NAME} AS name, n_chars AS size FROM documents) SELECT name, size, 'logs/' || name AS relative_path FROM n WHERE regexp_matches(name, '(?i)\\.(log|txt)$') AND name NOT LIKE '.%'")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing with a file for each document would show; tests list real folders."""
    docs = V.table(spark, sf_dir, "documents").select(F.expr(_NAME).alias("name"), F.col("n_chars").alias("length"))
    listing = docs.select(F.concat(F.lit("/srv/logs/"), "name").alias("path"), F.concat(F.lit("logs/"), "name").alias("relative_path"), F.lit(0).cast("timestamp").alias("modificationTime"), "length")
    return X.select_files(listing).select("name", "size", "relative_path")


@query("list_logs", "WITH " + V.EVENT_LINES_SQL + " SELECT file AS name, CAST(max(end_offset) AS BIGINT) AS size, 'file=' || file AS folder FROM event_lines GROUP BY file")
def list_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text logs' folders and files, listed level by level."""
    found = X.list_files(spark, f"{V.event_logs(spark, sf_dir)}/logs", extensions=("txt",), dotfiles=True)
    return found.select(V.log_name(F.col("path")).alias("name"), "size", F.substring_index("relative_path", "/", 1).alias("folder"))


query("lines_from_table", V.DOCUMENT_LINES_SQL + ' SELECT file, line_no, "offset", end_offset, raw FROM d')(lambda spark, sf_dir: V.document_lines(spark, sf_dir).select("file", "line_no", "offset", "end_offset", "raw"))
query("line_offsets", "WITH " + V.EVENT_LINES_SQL + ' SELECT file, line_no, "offset", end_offset, raw FROM event_lines')(lambda spark, sf_dir: V.event_lines(spark, sf_dir).select("file", "line_no", "offset", "end_offset", "raw"))


@query("read_lines", "WITH " + V.EVENT_LINES_SQL + ' SELECT file, line_no, "offset", end_offset, raw FROM event_lines')
def read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event logs as text files, a file for each, read by their bytes."""
    lines = L.read_lines(spark, f"{V.event_logs(spark, sf_dir)}/logs/*/*.txt")
    return lines.select(V.log_name(F.col("file")).alias("file"), "line_no", "offset", "end_offset", "raw")


@query("cap_lines", "WITH " + V.EVENT_LINES_SQL + ' SELECT file, "offset", end_offset, substr(raw, 1, 60) AS raw, strlen(raw) >= 60 AS truncated FROM event_lines')
def cap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the view's own lines are shorter than its cap, so cutting them again is cutting them once
    lines = V.event_lines(spark, sf_dir).withColumnRenamed("raw", "content")
    return L.capped(lines, 60).withColumn("truncated", L.reached(60)).select("file", "offset", "end_offset", "raw", "truncated")


@query("read_range", "WITH " + V.EVENT_LINES_SQL + ', b AS (SELECT * FROM event_lines WHERE "offset" < 20000),' + V.records_sql("b", "r") + f' SELECT {SHOWN_SQL} FROM r WHERE "offset" >= 5000')
def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.read_range(V.event_lines(spark, sf_dir, headers=True), 5000, 20_000)
    return L.in_range(fold.fold_records(lines), 5000).select(SHOWN)


@query("write_records", V.EVENTS_SQL + " SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(strlen(raw)) AS BIGINT) AS bytes FROM r GROUP BY 1")
def write_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = V.scratch(spark, "records")
    X.write_records(V.event_records(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).cast("long").alias("bytes"))


@query("search_stored", V.EVENTS_SQL + f" SELECT {SHOWN_SQL} FROM r WHERE level = 'error' AND {WINDOW_SQL}")
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept by day, of which a search with bounds reads three days, and of these what the index names."""
    path, criteria = V.event_store(spark, sf_dir), Criteria(level="error", date_from=DAY10, date_to=DAY12)
    found = T.search_kept(spark, path, V.event_index(spark, sf_dir), V.event_files(spark, sf_dir), criteria)
    return found.withColumn("file", V.log_name(F.col("file"))).select(SHOWN)


over_records("to_result_json", lambda r: X.to_result_json(r).select("file", "offset", F.get_json_object("json", "$.parsed.context.k").alias("k"), F.get_json_object("json", "$.parsed.level").alias("level"), F.get_json_object("json", "$.raw").alias("raw")), "SELECT file, \"offset\", json_extract_string(context, '$.k') AS k, level, raw FROM r")
query("export_tail", "WITH " + V.EVENT_LINES_SQL + ' SELECT file, "offset", raw AS value FROM event_lines QUALIFY row_number() OVER (PARTITION BY file ORDER BY "offset" DESC) <= 50')(lambda spark, sf_dir: X.export_tail(V.event_lines(spark, sf_dir), 50))
query("export_full", V.DOCUMENT_LINES_SQL + ' SELECT file, "offset", raw AS value FROM d')(lambda spark, sf_dir: X.export_full(V.document_lines(spark, sf_dir)))
_SIZES = "SELECT doc_id, n_chars * (doc_id % 7) * 4096 AS size FROM documents"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * (F.col("doc_id") % 7) * 4096).alias("size"))


query("export_policy", f"SELECT doc_id, size, CASE WHEN size > 100 * 1048576 THEN 'blocked' WHEN size > 25 * 1048576 THEN 'confirm' ELSE 'full' END AS policy FROM ({_SIZES})")(lambda spark, sf_dir: X.export_policy(_sizes(spark, sf_dir)))
_HUMAN = """CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN regexp_replace(CAST(CAST(round(size / 1024.0, 2) AS DECIMAL(20,2)) AS STRING), '\\.?0+$', '') || ' KB' WHEN size < 1073741824 THEN regexp_replace(CAST(CAST(round(size / 1048576.0, 2) AS DECIMAL(20,2)) AS STRING), '\\.?0+$', '') || ' MB' ELSE regexp_replace(CAST(CAST(round(size / 1073741824.0, 2) AS DECIMAL(20,2)) AS STRING), '\\.?0+$', '') || ' GB' END"""
query(
    "file_info",
    f"SELECT doc_id, size, {_HUMAN} AS size_human, size <= 104857600 AS downloadable FROM ({_SIZES})",
)(lambda spark, sf_dir: X.file_info(_sizes(spark, sf_dir)))
query("size_human", f"SELECT doc_id, {_HUMAN} AS size_human FROM ({_SIZES})")(lambda spark, sf_dir: _sizes(spark, sf_dir).select("doc_id", S.size_human(F.col("size")).alias("size_human")))

# lines to records
query("parse_app", V.EVENTS_SQL + f" SELECT file, \"offset\", 'app' AS parser, lower(regexp_extract(raw, '{V.HEADER_SQL}', 3)) AS level, regexp_extract(raw, '{V.HEADER_SQL}', 1) AS datetime, regexp_extract(raw, '{V.HEADER_SQL}', 2) AS channel FROM event_lines WHERE regexp_matches(raw, '{V.HEADER_SQL}')")(
    lambda spark, sf_dir: V.event_lines(spark, sf_dir).filter(P.supports_app(F.col("raw"))).withColumn("p", P.parse_app(F.col("raw"))).select("file", "offset", "p.parser", "p.level", "p.datetime", "p.channel")
)
_MESSAGES = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'paid ' || props || '  ' WHEN 1 THEN 'broken {{' || props WHEN 2 THEN 'list [1, 2]' ELSE 'text only' END AS text FROM events".replace("{{", "{")
query("trailing_context", f"WITH m AS ({_MESSAGES}), c AS (SELECT *, regexp_extract(rtrim(text), '(?s)[{{\\[].*$') AS cand FROM m) SELECT event_id, CASE WHEN cand <> '' AND json_valid(cand) THEN rtrim(substr(rtrim(text), 1, length(rtrim(text)) - length(cand))) ELSE text END AS message, CASE WHEN cand <> '' AND json_valid(cand) THEN cand END AS context FROM c")(
    lambda spark, sf_dir: spark.sql(_MESSAGES.replace("FROM events", "FROM {e}").replace("'broken {'", "'broken ' || chr(123)"), e=V.table(spark, sf_dir, "events")).withColumn("c", P.trailing_context(F.col("text"))).select("event_id", "c.message", "c.context")
)
_EXPECTED_JSON = """SELECT "offset", CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'info' WHEN 2 THEN 'notice' ELSE '400' END AS level,
  coalesce(json_extract_string(raw, '$.datetime'), json_extract_string(raw, '$.time'), json_extract_string(raw, '$.timestamp'), json_extract_string(raw, '$."@timestamp"')) AS datetime,
  CASE event_id % 4 WHEN 0 THEN 'app' WHEN 1 THEN 'web' END AS channel,
  CASE event_id % 4 WHEN 2 THEN CAST(event_id AS STRING) WHEN 3 THEN 'null' ELSE 'event ' || event_id END AS message,
  CASE event_id % 4 WHEN 0 THEN '{"i":' || event_id || '}' WHEN 2 THEN '{"value":"s"}' ELSE '{"user":' || json_extract_string(raw, '$.user') || '}' END AS context FROM jl"""
query("parse_json", f"{V.JSON_SQL} {_EXPECTED_JSON}")(lambda spark, sf_dir: V.json_lines(spark, sf_dir).filter(P.supports_json(F.col("raw"))).withColumn("p", P.parse_json(F.col("raw"))).select("offset", "p.level", "p.datetime", "p.channel", "p.message", "p.context"))
query("classify_lines", V.MIXED_SQL + " SELECT CASE event_id % 3 WHEN 0 THEN 'app' ELSE 'json' END AS parser, count(*) AS n, count(*) FILTER (event_id % 3 = 2) AS undated FROM ml GROUP BY 1")(
    lambda spark, sf_dir: fold.classify_lines(V.mixed_lines(spark, sf_dir)).groupBy("parsed.parser").agg(F.count("*").alias("n"), F.count_if(F.col("parsed.datetime").isNull()).alias("undated"))
)
RECORD_COLUMNS = ["file", "offset", "end_offset", "raw", "n_lines", "parser", "level", "datetime", "channel", "message", "context"]
over_records("fold_records", lambda r: r.select(RECORD_COLUMNS), 'SELECT file, "offset", end_offset, raw, n_lines, parser, level, datetime, channel, message, context FROM r')
_CAPPED = V.DOCUMENT_LINES_SQL + ' SELECT file, CAST(min("offset") AS BIGINT) AS "offset", CAST(max(end_offset) AS BIGINT) AS end_offset, CAST(count(*) AS INTEGER) AS n_lines, \'plain\' AS parser, min_by(raw, line_no) AS message, md5(string_agg(raw, chr(10) ORDER BY line_no)) AS digest FROM d GROUP BY file, (line_no - 1) // 21'
query("fold_cap", _CAPPED)(lambda spark, sf_dir: fold.fold_records(V.document_lines(spark, sf_dir, headers=True), max_continuation=20).select("file", "offset", "end_offset", "n_lines", "parser", "message", F.md5("raw").alias("digest")))
query("fold_no_plain", V.DOCUMENT_LINES_SQL + ' SELECT file, "offset", end_offset, CAST(1 AS INTEGER) AS n_lines, CAST(NULL AS STRING) AS parser FROM d')(lambda spark, sf_dir: fold.fold_records(V.document_lines(spark, sf_dir, headers=True), plain_records=False).select("file", "offset", "end_offset", "n_lines", "parser"))


@query("record_at", V.EVENTS_SQL + ', p AS (SELECT file, "offset" + 7 AS byte FROM event_lines) SELECT p.file, CAST(p.byte AS BIGINT) AS byte, CASE WHEN p.byte < r.end_offset THEN r."offset" END AS "offset", CASE WHEN p.byte < r.end_offset THEN r.end_offset END AS end_offset FROM p ASOF LEFT JOIN r ON p.file = r.file AND p.byte >= r."offset"')
def record_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = V.event_lines(spark, sf_dir, headers=True)
    return fold.record_at(fold.record_bounds(lines), lines.select("file", (F.col("offset") + 7).alias("byte")), ZONE_BYTES)


query("line_hits_to_records", V.EVENTS_SQL + f" SELECT {SHOWN_SQL} FROM r WHERE raw LIKE '%Handler.php%'")(lambda spark, sf_dir: fold.line_hits_to_records(V.event_lines(spark, sf_dir, headers=True), F.col("raw").contains("Handler.php")).select(SHOWN))

# predicates
matching("match_literal", Criteria("USER=1"), "contains(lower(raw), 'user=1')")
matching("match_literal_case", Criteria("handle(9", case=True), "contains(raw, 'handle(9')")
matching("match_regex", Criteria(r"ERROR: .*cents=\d*7 ", regex=True), r"regexp_matches(raw, '(?i)ERROR: .*cents=\d*7 ')")
matching("match_regex_case", Criteria(r"^\[.*WARNING: purchase user=\d+5 ", regex=True, case=True), r"regexp_matches(raw, '^\[.*WARNING: purchase user=\d+5 ')")
matching("match_regex_invalid", Criteria("HANDLE(9", regex=True), "contains(lower(raw), 'handle(9')")
matching("match_any_line", Criteria(r"^#2 .*handle\(\d*5", regex=True, scope="line"), r"regexp_matches(raw, '(?im)^#2 .*handle\(\d*5')")
matching("no_text_query", Criteria("  "), "true")
matching("filter_level", Criteria(level="Error"), "level = 'error'")
matching("filter_time", Criteria(date_from=DAY10, date_to=DAY12), WINDOW_SQL)
matching("filter_cursor", Criteria(from_offset=3000, end_offset=9000), '"offset" >= 3000 AND "offset" < 9000')
matching("filter_cursor_backward", Criteria(from_offset=9000, direction="backward"), '"offset" < 9000')

# search
over_records("search_forward", lambda r: Q.search(r, Criteria("click", limit=25), ["app-2.log"]).select(SHOWN), f"SELECT {SHOWN_SQL} FROM r WHERE file = 'app-2.log' AND contains(lower(raw), 'click') ORDER BY \"offset\" LIMIT 25")
over_records("search_backward", lambda r: Q.search(r, Criteria(level="error", limit=25, direction="backward"), ["app-2.log"]).select(SHOWN), f"SELECT {SHOWN_SQL} FROM r WHERE file = 'app-2.log' AND level = 'error' ORDER BY \"offset\" DESC LIMIT 25")
over_records("search_resume", lambda r: Q.search(r, Criteria("click", limit=10, from_offset=4000), ["app-2.log"]).select(SHOWN), f"SELECT {SHOWN_SQL} FROM r WHERE file = 'app-2.log' AND contains(lower(raw), 'click') AND \"offset\" >= 4000 ORDER BY \"offset\" LIMIT 10")
_ORDER = "list_position(['app-3.log', 'app-0.log', 'app-5.log', 'app-1.log'], file)"
over_records("search_many", lambda r: Q.search(r, Criteria(level="error", limit=300), LOGS).select(SHOWN), f"SELECT {SHOWN_SQL} FROM r WHERE level = 'error' AND {_ORDER} > 0 ORDER BY {_ORDER}, \"offset\" LIMIT 300")
over_records("newest_per_file", lambda r: Q.newest_per_file(r, Criteria("Handler.php"), 7).select(*SHOWN, F.col("place").cast("long").alias("place")), f"SELECT {SHOWN_SQL}, row_number() OVER (PARTITION BY file ORDER BY \"offset\" DESC) AS place FROM r WHERE contains(lower(raw), 'handler.php') QUALIFY place <= 7")


def _requested(lines: DataFrame) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, LOGS)), F.col("file"))
    return V.files_of(lines).withColumn("file_ord", at.cast("long")).filter("file_ord > 0")


def _status(criteria: Criteria) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.search_status(_requested(V.event_lines(spark, sf_dir)), V.event_records(spark, sf_dir), criteria)

    return run


def _status_sql(limit: int, backward: bool) -> str:
    hit = f"before < {limit} AND before + cnt {'>' if backward else '>='} {limit}"
    side, way = ('"offset"', "DESC") if backward else ("end_offset", "ASC")
    low = "0" if backward else "least(size, 0)"
    return f"""{V.EVENTS_SQL}, f AS (SELECT file, max(end_offset) AS size, {_ORDER} AS file_ord FROM event_lines GROUP BY file HAVING {_ORDER} > 0),
c AS (SELECT f.*, (SELECT count(*) FROM r WHERE r.file = f.file AND level = 'error') AS cnt FROM f),
b AS (SELECT *, coalesce(sum(cnt) OVER (ORDER BY file_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
m AS (SELECT file, {side} AS stop, row_number() OVER (PARTITION BY file ORDER BY "offset" {way}) AS place FROM r WHERE level = 'error')
SELECT file, CAST(file_ord AS BIGINT) AS file_ord, CAST(CASE WHEN before < {limit} THEN least(cnt, {limit} - before) ELSE 0 END AS BIGINT) AS n, before < {limit} AND NOT ({hit}) AS complete,
  before >= {limit} OR ({hit}) AS truncated,
  CAST(CASE WHEN before >= {limit} THEN 0 WHEN {hit} THEN (SELECT stop FROM m WHERE m.file = b.file AND m.place = {limit} - b.before) END AS BIGINT) AS next_cursor,
  CAST(CASE WHEN before < {limit} THEN {low} END AS BIGINT) AS range_start, CAST(CASE WHEN before < {limit} THEN size END AS BIGINT) AS range_end FROM b"""


query("search_status", _status_sql(300, False))(_status(Criteria(level="error", limit=300)))
query("search_status_backward", _status_sql(300, True))(_status(Criteria(level="error", limit=300, direction="backward")))


@query("attribute_files", V.EVENTS_SQL + ', f AS (SELECT file, max(end_offset) AS size FROM event_lines GROUP BY file) SELECT f.file, f.size, m."offset", m.message FROM f LEFT JOIN (SELECT * FROM r WHERE contains(raw, \'user=11 \')) m ON f.file = m.file')
def attribute_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.attribute_files(V.files_of(V.event_lines(spark, sf_dir)), V.event_records(spark, sf_dir).filter(Criteria("user=11 ", case=True).predicate()).select("file", "offset", "message"))


# counts
for _bucket, _format in (("minute", "%Y-%m-%d %H:%M"), ("hour", "%Y-%m-%d %H:00"), ("day", "%Y-%m-%d")):
    over_records(f"count_buckets_{_bucket}", lambda r, b=_bucket: C.count_buckets(r, Criteria("user="), b), f"SELECT strftime(ts, '{_format}') AS bucket, count(*) AS n FROM r GROUP BY 1")
over_records("count_summary", lambda r: C.count_summary(r, Criteria(level="error")), "SELECT count(*) AS total, count(*) FILTER (ts IS NULL) AS undated, CAST(min(epoch(ts)) AS BIGINT) AS \"first\", CAST(max(epoch(ts)) AS BIGINT) AS \"last\" FROM r WHERE level = 'error'")
query("count_mixed", V.MIXED_SQL + f" SELECT count(*) AS total, count(*) FILTER (event_id % 3 = 2) AS undated FROM ml")(lambda spark, sf_dir: C.count_summary(fold.fold_records(V.mixed_lines(spark, sf_dir, headers=True))).select("total", "undated"))
_FINE = "(SELECT count(DISTINCT strftime(ts, '%Y-%m-%d %H:%M')) FROM r) <= 5000"
over_records("count_auto", lambda r: C.count_auto(r, Criteria(), "minute", 5000), f"SELECT CASE WHEN {_FINE} THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE strftime(ts, '%Y-%m-%d %H:00') END AS bucket, CAST(count(*) AS BIGINT) AS n, CASE WHEN {_FINE} THEN 'minute' ELSE 'hour' END AS used FROM r GROUP BY 1")
over_records("bucket_map", lambda r: C.bucket_map(C.count_buckets(r, Criteria(), "day")).select(F.to_json("buckets").alias("buckets")), "SELECT '{' || string_agg('\"' || day || '\":' || n, ',' ORDER BY day) || '}' AS buckets FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM r GROUP BY 1)")


@query("count_per_file", V.EVENTS_SQL + " SELECT file, (SELECT count(*) FROM r WHERE r.file = e.file AND level = 'error' AND \"offset\" < 3000) AS total, CAST(0 AS BIGINT) AS range_start, CAST(least(max(end_offset), 3000) AS BIGINT) AS range_end FROM event_lines e GROUP BY file")
def count_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.count_per_file(V.files_of(V.event_lines(spark, sf_dir)), V.event_records(spark, sf_dir), Criteria(level="error", end_offset=3000))


# tails and pages
def _batch_sql(lines: str) -> str:
    return "WITH " + V.EVENT_LINES_SQL + f", b AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY \"offset\") AS line_no, \"offset\", end_offset, raw FROM ({lines}))," + V.records_sql("b", "r", 10**6) + f" SELECT {SHOWN_SQL} FROM r"


_RANKED = 'SELECT * FROM event_lines {0} QUALIFY row_number() OVER (PARTITION BY file ORDER BY "offset" {1}) <= {2}'
query("tail", _batch_sql(_RANKED.format("", "DESC", 40)))(lambda spark, sf_dir: paging.tail(V.event_lines(spark, sf_dir, headers=True), 40).select(SHOWN))
query("tail_conversations", "WITH t AS (SELECT 'conv-' || conv_id AS file, conv_id, turn, role || ': ' || text AS body FROM conversations), s AS (SELECT file, turn, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS seq FROM t), o AS (SELECT file, CAST(sum(strlen(raw) + 1) OVER w AS BIGINT) AS end_offset, CAST(sum(strlen(raw) + 1) OVER w - strlen(raw) - 1 AS BIGINT) AS \"offset\" FROM s WINDOW w AS (PARTITION BY file ORDER BY turn, seq)), l AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY file ORDER BY \"offset\" DESC) <= 5) SELECT file, max(end_offset) AS next_cursor, CASE WHEN min(\"offset\") > 0 THEN min(\"offset\") END AS previous_cursor, count(*) AS count FROM l GROUP BY file")(
    lambda spark, sf_dir: paging.tail_status(V.conversation_lines(spark, sf_dir), 5)
)
query("page_forward", _batch_sql(_RANKED.format('WHERE "offset" >= 2500', "ASC", 30)))(lambda spark, sf_dir: paging.page(V.event_lines(spark, sf_dir, headers=True), 2500, 30).select(SHOWN))
query("page_previous", _batch_sql(_RANKED.format('WHERE "offset" < 1500', "DESC", 30)))(lambda spark, sf_dir: paging.page(V.event_lines(spark, sf_dir, headers=True), 1500, 30, "previous").select(SHOWN))
query("page_previous_compat", _batch_sql(_RANKED.format("", "ASC", 60)))(lambda spark, sf_dir: paging.page(V.event_lines(spark, sf_dir), 1500, 60, "previous", compat=True).select(SHOWN))
query("page_status", "WITH " + V.EVENT_LINES_SQL + ", p AS (" + _RANKED.format('WHERE "offset" >= 2500', "ASC", 30) + '), z AS (SELECT file, max(end_offset) AS file_size FROM event_lines GROUP BY file) SELECT z.file, CASE WHEN max(p.end_offset) < file_size THEN max(p.end_offset) END AS next_cursor, CASE WHEN min(p."offset") > 0 THEN min(p."offset") END AS previous_cursor, file_size, coalesce(min(p."offset") = 0, false) AS reached_start, coalesce(max(p.end_offset) >= file_size, true) AS reached_end, count(p.file) AS count FROM z LEFT JOIN p ON z.file = p.file GROUP BY z.file, file_size')(lambda spark, sf_dir: paging.page_status(V.event_lines(spark, sf_dir), 2500, 30))
query("page_index", "WITH " + V.EVENT_LINES_SQL + ' SELECT file, (line_no - 1) // 200 AS page, min("offset") AS start, max(end_offset) AS "end", count(*) AS lines FROM event_lines GROUP BY 1, 2')(lambda spark, sf_dir: paging.page_index(V.event_lines(spark, sf_dir), 200))


# time index
@query("time_range", V.EVENTS_SQL + """, h AS (SELECT file, "offset", epoch(ts) AS t FROM r WHERE parser = 'app'),
k AS (SELECT file, max(end_offset) AS size FROM event_lines GROUP BY file),
a AS (SELECT k.file, size, (SELECT min("offset") FROM h WHERE h.file = k.file AND t >= epoch(TIMESTAMP '2024-01-10 00:00:00') - 300) AS ge, (SELECT max("offset") FROM h WHERE h.file = k.file AND t <= epoch(TIMESTAMP '2024-01-12 06:30:00') + 300) AS le FROM k),
f AS (SELECT a.*, (SELECT max("offset") FROM h WHERE h.file = a.file AND t < epoch(TIMESTAMP '2024-01-10 00:00:00') - 300 AND "offset" < coalesce(a.ge, 9e18)) AS low FROM a)
SELECT file, CAST(CASE WHEN low IS NULL THEN 0 ELSE coalesce((SELECT min("offset") FROM h WHERE h.file = f.file AND "offset" > f.low), size) END AS BIGINT) AS start,
  CAST(coalesce((SELECT min("offset") FROM h WHERE h.file = f.file AND t > epoch(TIMESTAMP '2024-01-12 06:30:00') + 300 AND "offset" > coalesce(f.le, -1)), size) AS BIGINT) AS "end" FROM f""")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.time_range(V.files_of(V.event_lines(spark, sf_dir)), V.event_records(spark, sf_dir), DAY10, DAY12)


over_records("time_index", lambda r: T.time_index(r, ZONE_BYTES).select("file", "block", F.unix_timestamp("min_ts").alias("min_t"), F.unix_timestamp("max_ts").alias("max_t"), "headers", "undated", "first_header", "last_header"), f"SELECT file, \"offset\" // {ZONE_BYTES} AS block, CAST(min(epoch(ts)) AS BIGINT) AS min_t, CAST(max(epoch(ts)) AS BIGINT) AS max_t, count(*) AS headers, count(*) FILTER (ts IS NULL) AS undated, min(\"offset\") AS first_header, max(\"offset\") AS last_header FROM r WHERE parser = 'app' GROUP BY 1, 2")
_IN_WINDOW = Criteria("Handler.php", date_from=DAY10, date_to=DAY12)
_IN_WINDOW_SQL = f"{V.EVENTS_SQL} SELECT {SHOWN_SQL} FROM r WHERE contains(lower(raw), 'handler.php') AND {WINDOW_SQL}"
query("search_blocks", _IN_WINDOW_SQL)(lambda spark, sf_dir: T.search_window(V.event_records(spark, sf_dir), V.lines_index(spark, sf_dir), _IN_WINDOW, ZONE_BYTES).select(SHOWN))


@query("search_window", _IN_WINDOW_SQL)
def search_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text logs and their kept index, of which the search reads the byte ranges that the window needs."""
    found = T.search_text(spark, V.event_index(spark, sf_dir), V.event_files(spark, sf_dir), _IN_WINDOW)
    return found.withColumn("file", V.log_name(F.col("file"))).select(SHOWN)


@query("tail_files", _batch_sql(_RANKED.format("", "DESC", 40)))
def tail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text logs' last lines, read from their ends."""
    lines = read_tails(spark, [f"{V.event_logs(spark, sf_dir)}/logs/file=app-{i}.log/*.txt" for i in range(8)], 40)
    return paging.fold_batch(lines).withColumn("file", V.log_name(F.col("file"))).select(SHOWN)


# the same over text logs, of which no more is read than the answer needs
def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text logs: file, size, and the log's name."""
    return files_in(spark, [f"{V.event_logs(spark, sf_dir)}/logs/file=app-{i}.log/*.txt" for i in range(8)]).withColumn("log", V.log_name(F.col("file")))


def _cursors(files: DataFrame, byte: int) -> DataFrame:
    """The logs with the start of the first line at or behind a byte as cursor, a line's place as pages give it."""
    return files.join(read_after(files.withColumn("cursor", F.lit(byte).cast("long")), 1).select("file", F.col("offset").alias("cursor")), "file")


def _shown(records: DataFrame) -> DataFrame:
    return records.withColumn("file", V.log_name(F.col("file"))).select(SHOWN)


def over_logs(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query on the text logs; ``sql`` reads their records as ``r``."""
    query(name, f"{V.EVENTS_SQL} {sql}")(lambda spark, sf_dir: _shown(make(_logs(spark, sf_dir))))


over_logs("search_forward_text", lambda f: seek.search_files(f.filter("log = 'app-2.log'"), Criteria("click", limit=25)), f"SELECT {SHOWN_SQL} FROM r WHERE file = 'app-2.log' AND contains(lower(raw), 'click') ORDER BY \"offset\" LIMIT 25")
over_logs("search_backward_text", lambda f: seek.search_files(f.filter("log = 'app-2.log'"), Criteria(level="error", limit=25, direction="backward")), f"SELECT {SHOWN_SQL} FROM r WHERE file = 'app-2.log' AND level = 'error' ORDER BY \"offset\" DESC LIMIT 25")
over_logs("search_resume_text", lambda f: seek.search_files(f.filter("log = 'app-2.log'"), Criteria("click", limit=10, from_offset=4000)), f"SELECT {SHOWN_SQL} FROM r WHERE file = 'app-2.log' AND contains(lower(raw), 'click') AND \"offset\" >= 4000 ORDER BY \"offset\" LIMIT 10")
over_logs("search_many_text", lambda f: seek.search_files(f.withColumn("file_ord", F.array_position(F.array(*map(F.lit, LOGS)), F.col("log"))).filter("file_ord > 0"), Criteria(level="error", limit=300)), f"SELECT {SHOWN_SQL} FROM r WHERE level = 'error' AND {_ORDER} > 0 ORDER BY {_ORDER}, \"offset\" LIMIT 300")
over_logs("search_span", lambda f: seek.search_span(f, _IN_WINDOW), f"SELECT {SHOWN_SQL} FROM r WHERE contains(lower(raw), 'handler.php') AND {WINDOW_SQL}")
query("time_range_text", ORACLES["time_range"])(lambda spark, sf_dir: seek.time_range_files(_logs(spark, sf_dir), DAY10, DAY12).select(V.log_name(F.col("file")).alias("file"), "start", "end"))
query("page_forward_text", ORACLES["page_forward"])(lambda spark, sf_dir: _shown(paging.page_text(_logs(spark, sf_dir).withColumn("cursor", F.lit(2500).cast("long")), 30)))
query("page_previous_text", _batch_sql(_RANKED.format("WHERE end_offset <= (SELECT min(e.\"offset\") FROM event_lines e WHERE e.\"offset\" >= 1500 AND e.file = event_lines.file)", "DESC", 30)))(lambda spark, sf_dir: _shown(paging.page_text(_cursors(_logs(spark, sf_dir), 1500), 30, "previous")))
query("numbered_page", "WITH " + V.EVENT_LINES_SQL + ' SELECT file, line_no, "offset", raw FROM event_lines WHERE line_no > 120 AND line_no <= 160')(lambda spark, sf_dir: paging.numbered_page(paging.line_index(L.read_lines(spark, f"{V.event_logs(spark, sf_dir)}/logs/*/*.txt").withColumn("file", F.regexp_replace("file", "^file:/+", "/")), ZONE_BYTES), _logs(spark, sf_dir), 3, 40).select(V.log_name(F.col("file")).alias("file"), "line_no", "offset", "raw"))
query("read_bounded", "WITH " + V.EVENT_LINES_SQL + ' SELECT file, line_no, "offset", end_offset, raw FROM event_lines')(lambda spark, sf_dir: read_bounded(_logs(spark, sf_dir), slice_bytes=100_000).select(V.log_name(F.col("file")).alias("file"), "line_no", "offset", "end_offset", "raw"))


@query("record_near", V.EVENTS_SQL + """, p AS (SELECT file, CAST(max(end_offset) * k // 7 AS BIGINT) AS byte FROM event_lines, range(1, 7) t(k) GROUP BY file, k)
SELECT p.file, p.byte, r."offset", r.end_offset FROM p JOIN r ON p.file = r.file AND p.byte >= r."offset" AND p.byte < r.end_offset""")
def record_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records at six bytes of every log, of which their neighbourhoods alone are read."""
    probes = _logs(spark, sf_dir).select("file", "size", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("k")).withColumn("byte", F.expr("size * k div 7"))
    return seek.records_near(probes).withColumn("file", V.log_name(F.col("file")))


# scalar functions
_STAMPS = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(ts AS STRING) WHEN 1 THEN ' ' || replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z' WHEN 2 THEN substring(CAST(ts AS STRING), 1, 10) WHEN 3 THEN '10:00' ELSE 'no date' END AS text FROM {e}"
query("to_ts", "SELECT event_id, CASE WHEN event_id % 5 < 2 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN event_id % 5 = 2 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) END AS t FROM events")(lambda spark, sf_dir: spark.sql(_STAMPS, e=V.table(spark, sf_dir, "events")).select("event_id", F.unix_timestamp(S.to_ts(F.col("text"))).alias("t")))
query("rstrip_eol", "SELECT event_id, rtrim(event_type || repeat(chr(13), CAST(event_id % 3 AS INTEGER)) || repeat(chr(10), CAST(event_id % 2 AS INTEGER)), chr(13) || chr(10)) AS text FROM events")(
    lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", S.rstrip_eol(F.expr("event_type || repeat(chr(13), cast(event_id % 3 as int)) || repeat(chr(10), cast(event_id % 2 as int))")).alias("text"))
)
query("cap_bytes", "SELECT event_id, substr(props, 1, 8) AS text, strlen(props) > 8 AS cut FROM events")(lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", *(c.alias(n) for c, n in zip(S.cap_bytes(F.col("props"), 8), ("text", "cut")))))
_TEXTS = "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props || ' x' WHEN 2 THEN '[1, 2' WHEN 3 THEN '\"text\"' ELSE '' END"
query("is_json", f"SELECT event_id, json_valid({_TEXTS}) AND {_TEXTS} <> '' AS ok FROM events")(lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", S.is_json(F.expr(_TEXTS)).alias("ok")))
query("fingerprint", "SELECT event_id, substr(sha256(event_id || ':' || user_id), 1, 8) AS mark FROM events")(lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", S.fingerprint(F.col("event_id"), F.col("user_id")).alias("mark")))
_CURSOR = "rtrim(translate(to_base64(encode({0})), '+/', '-_'), '=')"
_CURSOR_TEXT = "event_id || '.' || substr(sha256(event_id || ':' || user_id), 1, 8)"
query("cursor_encode", f"SELECT event_id, {_CURSOR.format(_CURSOR_TEXT)} AS cursor FROM events")(lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", S.cursor_encode(F.col("event_id"), S.fingerprint(F.col("event_id"), F.col("user_id"))).alias("cursor")))
query("cursor_decode", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id END AS \"offset\", CASE WHEN event_id % 3 = 0 THEN substr(sha256(event_id || ':' || user_id), 1, 8) END AS fingerprint FROM events")(
    lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", S.cursor_decode(F.when(F.col("event_id") % 3 == 0, S.cursor_encode(F.col("event_id"), S.fingerprint(F.col("event_id"), F.col("user_id")))).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise("!!!not-base64!!!@@")).alias("c")).select("event_id", "c.offset", "c.fingerprint")
)
query("cursor_valid", "SELECT event_id, event_id <= 5000 AND event_id % 2 = 0 AS valid FROM events")(
    lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", S.cursor_valid(F.struct(F.col("event_id").alias("offset"), F.when(F.col("event_id") % 4 > 0, S.fingerprint(F.lit(5000), F.col("event_id") % 2)).alias("fingerprint")), F.lit(5000), F.lit(0)).alias("valid")).withColumn("valid", F.col("valid") & (F.col("event_id") % 2 == 0))
)
query("file_identifier", f"SELECT page_id, {_CURSOR.format(chr(39) + 'local:' + chr(39) + ' || url')} AS identifier, url AS path FROM pages WHERE url IS NOT NULL")(
    lambda spark, sf_dir: V.table(spark, sf_dir, "pages").filter("url is not null").select("page_id", S.file_identifier(F.lit("local"), F.col("url")).alias("identifier")).withColumn("path", S.identifier_parts(F.col("identifier"))["path"])
)
query("bucket_label", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, strftime(ts, '%Y-%m-%d %H:00') AS hour, strftime(ts, '%Y-%m-%d') AS day FROM events")(
    lambda spark, sf_dir: V.table(spark, sf_dir, "events").withColumn("minute", S.bucket_label(F.col("ts").cast("timestamp"), "minute")).select("event_id", "minute", S.coarsen_label(F.col("minute"), "hour").alias("hour"), S.coarsen_label(F.col("minute"), "day").alias("day"))
)
query("coarsen_label", "SELECT strftime(ts, '%Y-%m-%d %H:00') AS hour, count(DISTINCT strftime(ts, '%Y-%m-%d %H:%M')) AS minutes FROM events GROUP BY 1")(
    lambda spark, sf_dir: V.table(spark, sf_dir, "events").select(S.bucket_label(F.col("ts").cast("timestamp"), "minute").alias("minute")).distinct().groupBy(S.coarsen_label(F.col("minute"), "hour").alias("hour")).agg(F.count("*").alias("minutes"))
)

# formats that are added through the registry
_ACCESS = "'10.0.0.' || CAST(user_id % 250 AS STRING) || ' - user' || CAST(user_id AS STRING) || ' [' || {0} || ' +0000] \"GET /' || event_type || ' HTTP/1.1\" ' || CASE event_type WHEN 'error' THEN '500' WHEN 'view' THEN '404' ELSE '200' END || ' ' || CAST(event_id AS STRING)"
query("parse_access", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS level, substring(CAST(ts AS STRING), 1, 19) AS datetime, 'user' || user_id AS channel, 'GET /' || event_type || ' HTTP/1.1' AS message FROM events")(
    lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", F.expr(_ACCESS.format("date_format(ts, 'dd/MMM/yyyy:HH:mm:ss')")).alias("raw")).withColumn("p", P.classify(F.col("raw"), [P.ACCESS_LOG])).select("event_id", "p.level", "p.datetime", "p.channel", "p.message")
)
query("parse_syslog", "SELECT event_id, ['emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'info', 'debug'][CAST(event_id % 8 AS INTEGER) + 1] AS level, replace(substring(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z' AS datetime, event_type AS channel, 'user ' || user_id AS message FROM events")(
    lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", F.expr("'<' || cast(event_id % 8 + 8 as string) || '>1 ' || replace(substring(cast(ts as string), 1, 19), ' ', 'T') || 'Z host1 ' || event_type || '[' || cast(user_id as string) || ']: user ' || cast(user_id as string)").alias("raw")).withColumn("p", P.classify(F.col("raw"), [P.SYSLOG_LINE])).select("event_id", "p.level", "p.datetime", "p.channel", "p.message")
)


@query("register_parser", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'piped' END AS parser, CASE WHEN event_id % 3 < 2 THEN event_type END AS level, CASE WHEN event_id % 3 < 2 THEN 'user ' || user_id END AS message FROM events")
def register_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A format of the user's own, ``time|level|message``, behind the known ones."""
    cell = lambda line, i: F.split_part(line, F.lit("|"), F.lit(i))
    P.register_parser("piped", lambda line: line.rlike(r"^\d{4}-\S+ \S+\|\w+\|"), lambda line: P.parsed("piped", cell(line, 2), cell(line, 1), None, cell(line, 3)))
    try:
        lines = V.table(spark, sf_dir, "events").select("event_id", F.expr("if(event_id % 3 = 2, 'at ', '') || substring(cast(ts as string), 1, 19) || '|' || event_type || '|user ' || cast(user_id as string)").alias("raw"))
        return lines.withColumn("p", P.classify(F.col("raw"))).select("event_id", "p.parser", "p.level", "p.message")
    finally:
        P.unregister_parser("piped")


@query("register_source", "WITH " + V.EVENT_LINES_SQL + ' SELECT file, line_no, "offset", raw FROM event_lines')
def register_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    L.register_source("event logs", lambda session, config: V.event_lines(session, config["tables"]))
    return L.lines_of(spark, "event logs", {"tables": sf_dir}).select("file", "line_no", "offset", "raw")


query("clamp_limit", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 200 ELSE greatest(1, least(5000, event_id - 300)) END AS n FROM events")(
    lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", S.clamp_limit(F.when(F.col("event_id") % 11 > 0, F.col("event_id") - 300)).cast("long").alias("n"))
)
query("count_arg_check", "SELECT event_id, CASE WHEN event_type NOT IN ('minute', 'hour', 'day') AND event_id % 2 = 0 THEN 'bucket' WHEN event_id % 3 = 0 AND event_id % 4 > 0 THEN 'cursor' END AS wrong FROM events")(
    lambda spark, sf_dir: V.table(spark, sf_dir, "events").select("event_id", C.count_error(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("hour"), F.col("event_id") % 3 == 0, F.col("event_id") % 4).alias("wrong"))
)
_BOUNDS = {"2024-01-12 06:30": "2024-01-12 06:30:00", "now": "2024-01-15 12:00:00", "today": "2024-01-15 00:00:00", "yesterday 14:05": "2024-01-14 14:05:00", "-36 hours": "2024-01-14 00:00:00", "2 days ago": "2024-01-13 12:00:00", "-1 week": "2024-01-08 12:00:00"}


@query("to_bound", " UNION ALL ".join(f"SELECT '{k}' AS bound, count(*) AS n FROM events WHERE ts >= TIMESTAMP '{v}'" for k, v in _BOUNDS.items()))
def to_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events each form of a bound keeps, seen from noon of a day."""
    noon = dt.datetime(2024, 1, 15, 12, tzinfo=TZ)
    held = [F.struct(F.lit(x).alias("bound"), F.count_if(F.col("ts").cast("timestamp") >= F.lit(S.to_bound(x, noon))).alias("n")) for x in _BOUNDS]
    return V.table(spark, sf_dir, "events").agg(F.array(*held).alias("held")).select(F.inline("held"))


# streaming
def _drain(stream: DataFrame, path: str) -> None:
    """Append what is there now to a table that keeps the stream's state beside it."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The stream's rows after all that is there now; complete results replace each other."""
    path = V.scratch(spark, name)
    if mode == "append":
        _drain(stream, path)
    else:
        run = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).outputMode(mode)
        run.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a stream, one line each."""
    shape = V.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(shape).parquet(f"{sf_dir}/[e]vents.parquet")  # a file, or a folder of them
    raw = F.expr(V._HEADER)
    return events.select(F.expr(V._FILE).alias("file"), F.col("event_id").alias("offset"), raw.alias("raw"), F.expr(f"lower({V._LEVEL})").alias("level"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))


query("follow_search", "SELECT event_id AS \"offset\", 'error' AS level FROM events WHERE event_type = 'error' AND user_id % 10 = 1")(lambda spark, sf_dir: _drained(spark, follow.search_stream(_event_stream(spark, sf_dir), Criteria(r"user=\d*1 ", regex=True, level="error")).select("offset", "level"), "follow-search"))
query("follow_counts", "SELECT strftime(ts, '%Y-%m-%d %H:00') AS bucket, count(*) AS n FROM events GROUP BY 1")(
    lambda spark, sf_dir: _drained(spark, follow.count_stream(_event_stream(spark, sf_dir)), "follow-counts", "complete").select(S.bucket_label(F.col("bucket_start"), "hour").alias("bucket"), "n")
)


@query("follow_lines", "WITH " + V.EVENT_LINES_SQL + ' SELECT file, "offset", end_offset, raw FROM event_lines')
def follow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text logs followed from their beginning."""
    stream = follow.follow_lines(spark, f"{V.event_logs(spark, sf_dir)}/logs", start="begin", recursive=True)
    return _drained(spark, stream, "follow-lines").select(V.log_name(F.col("file")).alias("file"), "offset", "end_offset", "raw")


_LONG, _SHORT = "'event ' || {} || ' of ' || {}", "'event ' || {}"


@query("follow_rotation", f"""WITH p AS (SELECT 1 AS part, {V._FILE} AS file, event_id, {_LONG.format("event_id", "user_id")} AS raw FROM events
UNION ALL SELECT 2, {V._FILE}, event_id, {_SHORT.format("event_id")} FROM events)
SELECT file, 'append' AS event, CAST(sum(strlen(raw) + 1) OVER w - strlen(raw) - 1 AS BIGINT) AS "offset", raw FROM p WINDOW w AS (PARTITION BY part, file ORDER BY event_id)
UNION ALL SELECT DISTINCT file, 'rotated', 0, NULL FROM p WHERE part = 2""")
def follow_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of all events that shorter ones of the same events replace between two ticks. A log is one file, which one task writes."""
    path = V.scratch(spark, "rotated")
    events = V.table(spark, sf_dir, "events").withColumn("file", F.expr(V._FILE))
    ids = [f"cast({x} as string)" for x in ("event_id", "user_id")]
    fs, own = file_system(path)
    fs.create_dir(f"{own}/logs")
    for no, form in enumerate((_LONG, _SHORT)):
        text = events.select("file", "event_id", F.expr(form.format(*ids)).alias("value"))
        text.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value").write.partitionBy("file").text(f"{path}/part-{no}")
        for f in sizes(f"{path}/part-{no}", recursive=True, hidden=False):
            fs.move(file_system(f)[1], f"{own}/logs/{re.search('file=([^/]*)/', f)[1]}")
        _drain(follow.follow_lines(spark, f"{path}/logs", start="begin"), f"{path}/out")
    return spark.read.parquet(f"{path}/out").select(F.substring_index("file", "/", -1).alias("file"), "event", "offset", "raw")


@query("follow_records", V.EVENTS_SQL + f" SELECT {SHOWN_SQL} FROM r QUALIFY row_number() OVER (PARTITION BY file ORDER BY \"offset\" DESC) > 1")
def follow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event logs appended in four parts, folded as they arrive; each file's last record is still open.

    A part has a file for each of a few groups of logs, and a trigger takes as many files, in the order of writing: so
    lines of a log come in its order, and what a micro-batch holds of it is a part.
    """
    path = V.scratch(spark, "appended")
    lines = V.written(V.event_lines(spark, sf_dir).withColumn("event", F.lit("append")), "lines")
    parts = lines.join(lines.groupBy("file").agg(F.max("line_no").alias("_all")), "file").withColumn("_part", F.floor((F.col("line_no") - 1) * 4 / F.col("_all")))
    for part in range(4):
        own = parts.filter(F.col("_part") == part).select("event", "file", "offset", "end_offset", "raw")
        own.repartition(8, "file").write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(path)
    return _drained(spark, follow.follow_records(stream), "follow-records").select(SHOWN)
