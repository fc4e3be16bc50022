"""Log views over the given tables: events as application and JSON logs, documents, pages and conversations as plain text.

Every view exists as DataFrames and as the SQL text (for DuckDB) that oracles begin with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracewright.operators.fold import fold_records
from tracewright.operators.timeindex import index_lines, time_index
from tracewright.sources.files import write_records
from tracewright.sources.lines import lines_from_table, read_lines
from tracewright.sources.stores import scratch, written  # noqa: F401

#: Consecutive events that make a block of their log file.
EVENTS_PER_BLOCK = 2000
#: Block size of the kept logs' time index.
ZONE_BYTES = 16_384

_LEVEL = "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' WHEN 'signup' THEN 'NOTICE' WHEN 'click' THEN 'INFO' ELSE 'DEBUG' END"
_FILE = "'app-' || CAST(user_id % 8 AS STRING) || '.log'"
_TIME = "substring(CAST(ts AS STRING), 1, 19)"
_ID = "CAST(event_id AS STRING)"
_HEADER = f"'[' || {_TIME} || '] app.' || {_LEVEL} || ': ' || event_type || ' user=' || CAST(user_id AS STRING) || ' cents=' || CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) || ' ' || props"
_TRACED = "event_type = 'error' AND event_id % 3 = 0"
_TRACE = "'\\n[stacktrace]\\n#0 /srv/Handler.php(00): handle(' || {0} || ')\\n#1 /srv/Handler.php(10): handle(' || {0} || ')\\n#2 /srv/Handler.php(20): handle(' || {0} || ')\\n#3 {{main}}'".format(_ID)
#: An event's lines.
EVENT_TEXT = f"{_HEADER} || CASE WHEN {_TRACED} THEN {_TRACE} ELSE '' END"
_JSON = (
    "CASE event_id % 4"
    f" WHEN 0 THEN '{{\"level\":\"Error\",\"datetime\":\"' || {_TIME} || '\",\"channel\":\"app\",\"message\":\"event ' || {_ID} || '\",\"context\":{{\"i\":' || {_ID} || '}}}}'"
    f" WHEN 1 THEN '{{\"level_name\":\"INFO\",\"time\":\"' || {_TIME} || '\",\"logger\":\"web\",\"msg\":\"event ' || {_ID} || '\",\"user\":' || CAST(user_id AS STRING) || '}}'"
    f" WHEN 2 THEN '{{\"severity\":\"Notice\",\"timestamp\":\"' || {_TIME} || '\",\"message\":' || {_ID} || ',\"context\":\"s\"}}'"
    f" ELSE '{{\"level\":400,\"@timestamp\":\"' || {_TIME} || '\",\"user\":' || CAST(user_id AS STRING) || '}}' END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str, headers: bool = False) -> DataFrame:
    """Eight application logs; some errors carry a stack trace of five lines. ``headers`` prepares them for folding."""
    events = table(spark, sf_dir, "events")
    return lines_from_table(events, F.expr(_FILE), F.expr(EVENT_TEXT), ["event_id"], block=F.floor(F.col("event_id") / EVENTS_PER_BLOCK), headers=headers)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_records(event_lines(spark, sf_dir, headers=True))


_kept: dict[tuple[str, ...], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    """A folder that is made once a session."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _kept:
        path = scratch(spark, name)
        make(path)
        _kept[key] = path
    return _kept[key]


def event_logs(spark: SparkSession, sf_dir: str) -> str:
    """A folder, made once a session, with the event logs as text (``logs/file=NAME/``), and nothing else: most ways into text need no more.

    A log's text is its events in their order, so they are dealt and sorted as they are, without lines or offsets.
    """

    def make(path: str) -> None:
        events = table(spark, sf_dir, "events").select(F.expr(_FILE).alias("file"), "event_id", F.coalesce(F.expr(EVENT_TEXT), F.lit("")).alias("value"))
        events.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value").write.partitionBy("file").text(f"{path}/logs")

    return _once(spark, sf_dir, "event-logs", make)


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lines(spark, f"{event_logs(spark, sf_dir)}/logs/*/*.txt", headers=True)


def event_store(spark: SparkSession, sf_dir: str) -> str:
    """The text logs' records kept by day, made once a session."""
    return _once(spark, sf_dir, "event-records", lambda path: write_records(fold_records(_log_lines(spark, sf_dir)), path))


def event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text logs' time index, kept once a session; where their records are kept it is made from these."""

    def make(path: str) -> None:
        stored = _kept.get((spark.sparkContext.applicationId, sf_dir, "event-records"))
        index = index_lines(_log_lines(spark, sf_dir), ZONE_BYTES) if stored is None else time_index(spark.read.parquet(stored), ZONE_BYTES)
        index.write.parquet(path)

    return spark.read.parquet(_once(spark, sf_dir, "event-index", make))


def lines_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time index of the event lines, kept once a session."""
    return spark.read.parquet(_once(spark, sf_dir, "lines-index", lambda path: index_lines(event_lines(spark, sf_dir, headers=True), ZONE_BYTES).write.parquet(path)))


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file and size of the text logs, under the names that their records and their index have."""
    found = spark.read.format("binaryFile").load(f"{event_logs(spark, sf_dir)}/logs/*/*.txt")
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"))


def log_name(path: Column) -> Column:
    """The log's name in the path of its text."""
    return F.regexp_extract(path, "file=([^/]*)/", 1)


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON log, its keys by event_id % 4."""
    events = table(spark, sf_dir, "events")
    return lines_from_table(events, F.lit("app.json"), F.expr(_JSON), ["event_id"], block=F.floor(F.col("event_id") / EVENTS_PER_BLOCK))


def mixed_lines(spark: SparkSession, sf_dir: str, headers: bool = False) -> DataFrame:
    """One log of bracketed, JSON and undated JSON lines in turn."""
    events = table(spark, sf_dir, "events")
    text = F.expr(f"CASE event_id % 3 WHEN 0 THEN {_HEADER} WHEN 1 THEN {_JSON} ELSE '{{\"level\":\"info\",\"message\":\"undated ' || {_ID} || '\"}}' END")
    return lines_from_table(events, F.lit("mixed.log"), text, ["event_id"], block=F.floor(F.col("event_id") / EVENTS_PER_BLOCK), headers=headers)


def document_lines(spark: SparkSession, sf_dir: str, max_line_length: int | None = None, headers: bool = False) -> DataFrame:
    """A file for each document; no line is a header."""
    docs = table(spark, sf_dir, "documents")
    return lines_from_table(docs, F.expr("'doc-' || CAST(doc_id AS STRING)"), "text", max_line_length=max_line_length, headers=headers)


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each conversation."""
    turns = table(spark, sf_dir, "conversations")
    return lines_from_table(turns, F.expr("'conv-' || CAST(conv_id AS STRING)"), F.expr("role || ': ' || text"), ["turn"], max_line_length=None)


def files_of(lines: DataFrame) -> DataFrame:
    """file and size of every file of the lines."""
    return lines.groupBy("file").agg(F.max("end_offset").alias("size"))


HEADER_SQL = r"(?s)^\[(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?)\]\s+([\w\-.]+)\.([A-Z]+):\s?(.*)$"
_PLACED = "CAST(row_number() OVER w AS BIGINT) AS line_no, CAST(sum(strlen(raw) + 1) OVER w - strlen(raw) - 1 AS BIGINT) AS \"offset\", CAST(sum(strlen(raw) + 1) OVER w AS BIGINT) AS end_offset"
EVENT_LINES_SQL = f"""
ev AS (SELECT event_id, {_FILE} AS file, {_HEADER} AS head, {_TRACED} AS traced FROM events),
el AS (
  SELECT file, event_id, 0 AS seq, head AS raw FROM ev
  UNION ALL
  SELECT file, event_id, s, CASE s WHEN 1 THEN '[stacktrace]' WHEN 5 THEN '#3 {{main}}' ELSE '#' || (s - 2) || ' /srv/Handler.php(' || (s - 2) || '0): handle(' || event_id || ')' END
  FROM ev, range(1, 6) t(s) WHERE traced
),
event_lines AS (SELECT file, {_PLACED}, raw FROM el WINDOW w AS (PARTITION BY file ORDER BY event_id, seq))"""


def records_sql(lines: str, name: str, most: int = 200) -> str:
    """CTEs that fold ``lines`` (file, line_no, offset, end_offset, raw) of the bracketed format to ``name``."""
    return f"""
{name}_h AS (SELECT *, max(CASE WHEN regexp_matches(raw, '{HEADER_SQL}') THEN line_no END) OVER (PARTITION BY file ORDER BY line_no) AS h FROM {lines}),
{name}_g AS (
  SELECT file, CAST(min("offset") AS BIGINT) AS "offset", CAST(max(end_offset) AS BIGINT) AS end_offset, string_agg(raw, chr(10) ORDER BY line_no) AS raw,
    CAST(count(*) AS INTEGER) AS n_lines, min_by(raw, line_no) AS first
  FROM {name}_h GROUP BY file, coalesce(h, 1), (line_no - coalesce(h, 1)) // {most + 1}
),
{name}_p AS (
  SELECT *, regexp_matches(first, '{HEADER_SQL}') AS headed, regexp_extract(first, '{HEADER_SQL}', 1) AS g1, regexp_extract(first, '{HEADER_SQL}', 2) AS g2,
    regexp_extract(first, '{HEADER_SQL}', 3) AS g3, regexp_extract(first, '{HEADER_SQL}', 4) AS g4, regexp_extract(regexp_extract(first, '{HEADER_SQL}', 4), '(?s)[{{\\[].*$') AS cand
  FROM {name}_g
),
{name} AS (
  SELECT file, "offset", end_offset, raw, n_lines, CASE WHEN headed THEN 'app' ELSE 'plain' END AS parser,
    CASE WHEN headed THEN lower(g3) END AS level, CASE WHEN headed THEN g1 END AS datetime, CASE WHEN headed THEN g2 END AS channel,
    CASE WHEN NOT headed THEN first WHEN cand <> '' AND json_valid(cand) THEN rtrim(substr(g4, 1, length(g4) - length(cand))) ELSE g4 END AS message,
    CASE WHEN headed AND cand <> '' AND json_valid(cand) THEN cand END AS context,
    CASE WHEN headed THEN CAST(g1 AS TIMESTAMP) END AS ts
  FROM {name}_p
)"""


EVENTS_SQL = "WITH " + EVENT_LINES_SQL + "," + records_sql("event_lines", "r")
JSON_SQL = f"WITH js AS (SELECT event_id, {_JSON} AS raw FROM events), jl AS (SELECT 'app.json' AS file, event_id, {_PLACED}, raw FROM js WINDOW w AS (ORDER BY event_id))"
MIXED_SQL = f"""WITH ml AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN {_HEADER} WHEN 1 THEN {_JSON} ELSE '{{"level":"info","message":"undated ' || {_ID} || '"}}' END AS raw FROM events)"""
DOCUMENT_LINES_SQL = """WITH dl AS (
  SELECT 'doc-' || doc_id AS file, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents
), d AS (
  SELECT file, CAST(line_no AS BIGINT) AS line_no, CAST(sum(strlen(content) + 1) OVER w - strlen(content) - 1 AS BIGINT) AS "offset", CAST(sum(strlen(content) + 1) OVER w AS BIGINT) AS end_offset, rtrim(content, chr(13) || chr(10)) AS raw
  FROM dl WINDOW w AS (PARTITION BY file ORDER BY line_no)
)"""
