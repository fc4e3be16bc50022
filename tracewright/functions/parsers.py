"""Recognising record headers. A parser is a pair of functions on a line's Column: whether it claims the line, and what it reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tracewright.functions.scalar import ascii_lower, is_json, let

PARSED = StructType([StructField(x, StringType()) for x in ("parser", "level", "datetime", "channel", "message", "context")] + [StructField("extra", ArrayType(StringType()))])
#: The shape of a bracketed application header, and the keys of JSON records in order of precedence.
APP_HEADER = r"(?s)^\[(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:?\d{2}|Z)?)\]\s+([\w\-.]+)\.([A-Z]+):\s?(.*)$"
LEVEL_KEYS = ("level", "level_name", "severity")
TIME_KEYS = ("datetime", "time", "timestamp", "@timestamp")
CHANNEL_KEYS = ("channel", "logger")
MESSAGE_KEYS = ("message", "msg")
#: What is trimmed at a message's end.
BLANKS = r"[ \t\n\r\x00\x0B]+\z"
ACCESS = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-)'
SYSLOG = r"^<(\d{1,3})>1? ?(\S+) (\S+) ([^:\s\[]+)(?:\[\d+\])?:? (.*)$"


@dataclass(frozen=True)
class Parser:
    name: str
    supports: Callable[[Column], Column]
    parse: Callable[[Column], Column]
    #: The datetime that ``parse`` reads, where it can be had for less.
    time: Callable[[Column], Column] | None = None


def parsed(parser: str, level: Column | None = None, datetime: Column | None = None, channel: Column | None = None, message: Column | None = None, context: Column | None = None) -> Column:
    """A header's struct; what isn't given is null."""
    given = {"level": level, "datetime": datetime, "channel": channel, "message": message, "context": context}
    none = F.lit(None).cast("string")
    return F.struct(F.lit(parser).alias("parser"), *((none if v is None else v.cast("string")).alias(k) for k, v in given.items()), F.lit(None).cast("array<string>").alias("extra"))


def trailing_context(message: Column) -> Column:
    """struct<message, context>: JSON from the first brace or bracket to the end leaves the message, if it is valid."""

    def split(own: Column) -> Column:
        at = F.regexp_instr(own, F.lit(r"[{\[]"))
        return let(F.substring(own, at, F.length(own)), lambda found: F.when((at > 0) & is_json(found), F.struct(F.regexp_replace(F.substring(own, F.lit(1), at - 1), BLANKS, "").alias("message"), found.alias("context"))))

    ends = F.regexp_replace(message, BLANKS, "")
    whole = F.struct(message.alias("message"), F.lit(None).cast("string").alias("context"))
    return F.when(message.rlike(r"[}\]][ \t\n\r\x00\x0B]*\z"), F.coalesce(let(ends, split), whole)).otherwise(whole)


def supports_app(line: Column) -> Column:
    return line.startswith("[") & line.rlike(APP_HEADER)


def parse_app(line: Column) -> Column:
    """``[datetime] channel.LEVEL: message``, with a JSON context at the message's end."""
    # one match gives all groups; only the last one may hold the separator
    parts = F.split(F.regexp_replace(line, APP_HEADER, "$1\x01$2\x01$3\x01$4"), "\x01", 4)
    return let(parts, lambda p: let(trailing_context(p[3]), lambda c: parsed("app", ascii_lower(p[2]), p[0], p[1], c["message"], c["context"])))


def supports_json(line: Column) -> Column:
    own = F.ltrim(line)
    return own.startswith("{") & is_json(own)


def _first(value: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys' values that isn't null, as VARIANT."""
    found = []
    for key in keys:
        own = F.try_variant_get(value, f'$["{key}"]', "variant")
        found.append(F.when(F.schema_of_variant(own) != "VOID", own))
    return F.coalesce(*found)


def parse_json(line: Column) -> Column:
    """A JSON object: known keys, and as context its ``context`` or all keys that aren't known."""
    return let(F.try_parse_json(line), lambda value: _read_json(line, value))


def _read_json(line: Column, value: Column) -> Column:
    kind = F.schema_of_variant
    text = lambda v: F.when(kind(v) == "STRING", v.try_cast("string"))
    level = let(_first(value, LEVEL_KEYS), lambda v: F.when(kind(v) == "STRING", ascii_lower(v.try_cast("string"))).when(kind(v) == "BIGINT", v.try_cast("string")))
    time = let(_first(value, TIME_KEYS), text)
    channel = let(_first(value, CHANNEL_KEYS), text)
    message = let(_first(value, MESSAGE_KEYS), lambda v: F.when(v.isNull(), "null").when(kind(v) == "STRING", v.try_cast("string")).otherwise(F.to_json(v)))
    known = F.array(*map(F.lit, LEVEL_KEYS + TIME_KEYS + CHANNEL_KEYS + MESSAGE_KEYS))
    rest = F.map_filter(F.from_json(line, "map<string,variant>"), lambda k, _: ~F.array_contains(known, k))
    nested = lambda v: kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY")
    context = let(_first(value, ("context",)), lambda v: F.when(v.isNull(), F.to_json(rest)).when(nested(v), F.to_json(v)).otherwise(F.to_json(F.struct(v.alias("value")))))
    return parsed("json", level, time, channel, message, context)


def parse_access(line: Column) -> Column:
    """A web server's combined access line: status 5xx is an error, 4xx a warning, else info."""
    part = [F.regexp_extract(line, ACCESS, i) for i in range(7)]
    level = F.when(part[5] >= "500", "error").when(part[5] >= "400", "warning").otherwise("info")
    stamp = F.date_format(F.try_to_timestamp(part[3], F.lit("dd/MMM/yyyy:HH:mm:ss Z")), "yyyy-MM-dd HH:mm:ss")
    return parsed("access", level, stamp, part[2], part[4], F.to_json(F.struct(part[1].alias("client"), part[5].alias("status"), part[6].alias("bytes"))))


def parse_syslog(line: Column) -> Column:
    """``<priority>time host program: message``; the level is the priority modulo 8."""
    part = [F.regexp_extract(line, SYSLOG, i) for i in range(6)]
    levels = F.array(*map(F.lit, ("emergency", "alert", "critical", "error", "warning", "notice", "info", "debug")))
    return parsed("syslog", F.get(levels, part[1].try_cast("int") % 8), part[2], part[4], part[5], F.to_json(F.struct(part[3].alias("host"))))


APP = Parser("app", supports_app, parse_app, lambda line: F.regexp_extract(line, APP_HEADER, 1))
JSON = Parser("json", supports_json, parse_json)
ACCESS_LOG = Parser("access", lambda c: c.rlike(ACCESS), parse_access)
SYSLOG_LINE = Parser("syslog", lambda c: c.rlike(SYSLOG), parse_syslog)

_registry: dict[str, Parser] = {"app": APP, "json": JSON}


def register_parser(name: str, supports: Callable[[Column], Column], parse: Callable[[Column], Column]) -> None:
    """Add a format behind the others, or replace one of this name where it stands."""
    _registry[name] = Parser(name, supports, parse)


def register_pandas_parser(name: str, supports: Callable[[Column], Column], parse: Callable[[pd.Series], pd.DataFrame]) -> None:
    """As ``register_parser``, with a function from lines to a frame of level, datetime, channel, message, context; it runs on Arrow batches."""
    shape = StructType([f for f in PARSED if f.name not in ("parser", "extra")])

    @F.pandas_udf(shape)
    def read(lines: pd.Series) -> pd.DataFrame:
        found = parse(lines.fillna("")).reindex(columns=shape.fieldNames()).astype(object)
        return found.where(found.notna(), None)

    def columns(line: Column) -> Column:
        own = read(line)
        return parsed(name, *(own[f] for f in shape.fieldNames()))

    register_parser(name, supports, columns)


def unregister_parser(name: str) -> None:
    _registry.pop(name, None)


def parsers() -> list[Parser]:
    """Registered parsers in order of precedence."""
    return list(_registry.values())


def classify(line: Column, use: list[Parser] | None = None) -> Column:
    """What the first parser that claims the line reads from it; null for a continuation."""
    out = None
    for p in use if use is not None else parsers():
        claimed, read = F.coalesce(p.supports(line), F.lit(False)), p.parse(line)
        out = F.when(claimed, read) if out is None else out.when(claimed, read)
    return F.lit(None).cast(PARSED) if out is None else out


_read: dict[tuple, Column] = {}


def reading(line: str, use: list[Parser] | None = None) -> Column:
    """``classify`` of a line that is given as an expression's text; the same columns are made but once a session, for they are large."""
    session = SparkContext._active_spark_context  # noqa: SLF001
    key = (None if session is None else session.applicationId, line, *(parsers() if use is None else use))
    if key not in _read:
        _read[key] = classify(F.expr(line), use)
    return _read[key]


def header_time(line: str, use: list[Parser] | None = None) -> Column:
    """The datetime that ``reading`` reads from a line, alone; null for a continuation."""
    session = SparkContext._active_spark_context  # noqa: SLF001
    key = (None if session is None else session.applicationId, "time of", line, *(parsers() if use is None else use))
    if key not in _read:
        own, out = F.expr(line), F.lit(None).cast("string")
        for p in reversed(use if use is not None else parsers()):
            out = F.when(F.coalesce(p.supports(own), F.lit(False)), p.parse(own)["datetime"] if p.time is None else p.time(own)).otherwise(out)
        _read[key] = out
    return _read[key]


def is_header(line: Column, use: list[Parser] | None = None) -> Column:
    """Whether some parser claims the line."""
    out = F.lit(False)
    for p in use if use is not None else parsers():
        out = out | F.coalesce(p.supports(line), F.lit(False))
    return out


def plain(line: Column) -> Column:
    """The struct of a line that no parser claims and that follows no header."""
    return parsed("plain", message=line)
