"""Scalar functions on log text, cursors and files. Each returns a Column; null gives null unless said otherwise."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = {"minute": ("yyyy-MM-dd HH:mm", 16), "hour": ("yyyy-MM-dd HH:00", 13), "day": ("yyyy-MM-dd", 10)}
UNITS = ["B", "KB", "MB", "GB", "TB"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other letters kept."""
    return F.translate(text, UPPER, LOWER)


def to_ts(text: Column) -> Column:
    """Time of a log text in whole seconds; null where it is blank or no date. Without a zone it is of the session's."""
    own = F.trim(text)
    return F.when(own.rlike(r"^\d{4}-"), F.date_trunc("second", own.try_cast("timestamp")))


def to_bound(text: str | None, now: dt.datetime | None = None) -> dt.datetime | None:
    """A search bound: absolute, or ``now``, ``today``, ``yesterday`` with an optional clock time, or ``+-N unit``; None if it is none of these."""
    if text is None or not text.strip():
        return None
    own = text.strip().lower()
    now = (now or dt.datetime.now(dt.timezone.utc)).replace(microsecond=0)
    if own == "now":
        return now
    if m := re.fullmatch(r"(today|yesterday)(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?", own):
        day = now.replace(hour=0, minute=0, second=0) - dt.timedelta(days=m[1] == "yesterday")
        return day + dt.timedelta(hours=int(m[2] or 0), minutes=int(m[3] or 0), seconds=int(m[4] or 0))
    if m := re.fullmatch(r"([+-]?\d+)\s*(second|sec|minute|min|hour|day|week)s?(\s+ago)?", own):
        unit = {"sec": "second", "min": "minute"}.get(m[2], m[2])
        return now + dt.timedelta(**{f"{unit}s": int(m[1]) * (-1 if m[3] else 1)})
    try:
        found = dt.datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return found if found.tzinfo else found.replace(tzinfo=now.tzinfo)


def rstrip_eol(text: Column) -> Column:
    """Without any carriage returns and line feeds at the end."""
    return F.rtrim(text, F.lit("\r\n"))


def cap_bytes(text: Column, limit: int | None) -> tuple[Column, Column]:
    """(the first ``limit`` bytes, whether there were more)."""
    if limit is None:
        return text, F.lit(False)
    more = F.octet_length(text) > limit
    return F.when(more, F.substring(text.cast("binary"), 1, limit).cast("string")).otherwise(text), more


def is_json(text: Column) -> Column:
    """Whether the whole text is one strict JSON value: as the only element of an array it must still parse."""
    one = lambda v: F.try_variant_get(v, "$[0]", "variant").isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull()
    return F.coalesce(let(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), one), F.lit(False))


def fingerprint(size: Column, mtime: Column) -> Column:
    """Eight hex digits that change when a file's size or modification time does."""
    return F.substring(F.sha2(F.concat_ws(":", size.cast("string"), mtime.cast("string")), 256), 1, 8)


def _base64url(text: Column) -> Column:
    plain = F.regexp_replace(F.base64(text.cast("binary")), r"[\r\n=]", "")
    return F.translate(plain, "+/", "-_")


def _unbase64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(plain.rlike("^[A-Za-z0-9+/]+$"), F.try_to_binary(padded, F.lit("base64")).cast("string"))


def cursor_encode(offset: Column, mark: Column | None = None) -> Column:
    """base64url of ``offset`` or ``offset.fingerprint``."""
    own = offset.cast("string")
    return _base64url(own if mark is None else F.when(mark.isNull(), own).otherwise(F.concat(own, F.lit("."), mark)))


def cursor_decode(cursor: Column) -> Column:
    """struct<offset, fingerprint>; bare digits are an offset; null where it is no cursor."""
    text = F.when(cursor.rlike(r"^\d+$"), cursor).otherwise(_unbase64url(cursor))
    offset = F.regexp_extract(text, r"^(\d+)(?:\.(.*))?$", 1)
    mark = F.regexp_extract(text, r"^(\d+)\.(.*)$", 2)
    return F.when(text.rlike(r"(?s)^\d+(\..*)?$"), F.struct(offset.try_cast("long").alias("offset"), F.when(text.contains("."), mark).alias("fingerprint")))


def cursor_valid(cursor: Column, size: Column, mtime: Column) -> Column:
    """Whether a decoded cursor lies in the file and was made for its present state."""
    mark = cursor["fingerprint"]
    return F.coalesce((cursor["offset"] >= 0) & (cursor["offset"] <= size) & (mark.isNull() | (mark == fingerprint(size, mtime))), F.lit(False))


def file_identifier(driver: Column, path: Column) -> Column:
    return _base64url(F.concat(driver, F.lit(":"), path))


def identifier_parts(identifier: Column) -> Column:
    """struct<driver, path>; null where it is no identifier."""
    text = _unbase64url(identifier)
    at = F.instr(text, ":")
    driver, path = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    return F.when((at > 1) & (F.length(path) > 0), F.struct(driver.alias("driver"), path.alias("path")))


def size_human(size: Column) -> Column:
    """``1.5 KB``: at base 1024, two decimals at most, without zeros behind them."""
    out = None
    for i, unit in enumerate(UNITS):
        value = F.round(size.cast("double") / 1024**i, 2).cast("decimal(20,2)").cast("string")
        plain = F.regexp_replace(value, r"\.?0+$", "")
        # only decimals lose zeros
        shown = F.when(value.contains("."), plain).otherwise(value)
        last = i == len(UNITS) - 1
        out = F.when(F.lit(True) if last else size < 1024 ** (i + 1), F.concat(shown, F.lit(f" {unit}"))) if out is None else out.when(F.lit(True) if last else size < 1024 ** (i + 1), F.concat(shown, F.lit(f" {unit}")))
    return out


def check_bucket(bucket: str) -> str:
    if bucket not in BUCKETS:
        raise ValueError(f"bucket must be one of {', '.join(BUCKETS)}, got {bucket!r}")
    return bucket


def bucket_label(ts: Column, bucket: str) -> Column:
    return F.date_format(ts, BUCKETS[check_bucket(bucket)][0])


def coarsen_label(label: Column, bucket: str) -> Column:
    """A finer label's coarser one, by its first letters."""
    own = F.substring(label, 1, BUCKETS[check_bucket(bucket)][1])
    return F.concat(own, F.lit(":00")) if bucket == "hour" else own


def clamp_limit(limit: int | None | Column, default: int = 200, most: int = 5000) -> int | Column:
    """``limit``, at least 1 and at most ``most``; without one the default."""
    if isinstance(limit, Column):
        return F.greatest(F.lit(1), F.least(F.lit(most), F.coalesce(limit, F.lit(default))))
    return max(1, min(most, default if limit is None else limit))
