"""Search criteria, compiled to predicates on records."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession, functions as F

from tracewright.functions.scalar import ascii_lower, clamp_limit, to_bound

#: A search's limit where none is given, and the most it may be.
DEFAULT_LIMIT, HIGHEST_LIMIT = 1000, 1000


@dataclass(frozen=True)
class Criteria:
    """What to look for; a blank query matches everything that passes the filters."""

    query: str = ""
    regex: bool = False
    case: bool = False
    level: str | None = None
    date_from: str | dt.datetime | None = None
    date_to: str | dt.datetime | None = None
    limit: int | None = DEFAULT_LIMIT
    from_offset: int = 0
    end_offset: int | None = None
    direction: str = "forward"
    scope: str = "record"
    on_bad_regex: str = "literal"

    def __post_init__(self):
        if self.direction not in ("forward", "backward"):
            raise ValueError(f"direction must be forward or backward, got {self.direction!r}")
        if self.scope not in ("record", "line"):
            raise ValueError(f"scope must be record or line, got {self.scope!r}")
        if self.on_bad_regex not in ("literal", "error"):
            raise ValueError(f"on_bad_regex must be literal or error, got {self.on_bad_regex!r}")

    @property
    def most(self) -> int:
        """The limit that a search keeps to: 1 to ``HIGHEST_LIMIT``."""
        return clamp_limit(self.limit, DEFAULT_LIMIT, HIGHEST_LIMIT)

    @property
    def backward(self) -> bool:
        return self.direction == "backward"

    def bounds(self) -> tuple[dt.datetime | None, dt.datetime | None]:
        return tuple(x if isinstance(x, dt.datetime) or x is None else to_bound(x) for x in (self.date_from, self.date_to))

    def text(self) -> Column | None:
        """Whether a record's raw text matches; None without a query."""
        if not self.query.strip():
            return None
        raw = F.col("raw")
        if self.regex and self._regex_is_sound():
            # (?d): a line ends at \n alone; (?i) folds ASCII letters only
            pattern = ("(?d)" if self.case else "(?di)") + self.query
            return F.exists(F.split(raw, "\n"), lambda x: x.rlike(pattern)) if self.scope == "line" else raw.rlike(pattern)
        found = (lambda x: x.contains(self.query)) if self.case else (lambda x: ascii_lower(x).contains(_ascii_lower(self.query)))
        return F.exists(F.split(raw, "\n"), found) if self.scope == "line" else found(raw)

    def _regex_is_sound(self) -> bool:
        spark = SparkSession.getActiveSession()
        try:
            spark.range(1).select(F.lit("").rlike(self.query)).collect()
            return True
        except PySparkException as e:
            if self.on_bad_regex == "error":
                raise ValueError(f"bad pattern {self.query!r}") from e
            return False

    def filters(self) -> Column:
        """Level, time and end of range; undated records pass the time bounds."""
        tests = [F.lit(True)]
        if self.level:
            tests.append(F.coalesce(F.lower("level") == self.level.lower(), F.lit(False)))
        low, high = self.bounds()
        if low is not None or high is not None:
            inside = [F.col("ts") >= F.lit(low)] * (low is not None) + [F.col("ts") <= F.lit(high)] * (high is not None)
            tests.append(F.col("ts").isNull() | reduce(lambda a, b: a & b, inside))
        return reduce(lambda a, b: a & b, tests)

    def cursor(self) -> Column:
        """Forward: records from the cursor on; backward: records below it (0 is the end)."""
        own = F.lit(True)
        if self.backward:
            own = F.col("offset") < self.from_offset if self.from_offset > 0 else own
        else:
            own = F.col("offset") >= self.from_offset
        return own if self.end_offset is None else own & (F.col("offset") < self.end_offset)

    def predicate(self, cursor: bool = True) -> Column:
        """All tests, the cheap ones first."""
        tests = [self.cursor()] * cursor + [self.filters()]
        text = self.text()
        return reduce(lambda a, b: a & b, tests + [text] * (text is not None))


def _ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)
