"""Log fixtures made from formulas, with what is expected of them."""

from __future__ import annotations

import datetime as dt

UTC = dt.timezone.utc
T0 = dt.datetime(2026, 3, 1, tzinfo=UTC)
LEVELS = ["INFO", "DEBUG", "WARNING", "ERROR", "CRITICAL"]


def app_lines(count: int, start: int = 0) -> list[str]:
    return [f"[2026-01-{i % 28 + 1:02d} 10:{i % 60:02d}:{i % 60:02d}] testing.{LEVELS[i % 5]}: Message number {i} {{\"i\":{i}}}" for i in range(start, start + count)]


def timed(stamps: list[dt.datetime], trace_every: int = 0) -> tuple[str, list[int]]:
    """The text and each header's offset."""
    text, offsets = "", []
    for i, at in enumerate(stamps):
        offsets.append(len(text))
        text += f"[{at:%Y-%m-%d %H:%M:%S}] testing.{LEVELS[i % 5]}: Event number {i} {{\"i\":{i}}}\n"
        if trace_every and i % trace_every == 0:
            text += "[stacktrace]\n" + "".join(f"#{f} /app/vendor/framework/Handler.php({f}0): Framework\\Handler->handle({i})\n" for f in range(3)) + "#3 {main}\n"
    return text, offsets


def minutes(n: int) -> list[dt.datetime]:
    return [T0 + dt.timedelta(minutes=i) for i in range(n)]


def json_lines(count: int) -> list[str]:
    return [f"{{\"level\": \"{['info', 'debug', 'warning', 'error'][i % 4]}\", \"datetime\":\"2026-01-01T10:00:{i % 60:02d}+00:00\", \"channel\":\"testing\", \"message\":\"json message {i}\", \"context\":{{\"i\":{i}}}}}" for i in range(count)]


def with_stack_trace(frames: int = 3) -> list[str]:
    return [
        "[2026-01-01 10:00:00] testing.INFO: before",
        "[2026-01-01 10:00:01] testing.CRITICAL: boom {\"ex\":\"[object] (RuntimeException(code: 0): boom at /app/x.php:1)",
        "[stacktrace]",
        *(f"#{i} /app/Handler.php({i}): Framework\\Handler->handle()" for i in range(frames)),
        f"#{frames} {{main}}",
        "\"}",
        "[2026-01-01 10:00:02] testing.INFO: after",
    ]
