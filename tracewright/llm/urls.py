"""URL filters: rules by host and path, and an exact block list of hosts held in a Bloom filter cascade.

The cascade's first level encodes the listed keys. Some other keys of the corpus pass it by chance; the second level
encodes just these, the third the listed keys that pass the second, and so on until no key is left. Since every key of
the corpus took part, membership is exact for all of them, without a join: a key that fails an even level (counted from
0) isn't listed, one that fails an odd level is.

Everything is DataFrame expressions. A level is one array of 64-bit words, made by a distributed ``bit_or`` and read
by the scan as a scalar subquery. No level has more than ``MAX_BITS`` bits: where the listed keys, or the others that
pass them by chance, would need more, keys are split by hash into shards with a cascade each. Then keys and rows are
written once, by shard, and each shard's rows are read by their own cascade alone.

Defined results: host and path of a null url, or one without ``://``, are empty; a null key isn't listed; repeated
rows are judged alike; a long url is taken whole; other columns stay in ``judge``; an empty table or list gives a result
without blocks by list.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.llm.common import cut, fresh, written

#: Bits and hash positions of a key in each level.
BITS_PER_KEY, HASHES = 10, 5
#: A level of one shard has at most so many bits (8 MB).
MAX_BITS = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What stands between the first ``://`` and the next of ``/?#``, with A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What stands behind the host up to ``?`` or ``#``."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct<verdict, rule>; null where none does."""
    ordered = sorted(rules, key=lambda x: (-len(x[1] + x[2]), x))
    found = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered]
    return F.coalesce(*found)


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


def _encode(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row with ``words``: the level's bits, 64 a word."""
    n = bits // 64
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
    set_bits = at.select(F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
    empty = keys.sparkSession.range(n).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = empty.union(set_bits.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))


class Cascade:
    """Exact membership of the corpus's keys in a list."""

    def __init__(self, keys: DataFrame, listed: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS):
        """``keys``: all keys of the corpus, ``listed``: the list; one column each, repeats and nulls allowed."""
        universe = keys.toDF("key").filter("key is not null").distinct()
        flags = listed.toDF("key").filter("key is not null").distinct().withColumn("listed", F.lit(True))
        universe = cut(universe.join(flags, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
        n = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
        by_chance = (1 - math.exp(-HASHES / bits_per_key)) ** HASHES
        self.shards = math.ceil(max(1, n.get(True, 0), n.get(False, 0) * by_chance) * bits_per_key / max_bits)
        while not self._built(universe, bits_per_key, max_bits):  # hashes dealt a shard more keys than expected
            self.shards *= 2

    def _built(self, universe: DataFrame, bits_per_key: int, max_bits: int) -> bool:
        """Build every shard's levels; False where one would be larger than ``max_bits``."""
        self.levels: list[list[tuple[DataFrame, int]]] = []
        if self.shards > 1:
            universe = written(universe.withColumn("shard", self._shard(F.col("key"))), "cascade-keys", "shard")
        for s in range(self.shards):
            levels = self._build(universe if self.shards == 1 else universe.filter(F.col("shard") == s).drop("shard"), bits_per_key, max_bits)
            if levels is None:
                return False
            self.levels.append(levels)
        return True

    def _shard(self, key: Column) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.shards)), F.lit(0)).cast("int")

    def _build(self, universe: DataFrame, bits_per_key: int, max_bits: int) -> list[tuple[DataFrame, int]] | None:
        levels: list[tuple[DataFrame, int]] = []
        sides = [universe.filter("listed").select("key"), universe.filter("not listed").select("key")]
        left = sides[0]
        while (n := left.count()) > 0:
            bits = 64 * math.ceil(n * bits_per_key / 64)
            if bits > max(64, max_bits):
                return None
            levels.append((cut(_encode(left, len(levels), bits)), bits))
            other = sides[len(levels) % 2]
            # keys of the other side that pass every level so far must be told apart by the next one
            left = cut(reduce(lambda df, i: df.filter(self._passes(F.col("key"), i, levels[i])), range(len(levels)), other))
        return levels

    @staticmethod
    def _passes(key: Column, level: int, encoded: tuple[DataFrame, int]) -> Column:
        words, bits = encoded[0].select("words").scalar(), encoded[1]
        tests = [F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1 for at in _positions(key, level, bits)]
        return reduce(lambda a, b: a & b, tests)

    def _member(self, key: Column, levels: list[tuple[DataFrame, int]]) -> Column:
        out = F.lit(len(levels) % 2 == 1)
        for i in reversed(range(len(levels))):
            out = F.when(~self._passes(key, i, levels[i]), i % 2 == 1).otherwise(out)
        return out

    def flag(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``df`` with the boolean column ``name``: whether ``key`` is listed."""
        shard = fresh(df, "_shard")
        if self.shards > 1:
            df = written(df.withColumn(shard, self._shard(F.col(key))), "cascade-rows", shard)
        parts = []
        for s, levels in enumerate(self.levels):
            own = df if self.shards == 1 else df.filter(F.col(shard) == s).drop(shard)
            parts.append(own.withColumn(name, F.coalesce(self._member(F.col(key), levels), F.lit(False)) if levels else F.lit(False)))
        return reduce(DataFrame.union, parts)


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict: the rule's, else ``block`` where the host is listed, else ``allow``."""
    h, p, r, hit = (fresh(pages, x) for x in ("_host", "_path", "_rule", "_listed"))
    parsed = pages.withColumns({h: host(F.col("url").cast("string")), p: path(F.col("url").cast("string"))})
    flagged = Cascade(parsed.select(h), listed).flag(parsed.withColumn(r, rule(F.col(h), F.col(p), rules)), h, hit)
    verdict = F.coalesce(F.col(r)["verdict"], F.when(F.col(hit), "block").otherwise("allow"))
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return flagged.select(*others, F.col(h).alias("host"), F.col(p).alias("path"), F.col(r)["rule"].alias("rule"), verdict.alias("verdict"))
