"""Approximate nearest neighbours by learned partitions, nearness being cosine.

1. Of a bounded sample of vectors the graph of nearest neighbours is made and cut into balanced parts: vectors move to
   the part that holds most of their neighbours, as long as it has room. A sample tells only so many parts apart, so
   where the table needs more, several cuts are made, each from another start, and a combination of their parts is a
   cell: there are as many cells as the table's size asks for.
2. For each cut a small classifier (one hidden layer) learns, from a vector, how its neighbours spread over the parts.
   A cell's probability is the product of its parts', so the best cells are found from each cut's best parts, without
   scoring all of them.
3. Every vector of the table is indexed in its most probable cell. Every query goes to several most probable cells; how
   many is the least number that reaches ``target`` recall on a second sample, none of whose vectors trained anything.
4. In a cell all of its vectors are ranked by their exact cosine in double precision. A cell is cut into blocks of a
   bounded size, so neither a crowded cell nor a crowded query list comes together in one task.

Vectors are first scaled by a power of two, which changes no cosine, so that squares of very large or small components
neither overflow nor vanish. Equal vectors (so scaled) are indexed once, with the ``k + 1`` least ids that hold them: no
more of them can be among a query's ``k`` nearest, since equal vectors are equally near and ties go to the smaller id.

The sample is of ``2 * SAMPLE`` vectors, those with the least hash of vec_id. Defined results: vectors that are null,
zero, of another length than most (for which no cosine is defined), or hold null or non-finite components take no part;
a vec_id that repeats is answered once, for its least vector, and is never its own neighbour; other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tracewright.llm.common import batches, by_hash, cut, likely_sample, runs

SAMPLE = 4096
#: About so many different vectors make a cell.
PART_VECTORS = 1500
#: The blocks of so many cells are sent to tasks; of more cells they are joined.
MAX_SENT_CELLS = 100_000
#: Scores of so many pairs of vector and cell are held at a time.
HELD_SCORES = 1 << 21
#: The number of probes is first looked for among so many cells, then among four times as many.
FIRST_TRIED = 256
#: A batch of queries on their way to cells holds about so many of them.
ROUTED_QUERIES = 20_000
#: A block of a part holds about so many vectors; so many queries at a time are held against it.
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 1024
#: More than what a block's cosines by a matrix product may differ from exact ones.
ROUNDING = 1e-9
NEIGHBOURS, HIDDEN, STEPS = 10, 64, 150
TARGET_RECALL = 0.95


@dataclass
class Router:
    """A classifier for each cut, the numbers of the cuts' parts, and the number of cells a query goes to."""

    layers: list[list[np.ndarray]]
    parts: list[int]
    probes: int

    @property
    def cells(self) -> int:
        return math.prod(self.parts)

    def scores(self, unit: np.ndarray) -> list[np.ndarray]:
        """Log-probabilities of the parts of each cut, vector by part."""
        out = []
        for w, b, v, c in self.layers:
            logits = np.maximum(unit @ w + b, 0) @ v + c
            logits -= logits.max(axis=1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
        return out

    def own(self, unit: np.ndarray) -> np.ndarray:
        """The most probable cell of each vector: of every cut the most probable part."""
        found = np.zeros(len(unit), np.int64)
        for own in self.scores(unit):
            found = found * own.shape[1] + own.argmax(axis=1)
        return found

    def by_cell(self, unit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Log-probabilities of all cells for some vectors at a time, with the first one's place."""
        step = max(1, HELD_SCORES // self.cells)
        for first in range(0, len(unit), step):
            every = np.zeros((len(unit[first : first + step]), 1))
            for own in self.scores(unit[first : first + step]):
                every = (every[:, :, None] + own[:, None, :]).reshape(len(every), -1)
            yield first, every

    def ranked(self, unit: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The k most probable cells of each vector, best first, with their log-probabilities; some vectors at a time, with the first one's place.

        Of a cell whose parts have the ranks r1, r2, ... in their cuts, at least r1 * r2 * ... cells are as probable. So
        only combinations of ranks whose product is at most k can be among the best k, and they are the same for all
        vectors: the work is that of the cells a query goes to, not of all cells.
        """
        k = min(k, self.cells)
        ranks = rank_products(self.parts, k)
        step = max(1, HELD_SCORES // len(ranks))
        for first in range(0, len(unit), step):
            some = unit[first : first + step]
            score, cell = np.zeros((len(some), len(ranks))), np.zeros((len(some), len(ranks)), np.int64)
            for own, rank in zip(self.scores(some), ranks.T):
                order = np.argsort(-own, axis=1, kind="stable")[:, : rank.max() + 1]
                score += np.take_along_axis(own, order, axis=1)[:, rank]
                cell = cell * own.shape[1] + order[:, rank]
            found = np.argpartition(-score, k - 1, axis=1)[:, :k]
            found = np.take_along_axis(found, np.argsort(-np.take_along_axis(score, found, axis=1), axis=1, kind="stable"), axis=1)
            yield first, np.take_along_axis(cell, found, axis=1), np.take_along_axis(score, found, axis=1)

    def best(self, unit: np.ndarray) -> np.ndarray:
        """The ``probes`` most probable cells of each vector."""
        if self.probes == self.cells:
            return np.broadcast_to(np.arange(self.cells), (len(unit), self.cells))
        return np.concatenate([cells for _, cells, _ in self.ranked(unit, self.probes)])


def rank_products(parts: list[int], k: int) -> np.ndarray:
    """Combinations of ranks from 0, one for each cut, the product of whose successors is at most k."""
    ranks, product = np.zeros((1, 0), np.int64), np.ones(1, np.int64)
    for n in parts:
        most = np.minimum(n, k // product)
        which = np.repeat(np.arange(len(most)), most)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(most) - most, most)
        ranks, product = np.column_stack([ranks[which], rank]), product[which] * (rank + 1)
    return ranks


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest others of every unit vector."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for a in range(0, len(x), 512):
        near = x[a : a + 512] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -2
        out[a : a + 512] = np.argpartition(-near, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """A part for every node of the graph; no part exceeds ``slack`` times the mean."""
    rng = np.random.default_rng(seed)
    n = len(x)
    room = math.ceil(slack * n / parts)
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.full(n, -1)
    size = np.zeros(parts, np.int64)
    near = x @ centres.T
    for i in np.argsort(-near.max(axis=1)):
        for p in np.argsort(-near[i]):
            if size[p] < room:
                part[i] = p
                size[p] += 1
                break
    for _ in range(rounds):
        held = np.zeros((n, parts))
        rows = np.repeat(np.arange(n), graph.shape[1])
        np.add.at(held, (rows, part[graph.ravel()]), 1)
        np.add.at(held, (graph.ravel(), part[rows]), 1)
        best = held.argmax(axis=1)
        gain = held[np.arange(n), best] - held[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, spread: np.ndarray, steps: int = STEPS, seed: int = 6) -> list[np.ndarray]:
    """Layers of the classifier for unit vectors and the spread of their neighbours over parts; full batches, Adam."""
    rng = np.random.default_rng(seed)
    d, m = x.shape[1], spread.shape[1]
    x = x * math.sqrt(d)
    layers = [rng.normal(0, math.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, m)), np.zeros(m)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for t in range(1, steps + 1):
        hidden = np.maximum(x @ layers[0] + layers[1], 0)
        out = hidden @ layers[2] + layers[3]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        error = (out / out.sum(axis=1, keepdims=True) - spread) / len(x)
        back = error @ layers[2].T * (hidden > 0)
        slopes = [x.T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
        for w, g, a, b in zip(layers, slopes, first, second):
            g += 1e-4 * w
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return [layers[0] * math.sqrt(d), *layers[1:]]


def fit(sample: np.ndarray, cells: int, k: int, target: float = TARGET_RECALL) -> Router:
    """A router to about so many cells from a sample: its first half trains, the second half finds the number of probes."""
    dims = sample.shape[1] if sample.ndim == 2 else 1
    x = unit(sample) if len(sample) else np.zeros((0, dims))
    half = len(x) // 2
    own, other = x[:half], x[half:]
    most = max(1, half // (4 * NEIGHBOURS))  # so many parts a sample tells apart
    if min(cells, most) < 2:
        return Router([[np.zeros((dims, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]], [1], 1)
    cuts = 1
    while most**cuts < cells:
        cuts += 1
    parts = min(most, math.ceil(cells ** (1 / cuts)))
    graph = neighbour_graph(own)
    router = Router([], [parts] * cuts, 1)
    for cut_no in range(cuts):
        part = balanced_parts(own, graph, parts, seed=5 + 2 * cut_no)
        spread = np.zeros((half, parts))
        np.add.at(spread, (np.repeat(np.arange(half), graph.shape[1]), part[graph.ravel()]), 1 / graph.shape[1])
        spread = 0.8 * spread
        spread[np.arange(half), part] += 0.2
        router.layers.append(train(own, spread, seed=6 + 2 * cut_no))
    asked = np.arange(min(len(other), 800))
    near = neighbour_graph_of(other, asked, k)
    cell = router.own(other)[near]
    own_score = np.zeros(cell.shape)
    rest = cell
    places = []
    for n in reversed(router.parts):
        places.append(rest % n)
        rest = rest // n
    for own_part, every in zip(reversed(places), router.scores(other[asked])):
        own_score += np.take_along_axis(every, own_part, axis=1)
    tried = FIRST_TRIED
    while True:  # for each neighbour of a query, how many cells are likelier than its own; from ``tried`` on that isn't told apart
        before = np.concatenate([(scores[:, :, None] > own_score[first : first + len(scores), None, :]).sum(axis=1).ravel() for first, _, scores in router.ranked(other[asked], tried)])
        at = int(np.sort(before)[math.ceil(target * len(before)) - 1])
        if at < tried or tried >= router.cells:
            break
        tried *= 4
    router.probes = min(router.cells, 1 + at)
    return router


def neighbour_graph_of(x: np.ndarray, asked: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of some of the vectors."""
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -2
    return np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & sound)
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("vector") == (length["n"] if length else 0))
    # the power of two below the largest component
    power = F.least(F.floor(F.log2(F.array_max(F.transform("vector", F.abs)))), F.lit(1023))
    return rows.withColumn("_scale", F.pow(F.lit(2.0), power)).select("vec_id", F.transform("vector", lambda x: x / F.col("_scale")).alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, k: int = 5, every: int = 50, target: float = TARGET_RECALL) -> DataFrame:
    """The k nearest of every query (vec_id divisible by ``every``) among all other rows: query_id, rank, vec_id, score."""
    usable = _usable(vectors)
    # repeated rows are dropped first, by id and vector, so that no number of them meets; tasks then pass on k + 1 ids a vector
    order = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    once = usable.dropDuplicates(["vec_id", "vector"]).withColumn("_rank", order).filter(F.col("_rank") <= k + 1)
    different = cut(once.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")))
    n = different.count()
    # at most 2 * SAMPLE vectors
    first = different.select(F.col("ids")[0].alias("first"), "vector")
    sample = likely_sample(first, "first", 2 * SAMPLE, n).orderBy(*by_hash("first")).limit(2 * SAMPLE).select("vector").collect()
    router = fit(np.array([r["vector"] for r in sample], dtype=float), math.ceil(n / PART_VECTORS), k, target)

    def index(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                part = router.own(unit(_matrix(batch.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *batch.columns], ["part", "vector", "ids"])

    def route(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            step = max(1, ROUTED_QUERIES // router.probes)
            for first in range(0, batch.num_rows, step):
                some = batch.slice(first, step)
                best = router.best(unit(_matrix(some.column(1))))
                who = pa.array(np.repeat(np.arange(some.num_rows), best.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(best.ravel(), pa.int64()), some.column(1).take(who), some.column(0).take(who)], ["part", "vector", "query_id"])

    indexed = cut(batches(different.select("vector", "ids"), index, "part long, vector array<double>, ids array<long>"))
    blocks = indexed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_VECTORS).alias("blocks"))  # a row for each cell
    if router.cells <= MAX_SENT_CELLS:
        blocks = F.broadcast(blocks)
    queries = usable.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = batches(queries.select("vec_id", "vector"), route, "part long, vector array<double>, query_id long").join(blocks, "part")
    asked = asked.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("query_id"), "vector", F.array().cast("array<long>").alias("ids"))
    stored = indexed.join(blocks, "part").select("part", F.pmod(F.xxhash64("vector"), F.col("blocks")).alias("block"), F.lit(None).cast("long").alias("query_id"), "vector", "ids")

    def rank(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        ids: list[list[int]] = []
        block = norms = None
        waiting: list[tuple[int, np.ndarray]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal block, norms
            if waiting and held:
                if block is None:
                    block = np.concatenate(held)
                    norms = np.linalg.norm(block, axis=1)
                asked = np.stack([v for _, v in waiting])
                near = (asked @ block.T) / norms
                # all that may be as near as the last of k + 1 (the query may be among them), however many tie there
                at_least = len(block) - min(k + 1, len(block))
                least = np.partition(near, at_least, axis=1)[:, at_least] - ROUNDING * np.linalg.norm(asked, axis=1)
                out: list[tuple[int, int, float]] = []
                for i, (query, vector) in enumerate(waiting):
                    at = np.flatnonzero(near[i] >= least[i])
                    exact = (block[at] * vector).sum(axis=1) / (norms[at] * np.linalg.norm(vector))
                    pairs = sorted((-s, i) for s, a in zip(exact.tolist(), at.tolist()) for i in ids[a] if i != query)
                    out += [(query, i, -s) for s, i in pairs[:k]]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])
            waiting.clear()

        for _, part, new in runs(rows, ["part", "block"]):
            if new:
                yield from answer()
                held, ids, block = [], [], None
            query = part.column(part.schema.get_field_index("query_id"))
            vector = _matrix(part.column(part.schema.get_field_index("vector")))
            for i, q in enumerate(query.to_pylist()):
                if q is not None:
                    waiting.append((q, vector[i]))
                    if len(waiting) >= BLOCK_QUERIES:
                        yield from answer()
            stored_rows = np.flatnonzero(query.is_null().to_numpy(zero_copy_only=False))
            if len(stored_rows):
                held.append(vector[stored_rows])
                ids += part.column(part.schema.get_field_index("ids")).take(pa.array(stored_rows)).to_pylist()
        yield from answer()

    keys = ["part", "block"]
    dealt = stored.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, F.col("query_id").asc_nulls_first())
    found = batches(dealt, rank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
