"""N-gram Jaccard join: pairs of documents whose sets of n-word shingles have a Jaccard similarity of ``threshold`` or more.

1. Every document's shingle set is hashed and signed by MinHash; documents with the same set shrink to one
   representative with a count (a map-side sum, so a group of copies of any size costs one row a task).
2. Signatures are cut into bands of rows. Row and band counts are chosen for a target recall at the threshold.
   Representatives shuffle on their band hashes; those that share one are its bucket.
3. Pairs that share a band are verified on their full shingle sets. So that texts that share many bands meet once, not
   once a band, they are first put into groups: each takes the group that is commonest in its buckets, beginning with
   the buckets' least members. A group's pairs are verified in the group; pairs across groups in the first bucket that
   they share, which leaves out the pairs within the bucket's commonest group. So texts that boilerplate chains to
   others don't meet all that the chain reaches, but those that share a band. Large groups and buckets are cut into
   blocks, and each pair of blocks is verified on its own, by products of incidence matrices; what leaves is, per
   document, its links' number and a link to its least partner, never the pairs.
4. Components of the verified links are the classes.

Words are what lies between ASCII white space, A-Z lower-cased. A text of fewer than n words is one shingle.

Defined results: a text without words (null, empty) is a class of its own without links; every row is a document, so
rows that repeat an id are judged by their own texts each, and equal ones are linked; a row without doc_id has no class
and no links; a very long text is hashed a part at a time, words of any length by all of their letters; other columns
are ignored by ``classes`` and kept by ``deduplicate``; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tracewright.llm.common import batches, cut, fresh, mix, runs, written
from tracewright.llm.graph import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Signatures have at most so many values.
MAX_VALUES = 128
#: A block holds about so many documents or shingles at most.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 400_000
#: Groups are taken over from the buckets so many times; more of them leave fewer pairs across groups.
ROUNDS = 2
#: Incidence matrices have so many columns at a time.
_COLUMNS = 4096
#: Texts are hashed in pieces of whole documents of about so many bytes.
_PIECE = 1 << 20


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_values: int = MAX_VALUES) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach the recall at the threshold within ``max_values``."""
    best = None
    for rows in range(1, max_values + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > max_values and best is not None:
            break
        best = bands, rows
    return best


_rng = np.random.default_rng(20240501)
_POSITION = _rng.integers(0, 1 << 63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 32, 4096, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 31, 4096, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACES = [bytes([x]) for x in np.flatnonzero(_SPACE).tolist()]
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def shingle_sets(raws: list[bytes], words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted 64-bit hashes of the shingles of every text, in turn."""
    first = 0
    while first < len(raws):
        last, size = first, 0
        while last < len(raws) and (last == first or size + len(raws[last]) < _PIECE):
            size += len(raws[last]) + 1
            last += 1
        if last == first + 1:
            hashed = np.concatenate([word_hashes([x])[0] for x in _parts(raws[first])])
            counts = [len(hashed)]
        else:
            hashed, counts = word_hashes(raws[first:last])
        yield from _shingled(hashed, counts, words)
        first = last


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text in parts of whole words; a word that is longer than a part is one of its own."""
    at = 0
    while len(raw) - at > _PIECE:
        end = 1 + max(raw.rfind(x, at, at + _PIECE) for x in _SPACES)
        if end <= at:
            after = _BLANK.search(raw, at + _PIECE)
            end = len(raw) if after is None else after.start()
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, list[int]]:
    """Hashes of the words of all texts, and how many each text has. A letter counts by its place in the word; words of more letters than there are places are hashed as a whole."""
    if len(raws) == 1 and len(raws[0]) > _PIECE:  # one long word
        own = raws[0].split()
        return np.array([_whole(w.lower()) for w in own], np.uint64), [len(own)]
    text = np.frombuffer(b" ".join([*raws, b""]).lower(), np.uint8)
    space = _SPACE[text]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends_of_docs = np.cumsum([len(x) + 1 for x in raws])
    n_words = np.diff(np.searchsorted(starts, ends_of_docs), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), [0] * len(raws)
    ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    at = np.arange(len(text), dtype=np.int64)
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(text))))
    value = (text.astype(np.uint64) + np.uint64(1)) * _POSITION[at & 0xFFFF]
    value[space] = 0
    word = mix(np.add.reduceat(value, starts))
    for i in np.flatnonzero(ends - starts > len(_POSITION)).tolist():
        word[i] = _whole(text[starts[i] : ends[i]].tobytes())
    return word, n_words.tolist()


def _whole(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _shingled(word: np.ndarray, counts: list[int], words: int) -> Iterator[np.ndarray]:
    n = len(word)
    padded = np.concatenate([word, np.zeros(words, np.uint64)])
    gram = np.zeros(n, np.uint64)
    for k in range(words):
        gram += padded[k : k + n] * _ORDER[k]
    gram = mix(gram)
    a = 0
    for count in counts:
        if count >= words:
            yield np.unique(gram[a : a + count - words + 1])
        elif count:
            yield mix(np.array([(word[a : a + count] * _ORDER[8 : 8 + count]).sum(dtype=np.uint64) + np.uint64(count)], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        a += count


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (a row for each non-empty set)."""
    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    starts = np.cumsum(sizes) - sizes
    low = (every >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(sets), bands), np.uint64)
    salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for band in range(bands):
        for row in range(rows):
            k = band * rows + row
            least = np.minimum.reduceat((low ^ _XOR[k]) * _ODD[k], starts)
            out[:, band] += least.astype(np.uint64) * _ORDER[row % 64]
        out[:, band] = mix(out[:, band] + salt[band])
    return out


def signed(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, print (128 bits that stand for the shingle set; null without words), shingles, bands."""
    bands, rows = choose_bands(threshold, recall)

    def sign(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, raws = batch.column(0).to_pylist(), [x or b"" for x in batch.column(1).to_pylist()]
            sets = list(shingle_sets(raws, words))
            full = [i for i, x in enumerate(sets) if len(x)]
            prints: list[bytes | None] = [None] * len(sets)
            own: list[np.ndarray | None] = [None] * len(sets)
            for first in range(0, len(full), 100):
                some = full[first : first + 100]
                for i, band in zip(some, signatures([sets[i] for i in some], bands, rows).view(np.int64)):
                    own[i] = band
                    prints[i] = print_of(sets[i])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "print", "shingles", "bands"])

    return batches(_raw(docs), sign, "doc_id long, print binary, shingles long, bands array<long>")


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence matrices over the shared elements."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    _, kind, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    use = shared[kind]
    owner, kind = owner[use], column[kind[use]]
    order = np.argsort(kind, kind="stable")
    owner, kind = owner[order], kind[order]
    out = np.zeros((n, n), np.float64)
    for low in range(0, int(shared.sum()), _COLUMNS):
        a, b = np.searchsorted(kind, [low, low + _COLUMNS])
        part = np.zeros((n, _COLUMNS), np.float32)
        part[owner[a:b], kind[a:b] - low] = 1
        out += part @ part.T
    return out


def _local_roots(links: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The least node that each row reaches over the links."""
    root = nodes.copy()
    while True:
        least = np.where(links, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        new = np.minimum(root, least)
        if (new == root).all():
            return root
        root = new


def print_of(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a shingle set; None for an empty one."""
    if not len(shingles):
        return None
    return np.array([shingles.sum(dtype=np.uint64), mix(shingles + _ORDER[9]).sum(dtype=np.uint64)], np.uint64).tobytes()


def verified(docs: DataFrame, members: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root, links) for every place where a node was compared; members: as ``meetings`` gives them."""

    def compare(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[tuple], across: int, unit: int, low: int, high: int) -> pa.RecordBatch | None:
            # rows that repeat the id of a node may have another text
            kept = {r[0]: (r, x) for r, x in zip(rows, shingle_sets([r[2] for r in rows], words)) if print_of(x) == r[4]}
            if len(kept) < 2:
                return None
            nodes = np.array(list(kept), np.int64)
            copies = np.array([r[1] for r, _ in kept.values()], np.int64)
            block = np.array([r[3] for r, _ in kept.values()], np.int64)
            size = np.array([len(x) for _, x in kept.values()], np.float64)
            inter = intersections([x for _, x in kept.values()])
            links = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
            np.fill_diagonal(links, False)
            if low != high:  # pairs within a block are compared where the block meets itself, also if its partner here is empty
                links &= block[:, None] != block[None, :]
            if across:  # pairs of one group are the group's; others count in the first band that they share
                group = np.array([r[5] for r, _ in kept.values()], np.int64)
                links &= group[:, None] != group[None, :]
                bands = np.array([r[6] for r, _ in kept.values()], np.int64)
                for i in np.flatnonzero(links.any(axis=1)).tolist():
                    js = np.flatnonzero(links[i])
                    links[i, js] = bands[i][(bands[js] == bands[i]).argmax(axis=1)] == unit
            some = links.any(axis=1)
            roots = _local_roots(links, nodes)
            return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(roots[some]), pa.array((links @ copies)[some])], ["node", "root", "links"])

        held: list[tuple] = []
        seen: set[tuple] = set()
        last = None
        for key, part, new in runs(source, keys):
            if new:
                if held and (done := settle(held, *last)) is not None:
                    yield done
                held = []
                seen.clear()
            last = key
            for row in zip(*(part.column(part.schema.get_field_index(x)).to_pylist() for x in ("node", "copies", "raw", "block", "print", "group", "bands"))):
                once = row[0], hashlib.blake2b(row[2] or b"", digest_size=16).digest()
                if once not in seen:
                    seen.add(once)
                    held.append(row)
        if held and (done := settle(held, *last)) is not None:
            yield done

    keys = ["across", "unit", "low", "high"]
    texts = _raw(docs).withColumnRenamed("doc_id", "first").join(members, "first")
    placed = texts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("partners") - 1)))
    placed = placed.select("node", "copies", "raw", "block", "print", "group", "bands", "across", "unit", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return batches(placed.repartition(*keys).sortWithinPartitions(*keys), compare, "node long, root long, links long")


def _commonest(rows: DataFrame, key: str) -> DataFrame:
    """For each key the group of most of its rows, of equally common ones the least."""
    counted = rows.groupBy(key, "group").agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.max(F.struct("n", (-F.col("group")).alias("least"))).alias("best")).select(key, (-F.col("best.least")).alias("group"))


def grouped(near: DataFrame) -> DataFrame:
    """(node, group) for the nodes of the buckets (node, band, hub); a hub is a bucket's least node."""
    groups = _commonest(near.select("node", F.col("hub").alias("group")), "node")
    for _ in range(ROUNDS):
        of_band = _commonest(near.join(groups, "node").select("band", "group"), "band")
        groups = _commonest(near.join(of_band, "band").select("node", "group"), "node")
    return groups


def _blocks(docs: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(docs / BLOCK_DOCS), F.ceil(shingles / BLOCK_SHINGLES))


def meetings(reps: DataFrame, near: DataFrame) -> DataFrame:
    """Where nodes are compared: a row for each group of several nodes (``across`` 0, the group is the unit), and for each bucket of several groups (1, the band).

    A unit's nodes are in blocks; a node's block meets ``partners`` blocks, from 0 on. In a bucket, the commonest group
    has the last blocks, which meet those of the other nodes but not each other.
    """
    nodes = cut(reps.join(grouped(near), "node"))
    facts = ["node", "first", "print", "copies", "bands", "group"]
    place = F.xxhash64("node")
    sizes = nodes.groupBy("group").agg(F.count("*").alias("n"), F.sum("shingles").alias("s")).filter("n > 1").select("group", _blocks(F.col("n"), F.col("s")).alias("blocks"))
    within = nodes.join(sizes, "group").select(*facts, F.lit(0).alias("across"), F.col("group").alias("unit"), F.pmod(place, F.col("blocks")).alias("block"), F.col("blocks").alias("partners"))

    own = near.select("node", "band").join(nodes.select("node", "group", "shingles"), "node").groupBy("band", "group").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    total = own.groupBy("band").agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", (-F.col("group")).alias("least"), "s")).alias("main"))
    rest = _blocks(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s"))
    mixed = total.filter("groups > 1").select("band", (-F.col("main.least")).alias("main"), rest.alias("rest"), _blocks(F.col("main.n"), F.col("main.s")).alias("last"))
    met = near.select("node", "band").join(mixed, "band").join(nodes, "node")
    is_main = F.col("group") == F.col("main")
    block = F.when(is_main, F.col("rest") + F.pmod(place, F.col("last"))).otherwise(F.pmod(place, F.col("rest")))
    partners = F.when(is_main, F.col("rest")).otherwise(F.col("rest") + F.col("last"))
    return within.union(met.select(*facts, F.lit(1).alias("across"), F.col("band").alias("unit"), block.alias("block"), partners.alias("partners")))


def _buckets(reps: DataFrame) -> DataFrame:
    """(node, band, hub) for the bands that several nodes share."""
    banded = reps.select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("band", "hub")
    return banded.join(hubs, "band")


def _classified(docs: DataFrame, words: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Signatures (doc_id, print, shingles, bands) of all documents, and per shingle set: print, first (least doc_id), component, links, copies."""
    sign = written(signed(docs, words, threshold, recall), "signatures")
    usable = sign.filter(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    sets = usable.groupBy("print", "bands", "shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    # a set's number is written with it, so that it is the same in all that follows
    reps = written(sets.withColumn("node", F.monotonically_increasing_id()), "representatives")
    near = written(_buckets(reps), "buckets")
    checked = cut(verified(docs, meetings(reps, near), words, threshold))
    linked = components(checked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = linked.join(checked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    per_set = reps.select("print", "first", "node", "copies").join(known, "node", "left")
    return sign, per_set.select("print", "first", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class), n_links (documents it is linked to)."""
    sign, per_set = _classified(docs, words, threshold, recall)
    per_set = cut(per_set)
    least = per_set.groupBy("component").agg(F.min("first").alias("class_id"))
    of_set = per_set.join(least, "component").select("print", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    paired = sign.select("doc_id", "print").join(of_set, "print", "left")
    return paired.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links"))


def deduplicate(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents without near copies: of each class the one with the least doc_id stays, with all its columns.

    Where an id repeats, its rows' texts are judged each on its own; of rows with that id and one set of words the one
    with the least text stays. Documents without words or without doc_id are no copies and stay, without words one a doc_id.
    """
    sign, per_set = _classified(docs, words, threshold, recall)
    of_class = per_set.groupBy("component").agg(F.min(F.struct("first", "print")).alias("_least")).select(F.col("_least.first").alias("doc_id"), F.col("_least.print").alias("print"))
    wordless = sign.filter(F.col("print").isNull() & F.col("doc_id").isNotNull()).select("doc_id", "print").distinct()
    stay = of_class.union(wordless)
    again = sign.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    nameless = docs.filter(F.col("doc_id").isNull())
    if again.isEmpty():  # what stays is then used once and needn't be kept
        return docs.join(stay.select("doc_id"), "doc_id", "left_semi").unionByName(nameless)
    stay = cut(stay)
    again = cut(again.join(stay.select("doc_id").distinct(), "doc_id", "left_semi"))
    once = docs.join(stay.join(again, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi")
    several = _of_repeated_ids(docs.join(again, "doc_id", "left_semi"), stay, words)
    return once.unionByName(several).unionByName(nameless)


def _of_repeated_ids(docs: DataFrame, stay: DataFrame, words: int) -> DataFrame:
    """Of rows whose id repeats those whose own set of words stays, one for each id and set."""
    own, place = fresh(docs, "_print"), fresh(docs, "_place")
    text = docs.columns.index("text")

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sets = shingle_sets([x.as_py() or b"" for x in batch.column(text).cast(pa.binary())], words)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(print_of, sets)), pa.binary())], [*batch.schema.names, own])

    told = batches(docs, add, StructType([*docs.schema.fields, StructField(own, BinaryType())]))
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("print").alias("_kept"))
    told = told.join(stay, (F.col("doc_id") == F.col("_id")) & F.col(own).eqNullSafe(F.col("_kept")), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", own).orderBy("text"))
    return told.withColumn(place, first).filter(F.col(place) == 1).select(*docs.columns)
