"""Whitening, structure repair and the quality classifier against brute force, formulas and held-out accuracy, on odd rows too."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import ftrl, queries, repair, whitening
from test_operators import DOCS, ODD, clashing, docs, labels, odd, prose  # noqa: F401

VECTORS = "vec_id long, embedding array<float>, label int"


# whitening
def _spectra():
    rng = np.random.default_rng(0)
    turn = lambda values: (lambda q: q @ np.diag(values) @ q.T)(np.linalg.qr(rng.standard_normal((len(values),) * 2))[0])
    return {
        "full": (lambda x: x @ x.T / 90)(rng.standard_normal((40, 90))),
        "diagonal": np.diag(np.arange(1.0, 20)),
        "identity": 3 * np.eye(5),
        "one direction": np.outer(np.arange(6.0), np.arange(6.0)),
        "clusters": turn([5] * 4 + [2] * 5 + [1, 1 + 1e-9, 0, 0]),
        "steep": turn(10.0 ** -np.arange(14)),
        "on the shift": np.diag([1.0, 2.0, 3.0]),
        "nothing": np.zeros((4, 4)),
        "a number": np.ones((1, 1)),
    }


@pytest.mark.parametrize("name", list(_spectra()))
def test_divide_and_conquer_equals_the_eigenvalues(name):
    a = _spectra()[name]
    values, vectors = whitening.eigen((a + a.T) / 2)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-14 and np.linalg.norm(a @ vectors - vectors * values) <= 1e-14 * size


def test_polar_factor():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((9, 9)))[0]
    a = q @ np.diag([3, 1, 1e-9, 2, -1, -5, -1e-12, 4, -1]) @ q.T
    wanted = q @ np.diag([1, 1, 1, 1, -1, -1, -1, 1, -1]) @ q.T
    assert np.abs(whitening.polar((a + a.T) / 2) - wanted).max() < 1e-3  # the smallest one's own direction is known to that
    assert np.abs(whitening.polar(q @ np.diag([1.0] * 4 + [-2.0] * 5) @ q.T) - q @ np.diag([1] * 4 + [-1] * 5) @ q.T).max() < 1e-14


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 40)) @ rng.standard_normal((40, 40))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(7, x[7].tolist(), 1), (None, x[8].tolist(), 1)]
    odd_rows = [(900, None, 0), (901, [], 0), (902, [1.0] * 39, 0), (903, [None] + [1.0] * 39, 0), (904, [float("nan")] * 40, 0), (905, [float("inf")] * 40, 0), (906, [3e38] * 40, 0)]
    source = spark.createDataFrame(rows + odd_rows, VECTORS).withColumns({c: F.lit("mine") for c in ("n", "component", "vector", "i")}).repartition(5)
    found = whitening.whiten(source).toPandas()
    whole = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in np.float32(v)] for _, v, _ in rows], dtype=object)
    n, sums = len(whole), whole.sum(axis=0)
    deviation = ((n * whole - sums) ** 2).sum(axis=1)
    centred = np.array((n * whole - sums), float) / n
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(found) == n * 32 and set(found["n"]) == {n} and found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9
    by = found.sort_values(["component", "deviation", "vec_id"])
    for c in (1, 2, 17, 32):
        own = by[by["component"] == c]
        wanted = np.sort(np.abs(centred @ vectors[:, c - 1]) / values[c - 1] ** 0.5)
        assert np.abs(np.sort(np.abs(own["whitened"])) - wanted).max() < 1e-8
        assert np.abs(own["explained"] - values[c - 1] / np.trace(v)).max() < 1e-12
        assert sorted(own["deviation"].astype(int)) == sorted(deviation)
    assert found["vec_id"].isna().sum() == 32 and (found["vec_id"] == 7).sum() == 64 and not (found["vec_id"] >= 900).any()


def test_whitening_of_few_and_equal_vectors(spark):
    few = spark.createDataFrame([(1, [1.0, 2.0, 0.5], 0), (2, [3.0, 2.0, 0.5], 0)], VECTORS)
    found = whitening.whiten(few).orderBy("vec_id", "component").collect()
    assert [r["component"] for r in found] == [1, 2, 3] * 2 and [abs(r["whitened"]) if r["whitened"] is not None else None for r in found] == [1.0, None, None] * 2
    assert [round(r["explained"], 12) for r in found[:3]] == [1.0, 0.0, 0.0] and {r["deviation"] for r in found} == {128**2}
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 3, VECTORS)).collect()
    assert len(same) == 6 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, 0.0, None, 0)}
    assert whitening.whiten(few.limit(0)).count() == 0 and whitening.whiten(few.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).count() == 0


def test_deviations_at_the_end_of_longs():
    model = whitening.Whitening(3, [0, 0], np.zeros((2, 0)), np.zeros(0), 0.0)
    root = 1012333499  # 9 * root ** 2 is just a long, 9 * (root + 1) ** 2 isn't
    x = np.array([[root, 0], [root + 1, 0], [1 << 40, 0], [1 << 62, 0], [-root, 5]])
    assert 9 * root**2 < 1 << 63 <= 9 * (root + 1) ** 2
    assert model.deviations(x) == [9 * root**2, None, None, None, 9 * root**2 + 225]


# structure repair
def brute_audit(letters):
    """By all ways, from behind: the least cost and, of equally cheap edits, the first ones."""
    n, far = len(letters), (10**9, "")
    best = {(n, s): far for s in range(4)}
    accept = (0, 3)

    def insert(s):
        return 3 if s == 2 else 2

    for i in range(n, -1, -1):
        base = {}
        for s in range(4):
            options = [(0, "")] if i == n and s in accept else []
            if i < n:
                x = letters[i]
                options.append((4 + best[i + 1, s][0], "D" + best[i + 1, s][1]))
                if x != "-":
                    more = 3 if x.isupper() or x == ":" else 0
                    to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}.get((x.lower(), s))
                    if to is not None:
                        options.append((more + best[i + 1, to][0], "K" + best[i + 1, to][1]))
                    options.append((3 + more + best[i + 1, insert(s)][0], "R" + best[i + 1, insert(s)][1]))
            base[s] = min(options, default=far)
        for _ in range(4):  # inserts stay in the row
            for s in range(4):
                c, p = base[insert(s)]
                base[s] = min(base[s], (c + 3, "I" + p))
        for s in range(4):
            best[i, s] = base[s]
    return best[0, 0]


def test_search_equals_all_ways():
    rng = random.Random(5)
    for _ in range(1500):
        rows = "".join(rng.choice("suaSUA.:-uauaua") for _ in range(rng.randint(0, 12)))
        assert repair.Search(rows, None).run(0) == brute_audit(rows), rows
    for _ in range(60):  # put together of pieces of any sizes
        rows = "".join(rng.choice("suaSUA.:-uauauaua") for _ in range(rng.randint(1, 60)))
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(6))})
        found = [repair.ways(rows[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert repair.joined([(np.array(c, np.int64), ",".join(p)) for c, p in found]) == brute_audit(rows), rows


def brute_repair(rows):
    """A conversation's result from its (turn, role, text), nulls being one space, in order."""
    seen, letters, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        x = role[0] if role[0] in "sua" else "."
        letters += "-" if fault in ("blank", "duplicate") else (":" if x == "." else x.upper()) if fault else x
    cost, audit = brute_audit(letters)
    out, state, at = [], "", 0
    for e in audit:
        given = "assistant" if state[-1:] == "u" else "user"
        role, text = ("", "") if e == "I" else rows[at][1:]
        at += e != "I"
        if e != "D":
            out.append(f"{role if e == 'K' else given}:{text}")
            state += out[-1][0]
    assert re.fullmatch("(s?(ua)+)?", state)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[0] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **counts, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def talk(seed, n, conv):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "So be it", " \t", "", "Why?", "é ﬁ .", None, "Well.\n\n", *(f"Text {i}{'.' if i % 3 else ''}" for i in range(n))]
    rows = [(conv, rng.choice([None, *range(n)]) if rng.random() < 0.1 else i, rng.choice(["user", "assistant"] * 6 + ["system", "tool", None, "Sys"]), rng.choice(texts)) for i in range(n)]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    put = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    digest = lambda r, x: hashlib.sha256(f"{len(r.encode())}:{r}:{x}".encode()).hexdigest()
    return sorted(put, key=lambda r: (r[0] is not None, r[0] or 0, r[1], x[: repair.HEAD] if (x := r[2]) else "", digest(r[1], r[2])))


def test_repair_equals_brute_force(spark):
    rows = [r for c in range(40) for r in talk(c, c % 9 + 1, c)] + talk(77, 400, 1000) + talk(78, 30, None)
    rows += [(2000, 3, "user", "same.")] * 300 + [(2001, 1, "user", "x" * 3000), (2001, 2, "assistant", "y" * 3000 + ".")]
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("place", "blank", "digest", "audit", "first", "cost")})
    found = {r["conv_id"]: r for r in repair.digests(source.repartition(6)).collect()}
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(tuple(rest))
    assert set(found) == set(by)
    for c, own in by.items():
        wanted = brute_repair(in_order(own))
        assert {x: found[c][x] for x in wanted} == wanted, c
    edited = repair.repair(source).orderBy("conv_id", "position").collect()
    for c in (5, 1000, None):
        own = [r for r in edited if r["conv_id"] == c]
        assert "".join(r["edit"] for r in own) == found[c]["audit"] and [r["position"] for r in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D").encode()).hexdigest() == found[c]["repaired_sha256"]
    assert repair.digests(source.limit(0)).count() == 0 and repair.repair(source.limit(0)).count() == 0


def test_damage_and_repair_query(spark, tmp_path):
    rows = [r for c in range(150) for r in talk(c, c % 7 + 1, c)] + [(500, t, "user", "Lost.") for t in range(100) if zlib.crc32(f"500:{t}".encode()) % 20 == 0] + talk(3, 5, None)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    by = {}
    for c, t, role, text in rows:
        own = by.setdefault(c, [])
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(t, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    found = {r["conv_id"]: r for r in queries.op12_structure_repair(spark, str(tmp_path)).collect()}
    assert set(found) == set(by) and found[500]["audit"] == "" and found[500]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    for c, own in by.items():
        wanted = brute_repair(in_order(own))
        assert {x: found[c][x] for x in wanted} == wanted, c


# quality classifier
def test_updates_equal_the_formulas():
    rng = np.random.default_rng(3)
    learner, z, n = ftrl.Learner(), np.zeros(6), np.zeros(6)
    z0 = n0 = 0.0

    def weight(i):
        if abs(z[i]) <= ftrl.L1:
            return 0.0
        return (np.sign(z[i]) * ftrl.L1 - z[i]) / ((ftrl.BETA + n[i] ** 0.5) / ftrl.ALPHA + ftrl.L2)

    for _ in range(200):
        at = np.sort(rng.choice(6, 3, replace=False))
        x, y = rng.random(3), int(rng.random() < 0.7)
        w = [weight(i) for i in at]
        w0 = -z0 * ftrl.ALPHA / (ftrl.BETA + n0**0.5)
        p = 1 / (1 + np.exp(-(w0 + sum(a * b for a, b in zip(w, x)))))
        for i, xi, wi in zip(at, x, w):
            g = (p - y) * xi
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / ftrl.ALPHA * wi
            n[i] += g * g
        z0 += (p - y) - ((n0 + (p - y) ** 2) ** 0.5 - n0**0.5) / ftrl.ALPHA * w0
        n0 += (p - y) ** 2
        learner.learn(at, x, y)
    assert np.allclose(learner.z[:6], z) and np.allclose(learner.weights()[:6], [weight(i) for i in range(6)]) and abs(learner.intercept + z0 * ftrl.ALPHA / (ftrl.BETA + n0**0.5)) < 1e-12


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_grams_and_scores_equal_a_plain_count(monkeypatch, part):
    monkeypatch.setattr(ftrl, "_PART", part)
    monkeypatch.setattr(ftrl, "_WORDS", 20)
    texts = ["The the THE cat### sat... 12 it's a_b x Xx xX a a a", "", " \n", "one", "word### and&&& word### and&&& " * 9, "É é Ünï ß"]
    rng = np.random.default_rng(4)
    model = ftrl.Model(rng.standard_normal(1 << ftrl.BITS).astype(np.float32), 0.3)
    hasher = ftrl.Hasher()
    scores = model.scores(texts, hasher)
    for text, score in zip(texts, scores):
        tokens = re.findall(r"[^\W_]+|[^\w\s]+|_+", text)
        words = [t.lower() for t in tokens]
        shapes = [(ftrl.shape_of(t), w in words[max(0, i - 2) : i]) for i, (t, w) in enumerate(zip(tokens, words))]
        total, kinds, plain = 0.3, {}, {}
        for kind, (of_shapes, n) in enumerate(ftrl.KINDS):
            row = shapes if of_shapes else words
            grams = [tuple(row[i : i + n]) for i in range(len(row) - n + 1)]
            _, buckets, _ = next((x for x in hasher.grams([(tokens, 0)]) if x[0] == kind), (kind, np.zeros(0, int), None))
            assert len(buckets) == len(grams)
            for gram, bucket in zip(grams, buckets):
                assert kinds.setdefault((kind, gram), bucket) == bucket
                plain[bucket] = plain.get(bucket, 0) + ftrl.SPREAD / len(grams)
            assert len({kinds[kind, g] for g in grams}) == len(set(grams))
        total += sum(v * model.weights[b] for b, v in plain.items())
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-6
        at, values = ftrl.features(text, hasher)
        assert at.tolist() == sorted(plain) and np.allclose(values, [plain[b] for b in sorted(plain)])


def test_quality_learns_and_handles_odd_rows(spark, monkeypatch):
    junk = lambda i: " ".join(w + "###" for w in prose(i, 50).split()) if i % 2 else prose(i, 50).upper()
    rows = [(i, junk(i) if i % 3 == 0 else prose(i, 50), "en") for i in range(400)]
    source = docs(spark, rows + [(1000 + i if i is not None else None, t, x) for i, t, x in ODD] + [(5000, prose(1, 30) + " " + "word " * 300_000, "en")]).withColumns({c: F.lit("mine") for c in ("score", "held_out", "quality", "buckets")})
    known = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (7, None, 0), (2, 0, 0)] + [(i, i % 2, 0) for i in range(100_000, 120_000)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(ftrl, "MAX_LOW", 100)
    monkeypatch.setattr(ftrl, "MAX_HIGH", 100)  # far fewer than labels without a document
    found = ftrl.score(source, known).collect()
    assert len(found) == source.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    held = [r for r in found if r["held_out"] and (r["doc_id"] or 10**6) < 400]
    assert held and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held)
    assert {r["held_out"] for r in found if r["doc_id"] is None} == {False}
    assert len({r["score"] for r in found if r["doc_id"] in (1001, 1002, 1003)}) == 1  # null, empty and white space alike
    kept = ftrl.filter_low(source, known)
    assert kept.columns == source.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in found if r["predicted"])
    monkeypatch.setattr(ftrl, "MAX_FEATURES", 300)  # room for the few short ones alone
    assert {r["score"] for r in ftrl.score(source, known).collect()} != {0.5}
    monkeypatch.undo()
    for nothing in (known.limit(0), known.filter("quality = 1")):
        assert {r["score"] for r in ftrl.score(source, nothing).collect()} == {0.5} and ftrl.filter_low(source, nothing).count() == 0
    assert ftrl.score(source.limit(0), known).count() == 0
