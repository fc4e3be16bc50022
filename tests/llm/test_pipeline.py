"""The pipeline's stages on a small table, each on what the one before kept, against the operators' own verdicts."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import jaccard, pii, quality, toxicity
from tracewright.llm.common import table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    labels = table(spark, sf_dir, "labels")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality rules", "n-gram jaccard join", "personal data", "best-fit packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == {r["doc_id"] for r in toxicity.score(before, labels).filter("predicted = 0").collect()}
        elif name == "quality rules":
            assert ids == {r["doc_id"] for r in quality.judge(before).filter("kept").collect()}
        elif name == "n-gram jaccard join":
            assert ids == {r["class_id"] for r in jaccard.classes(before).collect()}
        else:
            assert ids == {r["doc_id"] for r in before.select("doc_id").collect()}
            assert pii.find(kept).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


def test_odd_rows_pass_the_stages(spark, tmp_path):
    rng = random.Random(11)
    words = [a + b + c for a in ("ta", "ri", "mo", "len", "ku") for b in ("so", "per", "na", "") for c in ("l", "s", "")]
    say = lambda seed, n: " ".join(random.Random(seed).choices(words, k=n))
    rows = [(i, say(i, 240), "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, say(102, 240), None), (None, say(103, 240), "en"), (5, say(104, 240), "en"), (5, rows[5][1], "en"), (105, rows[6][1] + " end", "en"), (106, " ".join(say(200 + i, 500) for i in range(40)), "en")]
    rng.shuffle(rows)
    clashing = ["raw", "hash", "node", "first", "print", "component", "_row", "_print", "_place", "_pairs", "_language", "_reference", "n_chars", "row", "length", "held_out", "score"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({x: F.lit(7) for x in clashing})
    spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
        kept = kept.cache()
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == sorted([(False, i) for i in range(60)] + [(False, 5), (False, 102), (False, 106), (True, 0)])
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert packed.filter("piece = 0").count() == len(ids) and packed.filter("doc_id = 106").count() > 10
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
