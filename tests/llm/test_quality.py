import pyarrow as pa
import numpy as np
from pyspark.sql import functions as F

from seqlab.llm import quality
from seqlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op10_quality"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    assert got.count() == 1000


def test_vote_is_that_of_the_nearest():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(200, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = quality.Model(None, None, None, vectors, rng.integers(0, 2, 200).astype(float))
    for q in vectors[:20] + np.float32(0.1):
        q = q / np.linalg.norm(q)
        near = np.rint(vectors @ q * quality.DIGITS)
        top = sorted(range(200), key=lambda k: (-near[k], k))[: quality.NEIGHBOURS]
        w = (np.maximum(near[top], 0) / quality.DIGITS).astype(float) ** quality.POWER
        want = (w * model.labels[top]).sum() / w.sum()
        assert abs(quality.vote(model, q[None])[0] - want) < 1e-4


def test_rows(spark):
    rows = [(1, "good text here", "a"), (1, "good text here", "a"), (2, None, None), (None, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, 1)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == ["doc_id", "text", "rest", "score"]
    scores = {(r.doc_id, r.text): r.score for r in got.collect()}
    assert got.count() == 4 and all(0 <= s <= 1 for s in scores.values())
    assert scores[(2, None)] == scores[(None, "")]
    unlabelled = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, unlabelled).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs.limit(0), labels).labels.size == 0
    assert quality.features(pa.array(["", "x"])).shape == (2, 3073)
    assert [r[0] for r in spark.range(1).select(quality.held_out(F.lit(None))).collect()] == [False]
