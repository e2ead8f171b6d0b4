"""Each stage on what the one before it kept, against a plain version of it."""

import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from seqlab.llm import mixing, quality
from seqlab.llm.queries import KEEP, TARGETS, labelled_languages, quality_model
from seqlab.session import written
from tests.llm import test_line_dedup, test_signature_tree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(written(stage(spark, out[-1], SF), f"test_stage_{k}"))
    return out


def test_columns(stages):
    assert [s.columns for s in stages[:-1]] == [stages[0].columns] * 5


def test_quality(spark, stages):
    docs, kept = stages[:2]
    model = quality_model(spark, docs, SF)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, s in scores.items() if s >= KEEP}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.where("quality = 1").join(docs, "doc_id")
    assert good.join(kept, "doc_id", "left_semi").count() >= 0.97 * good.count()


def test_lines(stages):
    before, after = stages[1].collect(), {r.doc_id: r for r in stages[2].collect()}
    want = test_line_dedup.brute([(r.doc_id, r.text) for r in before])
    for k, r in enumerate(before):
        assert after[r.doc_id].text == want[k]
        assert want[k] == r.text or after[r.doc_id].n_chars == len(want[k])
    assert len(after) == len(before)


def test_groups(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = [d for d, _, c in test_signature_tree.brute(rows, 5, 80) if d == c]
    kept = stages[3].collect()
    assert sorted(r.doc_id for r in kept) == sorted(want)
    assert len(kept) < len(rows)


def test_mixing(spark, stages):
    docs = stages[3]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rates = {r.doc_id: r.rate for r in mixing.mix(docs, labelled_languages(docs, labels), TARGETS).collect()}
    times = Counter(r.doc_id for r in stages[4].collect())
    assert all(int(x) <= times[d] <= int(x) + 1 for d, x in rates.items())
    words = stages[4].groupBy("lang").agg(F.sum(F.size(F.split("text", r"[ \t-\r]+"))).alias("n")).collect()
    total = sum(r.n for r in words)
    assert all(abs(r.n / total - TARGETS[r.lang]) < 0.12 for r in words)


def test_encoding(stages):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in stages[4].collect():
        ids = plain.encode_ordinary(r.text)
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((r.doc_id, len(ids), digest, hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in stages[5].collect()) == sorted(want)


NAMES = ["_rate", "_copy", "_nth", "_times", "rate", "row", "score", "quality_score", "n_removed", "n_lines", "copy", "rest", "times", "id"]


def odd(spark, docs):
    """Nulls, empty texts, repeated rows, a map column and columns named as the operators' own."""
    some = docs.limit(25)
    extra = spark.createDataFrame(
        [(None, None, "en", "s", 0), (None, "no id at all", None, "s", 12), (10_000, None, "de", None, None),
         (10_001, "", "fr", "s", 0), (10_002, "word " * 30_000, "en", "s", 150_000)] * 2,
        docs.schema,
    )
    rows = some.union(some.limit(3)).union(extra)
    for name in NAMES:
        rows = rows.withColumn(name, F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return written(rows.withColumn("tags", F.create_map(F.lit("k"), F.col("lang"))), "odd")


def test_odd_rows_in_every_stage(spark, stages):
    docs = odd(spark, stages[0])
    labels = Counter(r.doc_id for r in docs.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        rows = out.collect()
        assert {r.doc_id for r in rows} <= set(labels)
        for r in rows:
            who = "-" if r.doc_id is None else str(r.doc_id)
            assert all(r[n] == n + who for n in NAMES) and r.tags == {"k": r.lang}, name
        if name == "line dedup":
            assert Counter(r.doc_id for r in rows) == labels
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in last) == labels
    assert {r.n_tokens for r in last if r.doc_id in (10_000, 10_001)} == {0}
