from pyspark.sql import functions as F

from seqlab.operators import features
from tests.conftest import make_sentences

SENTS = [
    [("Running", "A"), ("Boxes", "B"), ("undo", "A"), ("The", "B"), ("disabled", "A")],
    [("One", "A")],
    [("Two", "B"), ("Nation", "*")],
    [("Two", "*"), ("Nation", "B"), ("Two", None), ("is", None), ("Mr", "A"), ("M.", "B"), ("re", "A")],
    [("<s>", "A"), ("</s>", "B"), ("été", "A"), ("Été", "A")],
]


def corpus(spark):
    empty = spark.createDataFrame([(9, 0, "train", [], [])], "src_id long, seg int, split string, words array<string>, tags array<string>")
    return make_sentences(spark, SENTS * 2).union(empty)


def test_counts_are_those_of_the_examples(spark):
    rows = corpus(spark)
    each = features.examples(rows).select(F.explode("features").alias("feature"))
    want = {r.feature: r.n for r in each.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r.feature: r.n for r in features.feature_counts(rows).collect()}
    assert got == want
    assert want["prevprev_word=<s>"] == 20 and want["next_word=</s>"] == 12  # padding and words of that name


def test_histogram_is_that_of_the_examples(spark):
    rows = corpus(spark)
    sizes = features.examples(rows.where(F.size("words") > 0)).groupBy(F.size("features").alias("nnz")).count()
    got = {r.nnz: r.n_rows for r in features.nnz_histogram(rows).collect()}
    assert got == {r.nnz: r["count"] for r in sizes.collect()}


def test_names_are_made_per_case_not_per_token(spark):
    """The corpus grows, the number of cases does not: the same counts, times the copies."""
    one, many = make_sentences(spark, SENTS), make_sentences(spark, SENTS * 50)
    first = {r.feature: 50 * r.n for r in features.feature_counts(one).collect()}
    assert {r.feature: r.n for r in features.feature_counts(many).collect()} == first
    plan = features.feature_counts(many)._jdf.queryExecution().optimizedPlan().toString()
    names, cases = plan.index("Generate explode"), plan.index("Generate posexplode")
    assert "Aggregate" in plan[names:cases]
