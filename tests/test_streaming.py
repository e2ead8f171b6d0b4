from pyspark.sql import functions as F

from seqlab.sources.corpora import document_sentences, tokens
from seqlab.streaming import jobs


def docs_stream(spark, folder):
    schema = "doc_id long, text string, lang string"
    for i, text in enumerate(["a b. a", "b c", "a d. d"]):
        spark.createDataFrame([(i, text, "x")], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return tokens(document_sentences(stream))


def test_counts_and_words_over_several_batches(spark, tmp_path):
    rows = docs_stream(spark, str(tmp_path / "docs"))
    got = {r.word: r.n for r in jobs.running_vocab(rows, str(tmp_path / "vocab")).collect()}
    assert got == {"a": 3, "b": 2, "c": 1, "d": 2, ".": 2}
    fresh = jobs.unique_words(rows, str(tmp_path / "unique"))
    assert sorted(r.word for r in fresh.collect()) == [".", "a", "b", "c", "d"]
    assert fresh.select("batch").distinct().count() > 1


def test_labels_are_appended_once(spark, tmp_path):
    rows = docs_stream(spark, str(tmp_path / "docs"))
    out = jobs.label_append(rows, lambda df: df.withColumn("label", F.lit("L")), str(tmp_path / "labels"))
    assert out.count() == 10


def write_docs(spark, folder, texts, first=0):
    for i, text in enumerate(texts):
        rows = spark.createDataFrame([(first + i, text, "x")], "doc_id long, text string, lang string")
        rows.coalesce(1).write.mode("append").parquet(folder)


def test_folder_table_and_restart(spark, tmp_path):
    """Several files per trigger from a folder table; a second run goes on where the first ended."""
    folder, out = str(tmp_path / "documents.parquet"), str(tmp_path / "out")

    def run():
        stream = jobs.stream_table(spark, str(tmp_path), "documents", 2)
        return {r.word: r.n for r in jobs.running_vocab(tokens(document_sentences(stream)), out).collect()}

    write_docs(spark, folder, ["a b", "b c", "a d", "d"])
    assert run() == {"a": 2, "b": 2, "c": 1, "d": 2}
    write_docs(spark, folder, ["a e"], 4)
    assert run() == {"a": 3, "b": 2, "c": 1, "d": 2, "e": 1}
    batches = spark.read.parquet(out).select("batch").distinct().count()
    assert run() == {"a": 3, "b": 2, "c": 1, "d": 2, "e": 1}
    assert spark.read.parquet(out).select("batch").distinct().count() == batches == 3


def test_totals_go_on_after_a_restart(spark, tmp_path):
    """Each run takes up the state of the one before; a late batch counts when it comes."""
    from seqlab.streaming import totals

    folder, out = str(tmp_path / "docs"), str(tmp_path / "out")
    schema = "doc_id long, text string, lang string"

    def run():
        stream = spark.readStream.schema(schema).parquet(folder)
        totals.add_totals(tokens(document_sentences(stream)), out)
        return [tuple(r) for r in totals.totals(spark, out).orderBy("batch").collect()]

    write_docs(spark, folder, ["a b a", "c"])
    assert run() == [(0, 4, 3)]
    write_docs(spark, folder, ["a d. d", None], 2)
    assert run() == [(0, 4, 3), (1, 8, 5)]
    assert run() == [(0, 4, 3), (1, 8, 5)]
