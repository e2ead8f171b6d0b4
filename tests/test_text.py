import pytest
from pyspark.sql import functions as F

from seqlab.functions.text import word_class
from seqlab.operators import vocab
from seqlab.sources import files
from seqlab.sources.column_tags import ColumnTags
from seqlab.sources.corpora import tokens
from tests.conftest import make_sentences

CLASSES = {
    "90": "twoDigitNum", "1990": "fourDigitNum", "456789": "othernum", "A8956-67": "containsDigitAndAlpha",
    "09-96": "containsDigitAndDash", "11/9/89": "containsDigitAndSlash", "1\\2": "containsDigitAndSlash",
    "1.00": "containsDigitAndPeriod", "23,000": "UNK", "BBN": "allCaps", "M.": "capPeriod", "walked": "wordSuffixed",
    "boxes": "wordSuffixes", "bus": "wordSuffixus", "cats": "wordSuffixs", "table": "wordSuffixable",
    "running": "wordSuffixing", "final": "wordSuffixal", "basic": "wordSuffixic", "quickly": "wordSuffixly",
    "nation": "wordSuffixtion", "retry": "reWordPrefix", "disarm": "disWordPrefix", "under": "unWordPrefix",
    "decode": "deWordPrefix", "well-known": "withDash", "dog": "lowercase", ",": "UNK", "été": "UNK",
}


@pytest.mark.parametrize("first", [True, False])
def test_word_classes(spark, first):
    df = spark.createDataFrame([(w,) for w in [*CLASSES, "Sally"]], "word string")
    got = {r.word: r.c for r in df.select("word", word_class(F.col("word"), F.lit(first), F.lit(False)).alias("c")).collect()}
    want = dict(CLASSES) | {"Sally": "wordSuffixly" if first else "initCap"}
    # "Sally" ends in "ly", which only counts where capitals say nothing.
    assert got == want


def test_first_word_takes_frequent_lower_form(spark):
    sents = make_sentences(spark, [[("The", "D"), ("dog", "N")], [("the", "D"), ("dog", "N")], [("the", "D"), ("The", "D")]])
    rows = tokens(sents)
    done = vocab.preprocess(rows, vocab.word_norms(rows, 2).withColumn("keep", F.col("keep")))
    got = {(r.src_id, r.pos): r.word for r in done.collect()}
    assert got[(0, 0)] == "The"  # twice in the corpus: kept
    done = vocab.preprocess(rows, vocab.allowlist_norms(rows, spark.createDataFrame([("the",)], "word string")))
    got = {(r.src_id, r.pos): r.word for r in done.collect()}
    assert got == {(0, 0): "the", (0, 1): "lowercase", (1, 0): "the", (1, 1): "lowercase", (2, 0): "the", (2, 1): "initCap"}


def test_conll_reader(spark, tmp_path):
    text = "1\tThe\t_\tDT\n2\tdog\t_\tNN\n\n\n1\truns\t_\tVB\n   \n1\tfast\t_\tRB\n2\tnow\t_\tRB"
    (tmp_path / "a.conll").write_text(text)
    rows = files.read_conll(spark, str(tmp_path)).orderBy("file", "sentence", "pos").collect()
    sents = {}
    for r in rows:
        sents.setdefault(r.sentence, []).append((r.word, r.tag))
    assert list(sents.values()) == [[("The", "DT"), ("dog", "NN")], [("runs", "VB")], [("fast", "RB"), ("now", "RB")]]


def test_doc_reader(spark, tmp_path):
    (tmp_path / "d.txt").write_text("-DOCSTART- 1\na\tX\nb\tY\tZ\n\n-DOCSTART- 2\n-DOCSTART- 3\nc\tX\n")
    rows = files.read_docs(spark, str(tmp_path)).orderBy("sentence", "pos").collect()
    assert [(r.word, r.tag) for r in rows] == [("a", "X"), ("b", "Y\tZ"), ("c", "X")]


def test_readers_cut_files_by_lines(spark, tmp_path):
    """Neither a file without blank lines nor one with CRLF ends is a single record."""
    (tmp_path / "crlf").mkdir()
    (tmp_path / "crlf" / "a").write_bytes(b"1\tA\t_\tX\r\n\r\n1\tB\t_\tY\r\n2\tC\t_\tZ\r\n")
    rows = files.read_conll(spark, str(tmp_path / "crlf")).orderBy("sentence", "pos").collect()
    assert [(r.word, r.tag, r.pos) for r in rows] == [("A", "X", 0), ("B", "Y", 0), ("C", "Z", 1)]
    (tmp_path / "units").mkdir()
    (tmp_path / "units" / "a").write_text("".join(f"-DOCSTART- {k}\nw{k}\tT\n" for k in range(500)))
    rows = files.read_docs(spark, str(tmp_path / "units"))
    assert rows.select("sentence").distinct().count() == 500


def test_logs_take_the_last_block_of_finished_runs(spark, tmp_path):
    done = "accuracies\n[0.1]\nnoise\naccuracies\n[0.2, 0.3]\nLabels Only Experiment Done\n"
    (tmp_path / "a.txt").write_text(done)
    (tmp_path / "b.txt").write_text("accuracies\n[0.9]\n")
    rows = files.parse_run_logs(spark, str(tmp_path)).orderBy("step").collect()
    assert [(r.metric, r.step, r.value) for r in rows] == [("accuracies", 0, 0.2), ("accuracies", 1, 0.3)]


def test_narrow_words_stay_in_the_list(spark):
    rows = tokens(make_sentences(spark, [[("a", "X"), ("b", "X"), ("Zed", "X")]]))
    allowed = spark.createDataFrame([("a",), ("lowercase",), ("initCap",)], "word string")
    assert vocab.outside(vocab.preprocess(rows, vocab.allowlist_norms(rows, allowed)), allowed).count() == 0


def test_preprocess_shuffles_only_rarer_words(spark, monkeypatch):
    """Words that are a large share of the tokens are not handed to the shuffled look-up; null words stay."""
    monkeypatch.setattr(vocab, "MAX_HEAVY", 4, raising=False)
    given, keep = [], vocab.lookup
    monkeypatch.setattr(vocab, "lookup", lambda left, *rest: given.append(left) or keep(left, *rest))
    words = ["the"] * 5 + ["Cats", "x9", None]
    rows = spark.createDataFrame(
        [(1, 0, i, w, "X", "train") for i, w in enumerate(words)],
        "src_id long, seg int, pos int, word string, tag string, split string",
    )
    out = vocab.preprocess(rows, vocab.word_norms(rows, 2))
    got = [(r.orig, r.word, r.replaced) for r in out.orderBy("pos").collect()]
    assert got[:5] == [("the", "the", False)] * 5
    assert got[5:] == [("Cats", "initCap", True), ("x9", "containsDigitAndAlpha", True), (None, None, None)]
    assert sorted(r.word for r in given[-1].collect()) == ["Cats", "x9"]


def test_sentences_are_put_together_where_they_are_read(spark, tmp_path):
    """Sentences that go on over batches, ranges and blocks are whole, and their tokens are not shuffled."""
    units = [[f"w{k}.{i}\tT{i % 3}" if (k + i) % 7 else f"w{k}.{i}" for i in range(1 + 37 * k % 50)] for k in range(60)]
    for part in range(2):
        text = "".join(f"-DOCSTART- {k}\n" + "".join(f"{line}\n" for line in u) for k, u in enumerate(units[part::2]))
        (tmp_path / f"{part}.txt").write_text(text)
    spark.dataSource.register(ColumnTags)
    keep = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.read.format("column_tags").option("layout", "docs").option("splitBytes", "300").load(str(tmp_path))
        got = files.sentences(rows)
        cells = [[line.split("\t") for line in u] for u in units]
        want = [(" ".join(c[0] for c in u), " ".join(c[1] for c in u if len(c) > 1)) for u in cells]
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", keep)


def test_align_pairs_tokens_that_move_packed(spark):
    """As a full join, with repeated, missing and null keys; no row of words is shuffled."""
    schema = "src_id long, seg int, pos int, word string, tag string"
    a = [(1, 0, 0, "a", "X"), (1, 0, 1, "b", None), (1, 0, 1, "b", "Y"), (-7, 2, 0, None, "X"), (None, 0, 0, "n", "X"), (3, 0, 5, "é", "X")]
    b = [(1, 0, 0, "UNK", "X"), (1, 0, 1, "b", "Y"), (1, 0, 1, "c", "Y"), (-7, 2, 0, "d", "X"), (None, 0, 0, "n", "X"), (9, 1, 0, "z", "X")]
    left, right = (spark.createDataFrame(x, schema).repartition(3) for x in (a, b))
    got = vocab.align(left, right)
    key = ["src_id", "seg", "pos"]
    one, two = (x.toDF(*key, f"{n}_word", f"{n}_tag") for n, x in (("a", left), ("b", right)))
    want = one.join(two, key, "full").withColumn("missing", F.col("a_tag").isNull() | F.col("b_tag").isNull())
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(bucket" in plan and "hashpartitioning(src_id" not in plan
