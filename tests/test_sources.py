import random
import re

import pytest
from pyspark.sql import functions as F

from seqlab.sources import committed
from seqlab.sources.column_tags import ColumnTags, Range, read_range
from seqlab.sources.models import append_metrics


def sentences(text, layout):
    """[(words, tags)] of a file, line by line."""
    out, now = [], []
    for line in text.split("\n"):
        line = re.sub("[ \t\r]+$", "", line)
        if line == "" or (layout == "docs" and re.match("-DOCSTART-.+", line)):
            out += [now] if now else []
            now = []
            continue
        cols = line.split("\t") if layout == "conll" else line.split("\t", 1)
        word, tag = (1, 3) if layout == "conll" else (0, 1)
        now.append((cols[word] if len(cols) > word else None, cols[tag] if len(cols) > tag else None))
    return out + ([now] if now else [])


def made_up(rng, layout, n):
    out = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.15:
            out.append(rng.choice(["", "  ", "\t", "\r"]))
        elif kind < 0.25 and layout == "docs":
            out.append(rng.choice(["-DOCSTART- 1", "-DOCSTART-", "-DOCSTART-x"]))
        else:
            word, tag = rng.choice(["é", "dog", "a b"]), rng.choice(["X", "YY"])
            line = f"1\t{word}\t_\t{tag}" if layout == "conll" else f"{word}\t{tag}"
            out.append(rng.choice([line, line + " ", word, line + "\tmore\r"]))
    return "\n".join(out) + rng.choice(["", "\n", "\n\n"])


def grouped(batches):
    out = {}
    for b in batches:
        for r in b.to_pylist():
            own = out.setdefault(r["sentence"], [])
            assert r["pos"] == len(own)
            own.append((r["word"], r["tag"]))
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("layout", ["conll", "docs"])
def test_ranges_hold_each_sentence_once(tmp_path, monkeypatch, layout):
    """However a file is cut into ranges and blocks, its sentences are those of reading it through."""
    from seqlab.sources import column_tags

    rng = random.Random(3)
    for k in range(25):
        text = made_up(rng, layout, rng.randint(0, 60))
        path = tmp_path / f"f{layout}{k}"
        path.write_bytes(text.encode())
        size = len(text.encode())
        for split, block in ((10_000, 10_000), (40, 7), (1 + rng.randint(0, 200), 64)):
            monkeypatch.setattr(column_tags, "BLOCK_BYTES", block)
            got = []
            for a in range(0, size, split):
                part = Range(str(path), a, min(a + split, size), a == 0)
                got += list(read_range(part, layout, ["sentence", "pos", "word", "tag"]))
            assert grouped(got) == sentences(text, layout), (k, split, block)


def test_read_with_spark(spark, tmp_path):
    spark.dataSource.register(ColumnTags)
    rng = random.Random(5)
    texts = [made_up(rng, "conll", 300) for _ in range(3)]
    for k, text in enumerate(texts):
        (tmp_path / f"f{k}").write_bytes(text.encode())
    (tmp_path / "_SUCCESS").write_text("not\ta\tfile\tof tokens")
    rows = spark.read.format("column_tags").option("splitBytes", 500).load(str(tmp_path))
    packed = rows.groupBy("file", "sentence").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "tag"))).alias("t"))
    got = sorted(([(t.word, t.tag) for t in r.t] for r in packed.collect()), key=repr)
    assert got == sorted((s for text in texts for s in sentences(text, "conll")), key=repr)
    words = spark.read.format("column_tags").schema("word string").load(str(tmp_path))
    assert words.columns == ["word"] and words.count() == rows.count()
    with pytest.raises(Exception, match="layout"):
        spark.read.format("column_tags").option("layout", "other").load(str(tmp_path)).count()


def test_stream_of_growing_files(spark, tmp_path):
    """What has no bound behind it waits; each sentence is read once over several runs."""
    spark.dataSource.register(ColumnTags)
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()
    log = folder / "log"

    def run():
        stream = spark.readStream.format("column_tags").load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.word for r in spark.read.parquet(out).collect())

    log.write_text("1\ta\t_\tX\n\n1\tb\t_\tX\n")
    assert run() == ["a"]
    with open(log, "a") as f:
        f.write("2\tc\t_\tX\n\n1\td\t_\tX\n\n1\te")
    assert run() == ["a", "b", "c", "d"]
    (folder / "other").write_text("1\tz\t_\tX\n\n")
    with open(log, "a") as f:
        f.write("\t_\tX\n\n")
    assert run() == ["a", "b", "c", "d", "e", "z"]


def test_a_batch_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(0, 50, numPartitions=4).selectExpr("id", "'a' AS name")
    committed.append(rows, path, "first")
    committed.append(rows, path, "first")
    assert committed.read(spark, path).count() == 50
    committed.append(rows.where("id < 5"), path, "second")
    committed.append(rows.where("id < 0"), path, "empty")
    assert committed.read(spark, path).count() == 55
    assert [r["batch"] for r in committed.records(path)] == ["empty", "first", "second"]


def test_attempts_that_die_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(0, 20, numPartitions=2)
    table = rows.toArrow().to_batches()
    writer = committed._Writer({"path": path, "batch": "b"}, rows.schema)
    killed = writer.write(iter(table))  # its message never arrives
    kept = writer.write(iter(table))
    writer.commit([kept, None])
    again = writer.write(iter(table))
    writer.commit([again])  # the batch is there: this attempt's files go
    assert killed.rows == 20 and committed.read(spark, path).count() == 20
    import os

    assert len(os.listdir(path + "/data")) == 2  # the committed file, and the killed attempt's, which nobody reads
    broken = rows.selectExpr("CASE WHEN id = 19 THEN raise_error('dies') ELSE id END AS id")
    with pytest.raises(Exception, match="dies"):
        committed.append(broken, path, "never")
    assert committed.read(spark, path).count() == 20
    with pytest.raises(FileNotFoundError):
        committed.read(spark, str(tmp_path / "none"))


def test_metrics_of_a_round_written_twice(spark, tmp_path):
    rows = spark.createDataFrame([("r", "m", 1, 0.5)], "run string, metric string, step int, value double")
    for _ in range(2):
        append_metrics(rows, str(tmp_path / "m"), "r-1")
    assert committed.read(spark, str(tmp_path / "m")).count() == 1


def test_documents_in_pieces_by_their_size(spark, tmp_path, monkeypatch):
    """Texts of many pieces are dealt to as many tasks, few to none; the sentences are the same."""
    from seqlab.sources import corpora

    rows = [(i if i % 7 else None, f"Line {i}. Next one, {i % 5}!\nEnd", "en") for i in range(200)] + [(1, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    whole = corpora.tok(spark, str(tmp_path))
    monkeypatch.setattr(corpora, "PIECE", 256)
    cut = corpora.tok_pieces(spark, str(tmp_path))
    size = sum(len(r[1]) for r in rows if r[1])
    assert cut.rdd.getNumPartitions() == -(-size // 256) > 8
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
