"""The queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlab.llm import (
    byte_bpe, collocations, cover_tree, grid_join, line_dedup, lz_dedup, mixing, pii, quality, sharding, signature_tree,
    spelling, token_files,
)
from seqlab.session import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token_files")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary)
    return token_files.with_crc(token_files.read_tokens(spark, path))


@query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(
        table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN
    )


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    counts = [pii.count_of(spans, kind).alias(f"n_{kind}") for kind in pii.BASE]
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *counts,
        F.sha2(pii.as_text(pii.base_only(spans)), 256).alias("base_sha256"),
        pii.as_text(spans).alias("spans"),
        F.transform(spans, lambda s: s["score"]).alias("scores"),
    )


@query("op6_lz_dedup")
def op6_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_dedup.digests(lz_dedup.remove(table(spark, sf_dir, "documents")))


OP9_SQL = r"""
WITH cut AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS place
    FROM documents
), lines AS (
    SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body
    FROM cut
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k
    FROM lines WHERE body <> ''
), windows AS (
    SELECT doc_id, k, body, lead(body) OVER w AS b2, lead(body, 2) OVER w AS b3
    FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), ranked AS (
    SELECT doc_id, k,
           row_number() OVER (PARTITION BY body, b2, b3 ORDER BY doc_id, k) AS nth
    FROM windows WHERE b3 IS NOT NULL
), gone AS (
    SELECT DISTINCT doc_id, k + step AS k
    FROM ranked, (VALUES (0), (1), (2)) AS steps(step) WHERE nth > 1
), judged AS (
    SELECT l.doc_id, l.place, l.line, n.k IS NOT NULL AS counted, g.k IS NOT NULL AS dropped
    FROM lines l LEFT JOIN numbered n USING (doc_id, place) LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.k = n.k
), kept AS (
    SELECT doc_id, count(*) FILTER (counted) AS n_lines, count(*) FILTER (dropped) AS n_removed,
           string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped) AS text
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query("op9_line_dedup", OP9_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Fitted on the labels of ``sf_dir`` and the texts of ``docs``, without held-out ids."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    return quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))


KEEP = 0.3


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"),
    )


@query("op7_signature_tree")
def op7_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.similar(table(spark, sf_dir, "documents"), n_words=4, percent=85)


@query("op5_grid_join")
def op5_grid_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_join.near(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op8_cover_tree")
def op8_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5)


TARGETS = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the documents that ``labels`` calls good and clean."""
    good = labels.where("quality = 1 AND toxic = 0").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(good, "doc_id", "left_semi")


def _op2_sql() -> str:
    names = list(TARGETS)
    n = range(len(names))
    total = " + ".join(f"p{k}" for k in n)
    steps = []
    for step in range(mixing.STEPS):
        before = "start" if step == 0 else f"step{step - 1}"
        sums = ", ".join(f"coalesce(sum(rate * tokens * (p{k} / ({total}))), 0) AS y{k}" for k in n)
        move = " + ".join(
            f"(p{k} / ({total})) * CASE WHEN a{k} = 0 THEN 0 ELSE (y{k} - {w / sum(TARGETS.values())!r} * whole) / a{k} END"
            for k, w in enumerate(TARGETS.values())
        )
        steps.append(
            f"now{step} AS MATERIALIZED (SELECT {sums} FROM {before}), step{step} AS MATERIALIZED "
            f"(SELECT s.* EXCLUDE (rate), greatest(0.0, rate - ({move})) AS rate FROM {before} s, now{step}, ones)"
        )
    return f"""
WITH sample AS (
    SELECT doc_id, min(lang) AS domain FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)
      AND lang IN ({", ".join(f"'{d}'" for d in names)})
    GROUP BY doc_id ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {mixing.LABELLED}
), cut AS (
    SELECT doc_id, unnest(string_split_regex(text, '[\\x20\\x09-\\x0D]+')) AS w FROM documents
), words AS (
    SELECT doc_id, (ascii(substr(w, 1, 1)) * 961 + ascii(substr(w, 2, 1)) * 31
           + ascii(substr(w, 3, 1)) + length(w) * 7) % {mixing.BUCKETS} AS bucket
    FROM cut WHERE w <> ''
), counts AS (
    SELECT bucket, {", ".join(f"count(*) FILTER (domain = '{d}') AS c{k}" for k, d in enumerate(names))}
    FROM words JOIN sample USING (doc_id) GROUP BY bucket
), totals AS (
    SELECT {", ".join(f"coalesce(sum(c{k}), 0) AS t{k}" for k in n)} FROM counts
), model AS (
    SELECT b.range AS bucket, {", ".join(
        f"round(ln((coalesce(c{k}, 0) + 1.0)::DOUBLE / (t{k} + {mixing.BUCKETS})::DOUBLE) * 1000000)::BIGINT AS l{k}" for k in n)}
    FROM range({mixing.BUCKETS}) b LEFT JOIN counts ON counts.bucket = b.range CROSS JOIN totals
), prior AS (
    SELECT {", ".join(
        f"round(ln((count(*) FILTER (domain = '{d}') + 1)::DOUBLE / (count(*) + {len(names)})::DOUBLE) * 1000000)::BIGINT AS r{k}"
        for k, d in enumerate(names))}
    FROM sample
), spoken AS (
    SELECT doc_id, count(*) AS n_tokens, {", ".join(f"sum(l{k})::BIGINT AS s{k}" for k in n)}
    FROM words JOIN model USING (bucket) GROUP BY doc_id
), logs AS (
    SELECT d.doc_id, coalesce(n_tokens, 0)::BIGINT AS n_tokens, {", ".join(
        f"(coalesce(s{k}, 0)::DOUBLE * least(1.0::DOUBLE, {float(mixing.EVIDENCE)}::DOUBLE / greatest(coalesce(n_tokens, 0), 1)) + r{k}) / 1000000 AS g{k}" for k in n)}
    FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN spoken USING (doc_id) CROSS JOIN prior
), odds AS (
    SELECT doc_id, n_tokens, {", ".join(f"exp(g{k} - greatest({', '.join(f'g{j}' for j in n)})) AS e{k}" for k in n)} FROM logs
), members AS (
    SELECT doc_id, n_tokens, {", ".join(f"round(e{k} / ({' + '.join(f'e{j}' for j in n)}) * 1000)::BIGINT AS p{k}" for k in n)} FROM odds
), start AS MATERIALIZED (
    SELECT {", ".join(f"p{k}" for k in n)}, sum(n_tokens)::DOUBLE AS tokens, 1.0::DOUBLE AS rate FROM members GROUP BY ALL
), sums AS (
    SELECT {", ".join(f"coalesce(sum(tokens * (p{k} / ({total}))), 0) AS a{k}" for k in n)} FROM start
), ones AS MATERIALIZED (SELECT *, {" + ".join(f"a{k}" for k in n)} AS whole FROM sums),
{", ".join(steps)}
SELECT doc_id, n_tokens, {", ".join(f"m.p{k} AS p_{d}" for k, d in enumerate(names))}, round(rate, 5) + 0.0 AS rate
FROM members m JOIN step{mixing.STEPS - 1} s ON {" AND ".join(f"m.p{k} = s.p{k}" for k in n)}
"""


@query("op2_mixing", _op2_sql())
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = labelled_languages(docs, table(spark, sf_dir, "labels"))
    rates = mixing.mix(docs, labelled, TARGETS)
    return rates.withColumn("rate", F.round("rate", 5) + F.lit(0.0))


OP11_SQL = r"""
WITH cut AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), pieces AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM cut
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
    SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
    FROM starts, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)
), counts AS (
    SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL
), candidates AS (
    SELECT lang, k, phrase, n AS a FROM counts WHERE k > 1 AND n >= 100
), kept AS (
    SELECT * FROM candidates c WHERE NOT EXISTS (
        SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a
        AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
), cuts AS (
    SELECT c.*, t.n, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS one, array_to_string(string_split(phrase, ' ')[j + 1 :], ' ') AS two
    FROM kept c JOIN totals t USING (lang), (SELECT unnest(range(1, 5)) AS j) WHERE j < k
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.n, c.j, x.n AS l, y.n AS r, ((1000::HUGEINT * c.a * c.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.one JOIN counts y ON y.lang = c.lang AND y.phrase = c.two
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), longest=5, at_least=100, first=2000)


def _crc_table() -> str:
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ 0xEDB88320 if x & 1 else x >> 1
        out.append(str(x))
    return ", ".join(out)


# DuckDB's levenshtein compares bytes, so letters of two bytes get one that no word here holds.
_ACCENTED = "".join(map(chr, range(0xC0, 0x100)))
_STAND_INS = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c not in "'\\")[: len(_ACCENTED)]


def _op12_sql() -> str:
    value = "coalesce(doc_id::VARCHAR, '') || ':' || run"
    return rf"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), per_doc AS (
    SELECT doc_id, run, count(*) AS n, hex(encode({value})) AS h FROM runs WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, ([{_crc_table()}]::BIGINT[])[1 + xor(c & 255, b)])), 4294967295::BIGINT) AS crc FROM per_doc
), spelled AS (
    SELECT CASE WHEN crc % 97 = 0 THEN substr(run, 1, (crc % length(run))::INT) || substr(run, (crc % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
    SELECT word, sum(n)::BIGINT AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), keyed AS MATERIALIZED (
    SELECT word, n, length(word) AS size, translate(word, '{_ACCENTED}', '{_STAND_INS}') AS key FROM words
), near AS MATERIALIZED (
    SELECT a.word, a.n, b.word AS near, b.n AS near_n
    FROM keyed a JOIN (SELECT *, unnest([size - 1, size, size + 1]) AS other FROM keyed) b
    ON a.size = b.other AND levenshtein(a.key, b.key) = 1
), best AS (
    SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near
    FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1
), forms AS MATERIALIZED (
    SELECT word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * words.n THEN near END AS form,
           CASE WHEN near_n >= 2 * words.n THEN near_n END AS form_n
    FROM words LEFT JOIN best USING (word)
), way AS (
    SELECT word, word AS root, 0 AS step FROM forms
    UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN forms f ON f.word = way.root WHERE f.form IS NOT NULL
)
SELECT f.word, n, n_near, form, form_n, w.root FROM forms f
JOIN (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word) w USING (word)
"""


@query("op12_spelling", _op12_sql())
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.words(table(spark, sf_dir, "documents")))


@query("op13_sharding")
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shards(docs).select(
        "doc.doc_id",
        "size",
        F.crc32(F.coalesce("doc.text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
