"""Common table expressions in DuckDB SQL for the corpora the queries share."""

from __future__ import annotations

from seqlab.functions.text import FLAG_NAMES, PREFIXES, SHAPES_FIRST, SHAPES_LAST, SUFFIXES

MIN_FREQ = 2
TOP_N = 2000
L1, L2 = 0.4, 0.55
HMM_L1, HMM_L2 = 0.6, 0.3


def split_sql(ident: str) -> str:
    return (
        f"CASE substr(md5(CAST({ident} AS VARCHAR)), 1, 1) "
        "WHEN '0' THEN 'dev' WHEN '1' THEN 'test' ELSE 'train' END"
    )


def uniform_sql(*parts: object) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST(('0x' || substr(md5({joined}), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0)"


def key_sql(*parts: object) -> str:
    joined = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5({joined})"


def lower_sql(word: str) -> str:
    return f"translate({word}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def class_sql(word: str, first: bool, frequent: str) -> str:
    rules = [f"WHEN regexp_matches({word}, '{p}') THEN '{n}'" for p, n in SHAPES_FIRST]
    if first:
        rules.append(f"WHEN {frequent} THEN {lower_sql(word)}")
    else:
        rules.append(f"WHEN regexp_matches({word}, '^[A-Z]') THEN 'initCap'")
    rules += [f"WHEN regexp_matches({word}, '{p}') THEN '{n}'" for p, n in SHAPES_LAST]
    return f"CASE {' '.join(rules)} ELSE 'UNK' END"


def sentences_sql(ident: str, tag: str, table: str) -> str:
    lines = (
        "regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), '\\n+')"
    )
    words = (
        "list_filter(regexp_split_to_array(regexp_replace(line, '([.,!?;:])', ' \\1 ', 'g'), '[ \\t\\r]+'), "
        "lambda w: w <> '')"
    )
    return (
        f"SELECT src_id, seg, tag, split, {words} AS words FROM ("
        f"SELECT {ident} AS src_id, {tag} AS tag, {split_sql(ident)} AS split, unnest({lines}) AS line, "
        f"generate_subscripts({lines}, 1) - 1 AS seg FROM {table})"
    )


def features_sql(source: str) -> str:
    """Exploded feature names of context rows."""
    cap = "(regexp_matches(word, '^[A-Z]') AND prev_tag <> '*')"
    low = lower_sql("word")
    items = [
        f"'{n}=' || {n}"
        for n in ("word", "next_word", "prev_word", "prevprev_word", "prev_tag", "prevprev_tag")
    ]
    items.append("'tag_bigram=' || prev_tag || ' ' || prevprev_tag")
    items.append(f"CASE WHEN {cap} THEN 'is_cap' END")
    items.append("CASE WHEN regexp_matches(prev_word, '^[A-Z]') AND prevprev_tag <> '*' THEN 'prev_is_cap' END")
    items.append("CASE WHEN regexp_matches(next_word, '^[A-Z]') THEN 'next_is_cap' END")
    items += [f"CASE WHEN NOT {cap} AND ends_with({low}, '{s}') THEN 'suffix_{s}' END" for s in SUFFIXES]
    items += [f"CASE WHEN NOT {cap} AND starts_with({low}, '{p}') THEN 'prefix_{p}' END" for p in PREFIXES]
    return (
        f"SELECT * FROM (SELECT src_id, seg, pos, split, tag, unnest([{', '.join(items)}]) AS feature "
        f"FROM {source}) WHERE feature IS NOT NULL"
    )


def context_sql(source: str) -> str:
    w = "OVER (PARTITION BY src_id, seg ORDER BY pos)"
    return (
        f"SELECT src_id, seg, pos, split, word, tag, "
        f"coalesce(lead(word) {w}, '</s>') AS next_word, coalesce(lag(word) {w}, '<s>') AS prev_word, "
        f"coalesce(lag(word, 2) {w}, '<s>') AS prevprev_word, coalesce(lag(tag) {w}, '*') AS prev_tag, "
        f"coalesce(lag(tag, 2) {w}, '*') AS prevprev_tag FROM {source}"
    )


def trigram_sql(source: str) -> str:
    """Trigrams of (src_id, seg, pos, word, split) rows with one stop row per sentence."""
    w = "OVER (PARTITION BY src_id, seg ORDER BY pos)"
    return (
        f"SELECT src_id, seg, pos, split, coalesce(lag(word, 2) {w}, '<s>') AS w1, "
        f"coalesce(lag(word) {w}, '<s>') AS w2, word AS w3 FROM ("
        f"SELECT src_id, seg, pos, split, word FROM {source} UNION ALL "
        f"SELECT src_id, seg, max(pos) + 1, split, '</s>' FROM {source} GROUP BY src_id, seg, split)"
    )


def lm_sql(grams: str, where: str) -> dict[str, str]:
    return {
        "tri": f"SELECT w1, w2, w3, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY w1, w2) AS p3 "
        f"FROM {grams} WHERE {where} GROUP BY w1, w2, w3",
        "bi": f"SELECT w2, w3, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY w2) AS p2 "
        f"FROM {grams} WHERE {where} GROUP BY w2, w3",
        "uni": f"SELECT w3, count(*) AS n, count(*) / sum(count(*)) OVER () AS p1 "
        f"FROM {grams} WHERE {where} GROUP BY w3",
    }


def prob_sql(l1: object = L1, l2: object = L2) -> str:
    return f"({l1} * coalesce(p3, 0) + {l2} * coalesce(p2, 0) + (1 - {l1} - {l2}) * p1)"


def softmax_sql(source: str, keys: str) -> str:
    """Long scores (keys, class_id, z) to probabilities."""
    return (
        f"SELECT *, e / sum(e) OVER (PARTITION BY {keys}) AS p FROM (SELECT *, "
        f"exp(greatest(z - max(z) OVER (PARTITION BY {keys}), -300.0)) AS e FROM {source})"
    )


def weights_sql(features: str) -> str:
    return (
        f"SELECT f.feature, t.class_id, ln(1.0 + coalesce(c.n, 0)) - ln((SELECT count(*) FROM seq_tags) + f.n) AS w "
        f"FROM (SELECT feature, count(*) AS n FROM {features} GROUP BY feature) f CROSS JOIN seq_tags t "
        f"LEFT JOIN (SELECT feature, tag, count(*) AS n FROM {features} GROUP BY feature, tag) c "
        f"ON c.feature = f.feature AND c.tag = t.tag"
    )


def bias_sql(tokens: str) -> str:
    return (
        f"SELECT t.class_id, ln((1.0 + coalesce(c.n, 0)) / ((SELECT count(*) FROM seq_tags) + "
        f"(SELECT count(*) FROM {tokens}))) AS b FROM seq_tags t "
        f"LEFT JOIN (SELECT tag, count(*) AS n FROM {tokens} GROUP BY tag) c USING (tag)"
    )


def score_sql(features: str, weights: str, bias: str) -> str:
    """Long scores per token and class; unknown features add nothing."""
    return (
        f"SELECT k.src_id, k.seg, k.pos, k.tag, b.class_id, b.b + coalesce(s.w, 0) AS z FROM "
        f"(SELECT DISTINCT src_id, seg, pos, tag FROM {features}) k CROSS JOIN {bias} b LEFT JOIN "
        f"(SELECT f.src_id, f.seg, f.pos, w.class_id, sum(w.w) AS w FROM {features} f JOIN {weights} w "
        f"USING (feature) GROUP BY ALL) s ON s.src_id = k.src_id AND s.seg = k.seg AND s.pos = k.pos "
        f"AND s.class_id = b.class_id"
    )


_tok_lm = lm_sql("tok_grams", "split = 'train'")
_seq_lm = lm_sql("seq_grams", "split = 'train'")
_train = "(SELECT * FROM seq_feats WHERE split = 'train')"
_half_key = "substr(md5(CAST(src_id AS VARCHAR) || '|half'), 1, 1) < '8'"
_half = f"(SELECT * FROM seq_feats WHERE split = 'train' AND {_half_key})"

FRAGMENTS: dict[str, str] = {
    "tok_all": sentences_sql("doc_id", "lang", "documents"),
    "tok_sent": "SELECT * FROM tok_all WHERE len(words) > 0",
    "bench_sent": "SELECT * FROM (" + sentences_sql("item_id", "'benchmark'", "benchmark") + ") WHERE len(words) > 0",
    "tok": "SELECT src_id, seg, split, tag, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM tok_sent",
    "seq": (
        f"SELECT *, {split_sql('src_id')} AS split FROM (SELECT user_id AS src_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS seg, "
        "CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, "
        "json_extract_string(props, '$.k') AS word, event_type AS tag FROM events)"
    ),
    "conv": (
        f"SELECT src_id, seg, tag, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos, {split_sql('src_id')} AS split FROM ("
        "SELECT conv_id AS src_id, turn AS seg, role AS tag, list_filter(regexp_split_to_array(regexp_replace(text, '([.,!?;:])', ' \\1 ', 'g'), "
        "'[ \\t\\r\\n]+'), lambda w: w <> '') AS words FROM conversations)"
    ),
    "tok_vocab": "SELECT word, count(*) AS total, count(*) FILTER (split = 'train') AS n FROM tok GROUP BY word",
    "tok_norm": (
        f"SELECT v.word, v.total, v.n, v.n >= {MIN_FREQ} AS keep, "
        f"CASE WHEN v.n >= {MIN_FREQ} THEN v.word ELSE {class_sql('v.word', True, 'l.word IS NOT NULL')} END AS as_first, "
        f"CASE WHEN v.n >= {MIN_FREQ} THEN v.word ELSE {class_sql('v.word', False, '')} END AS as_later "
        f"FROM tok_vocab v LEFT JOIN tok_vocab l ON l.word = {lower_sql('v.word')} AND l.n >= {MIN_FREQ}"
    ),
    "tok_pre": (
        "SELECT t.src_id, t.seg, t.pos, t.split, t.tag, t.word AS orig, "
        "CASE WHEN t.pos = 0 THEN n.as_first ELSE n.as_later END AS word, NOT n.keep AS replaced "
        "FROM tok t JOIN tok_norm n ON n.word = t.word"
    ),
    "tok_top": (
        f"SELECT word, count(*) AS n FROM tok_pre WHERE split = 'train' GROUP BY word ORDER BY n DESC, word LIMIT {TOP_N}"
    ),
    "allow_norm": (
        f"SELECT v.word, CASE WHEN k.word IS NOT NULL THEN v.word ELSE {class_sql('v.word', True, 'l.word IS NOT NULL')} END AS as_first, "
        f"CASE WHEN k.word IS NOT NULL THEN v.word ELSE {class_sql('v.word', False, '')} END AS as_later, k.word IS NOT NULL AS keep "
        f"FROM tok_vocab v LEFT JOIN tok_top k ON k.word = v.word LEFT JOIN tok_top l ON l.word = {lower_sql('v.word')}"
    ),
    "tok_narrow": (
        "SELECT t.src_id, t.seg, t.pos, t.split, t.tag, t.word AS orig, "
        "CASE WHEN t.pos = 0 THEN n.as_first ELSE n.as_later END AS word FROM tok t JOIN allow_norm n ON n.word = t.word"
    ),
    "tok_grams": trigram_sql("tok"),
    "tok_tri": _tok_lm["tri"],
    "tok_bi": _tok_lm["bi"],
    "tok_uni": _tok_lm["uni"],
    "tok_probs": (
        "SELECT g.*, t.n AS n3, b.n AS n2, u.n AS n1, t.p3, b.p2, u.p1 FROM tok_grams g "
        "LEFT JOIN tok_tri t ON t.w1 = g.w1 AND t.w2 = g.w2 AND t.w3 = g.w3 "
        "LEFT JOIN tok_bi b ON b.w2 = g.w2 AND b.w3 = g.w3 LEFT JOIN tok_uni u ON u.w3 = g.w3"
    ),
    "tok_dev": "SELECT * FROM tok_probs WHERE split = 'dev'",
    "seq_grams": trigram_sql("seq"),
    "seq_tri": _seq_lm["tri"],
    "seq_bi": _seq_lm["bi"],
    "seq_uni": _seq_lm["uni"],
    "seq_probs": (
        "SELECT g.*, t.n AS n3, b.n AS n2, u.n AS n1, t.p3, b.p2, u.p1 FROM seq_grams g "
        "LEFT JOIN seq_tri t ON t.w1 = g.w1 AND t.w2 = g.w2 AND t.w3 = g.w3 "
        "LEFT JOIN seq_bi b ON b.w2 = g.w2 AND b.w3 = g.w3 LEFT JOIN seq_uni u ON u.w3 = g.w3 WHERE g.split = 'dev'"
    ),
    # Tag counts of the training sequences.
    "hmm_tri": (
        "SELECT t1, t2, t3, count(*) AS n FROM (SELECT coalesce(lag(tag, 2) OVER w, '<START>') AS t1, "
        "coalesce(lag(tag) OVER w, '<START>') AS t2, tag AS t3 FROM (SELECT src_id, seg, pos, tag FROM seq WHERE split = 'train' "
        "UNION ALL SELECT src_id, seg, max(pos) + 1, '<STOP>' FROM seq WHERE split = 'train' GROUP BY src_id, seg) "
        "WINDOW w AS (PARTITION BY src_id, seg ORDER BY pos)) GROUP BY t1, t2, t3"
    ),
    "hmm_bi": (
        "SELECT t2, t3, sum(n) AS n FROM (SELECT t2, t3, n FROM hmm_tri UNION ALL SELECT '<START>', '<START>', "
        "(SELECT count(*) FROM (SELECT DISTINCT src_id, seg FROM seq WHERE split = 'train'))) GROUP BY t2, t3"
    ),
    "hmm_uni": "SELECT t3, sum(n) AS n FROM hmm_bi GROUP BY t3",
    "hmm_total": "SELECT sum(n) AS n FROM hmm_uni WHERE t3 <> '<START>'",
    "hmm_emit": "SELECT word, tag, count(*) AS n FROM seq WHERE split = 'train' GROUP BY word, tag",
    "hmm_tag": "SELECT tag, sum(n) AS n FROM hmm_emit GROUP BY tag",
    "seq_tags": "SELECT CAST(row_number() OVER (ORDER BY tag) - 1 AS INTEGER) AS class_id, tag FROM (SELECT DISTINCT tag FROM seq)",
    "seq_ctx": context_sql("seq"),
    "seq_feats": features_sql("seq_ctx"),
    "tok_ctx": context_sql("tok"),
    "tok_feats": features_sql("tok_ctx"),
    "teacher_w": weights_sql(_train),
    "teacher_b": bias_sql("(SELECT * FROM seq WHERE split = 'train')"),
    "student_w": weights_sql(_half),
    "student_b": bias_sql(f"(SELECT * FROM seq WHERE split = 'train' AND {_half_key})"),
    "eval_feats": "SELECT * FROM seq_feats WHERE split <> 'train'",
    "teacher_z": score_sql("eval_feats", "teacher_w", "teacher_b"),
    "student_z": score_sql("eval_feats", "student_w", "student_b"),
    "student_all": score_sql("seq_feats", "student_w", "student_b"),
    "teacher_all": score_sql("seq_feats", "teacher_w", "teacher_b"),
    "student_pa": softmax_sql("student_all", "src_id, seg, pos"),
    "teacher_pa": softmax_sql("teacher_all", "src_id, seg, pos"),
    "teacher_p": softmax_sql("teacher_z", "src_id, seg, pos"),
    "student_p": softmax_sql("student_z", "src_id, seg, pos"),
    "seq_norm": (
        f"SELECT v.word, CASE WHEN v.n >= {MIN_FREQ} THEN v.word ELSE {class_sql('v.word', True, 'l.word IS NOT NULL')} END AS as_first, "
        f"CASE WHEN v.n >= {MIN_FREQ} THEN v.word ELSE {class_sql('v.word', False, '')} END AS as_later FROM "
        "(SELECT word, count(*) FILTER (split = 'train') AS n FROM seq GROUP BY word) v LEFT JOIN "
        f"(SELECT word FROM seq WHERE split = 'train' GROUP BY word HAVING count(*) >= {MIN_FREQ}) l ON l.word = {lower_sql('v.word')}"
    ),
    "seq_pre": (
        "SELECT t.src_id, t.seg, t.pos, t.split, t.tag, CASE WHEN t.pos = 0 THEN n.as_first ELSE n.as_later END AS word "
        "FROM seq t JOIN seq_norm n ON n.word = t.word"
    ),
    "seq_top": "SELECT word FROM seq_pre WHERE split = 'train' GROUP BY word ORDER BY count(*) DESC, word LIMIT 60",
    "seq_allow": (
        f"SELECT CASE WHEN k.word IS NOT NULL THEN t.word WHEN t.pos = 0 THEN {class_sql('t.word', True, 'l.word IS NOT NULL')} "
        f"ELSE {class_sql('t.word', False, '')} END AS word FROM seq t LEFT JOIN seq_top k ON k.word = t.word "
        f"LEFT JOIN seq_top l ON l.word = {lower_sql('t.word')}"
    ),
    "bench_tok": (
        "SELECT src_id, seg, split, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos, '' AS tag FROM bench_sent"
    ),
    "bench_ctx": context_sql("bench_tok"),
    "bench_feats": features_sql("bench_ctx"),
    "seq_pre_ctx": context_sql("seq_pre"),
    "seq_pre_feats": features_sql("seq_pre_ctx"),
    "flag_names": "SELECT unnest([" + ", ".join(f"'{f}'" for f in FLAG_NAMES) + "]) AS feature",
    "feat_vocab": (
        "SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS idx FROM "
        "(SELECT feature FROM seq_feats WHERE split IN ('train', 'dev') UNION SELECT feature FROM flag_names)"
    ),
    "emb": (
        "SELECT vec_id, label, unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) - 1 AS class_id FROM embeddings"
    ),
    "emb_p": softmax_sql("emb", "vec_id"),
}
