import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from seqlab.llm import byte_bpe, token_files
from seqlab.llm.arrow_text import slices
from seqlab.session import work_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "The cat's here, isn't it?  Yes!!\n\n It's 12 o'clock\t. ",
    "ÉTÉ été é H̱ 中文 🙂🙂 a   b   c",
    "x" * 3000 + " " + "=" * 500,
    "<|endoftext|> in a text <|startoftext|>and on",
    "",
    None,
    " ",
    "we'll they're 'tis ''s a''s !'s",
]


def mixed(rng, n):
    letters = " \n\t'stabEXY!.,-=#é　中🙂0123́\x1c\x85"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = TEXTS + mixed(random.Random(1), 400)
    return list(enumerate(texts)) + [(3, texts[0]), (3, texts[0]), (None, "no id")]


def frame(spark, rows):
    return spark.createDataFrame([(t, d, 7) for d, t in rows], "text string, doc_id long, part int")


def test_token_files(spark, rows):
    path = work_path(spark, "token_test")
    token_files.write_tokens(frame(spark, rows), path, WORDS)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    plain = Tokenizer.from_file(WORDS)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    assert len(got) == len(order)
    for r, (d, text) in zip(got, order):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (d, start, len(ids), ids)
        start += len(ids)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.with_crc(token_files.read_tokens(spark, path)).collect()}
    for r in got:
        assert crc[(r.doc_id, r.start)] == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    picked = token_files.pick_documents(spark, path, [5, 9]).collect()
    assert sorted(r.doc_id for r in picked) == [5, 9]


def test_files_are_in_order(spark, rows):
    from pyarrow import orc

    path = work_path(spark, "token_order")
    token_files.write_tokens(frame(spark, rows), path, WORDS)
    seen = []
    for name in sorted(p for p in spark.read.orc(path).inputFiles()):
        seen += orc.ORCFile(name.removeprefix("file://")).read(["doc_id"]).column(0).to_pylist()
    assert [s for s in seen if s is not None] == sorted(s for s in seen if s is not None)


def test_byte_bpe_is_that_of_the_ranks(spark, rows):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.round_trip(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for d, text in rows:
        ids = plain.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want.append((d, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_offsets_and_split_characters(spark):
    texts = [t for t in TEXTS if t] + ["\U0001f9ffஹ ཀ"]
    docs = frame(spark, list(enumerate(texts)))
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    with open(RANKS, "rb") as f:
        codec = byte_bpe.Codec(f.read(), public_tokenizers.PATTERN)
    split = 0
    for r in encoded.collect():
        text, at = texts[r.doc_id], 0
        for i, a, b in zip(r.ids, r.starts, r.ends):
            token = codec.tokens[i]
            own = text[a:b].encode()
            before = len(text[:a].encode())
            assert own[at - before : at - before + len(token)] == token
            split += own != token
            at += len(token)
        assert at == len(text.encode())
    assert split > 0
    back = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))


def test_empty_tables(spark, rows):
    none = frame(spark, rows).limit(0)
    path = work_path(spark, "token_none")
    token_files.write_tokens(none, path, WORDS)
    assert token_files.with_crc(token_files.read_tokens(spark, path)).count() == 0
    assert byte_bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encode(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_slices_hold_whole_texts():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 5, None, "b" * 50, "c", ""]})
    pieces = [t.to_pylist() for _, t in slices(iter([batch]), limit=10)]
    assert pieces == [["a" * 5, ""], ["b" * 50], ["c", ""]]
