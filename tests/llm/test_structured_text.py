"""Texts whose patterns cancel out in polynomial hashes: Thue-Morse words and their complements."""

import base64
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from seqlab.llm import arrow_text, byte_bpe, line_dedup, lz_dedup, signature_tree, token_files
from seqlab.session import work_path

FLIP = str.maketrans("ab", "ba")


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(FLIP)
    return word


ONE = thue_morse(2048)
TWO = ONE.translate(FLIP)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_hashes_differ_for_every_seed():
    for n in (1024, 2048, 4096):
        data, offsets = arrow_text.buffers(pa.array([thue_morse(n), thue_morse(n).translate(FLIP)]))
        starts, ends, _ = arrow_text.word_bounds(data, offsets)
        for seed in range(5):
            one, two = arrow_text.word_hashes(data, starts, ends, seed)
            assert one != two
    letters = np.array([3 if c == "a" else 8 for c in ONE + TWO], np.uint64)
    for seed in range(3):
        hashes = arrow_text.window_hashes(letters, 2048, seed)
        assert hashes[0] != hashes[2048]


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    data, offsets = arrow_text.buffers(pa.array(["a bc " + "x" * 700 + " d", "", ONE + " é " + TWO]))
    starts, ends, _ = arrow_text.word_bounds(data, offsets)
    whole = arrow_text.word_hashes(data, starts, ends)
    for size in (1, 7, 300):
        monkeypatch.setattr(arrow_text, "BLOCK", size)
        assert (arrow_text.word_hashes(data, starts, ends) == whole).all()
    alone = [arrow_text.buffers(pa.array([data[a:b].tobytes().decode()])) for a, b in zip(starts, ends)]
    own = [arrow_text.word_hashes(d, np.array([0]), np.array([len(d)]))[0] for d, _ in alone]
    assert own == whole.tolist()


def test_token_ids(spark):
    path = work_path(spark, "structured")
    plain = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(frame(spark, [ONE, TWO]), path, plain)
    got = {r.doc_id: r.ids_crc32 for r in token_files.with_crc(token_files.read_tokens(spark, path)).collect()}
    encode = Tokenizer.from_file(plain).encode
    for k, text in enumerate([ONE, TWO]):
        ids = encode(text, add_special_tokens=False).ids + [2]
        assert got[k] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_bpe(spark):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(frame(spark, [ONE, TWO]), ranks, public_tokenizers.PATTERN)
    with open(ranks, "rb") as f:
        own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={})
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {
        0: plain.encode_ordinary(ONE), 1: plain.encode_ordinary(TWO)
    }
    back = byte_bpe.decode(encoded, ranks, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {0: ONE, 1: TWO}


def test_words_are_not_removed(spark):
    rows = lz_dedup.remove(frame(spark, [" ".join([w] * 20) for w in (ONE, TWO)])).collect()
    assert [r.n_removed for r in rows] == [0, 0]
    by_letter = [" ".join(w) for w in (ONE, TWO)]
    rows = lz_dedup.remove(frame(spark, by_letter), 1500).collect()
    assert [r.n_removed for r in rows] == [0, 0]


def test_lines_are_not_removed(spark):
    texts = ["\n".join(w + str(k) for k in range(3)) for w in (ONE, TWO)]
    rows = line_dedup.dedup(frame(spark, texts)).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in rows} == {0: (texts[0], 0), 1: (texts[1], 0)}


def test_documents_are_not_linked(spark):
    texts = [" ".join([w, w + "x", w + "y", w, w + "z"]) for w in (ONE, TWO)]
    rows = signature_tree.similar(frame(spark, texts), 4, 85).collect()
    assert {r.doc_id: r.component_id for r in rows} == {0: 0, 1: 1}
