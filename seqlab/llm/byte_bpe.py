"""Byte-level BPE with the tokenizers library over Arrow batches, and the way back.

A rank file (base64 token and rank per line) becomes a byte-level BPE model: every byte has a
printable stand-in character, every token a string of them, and every split of a token into two
tokens a merge in the order of the ranks. Texts are encoded whole; offsets of ids are found by
their byte lengths and the byte-to-character map of the text. Decoding reverses the stand-in
table and joins bytes, so that a character split over several ids comes back whole.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from seqlab.llm.arrow_text import buffers, list_array, slices
from seqlab.llm.chunk_encoder import ChunkEncoder

#: UTF-8 forms of white space outside ASCII, and the ASCII controls that some patterns count.
_WIDE_BLANKS = [
    *(bytes([b]) for b in range(0x1C, 0x20)),
    *(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B))),
    *(chr(c).encode() for c in (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)),
]
_LEADS = np.zeros(256, bool)
_LEADS[[b[0] for b in _WIDE_BLANKS]] = True


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Visible Latin-1 characters stand for themselves, the others follow from U+0100 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one rank file; built once per Python worker."""

    def __init__(self, ranks_text: bytes, pattern: str) -> None:
        lines = (line.split() for line in ranks_text.splitlines() if line)
        ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        stand_in = byte_characters()
        vocab = {"".join(stand_in[b] for b in token): rank for token, rank in ranks.items()}
        merges = [
            ("".join(stand_in[b] for b in token[:k]), "".join(stand_in[b] for b in token[k:]))
            for token in sorted(ranks, key=ranks.__getitem__)
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        byte_of = {c: b for b, c in enumerate(stand_in)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in vocab.items():
            self.tokens[rank] = bytes(byte_of[c] for c in token)
        self.token_bytes = np.array([len(t) for t in self.tokens])
        self.digits = [str(k) for k in range(len(self.tokens))]
        self.by_chunk = ChunkEncoder(self._ids)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each text."""
        data, offsets = buffers(texts)
        wide = np.zeros(len(texts), bool)
        leads = np.flatnonzero(_LEADS[data])
        if len(leads):
            raw = data.tobytes()
            found = [at for at in leads.tolist() if _wide_blank(raw, at)]
            wide[np.searchsorted(offsets, found, "right") - 1] = True
        if not wide.any():
            return self.by_chunk(data, offsets)
        # A run of mixed white space may be one piece, so such texts are not cut into chunks.
        ids, counts = [], np.zeros(len(texts), np.int64)
        for k, (start, stop) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            own = data[start:stop]
            if wide[k]:
                ids.append(np.array(self._ids([own.tobytes().decode()])[0], np.int32))
            else:
                ids.append(self.by_chunk(own, np.array([0, len(own)]))[0])
            counts[k] = len(ids[-1])
        return np.concatenate(ids), counts

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def _wide_blank(raw: bytes, at: int) -> bool:
    return any(raw.startswith(blank, at) for blank in _WIDE_BLANKS)


@lru_cache(maxsize=2)
def _codec(ranks_text: bytes, pattern: str) -> Codec:
    return Codec(ranks_text, pattern)


def _codec_of(ranks_file: str, pattern: str) -> Callable[[], Codec]:
    """Reads the file here and takes its content to the executors."""
    with open(ranks_file, "rb") as f:
        content = f.read()
    return lambda: _codec(content, pattern)


def character_spans(
    data: np.ndarray, offsets: np.ndarray, byte_lengths: np.ndarray, counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character of every id in its own text.

    An id that holds only a part of a character has that character as its span.
    """
    ends = np.cumsum(byte_lengths)
    starts = ends - byte_lengths
    first_of_char = (data & 0xC0) != 0x80
    seen = np.concatenate([[0], np.cumsum(first_of_char)])  # characters that begin before a byte
    base = np.repeat(seen[offsets[:-1]], counts)
    return seen[starts + 1] - 1 - base, seen[ends] - base


def encode(docs: DataFrame, ranks_file: str, pattern: str, offsets: bool = True) -> DataFrame:
    """doc_id, ids and, if asked for, starts and ends of every id in characters.

    A null text counts as empty and has no ids; repeated rows stay repeated; a null ``doc_id``
    stays null; other columns are ignored; an empty table gives an empty one.
    """
    codec_of = _codec_of(ranks_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for piece, texts in slices(batches):
            ids, counts = codec.encode(texts)
            columns = [piece.column(0), list_array(ids, counts, pa.int32())]
            if offsets:
                lengths = codec.token_bytes[ids]
                for side in character_spans(*buffers(texts), lengths, counts):
                    columns.append(list_array(side, counts, pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "ids", "starts", "ends"][: 4 if offsets else 2]
    schema = ", ".join(["doc_id long", *(f"{n} array<int>" for n in names[1:])])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id, the decoded bytes and their text; bytes that are no UTF-8 become U+FFFD in it.

    Null ids count as none.
    """
    codec_of = _codec_of(ranks_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for batch in batches:
            raw = [codec.decode(x or []) for x in batch.column(1).to_pylist()]
            text = [x.decode("utf-8", "replace") for x in raw]
            columns = [batch.column(0), pa.array(raw, pa.binary()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "bytes", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary, text string")


def round_trip(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Encode and decode every whole text in one pass and return digests of both sides.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the
    decoded bytes). Nulls, repeated rows and empty tables as in :func:`encode`.
    """
    codec_of = _codec_of(ranks_file, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of()
        for piece, texts in slices(batches):
            ids, counts = codec.encode(texts)
            flat, ends = ids.tolist(), np.cumsum(counts).tolist()
            id_hash, text_hash = [], []
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                own = flat[start:end]
                joined = ",".join([codec.digits[i] for i in own])
                id_hash.append(sha256(joined.encode()).hexdigest())
                text_hash.append(sha256(codec.decode(own)).hexdigest())
            columns = [piece.column(0), pa.array(counts), pa.array(id_hash), pa.array(text_hash)]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
