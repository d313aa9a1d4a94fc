"""Byte-level BPE with a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoded pre-tokens that one task remembers, and the longest of them in characters.
CACHE_WORDS = 200_000
CACHE_LENGTH = 64


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by rank; ranks run from 0 without a gap."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model: piece id = rank, score = -rank, the unknown piece last, identity normalisation."""
    letters = byte_letters()
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encode texts to ids and back in one task."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece

        self.tokens = tokens
        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        letters = byte_letters()
        self.letters = {b: ord(c) for b, c in enumerate(letters)}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words, known = self.find(text), self.known
        missing = [w for w in set(words) if w not in known]
        extra = {}
        if missing:
            if len(known) > CACHE_WORDS:
                known.clear()
                missing = list(set(words))
            mapped = [w.encode().decode("latin-1").translate(self.letters) for w in missing]
            for w, ids in zip(missing, self.model.encode(mapped, out_type=int, num_threads=1)):
                (known if len(w) <= CACHE_LENGTH else extra)[w] = struct.pack(f"<{len(ids)}I", *ids)
        if extra:
            return b"".join([known[w] if w in known else extra[w] for w in words])
        return b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")])


def _codec(path: str | None, name: str, pattern: str | None) -> Codec:
    import public_tokenizers

    return Codec(read_ranks(path or public_tokenizers.path(name)), pattern or public_tokenizers.PATTERN)


def _digests(path, name, pattern):
    def run(batches):
        codec = _codec(path, name, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encoded(path, name, pattern):
    def run(batches):
        codec = _codec(path, name, pattern)
        for batch in batches:
            ids = [list(memoryview(codec.encode(t.as_py() or "")).cast("I")) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, ranks_path: str | None = None, ranks_name: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text. Null text: no ids. Repeated rows: one result each."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_encoded(ranks_path, ranks_name, pattern), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks_path: str | None = None, ranks_name: str = "byte_bpe_50k.tiktoken", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of every row's ids. Null ids: no bytes."""

    def run(batches):
        import public_tokenizers

        tokens = read_ranks(ranks_path or public_tokenizers.path(ranks_name))
        for batch in batches:
            out = [b"".join([tokens[i] for i in ids.as_py() or []]) for ids in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def round_trip_digests(docs: DataFrame, ranks_path: str | None = None, ranks_name: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row: texts are encoded and the ids decoded in one pass, row by row.

    Null and empty texts: no ids, digests of no bytes. Very long pre-tokens are encoded like others but not remembered.
    Repeated rows and ids: one result each. Empty table: no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_digests(ranks_path, ranks_name, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
