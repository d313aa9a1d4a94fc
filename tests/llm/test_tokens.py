import base64
import hashlib
import random
import struct
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sonolume.llm import byte_bpe
from sonolume.llm.token_counts import token_counts

from .fixtures import awkward_docs, no_docs


@pytest.mark.parametrize("head", [200_000, 5])
def test_counts_equal_the_library(spark, head):
    df, rows = awkward_docs(spark)
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    library.no_truncation()
    want = Counter()
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False))
        want[i, len((t or "").encode()), n, n > 100] += 1
    got = token_counts(df, limit=100, head_words=head).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_byte_bpe_equals_tiktoken(spark):
    df, rows = awkward_docs(spark)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want, lists = Counter(), Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        lists[i, tuple(ids)] += 1
    got = byte_bpe.round_trip_digests(df).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    encoded = byte_bpe.encode_documents(df)
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == lists
    back = byte_bpe.decode_documents(encoded).collect()
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back) == Counter((i, (t or "").encode()) for i, t in rows)


def test_byte_bpe_on_random_text():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe._codec(None, "byte_bpe_50k.tiktoken", None)
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(32, 126), rng.randint(0xA0, 0x2FF), rng.randint(0x3000, 0x4000), rng.randint(0x1F300, 0x1F6FF), 10, 32])) for _ in range(rng.randint(0, 60)))
        assert list(memoryview(codec.encode(text)).cast("I")) == library.encode_ordinary(text)
    long = "a" * 50_000 + "ab" * 30_000
    assert list(memoryview(codec.encode(long)).cast("I")) == library.encode_ordinary(long)


def test_empty(spark):
    assert token_counts(no_docs(spark)).count() == 0
    assert byte_bpe.round_trip_digests(no_docs(spark)).count() == 0
