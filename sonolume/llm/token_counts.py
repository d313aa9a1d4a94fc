"""Token counts from per-document pre-token frequencies and one count a distinct pre-token."""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import common_floor, first_row_key, materialize, row_keys

#: Pre-tokens sent to every executor: at most so many, none longer than HEAD_BYTES, so below 20 MB whatever the corpus.
HEAD_WORDS = 200_000
HEAD_BYTES = 64
#: A task emits its partial vocabulary when it holds so many distinct words.
FLUSH_WORDS = 400_000


def _vocabulary(batches):
    seen: Counter = Counter()

    def flush():
        out = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "freq"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            if (t := text.as_py()) is not None:
                seen.update(t.split())
                if len(seen) > FLUSH_WORDS:
                    yield flush()
    if seen:
        yield flush()


def _pieces(path: str | None, name: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        else:
            tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            words = [w.decode() for w in batch.column("word").to_pylist()]
            counts = []
            for i in range(0, len(words), 2000):
                counts += [len(e) for e in tokenizer.encode_batch_fast(words[i : i + 2000], add_special_tokens=False)]
            yield pa.record_batch([batch.column("word"), batch.column("freq"), pa.array(counts, pa.int64())], ["word", "freq", "pieces"])

    return run


def _frequencies(head, id_type):
    names = ["doc_id", "row", "n_bytes", "word", "n"]

    def run(batches):
        known = head.value
        for batch, key in row_keys(batches, first_row_key()):
            ids, rows, sizes, words, counts = [], [], [], [], []
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                text, total = text.as_py() or b"", 0
                rest = []
                for word, n in Counter(text.split()).items():
                    pieces = known.get(word)
                    if pieces is None:
                        rest.append((word, n))
                    else:
                        total += n * pieces
                # The document's own row: a word that no text can hold (not UTF-8) keeps it apart from real words.
                for word, n in ((b"\xff" + (key + i).to_bytes(8, "big"), total), *rest):
                    ids.append(doc)
                    rows.append(key + i)
                    sizes.append(len(text))
                    words.append(word)
                    counts.append(n)
                if len(ids) > 200_000:
                    yield pa.record_batch([pa.array(ids, id_type), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names)
                    ids, rows, sizes, words, counts = [], [], [], [], []
            if ids:
                yield pa.record_batch([pa.array(ids, id_type), pa.array(rows, pa.int64()), pa.array(sizes, pa.int64()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names)

    return run


def token_counts(docs: DataFrame, limit: int = 2048, tokenizer_path: str | None = None, tokenizer_name: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    The tokenizer drops white space and never joins over it, so pre-tokens are the words between ASCII white space. Each
    distinct word is tokenised once. Documents are turned into word frequencies; the commonest words (a bounded table)
    are counted in place, the others by a join with the whole word table. No id sequence of a text is built.

    Null text: 0 bytes, 0 tokens. Repeated rows and ids: one result each. Empty table: no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    vocabulary = base.select("text").mapInArrow(_vocabulary, "word binary, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))
    table = materialize(vocabulary.mapInArrow(_pieces(tokenizer_path, tokenizer_name), "word binary, freq long, pieces long"), "pieces")
    floor = common_floor(table.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0], head_words)
    top = table.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("freq") >= floor)).orderBy(F.desc("freq"), "word").limit(head_words).select("word", "pieces", "freq").toArrow()
    least = min(top["freq"].to_pylist(), default=0) if top.num_rows == head_words else None
    head = spark.sparkContext.broadcast(dict(zip(top["word"].to_pylist(), top["pieces"].to_pylist())))
    counted = base.mapInArrow(_frequencies(head, pa.int64()), "doc_id long, row long, n_bytes long, word binary, n long")
    # Words outside the head: those at most as common as its last or below the floor, and the long ones.
    rest = table.where((F.col("freq") <= F.lit(least) if least is not None else F.col("freq") < floor) | (F.octet_length("word") > HEAD_BYTES))
    total = F.sum(F.col("n") * F.coalesce("pieces", F.lit(1)))
    return (
        counted.join(rest.select("word", "pieces"), "word", "left")
        .groupBy("doc_id", "row")
        .agg(F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
