"""Hidden Markov language model: Baum-Welch over partitions, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import common_floor, count_words, first_row_key, materialize, row_keys

#: Words with emission probabilities of their own (with K states: a table of fixed size), of HEAD_BYTES together at most.
HEAD_WORDS = 30_000
HEAD_BYTES = 4_000_000
#: All other words are dealt by hash into so many classes (a power of 2), each with emission probabilities of its own and
#: exact counts of its words.
CLASSES = 4096
STATES = 6
ROUNDS = 5
#: For training, texts are read in pieces of SEGMENT tokens, so that one step of the recursion serves many of them. Each sees
#: CONTEXT tokens of its text on both sides, in which the chain forgets where it was cut; scores use whole texts.
SEGMENT = 256
CONTEXT = 32
BATCH_TOKENS = 300_000
HASH_SEED = 42  # that of Spark's xxhash64


class Symbols(dict):
    """Symbols by word: those of the head, and the classes of the last other words seen."""

    def __init__(self, head: dict, classes: int):
        super().__init__(head)
        self.rare, self.mask, self.seen = len(head), classes - 1, {}

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = self.seen.get(word)
        if found is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            found = self.seen[word] = self.rare + (xxhash.xxh64_intdigest(word, HASH_SEED) & self.mask)
        return found


def _encode(head, classes: int, kind):
    def run(batches):
        symbols = Symbols(head.value, classes)
        rare, end = symbols.rare, np.array([symbols.rare + classes], kind)
        for batch, key in row_keys(batches, first_row_key()):
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids, sizes, words, freqs = [], [], [], []
                for text in part.column("text"):
                    tokens = (text.as_py() or b"").lower().split()
                    found = np.fromiter(map(symbols.__getitem__, tokens), kind, len(tokens))
                    tail = Counter([tokens[k] for k in np.flatnonzero(found >= rare).tolist()])
                    ids.append(np.concatenate([found, end]).tobytes())
                    sizes.append(len(found) + 1)
                    words.append(list(tail))
                    freqs.append(list(tail.values()))
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(range(key + lo, key + lo + part.num_rows), pa.int64()), part.column("held_out"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(words, pa.list_(pa.binary())), pa.array(freqs, pa.list_(pa.int64()))],
                    ["doc_id", "row", "held_out", "n_tokens", "ids", "words", "freqs"],
                )

    return run


def time_major(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences put end to end: their order by length (longest first), each token's place when all first tokens come
    first, then all second ones and so on, and where each step begins."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    active = np.bincount(lengths, minlength=lengths.max() + 1)[::-1].cumsum()[::-1][1:]
    begins = np.concatenate([[0], np.cumsum(active)])
    step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return order, begins[step] + np.repeat(rank, lengths), begins


def forward(ids: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 probability of every sequence; emit is symbols x states."""
    order, place, begins = time_major(lengths)
    by_step = np.empty(len(ids), np.int64)
    by_step[place] = ids
    total = np.zeros(len(lengths))
    state = None
    for a, b in zip(begins[:-1], begins[1:]):
        n = b - a
        state = (start if state is None else state[:n] @ move) * emit[by_step[a:b]]
        norm = state.sum(axis=1)
        state /= norm[:, None]
        total[:n] += np.log10(norm)
    out = np.empty(len(lengths))
    out[order] = total
    return out


def expected_counts(ids, lengths, start, move, emit, counted=None, whole=None):
    """Sums over all sequences of the expected starts (K), moves (K x K) and emissions (symbols x K).

    counted: whether a token (and the move to it) counts or is context only. whole: whether a sequence begins where its text
    does; others begin in the steady state of the moves and give no start. By default all are.
    """
    order, place, begins = time_major(lengths)
    by_step, weight = np.empty(len(ids), np.int64), np.ones((len(ids), 1))
    by_step[place] = ids
    if counted is not None:
        weight[place, 0] = counted
    first = np.ones(len(lengths), bool) if whole is None else whole[order]
    entry = np.where(first[:, None], start, np.linalg.matrix_power(move, 1024)[0])
    seen = emit[by_step]
    alpha, norms = np.empty_like(seen), np.empty(len(ids))
    steps = list(zip(begins[:-1], begins[1:]))
    for t, (a, b) in enumerate(steps):
        n = b - a
        x = (entry if t == 0 else alpha[steps[t - 1][0] : steps[t - 1][0] + n] @ move) * seen[a:b]
        norms[a:b] = x.sum(axis=1)
        alpha[a:b] = x / norms[a:b, None]
    moves = np.zeros_like(move)
    beta = np.ones((steps[-1][1] - steps[-1][0], len(start)))
    gamma = np.empty_like(alpha)
    for t in range(len(steps) - 1, -1, -1):
        a, b = steps[t]
        gamma[a:b] = alpha[a:b] * beta
        if t:
            p = steps[t - 1][0]
            ahead = seen[a:b] * beta / norms[a:b, None]
            moves += alpha[p : p + b - a].T @ (ahead * weight[a:b])
            before = np.ones((a - p, len(start)))
            before[: b - a] = ahead @ move.T
            beta = before
    starts = gamma[: steps[0][1]][first].sum(axis=0)
    gamma *= weight
    emitted = np.stack([np.bincount(by_step, weights=gamma[:, k], minlength=len(emit)) for k in range(len(start))], axis=1)
    return starts, moves * move, emitted


def pieces(ids: np.ndarray):
    """(tokens, where the counted ones begin and end, whether it begins the text) of every piece of a text."""
    for k in range(0, len(ids), SEGMENT):
        lo, end = max(0, k - CONTEXT), min(len(ids), k + SEGMENT)
        yield ids[lo : end + CONTEXT], k - lo, end - lo, lo == 0


def piece_counts(found: list, start, move, emit):
    lengths = np.array([len(p[0]) for p in found])
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    lo, hi = (np.repeat(np.array([p[k] for p in found]), lengths) for k in (1, 2))
    return expected_counts(np.concatenate([p[0] for p in found]), lengths, start, move, emit, (at >= lo) & (at < hi), np.array([p[3] for p in found]))


def _expectations(model, states: int, kind):
    names = ["symbol", *(f"g{k}" for k in range(states))]

    def run(batches):
        start, move, emit = model.value
        sums = None
        waiting: list = []
        size = 0

        def add(sums):
            found = piece_counts(waiting, start, move, emit)
            return found if sums is None else tuple(x + y for x, y in zip(sums, found))

        for batch in batches:
            for raw in batch.column(0):
                for piece in pieces(np.frombuffer(raw.as_py(), kind)):
                    waiting.append(piece)
                    size += len(piece[0])
                    if size >= BATCH_TOKENS:
                        sums, waiting, size = add(sums), [], 0
        if waiting:
            sums = add(sums)
        if sums is not None:
            table = np.concatenate([sums[2], sums[0][None], sums[1]])
            symbols = np.nonzero(table.sum(axis=1) > 0)[0]
            yield pa.record_batch([pa.array(symbols, pa.int32()), *(pa.array(table[symbols, k]) for k in range(states))], names)

    return run


def first_model(unigram: np.ndarray, states: int, seed: int = 7):
    """States that stay, each with the unigram distribution shaken by a fixed random factor."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.gamma(2.0, 0.5, (len(unigram), states))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), move, emit / emit.sum(axis=0)


def next_model(starts, moves, emitted, unigram):
    """Maximisation with a little prior: 10 tokens of the unigram distribution a state, one move and one start each."""
    starts, moves, emitted = starts + 1, moves + 1, emitted + 10 * unigram[:, None]
    return starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0)


def _scores(model, base, rare: int, kind):
    """Scores of rows, as many at once as have BATCH_TOKENS together."""

    def run(batches):
        start, move, emit = model.value
        for batch in batches:
            before = np.cumsum(np.concatenate([[0], batch.column("n_tokens").to_numpy()]))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(before, before[lo] + BATCH_TOKENS, "right")) - 1)
                part, lo = batch.slice(lo, hi - lo), hi
                ids = [np.frombuffer(raw.as_py(), kind) for raw in part.column("ids")]
                score = forward(np.concatenate(ids), np.array([len(i) for i in ids]), start, move, emit)
                plain = base.value
                base_score = [float(plain[i].sum()) for i in ids]
                known = [int(((i < rare) | (i == len(plain) - 1)).sum()) for i in ids]
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("row"), part.column("held_out"), part.column("n_tokens"), pa.array(known, pa.int64()), pa.array(base_score), pa.array(score), part.column("words"), part.column("freqs")],
                    ["doc_id", "row", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "freqs"],
                )

    return run


def hmm_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, head_words: int = HEAD_WORDS, classes: int = CLASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row, by a model of the training rows.

    Training rows: crc32(id as text) mod 5 is not 1 (null id: of the empty text). All their tokens are counted and all take
    part in every Baum-Welch round; each partition sends its expected counts a symbol, which Spark sums, and the driver
    sees (head_words + classes + 2 + states) x states numbers. Symbols are the commonest words, classes of the other words by
    hash, and the end. Inside a class a word has probability (c + 0.5) / (its tokens + 0.5 * (its words + 1)), unseen words of
    the class together one more word: so the score is the log10 of a proper distribution. Words of classes are counted by a
    join. Null and blank texts: the end alone. Texts of any length are learnt from and scored whole. Repeated rows: one
    result each, all learnt from. Empty table: no rows.
    """
    if classes & (classes - 1):
        raise ValueError("classes must be a power of 2")
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    train = base.where(~F.col("held_out"))
    table = materialize(train.select("text").mapInArrow(count_words, "word binary, freq long").groupBy("word").agg(F.sum("freq").alias("freq")), "words")
    texts = train.select(F.lit(1)).count()
    words, tokens = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("freq"), F.lit(0))).first()
    total, distinct = tokens + texts, words + (texts > 0)
    # Of words too long for the head (a rule of a million dashes) a prefix comes to the driver, and they go to classes.
    top = table.where(F.col("freq") >= common_floor(tokens, head_words)).select(F.substring("word", 1, HEAD_BYTES // 100).alias("word"), "freq", F.octet_length("word").alias("bytes")).orderBy(F.desc("freq"), "word").limit(head_words).toArrow()
    sizes = np.array(top["bytes"].to_pylist(), np.int64)
    taken = (sizes <= HEAD_BYTES // 100) & (np.cumsum(sizes) <= HEAD_BYTES)
    freqs = np.array(top["freq"].to_pylist(), np.float64)[taken]
    names = [w for w, t in zip(top["word"].to_pylist(), taken.tolist()) if t]
    rare, end = len(freqs), len(freqs) + classes
    kind = np.uint16 if end < 1 << 16 else np.uint32
    head = spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})
    own_words = F.broadcast(spark.createDataFrame([(bytearray(w),) for w in names], "word binary"))
    class_of = lambda w: F.xxhash64(w).bitwiseAND(F.lit(classes - 1)).cast("int")
    tail = table.join(own_words, "word", "left_anti")
    class_tokens, class_words = np.zeros(classes), np.zeros(classes)
    for c, n, k in tail.groupBy(class_of("word").alias("class")).agg(F.sum("freq"), F.count(F.lit(1))).collect():
        class_tokens[c], class_words[c] = n, k

    coded = base.mapInArrow(_encode(head, classes, kind), "doc_id long, row long, held_out boolean, n_tokens long, ids binary, words array<binary>, freqs array<long>")
    coded = materialize(coded, "coded")
    unigram = np.concatenate([freqs, class_tokens, [texts]]) + 0.5
    unigram /= unigram.sum()
    model = first_model(unigram, states)
    sequences = coded.where(~F.col("held_out")).select("ids")
    shape = ", ".join(["symbol int", *(f"g{k} double" for k in range(states))])
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        sums = sequences.mapInArrow(_expectations(sent, states, kind), shape).groupBy("symbol").agg(*(F.sum(f"g{k}").alias(f"g{k}") for k in range(states))).toArrow()
        got = np.zeros((end + 1 + 1 + states, states))
        if sums.num_rows:
            got[sums["symbol"].to_numpy()] = np.stack([sums[f"g{k}"].to_numpy() for k in range(states)], axis=1)
        model = next_model(got[end + 1], got[end + 2 :], got[: end + 1], unigram)
        sent.unpersist()

    below = total + 0.5 * (distinct + 1)
    plain = np.concatenate([np.log10((freqs + 0.5) / below), np.zeros(classes), [np.log10((texts + 0.5) / below)]])
    scored = coded.mapInArrow(
        _scores(spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(plain), rare, kind),
        "doc_id long, row long, held_out boolean, n_tokens long, n_known long, base_score double, score double, words array<binary>, freqs array<long>",
    )
    # The document's own row comes as a word that no text holds, next to its words of classes.
    own = F.array(F.struct(F.concat(F.lit(b"\xff"), F.col("row").cast("string").cast("binary")).alias("words"), F.lit(0).cast("long").alias("freqs")))
    flat = scored.select("doc_id", "row", "held_out", "n_tokens", "n_known", "base_score", "score", F.explode(F.concat(own, F.arrays_zip("words", "freqs"))).alias("w"))
    first = lambda c, zero: F.when(F.col("w.freqs") == 0, F.col(c)).otherwise(F.lit(zero)).alias(c)
    flat = flat.select("doc_id", "row", "held_out", "n_tokens", first("n_known", 0), first("base_score", 0.0), first("score", 0.0), F.col("w.words").alias("word"), F.col("w.freqs").alias("n"))
    share = spark.createDataFrame([(k, float(t + 0.5 * (w + 1))) for k, (t, w) in enumerate(zip(class_tokens, class_words))], "class int, mass double")
    c = F.coalesce("freq", F.lit(0))
    end_known = 0 if texts else -1
    return (
        flat.join(tail, "word", "left")
        .withColumn("class", class_of("word"))
        .join(F.broadcast(share), "class")
        .groupBy("doc_id", "row", "held_out", "n_tokens")
        .agg(
            (F.sum("n_known") + F.sum(F.when(c > 0, F.col("n")).otherwise(0)) + end_known).alias("n_known"),
            F.sum(F.col("base_score") + F.col("n") * F.log10((c + 0.5) / below)).alias("base_score"),
            F.sum(F.col("score") + F.col("n") * F.log10((c + 0.5) / F.col("mass"))).alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    )
