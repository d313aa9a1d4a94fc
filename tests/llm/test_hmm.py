import math
import random
import zlib
from collections import Counter

import numpy as np

from sonolume.llm import hmm

from .fixtures import awkward_docs, no_docs


def plain_forward(ids, start, move, emit):
    state, total = start, 0.0
    for t, i in enumerate(ids):
        state = (state if t == 0 else state @ move) * emit[i]
        total += math.log10(state.sum())
        state = state / state.sum()
    return total


def random_model(rng, symbols, states):
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0)


def test_recursions_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    start, move, emit = random_model(rng, 4, 3)
    seqs = [rng.integers(0, 4, n) for n in (1, 4, 3, 4, 2)]
    ids, lengths = np.concatenate(seqs), np.array([len(s) for s in seqs])
    starts, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    logs = []
    for s in seqs:
        paths = {}
        for path in itertools.product(range(3), repeat=len(s)):
            p = start[path[0]] * emit[s[0], path[0]]
            for a, b, i in zip(path, path[1:], s[1:]):
                p *= move[a, b] * emit[i, b]
            paths[path] = p
        total = sum(paths.values())
        logs.append(math.log10(total))
        for path, p in paths.items():
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / total
            for i, k in zip(s, path):
                emitted[i, k] += p / total
    assert np.allclose(hmm.forward(ids, lengths, start, move, emit), logs)
    got = hmm.expected_counts(ids, lengths, start, move, emit)
    assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2], emitted)


def brute_base(rows):
    token_lists = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, (t or "").encode().lower().split() + [None]) for i, t in rows]
    c = Counter(w for _, held, ws in token_lists if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, held, ws in token_lists]


def test_counts_and_base(spark):
    df, rows = awkward_docs(spark)
    for head, classes in ((30_000, 4096), (8, 16), (8, 1)):
        got = hmm.hmm_scores(df, states=2, rounds=1, head_words=head, classes=classes).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
        a = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
        for x, y in zip(a, sorted(brute_base(rows), key=key), strict=True):
            assert x[:5] == y[:5] and math.isclose(x[5], y[5], rel_tol=1e-9)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_single_state_is_a_unigram_distribution(spark):
    """With one state the score of a one-word text is its probability; over all words and one unseen these add up to 1."""
    held = [i for i in range(100, 400) if zlib.crc32(str(i).encode()) % 5 == 1][:8]
    rows = [(i, "a b c d e f a b a") for i in range(20)] + list(zip(held, ["a", "b", "c", "d", "e", "f", "never", ""]))
    got = {r.doc_id: r.score for r in hmm.hmm_scores(spark.createDataFrame(rows, "doc_id long, text string"), states=1, rounds=2, head_words=3, classes=1).collect()}
    end = 10 ** got[held[7]]
    assert math.isclose(sum(10 ** got[held[k]] / end for k in range(7)) + end, 1, rel_tol=1e-6)


def plain_training(texts, states, rounds, classes):
    """Baum-Welch sequence by sequence, on whole texts whose words are all in the head; the model and the words' symbols."""
    lists = [t.encode().lower().split() for t in texts]
    freq = Counter(w for ws in lists for w in ws)
    names = sorted(freq, key=lambda w: (-freq[w], w))
    symbol = {w: i for i, w in enumerate(names)}
    end = len(names) + classes
    unigram = np.array([freq[w] for w in names] + [0] * classes + [len(texts)]) + 0.5
    unigram /= unigram.sum()
    start, move, emit = hmm.first_model(unigram, states)
    for _ in range(rounds):
        starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((end + 1, states))
        for ws in lists:
            ids = [symbol[w] for w in ws] + [end]
            alpha, beta = [start * emit[ids[0]]], [np.ones(states)]
            for i in ids[1:]:
                alpha.append(alpha[-1] @ move * emit[i])
            for i in ids[:0:-1]:
                beta.insert(0, move @ (emit[i] * beta[0]))
            total = alpha[-1].sum()
            starts += alpha[0] * beta[0] / total
            for t, i in enumerate(ids):
                emitted[i] += alpha[t] * beta[t] / total
                if t:
                    moves += np.outer(alpha[t - 1], emit[i] * beta[t]) * move / total
        start, move, emit = hmm.next_model(starts, moves, emitted, unigram)
    return symbol, end, start, move, emit


def test_score_equals_plain_training(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abcdefgh"[(i % 3) * 2 :], k=rng.randint(0, 30)))) for i in range(60)]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    symbol, end, *model = plain_training([t for i, t in rows if not held(i)], 3, 3, 8)
    got = {r.doc_id: r.score for r in hmm.hmm_scores(spark.createDataFrame(rows, "doc_id long, text string"), states=3, rounds=3, classes=8).collect()}
    for i, t in rows:
        assert math.isclose(got[i], plain_forward([symbol[w] for w in t.encode().split()] + [end], *model), rel_tol=1e-7), i


def test_pieces_with_context_count_as_whole_texts():
    rng = np.random.default_rng(4)
    start, move, emit = random_model(rng, 50, 4)
    texts = [rng.integers(0, 50, n) for n in (1, 255, 256, 257, 288, 1000, 2500)]
    want = hmm.expected_counts(np.concatenate(texts), np.array([len(t) for t in texts]), start, move, emit)
    got = hmm.piece_counts([p for t in texts for p in hmm.pieces(t)], start, move, emit)
    assert sum(hi - lo for t in texts for _, lo, hi, _ in hmm.pieces(t)) == sum(map(len, texts))
    assert all(np.allclose(a, b, rtol=1e-6, atol=1e-6) for a, b in zip(got, want))
    assert math.isclose(got[0].sum(), len(texts)) and math.isclose(got[1].sum(), sum(len(t) - 1 for t in texts)) and math.isclose(got[2].sum(), sum(map(len, texts)))


def test_long_words_and_rows_over_the_batch(spark, monkeypatch):
    rows = [(i, "-" * 50_000 + " a b") for i in range(6)] + [(9, "x " * 3000)]
    got = hmm.hmm_scores(spark.createDataFrame(rows, "doc_id long, text string"), states=2, rounds=1).collect()
    assert len(got) == 7 and all(math.isfinite(r.score) for r in got)


def test_states_help_on_held_out_texts(spark):
    rng = random.Random(0)
    tongues = [[f"{t}{k}" for k in range(40)] for t in "xyz"]
    rows = [(i, " ".join(rng.choices(tongues[i % 3], k=60))) for i in range(600)]
    got = [r for r in hmm.hmm_scores(spark.createDataFrame(rows, "doc_id long, text string"), states=4, rounds=8).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 10 * len(got)


def test_empty(spark):
    assert hmm.hmm_scores(no_docs(spark)).count() == 0
