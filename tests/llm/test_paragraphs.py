import random

import numpy as np
import pyarrow as pa
import pytest

from sonolume.llm import paragraphs
from sonolume.llm.paragraphs import MISS, PASSAGE, STEP, bands_for, chosen_windows, cut_text, remove_repeats, repeated_paragraphs, run_hashes

from .fixtures import awkward_docs, no_docs


def normal_form(line):
    return b" ".join(line.lower().split())


def shingles(line, width=5):
    w = line.split(b" ")
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def brute(rows, similarity=0.8, min_words=20):
    """{(id, text): (paragraphs, repeated, removed lines, keepers)} by comparing all pairs of paragraphs."""
    rows = list(dict.fromkeys(rows))
    items = []
    for i, t in rows:
        for n, line in enumerate((t or "").encode().split(b"\n")):
            form = normal_form(line)
            if len(form.split()) >= min_words:
                items.append((i, t, n, form, shingles(form)))
    label = list(range(len(items)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for x in range(len(items)):
        for y in range(x):
            a, b = items[x][4], items[y][4]
            if len(a & b) >= similarity * len(a | b):
                label[find(x)] = find(y)
    groups = {}
    for x in range(len(items)):
        groups.setdefault(find(x), []).append(items[x])
    out = {r: [0, 0, [], set()] for r in rows}
    for i, t, *_ in items:
        out[i, t][0] += 1
    for g in groups.values():
        if len(g) > 1:
            keeper = min(g, key=lambda e: (e[0] is not None, e[0] or 0, e[2]))
            for e in g:
                out[e[0], e[1]][1] += 1
                if e is not keeper:
                    out[e[0], e[1]][2].append(e[2])
                    out[e[0], e[1]][3].add(keeper[0])
    return {k: (a, b, sorted(c), sorted(d)) for k, (a, b, c, d) in out.items()}


@pytest.mark.parametrize("sent", [paragraphs.SENT_PARAGRAPHS, 3])
def test_against_all_pairs(spark, sent, monkeypatch):
    monkeypatch.setattr(paragraphs, "SENT_PARAGRAPHS", sent)
    df, rows = awkward_docs(spark, n=40)
    rng = random.Random(4)
    pool = [[f"p{k}w{rng.randint(0, 60)}" for _ in range(rng.choice([19, 20, 60, 90]))] for k in range(14)]
    more = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1])):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            lines.append((" " if rng.random() < 0.8 else "  ").join(w).upper() if rng.random() < 0.2 else " ".join(w))
        more.append((700 + i, "\n".join(lines)))
    all_docs = df.union(spark.createDataFrame([(i, t, *[None] * 8) for i, t in more], df.schema))
    rows = rows + more
    want = brute(rows)
    texts = {r.doc_id: r.text for r in spark.createDataFrame(more, "doc_id long, text string").collect()}
    got = repeated_paragraphs(all_docs, miss=1e-7, passage=9_999).collect()
    assert len(got) == len(want)
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, []).append((r.n_paragraphs, r.n_repeated, list(r.removed_lines), list(r.kept_in)))
    for (i, t), w in want.items():
        if i in texts:
            assert seen[i] == [w], i
    cleaned = {r.doc_id: r.text for r in remove_repeats(all_docs, miss=1e-7, passage=9_999).collect() if r.doc_id in texts}
    for i, t in texts.items():
        gone = set(want[i, t][2])
        assert cleaned[i] == "\n".join(line for n, line in enumerate(t.split("\n")) if n not in gone)


def test_bands():
    assert all((1 - 0.8**r) ** bands_for(0.8, r, 1e-3) <= 1e-3 for r in (1, 2, 3))


def test_registered_settings_find_pairs_near_the_limit(spark):
    """300 pairs of 60-word paragraphs with one word of each pair changed (similarity 51 / 61): MISS says under one is lost."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        other = list(words)
        other[rng.randint(10, 49)] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    found = repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed = 1").count()
    assert found >= 300 - max(2, 10 * 300 * MISS)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = {r.doc_id: (r.n_paragraphs, r.n_repeated, r.n_removed, list(r.kept_in)) for r in repeated_paragraphs(df).collect()}
    assert got == {1: (1, 1, 0, []), 2: (1, 1, 1, [1])}
    alone = repeated_paragraphs(df.where("doc_id = 1")).collect()
    assert [(r.n_paragraphs, r.n_repeated, r.n_shared) for r in alone] == [(1, 0, 0)]
    assert sorted((r.doc_id, r.text) for r in remove_repeats(df).collect()) == [(1, text), (1, text), (2, "")]


def test_chosen_windows():
    rng = np.random.default_rng(3)
    for step in (1, 2, 5, 18):
        x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        got = set(chosen_windows(x, step).tolist())
        padded = [None] * (step - 1) + list(x) + [None] * (step - 1)
        want = set()
        for j in range(len(padded) - step + 1):
            near = [(v, j + k - step + 1) for k, v in enumerate(padded[j : j + step]) if v is not None]
            want.add(min(near)[1])
        assert got == want
    assert len(chosen_windows(np.zeros(0, np.uint64), 3)) == 0 and chosen_windows(np.full(9, 5, np.uint64), 3).tolist() == [0]


def test_run_hashes():
    x = np.random.default_rng(1).integers(0, 1 << 63, 100, dtype=np.uint64)
    for n in (1, 5, 30):
        whole = run_hashes(x, n)
        assert len(whole) == 101 - n and all(run_hashes(x[i : i + n], n)[0] == whole[i] for i in range(0, 101 - n, 7))
    assert len(run_hashes(x, 101)) == 0


def test_cut_text():
    text = b"a b  c\n\n d e\nf g\n"
    assert cut_text(text, [], []) == text
    assert cut_text(text, [2], []) == b"a b  c\n\nf g\n"
    assert cut_text(text, [], [1, 2, 4, 6]) == b"a  c\n\n d\n g\n"
    assert cut_text(text, [0], [3, 5]) == b"\nf g\n"


def test_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    names = "doc_id long, text string, own_mark string, gone_lines string, gone_words string, at_id string, at_mark string, line string, mark string, pid string"
    df = spark.createDataFrame([(i, text, *"abcdefgh") for i in range(2)], names)
    assert [tuple(r) for r in remove_repeats(df).orderBy("doc_id").collect()] == [(0, text, *"abcdefgh"), (1, "", *"abcdefgh")]


def test_rows_columns_and_empty(spark):
    df, rows = awkward_docs(spark, n=10)
    assert remove_repeats(df).count() == len(rows) and remove_repeats(df).columns == df.columns
    assert repeated_paragraphs(no_docs(spark)).count() == 0


def test_passages_inside_and_across_lines(spark):
    rng = random.Random(6)
    own = lambda n, tag: [f"{tag}{rng.randint(0, 9999)}" for _ in range(n)]
    lines = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    inside, wrapped = own(60, "in"), own(60, "wr")
    texts = [
        " ".join(own(40, "a") + inside + own(50, "b")), " ".join(own(70, "c") + inside + own(20, "d")),
        lines(own(25, "e") + wrapped + own(35, "f"), 10), lines(own(13, "g") + wrapped + own(47, "h"), 10), " ".join(own(90, "k")) + " \n", "x " * 300,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in repeated_paragraphs(df).collect()}
    assert [found[i].n_passage_words > 0 for i in range(6)] == [False, True, False, True, False, False]
    assert list(found[1].passages_in) == [0] and list(found[3].passages_in) == [2] and all(found[i].n_removed == 0 for i in range(6))
    left = {r.doc_id: r.text for r in remove_repeats(df).collect()}
    assert all(left[i] == texts[i] for i in (0, 2, 4, 5))
    for i, passage in ((1, inside), (3, wrapped)):
        words = left[i].split()
        assert [w for w in words if w not in passage] == [w for w in texts[i].split() if w not in passage]
        assert found[i - 1].n_shared > 0 and found[i - 1].n_passage_words == 0
        assert sum(w in passage for w in words) <= 2 * (STEP - 1)


def test_every_passage_of_51_words_is_found(spark):
    rng = random.Random(9)
    own = lambda n, tag: [f"{tag}{rng.randint(0, 9999)}" for _ in range(n)]
    assert PASSAGE + STEP - 1 <= 51
    rows = []
    for i in range(120):
        shared = own(51, "s")
        for k in (0, 1):
            words = own(rng.randint(1, 80), "a") + shared + own(rng.randint(1, 80), "b")
            cuts = sorted(rng.sample(range(1, len(words)), 5))
            rows.append((2 * i + k, "\n".join(" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, len(words)]))))
    got = repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.n_passage_words >= PASSAGE or r.n_removed > 0 for r in got) == 120 and sum(r.n_shared > 0 or r.n_repeated > 0 for r in got) == 240


def test_short_lines_beside_removed_ones(spark):
    """Two near copies whose long line repeats an older document's: the short lines around it are a repeat as well."""
    rng = random.Random(12)
    own = lambda n, tag: " ".join(f"{tag}{rng.randint(0, 9999)}" for _ in range(n))
    long, before, after = own(40, "l"), [own(15, "b") for _ in range(2)], [own(15, "c") for _ in range(3)]
    copy = "\n".join([*before, long, *after])
    texts = [long, copy, copy + "\n" + own(10, "d"), own(80, "e")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in repeated_paragraphs(df).collect()}
    assert [found[i].n_matches > 0 for i in range(4)] == [True, True, True, False]
    left = {r.doc_id: r.text for r in remove_repeats(df).collect()}
    assert left[0] == long and left[3] == texts[3] and left[1] == "\n".join([*before, *after])
    assert all(a not in left[2] for a in (before[1], after[0], after[1])) and texts[2].split("\n")[-1] in left[2]


@pytest.mark.parametrize("wide", [10, 7, 10**6])
def test_passages_with_a_changed_word_are_found_whatever_the_line_ends(spark, wide):
    """60 pairs of 60 words with one word changed (similarity 51 / 61) inside other words, and 60 texts that share nothing."""
    rng = random.Random(21)
    own = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    rows = []
    for i in range(60):
        one = own(60)
        two = list(one)
        two[rng.randint(10, 49)] = "changed"
        for k, words in enumerate((own(rng.randint(3, 40)) + one + own(rng.randint(3, 40)), own(rng.randint(3, 40)) + two + own(rng.randint(3, 40)), own(120))):
            rows.append((3 * i + k, "\n".join(" ".join(words[j : j + wide]) for j in range(0, len(words), wide))))
    got = {r.doc_id: r for r in repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[3 * i + 1].n_passage_words >= PASSAGE and list(got[3 * i + 1].passages_in) == [3 * i] and got[3 * i].n_matches > 0 for i in range(60))
    assert all(got[3 * i + 2].n_matches == 0 for i in range(60))


def test_windows_that_meet_by_one_hash_only_are_not_equal(spark, monkeypatch):
    real = paragraphs.run_hashes

    def weak(words, length, base=paragraphs.BASE):
        found = real(words, length, base)
        return found & np.uint64(7) if length == PASSAGE and base == paragraphs.BASE else found

    rows = [(i, " ".join(f"w{i}x{k}" for k in range(19)) + "\n" + " ".join(f"v{i}x{k}" for k in range(19))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "doc_id AS mark", "text").coalesce(1)
    monkeypatch.setattr(paragraphs, "run_hashes", weak)
    batches = [pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[0] for r in rows]), pa.array([r[1].encode() for r in rows], pa.binary())], ["doc_id", "mark", "text"])]
    found = [(b.column(5).to_pylist(), b.column(6).to_pylist()) for b in paragraphs.window_batches(batches, PASSAGE, STEP)]
    grams, checks = (sum(x, []) for x in zip(*found))
    assert len(set(grams)) <= 8 and len(set(checks)) == len(checks) > 20
    monkeypatch.setattr(paragraphs, "passage_rows", lambda *_: spark.createDataFrame([(i, i, 0, 0, 1, g, c) for i, (g, c) in enumerate(zip(grams, checks))], "doc_id long, mark long, at int, line int, last int, gram long, check long"))
    none = spark.createDataFrame([], "doc_id long, mark long, removed_lines array<int>")
    assert paragraphs.repeated_passages(docs, none).count() == 0


def test_words_of_blocks(monkeypatch):
    """Words, lines and hashes of small blocks against plain Python: empty and null texts, long words, every kind of white space."""
    monkeypatch.setattr(paragraphs, "BLOCK_BYTES", 200)
    rng = random.Random(1)
    bits = ["a", "B", "\u00e9", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\xa0", "xyz", "word" * 3, "word" * 17, "word" * 40]
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.choice([0, 0, 1, 5, 40]))).encode() for _ in range(300)]
    got = {}
    for first, w in paragraphs.word_blocks(pa.array(texts, pa.binary()).slice(3)):
        for h, t, n in zip(w.hashes.tolist(), w.text.tolist(), w.line.tolist()):
            got.setdefault(first + t, []).append((h, n))
    words, hashes = {}, {}
    for i, text in enumerate(texts[3:]):
        want = [(x, n) for n, line in enumerate((text or b"").lower().split(b"\n")) for x in line.split()]
        assert [n for _, n in want] == [n for _, n in got.get(i, [])]
        assert all(words.setdefault(x, h) == h and hashes.setdefault(h, x) == x for (x, _), (h, _) in zip(want, got.get(i, [])))
