import re
from collections import Counter

from sonolume.llm.quality import clean_lines, kept_documents

from .fixtures import awkward_docs, no_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat), failed


def test_counts(spark):
    df, rows = awkward_docs(spark)
    got = clean_lines(df).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((i, *brute(t)) for i, t in rows)
    assert all(not (r.base_failed and r.kept) for r in got)


def test_verdicts(spark):
    prose = "\n".join(f"Here{i} is line {i} of{i} plain prose, and{i} it goes{i} on for{i} a while{i}." for i in range(12))
    bar = "\n".join(" | ".join(f"item{i}{j}" for j in range(12)) for i in range(8))
    shout = "\n".join(" ".join(f"LOUD{i}{j}!!" for j in range(12)) for i in range(8))
    run_on = " ".join(f"keyword{i}" for i in range(80))
    lines = prose + "\nAll rights reserved.\nHome | About | Contact"
    rows = [(1, prose), (2, bar), (3, shout), (4, run_on), (5, lines), (6, prose + "\n" + bar + "\n" + shout)]
    got = {r.doc_id: r for r in clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(1, 7)] == [True, False, False, False, True, False]
    assert got[5].clean_text == prose and got[1].clean_text == prose


def test_empty(spark):
    assert clean_lines(no_docs(spark)).count() == 0


def test_clashing_columns(spark):
    prose = "\n".join(f"Here{i} is line {i} of{i} plain prose, and{i} it goes{i} on for{i} a while{i}." for i in range(12))
    df = spark.createDataFrame([(1, prose, "mine", "mine", "mine", "mine", "mine", "mine")], "doc_id long, text string, kept string, _at string, _words string, judged_words string, n_words string, `a.b` string")
    assert [tuple(r) for r in kept_documents(df).collect()] == [(1, prose, *["mine"] * 6)]
    row = clean_lines(df).first()
    assert row.kept is True and row.n_words > 50 and row["a.b"] == "mine" and row["_at"] == "mine"
