import random
from collections import Counter

import corpus_pipeline
from sonolume.llm.common import materialize
from sonolume.llm.secrets import find_spans, hide

from .test_paragraphs import brute as brute_paragraphs
from .test_simhash import brute_components, brute_fp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(rng):
    line = lambda n, tag: " ".join(f"{tag}{rng.randint(0, 400)}" for _ in range(n)) + "."
    shared = line(60, "shared")
    texts = ["\n".join(line(rng.randint(25, 50), f"t{i}w") for _ in range(3)) for i in range(30)]
    texts += [texts[0], texts[1], texts[2] + " more."]
    texts += [texts[3 + i] + "\n" + shared for i in range(4)]
    texts[9] += "\nHome | About | Contact | Login"
    texts[10] += "\nHere the token = \"586908a73d53ffc7776756ed304e7317d12d4663\", as it is, was left in by mistake."
    texts += [None, "", "short text", " | ".join(["nav"] * 80), "BUY NOW!! " * 60]
    return list(enumerate(texts))


def test_stages_and_run(spark, tmp_path):
    rows = documents(random.Random(8))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]

    run = lambda name, docs: materialize(stage[name](spark, docs, str(tmp_path)), name)
    docs = run("quality_rules", df)
    assert docs.columns == COLUMNS
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == set(range(37))
    assert kept[9] == "\n".join(rows[9][1].split("\n")[:-1]) and all(kept[i] == rows[i][1] for i in kept if i not in (9,))

    docs = run("near_dedup", docs)
    assert docs.columns == COLUMNS
    ids = sorted(kept)
    fps = [brute_fp(kept[i]) for i in ids]
    label = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    want = {ids[c] for c in label}
    got = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == want and {30, 31} & want == set()

    docs = run("substring_dedup", docs)
    assert docs.columns == COLUMNS
    removed = brute_paragraphs(list(got.items()))
    want_text = {i: "\n".join(line for n, line in enumerate(t.split("\n")) if n not in set(removed[i, t][2])) for i, t in got.items()}
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert got == {i: (t, len(t)) for i, t in want_text.items()}
    assert sum("shared" in t for t, _ in got.values()) <= 1

    docs = run("secret_scan", docs)
    assert docs.columns == COLUMNS
    clean = {i: hide(t, find_spans(t)[2], "[secret]") for i, t in want_text.items()}
    assert {r.doc_id: r.text for r in docs.collect()} == clean and "586908a7" not in clean[10]

    packed = stage["best_fit_packing"](spark, docs, str(tmp_path)).collect()
    lengths = Counter()
    for r in packed:
        lengths[r.doc_id] += r.length
    assert lengths == {i: len(t.split()) + 1 for i, t in clean.items()}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in whole) == Counter((r.doc_id, r.piece, r.start, r.length) for r in packed)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        df2 = f(spark, df, str(tmp_path))
        assert df2.count() == 0


def test_near_dedup_with_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c, d, e, f = (" ".join(f"{tag}{rng.randint(0, 400)}" for _ in range(120)) for tag in "abcdef")
    rows = [(5, a), (5, b), (3, a), (None, c), (None, d), (None, d), (None, e), (9, e), (7, f), (7, f), (None, a)]
    df = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == COLUMNS
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(3, a), (5, b), (None, c), (None, d), (9, e), (7, f)])


def test_every_stage_keeps_columns_of_odd_names(spark):
    rng = random.Random(3)
    line = lambda: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) + "."
    texts = ["\n".join(line() for _ in range(2)) for _ in range(6)]
    texts += [texts[0], texts[1] + "\n" + texts[2].split("\n")[0], texts[3] + ' token = "586908a73d53ffc7776756ed304e7317d12d4663".']
    odd = ["a.b", "own_mark", "KEPT", "tick`ed", "near_row", "c1", "n words"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in odd)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *(f"{c}{i}" for c in odd)) for i, t in enumerate(texts)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), name)
        assert docs.columns == COLUMNS + odd
        rows = docs.collect()
        assert rows and all(r[len(COLUMNS) + k] == f"{c}{r.doc_id}" for r in rows for k, c in enumerate(odd))
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} == {r.doc_id for r in rows}
