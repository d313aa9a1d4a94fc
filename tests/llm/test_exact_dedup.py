import hashlib
import re
from collections import Counter, defaultdict

import pytest

from sonolume.llm import exact_dedup

from .fixtures import awkward_docs, no_docs


def brute(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    digest = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t in rows]
    groups = defaultdict(list)
    for n, d in enumerate(digest):
        groups[d].append(n)
    out = []
    for ns in groups.values():
        first = min(ns, key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n))
        out += [(rows[n][0], rows[first][0], len(ns), n == first, digest[n]) for n in ns]
    return Counter(out)


def found(df, **options):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_duplicates(df, **options).collect())


@pytest.mark.parametrize("support", [0.5, 0.02, 1e-3])
def test_awkward_rows(spark, support):
    df, rows = awkward_docs(spark)
    more = [(1000 + i, "the  same\tone" if i % 2 else "the same one") for i in range(60)] + [(None, "the same one"), (7, "the same one")]
    df = df.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    assert found(df.repartition(7), support=support) == brute(rows + more)


def test_frequent_texts_are_settled_by_the_broadcast_table(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i % 41}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, support=0.1) == found(df, support=0.9) == brute(rows)


def test_columns_of_odd_names_and_no_rows(spark):
    df = spark.createDataFrame([(2, "a b", 1, 2, 3), (1, "a\nb", 1, 2, 3)], "`doc.id` long, `t``x` string, row int, digest int, `a.b` int").withColumnRenamed("t`x", "text")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(df, id_col="doc.id").collect()}
    assert got == {(2, 1, False), (1, 1, True)}
    assert found(no_docs(spark)) == Counter()
