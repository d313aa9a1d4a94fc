"""Line-first quality rules, as DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, quoted, word_array

#: A line of marks: this share of its characters or more are of MARKS.
MARKS = "#*$%&|<>{}!~^=_\\"
MARK_PERCENT = 6
#: A line that is longer than this and has capitals but no small letter.
CAPITALS_LENGTH = 20
#: A line of this many words without any sentence mark.
UNPUNCTUATED_WORDS = 12
BOILERPLATE = (
    r"(?i)\b(all rights reserved|copyright|licensed under|general public license|privacy policy|cookie policy|accept cookies|terms of (use|service)"
    r"|sign (in|up)|log ?in|subscribe|newsletter|click here|read more|share this|powered by|back to top|skip to content|previous post|next post)\b"
)
BOILERPLATE_WORDS = 20
#: A document goes if it loses more than this share of its non-space characters.
LOST_PERCENT = 40


def _bad_line(line: Column) -> Column:
    length = F.length(line)
    marks = length - F.length(F.translate(line, MARKS, ""))
    spaces = length - F.length(F.translate(line, " ", ""))
    return (
        (marks * 100 >= length * MARK_PERCENT)
        | ((length >= CAPITALS_LENGTH) & line.rlike("[A-ZÀ-ÖØ-Þ]") & ~line.rlike("[a-zß-öø-ÿ]"))
        | ((spaces >= UNPUNCTUATED_WORDS - 1) & ~line.rlike("[.,;:!?。，！？؟।]"))
        | ((spaces < BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
    )


def _solid(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


#: What clean_lines adds.
VERDICT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "lost_chars", "base_failed", "kept")


def _judged(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with the fields in VERDICT under names that it has not, and these names."""
    own = {c: fresh(docs, f"judged_{c}") for c in (*VERDICT, "words", "lines", "windows", "full", "good", "at")}
    words, lines, windows, full, good, at = (own.pop(c) for c in ("words", "lines", "windows", "full", "good", "at"))
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    staged = docs.withColumn(words, word_array(F.col(quoted(text_col)))).withColumn(lines, F.split(text, "\n"))
    staged = staged.withColumn(
        windows,
        F.array_sort(F.slice(F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))), 1, F.greatest(F.size(words) - 2, F.lit(0)))),
    ).withColumn(full, F.filter(lines, has_word)).withColumn(good, F.filter(lines, lambda line: ~has_word(line) | ~_bad_line(line)))
    twice = F.transform(windows, lambda x, k: F.when((x["h"] == F.get(windows, k + 1)["h"]) | (x["h"] == F.get(windows, k - 1)["h"]), x["i"]))
    staged = staged.withColumn(at, F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    covered = F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), i - F.coalesce(F.get(at, k - 1), i - 3))), F.lit(0), lambda a, b: a + b)
    staged = (
        staged.withColumn(own["n_words"], F.size(words).cast("long"))
        .withColumn(own["word_chars"], _solid(text))
        .withColumn(own["n_symbols"], (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
        .withColumn(own["n_dup_lines"], (F.size(full) - F.size(F.array_distinct(full))).cast("long"))
        .withColumn(own["n_repeat_words"], covered.cast("long"))
        .withColumn(own["clean_text"], F.array_join(good, "\n"))
    )
    staged = staged.withColumn(own["lost_chars"], F.col(own["word_chars"]) - _solid(F.col(own["clean_text"])))
    base_failed = (F.col(own["n_words"]) < 50) | (100 * F.col(own["n_repeat_words"]) > 50 * F.col(own["n_words"]))
    staged = staged.withColumn(own["base_failed"], base_failed)
    kept = ~F.col(own["base_failed"]) & (F.col(own["lost_chars"]) * 100 <= F.col(own["word_chars"]) * LOST_PERCENT)
    return staged.withColumn(own["kept"], kept).drop(words, lines, windows, full, good, at), own


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every line, remove the failures, then judge the document; every row of docs returns.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean), lost_chars (long)
    and clean_text (the lines that pass). Input columns of these names are replaced, all others stay.
    n_repeat_words counts the words inside 3-word windows whose 64-bit hash occurs again in the text: each text's windows
    are sorted in its own row, so nothing is shuffled. Null text counts as empty and fails (under 50 words). Texts of any
    length are judged whole, in one row's memory. Repeated rows: one result each. Empty table: no rows.
    """
    judged, own = _judged(docs, text_col)
    return judged.select(*(F.col(quoted(c)) for c in docs.columns if c.lower() not in VERDICT), *(F.col(own[c]).alias(c) for c in VERDICT))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows of docs, their text without the failing lines; other columns stay as they are, whatever their names.

    The partition number, which counts as not deterministic, keeps the optimiser from copying the whole expression of
    ``kept`` into a filter below, where its arrays would be built anew for each of their elements.
    """
    judged, own = _judged(docs, text_col)
    at = fresh(judged, "judged_at")
    judged = judged.withColumn(at, F.spark_partition_id()).where(F.col(own["kept"]) & (F.col(at) >= 0))
    return judged.select(*(F.col(own["clean_text"]).alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns))
