"""Secret scans: fixed patterns, and a guess-cost dynamic programme over values in credential contexts."""

from __future__ import annotations

import hashlib
import math
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import common_floor, count_words, discard, materialize

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs are maximal, so a least length inside the pattern drops the same matches as a test afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Where a credential is likely to be given: more names and more characters than ASSIGN knows.
CONTEXT = re.compile(
    r"""(?:passphrase|passcode|password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credential|bearer)s?["']?\x20*(?:=>|:=|[:=])\x20*["']?([^\s"'<>|,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
#: A context value needing 10 ** MIN_LOG_GUESSES guesses or more is reported.
MIN_LOG_GUESSES = 10.0
#: Longest word, date or walk that the segmentation considers.
LONGEST_PART = 24

#: Words of the corpus in the dictionary at most, after COMMON_WORDS (about 4 MB in a task), and the occurrences that each needs.
DICTIONARY = 50_000
LEAST_OCCURRENCES = 5
#: What names a value instead of giving it: placeholders, and dotted names or addresses as a whole.
REFERENCE = re.compile(r"\$?\{\{?[^{}]*\}?\}|\$[A-Za-z_]\w*|%[A-Za-z_]\w*%|[A-Za-z_]{1,40}(?:\.[A-Za-z_]{1,40})+(?:\(.*\)?)?|[a-z]+://[^@]*", re.ASCII)
LOG_REFERENCE = 3.0

#: Common password words, commonest first (fixed values).
COMMON_WORDS = (
    "password passw0rd pass admin root user test guest login welcome master secret letmein dragon monkey qwerty iloveyou sunshine princess football baseball "
    "superman batman shadow michael jordan hunter ranger buster soccer hockey killer george charlie andrew thomas robert daniel ashley jessica pepper ginger "
    "summer winter spring autumn monday friday orange banana cookie coffee cheese flower purple yellow silver golden diamond computer internet server system "
    "default changeme temp temporary example sample demo dummy placeholder none null true false your my the key api token service account database access "
    "public private value string hello world love angel star magic lucky happy money tiger eagle lion wolf bear horse"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
LEET = str.maketrans("013457@$!", "oieastasi")
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")
LOG2 = math.log10(2)


def _neighbours() -> set[tuple[str, str]]:
    found = set()
    for r, row in enumerate(KEY_ROWS):
        for k, c in enumerate(row):
            found |= {(c, d) for d in row[max(0, k - 1) : k + 2] if d != c}
            if r + 1 < len(KEY_ROWS):
                below = KEY_ROWS[r + 1]
                found |= {p for d in below[max(0, k - 1) : k + 1] for p in ((c, d), (d, c))}
    return found


NEXT_KEYS = _neighbours()


def _brute(c: str) -> float:
    """log10 of the characters to try at one place."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 3.0


def _word_cost(part: str, ranks: dict[str, int]) -> float | None:
    low = part.lower()
    rank, extra = ranks.get(low), 0.0
    if rank is None and (rank := ranks.get(low.translate(LEET))) is not None:
        extra = LOG2
    if rank is None:
        return None
    if part != low:
        extra += LOG2 if part == part.upper() or part == part.capitalize() else len(part) * LOG2
    return math.log10(rank + 1) + extra


def parts_from(value: str, i: int, run_end: int, again, ranks: dict[str, int]):
    """(end, log10 of the guesses) of every part but brute force that may begin at i, its factor 2 for the place included."""
    n = len(value)
    # One character again and again; where a run is very long, up to its last places.
    for k in range(max(i + 3, run_end - LONGEST_PART), run_end + 1):
        yield k, _brute(value[i]) + math.log10(k - i) + LOG2
    low = value[i : i + LONGEST_PART].lower()
    if len(low) == len(value[i : i + LONGEST_PART]):  # a few letters get longer in lower case
        for step in (1, -1):
            j = 1
            while j < len(low) and low[j].isalnum() and ord(low[j]) - ord(low[j - 1]) == step:
                j += 1
            if j >= 3:
                yield i + j, math.log10(26 if low[0].isalpha() else 10) + math.log10(j) + 2 * LOG2
        # A walk over neighbouring keys: 47 starts, about 4 turns a key.
        j, turns = 1, 0
        while j < len(low) and (low[j - 1], low[j]) in NEXT_KEYS:
            turns += j >= 2 and ord(low[j]) - ord(low[j - 1]) != ord(low[j - 1]) - ord(low[j - 2])
            j += 1
            if j >= 4:
                yield i + j, math.log10(47 * j) + turns * 0.3 + LOG2
    # The part before, once more or as often as it comes again.
    for size in range(2, min(i, LONGEST_PART) + 1):
        times = again[size][i] // size
        for m in {1, times} if times else ():
            yield i + m * size, math.log10(2 * size * m)
    if run_end < i + 3:  # no word begins with one letter three times
        for j in range(i + 3, min(n, i + LONGEST_PART) + 1):
            word = _word_cost(value[i:j], ranks)
            if word is not None:
                yield j, word + LOG2
    date = DATE.match(value, i)
    if date:
        yield date.end(), (math.log10(119) if date.end() - i == 4 else math.log10(365 * 119)) + LOG2


def repeats_behind(value: str) -> tuple[list[int], list]:
    """The end of the run of one character at each place; and by size the number of characters from each place on that equal those size places before."""
    n = len(value)
    run_end = [n] * n
    for i in range(n - 2, -1, -1):
        run_end[i] = run_end[i + 1] if value[i] == value[i + 1] else i + 1
    again: list = [None, None]
    for size in range(2, min(n, LONGEST_PART) + 1):
        row = array("i", bytes(4 * (n + 1)))
        for i in range(n - 1, size - 1, -1):
            if value[i] == value[i - size]:
                row[i] = row[i + 1] + 1
        again.append(row)
    return run_end, again


def guess_cost(value: str, ranks: dict[str, int] = RANK) -> float:
    """log10 of the guesses for the cheapest segmentation into words, dates, repeats, walks and brute-force spans.

    cost[j] = min over i < j of cost[i] + the cost of value[i:j] as one part; parts other than brute force carry a factor 2
    for their place. From each place at most a fixed number of parts begins, so time is linear in the length of the value.
    A value that as a whole refers to another (a placeholder, a dotted name, an address) costs LOG_REFERENCE at most. The
    empty value costs 0.
    """
    n = len(value)
    cost = [0.0] + [math.inf] * n
    run_end, again = repeats_behind(value)
    for i in range(n):
        here = cost[i]
        cost[i + 1] = min(cost[i + 1], here + _brute(value[i]))
        for j, part in parts_from(value, i, run_end[i], again, ranks):
            if here + part < cost[j]:
                cost[j] = here + part
    return min(cost[n], LOG_REFERENCE) if n and REFERENCE.fullmatch(value) else cost[n]


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY, least: int = LEAST_OCCURRENCES) -> dict[str, int]:
    """Ranks of words: COMMON_WORDS, then the commonest words of the corpus (3 to LONGEST_PART letters a-z), at most ``most``.

    A word needs ``least`` occurrences, and in a large corpus common_floor(all, most) too, so that the last task reads a
    bounded number of words.
    """
    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count_words, "word binary, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))
    words = counted.select(F.col("word").cast("string").alias("word"), "freq").where(F.col("word").rlike(f"^[a-z]{{3,{LONGEST_PART}}}$") & (F.col("freq") >= least))
    words = materialize(words, "dictionary")
    floor = common_floor(words.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0], most)
    ranks = dict(RANK)
    for word in words.where(F.col("freq") >= floor).orderBy(F.desc("freq"), "word").limit(most).toArrow()["word"].to_pylist():
        ranks.setdefault(word, len(ranks) + 1)
    discard(words)
    return ranks


def find_spans(text: str, min_log_guesses: float = MIN_LOG_GUESSES, ranks: dict[str, int] = RANK) -> tuple[list, list, list]:
    """Base spans and all spans of a text as sorted (start, kind index, end), and the value ranges to hide."""
    base, values = [], []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            base.append((m.start(), 0, m.end()))
            values.append((m.start(2), m.end(2)))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for m in pattern.finditer(text):
            base.append((m.start(), kind, m.end()))
            values.append((m.start(), m.end()))
    added = []
    for m in CONTEXT.finditer(text):
        value = m.group(1).rstrip(".)]}")
        if len(value) >= 6 and not REFERENCE.fullmatch(m.group(1)) and guess_cost(value, ranks) >= min_log_guesses:
            added.append((m.start(1), 3, m.start(1) + len(value)))
            values.append((m.start(1), m.start(1) + len(value)))
    return sorted(base), sorted(base + added), values


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def hide(text: str, values, mark: str) -> str:
    """The text with the union of the ranges replaced by a mark each."""
    out, at = [], 0
    for a, b in sorted(values):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def _scan(min_log_guesses, ranks):
    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text in batch.column(1):
                base, spans, _ = find_spans(text.as_py() or "", min_log_guesses, ranks.value)
                for kind in range(3):
                    cols[kind].append(sum(k == kind for _, k, _ in base))
                cols[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols[4].append(_joined(spans))
            yield pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, min_log_guesses: float = MIN_LOG_GUESSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row's whole text, in code points.

    The words of values are looked up in the dictionary of all texts. Null and empty texts: no spans. Texts and values of
    any length are scanned whole. Spans of one kind don't overlap; of two kinds they may. Repeated rows: one result each.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(_scan(min_log_guesses, ranks), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, mark: str = "[secret]", min_log_guesses: float = MIN_LOG_GUESSES, text_col: str = "text") -> DataFrame:
    """docs with every secret value in the text replaced by mark; other columns and null texts stay as they are."""
    at = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names that any reader takes
    ranks = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text_col))

    def run(batches):
        for batch in batches:
            texts = []
            for text in batch.column(at):
                t = text.as_py()
                texts.append(t if t is None else hide(t, find_spans(t, min_log_guesses, ranks.value)[2], mark))
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
