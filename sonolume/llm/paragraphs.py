"""Substring dedup: paragraphs by MinHash banding and exact Jaccard on colliding pairs, passages anywhere in the text by chosen word windows."""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, fresh, materialize, quoted

SEED = 42
#: Words in a shingle and least Jaccard similarity of two paragraphs that count as one passage.
WIDTH = 5
SIMILARITY = 0.8
#: A line of so many words is a paragraph of its own. Shorter lines are compared as parts of passages, which run over line breaks.
MIN_WORDS = 20
#: Share of pairs at exactly SIMILARITY that may share no band, and hashes in a band.
MISS = 1e-3
ROWS = 2
#: Longs of a paragraph's odd sketch: every shingle flips one of its bits.
SKETCH = 4
#: Words in a window, as many as in the least paragraph. Of STEP windows in a row one at least is compared, so that equal runs of
#: PASSAGE + STEP - 1 = 30 words share a window wherever they lie, and STEP - 1 words at each end of a run may stay. Two passages
#: with k scattered words changed have SIMILARITY on five-word shingles from 45 k + 4 words on, which leaves a run of 30 equal
#: words or more if they have 60 words (k = 1) or more than one change (94 words, k = 2): none of these is missed.
PASSAGE = 20
STEP = 11
#: Bytes of text that are cut into words at once, and words and paragraphs that are signed at once.
BLOCK_BYTES = 1 << 20
BLOCK_WORDS = 200_000
BLOCK_PARAGRAPHS = 60_000
#: Bytes of the longest words that are hashed together.
LONG_WORD = 64
#: Up to so many colliding paragraphs (8 bytes each) are sent to the tasks that cut their shingles; more are joined.
SENT_PARAGRAPHS = 1_000_000
BASE = 0x9E3779B97F4A7C15
CHECK_BASE = 0xC2B2AE3D27D4EB4F
LOW_48 = np.uint64((1 << 48) - 1)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BYTES = np.arange(256, dtype=np.uint8)
SPACE = (BYTES == 32) | ((BYTES >= 9) & (BYTES <= 13))
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` hashes such that a pair at ``similarity`` collides in one at least, but for a share ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of a block of texts put end to end: their hashes (64 bits, A-Z in lower case), texts (numbers in the block) and lines (from 0 in each text)."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        starts = np.concatenate([[0], ends[:-1]])
        lower = LOWER[data]
        inside = ~SPACE[data]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[starts] = fresh[-1] = True
        first = np.flatnonzero(inside & (fresh[:-1] | np.concatenate([[True], ~inside[:-1]])))
        after = np.flatnonzero(inside & (fresh[1:] | np.concatenate([~inside[1:], [True]]))) + 1
        self.hashes = word_hashes(lower, first, after - first)
        self.text = np.searchsorted(ends, first, "right")
        breaks = np.flatnonzero(data == 10)
        self.line = np.searchsorted(breaks, first) - np.searchsorted(breaks, starts)[self.text]


def word_hashes(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the words of these places, from eight bytes at a time; of longer words than LONG_WORD from the library's hash."""
    import xxhash

    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    found = _mixed(sizes.astype(np.uint64) * np.uint64(BASE) + np.uint64(SEED))
    at = np.flatnonzero(sizes <= LONG_WORD)
    done = 0
    while len(at):
        left = np.minimum(sizes[at] - done, 8).astype(np.uint64)
        part = eights[first[at] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        found[at] = _mixed((found[at] ^ part) * np.uint64(BASE))
        done += 8
        at = at[sizes[at] > done]
    for i in np.flatnonzero(sizes > LONG_WORD):
        found[i] = xxhash.xxh3_64_intdigest(data[first[i] : first[i] + sizes[i]].tobytes(), SEED)
    return found


def word_blocks(column):
    """(number of the first text, Words) for blocks of texts (an Arrow column of binaries; null counts as empty) of BLOCK_BYTES or one longer text."""
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK_BYTES, "right")) - 1)
        if offsets[stop] > offsets[start]:
            yield start, Words(data[offsets[start] : offsets[stop]], offsets[start + 1 : stop + 1] - offsets[start])
        start = stop


def run_hashes(words: np.ndarray, length: int, base: int = BASE) -> np.ndarray:
    """64-bit hash of every run of ``length`` words, from the hashes of the words; runs of 1, 2, 4, ... words are put together."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, done, piece, size = np.zeros(n, np.uint64), 0, words, 1
    while done < length:
        factor = np.uint64(pow(base, size, 1 << 64))
        if length & size:
            total = total * factor + piece[done : done + n]
            done += size
        if done < length:
            piece, size = piece[:-size] * factor + piece[size:], 2 * size
    return _mixed(total)


class Paragraphs:
    """Paragraphs of a block of texts: where they stand and their ids; cut() gives their distinct shingles (48 bits each), put end to end."""

    def __init__(self, doc: np.ndarray, line: np.ndarray, words: np.ndarray, lengths: np.ndarray):
        self.doc, self.line, self.words, self.lengths = doc, line, words, lengths
        starts = np.cumsum(lengths) - lengths
        self.place = np.arange(len(words)) - np.repeat(starts, lengths)
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(lengths.max() - 1, BASE, np.uint64))])
        self.pid = _mixed(np.add.reduceat(words * powers[self.place], starts) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def only(self, chosen: np.ndarray) -> Paragraphs | None:
        at = np.flatnonzero(chosen)
        return Paragraphs(self.doc[at], self.line[at], self.words[np.repeat(chosen, self.lengths)], self.lengths[at]) if len(at) else None

    def cut(self, width: int) -> Paragraphs:
        shingles = run_hashes(self.words, width)
        number = np.repeat(np.arange(len(self.lengths)), self.lengths)[: len(shingles)]
        whole = self.place[: len(shingles)] <= self.lengths[number] - width
        keyed = np.sort((number[whole].astype(np.uint64) << np.uint64(48)) | (shingles[whole] >> np.uint64(16)))
        keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
        self.owner, self.shingles = (keyed >> np.uint64(48)).astype(np.int64), keyed & LOW_48
        self.begins = np.flatnonzero(np.concatenate([[True], self.owner[1:] != self.owner[:-1]]))
        self.size = np.diff(np.append(self.begins, len(keyed)))
        return self

    def odd_sketches(self) -> np.ndarray:
        """64 * SKETCH parities each. Two sketches differ in at most as many bits as the sets have elements apart."""
        bits = 64 * SKETCH
        flips = np.bincount(self.owner * bits + (self.shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits * len(self.size))
        return np.packbits((flips & 1).astype(np.uint8).reshape(-1, bits), axis=1).view(np.int64)

    def band_keys(self, bands: int, rows: int) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        a = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        keys = []
        for band in range(bands):
            key = np.full(len(self.size), band + 1, np.uint64)
            for f in range(band * rows, (band + 1) * rows):
                key = _mixed(key * np.uint64(BASE) + np.minimum.reduceat(a[f] * self.shingles + b[f], self.begins))
            keys.append(key.view(np.int64))
        return np.stack(keys)


def paragraph_blocks(column, min_words: int, width: int):
    """Paragraphs of the texts of an Arrow column in blocks; lower case is taken of A-Z only, white space between words counts as one space."""
    for first, w in word_blocks(column):
        new = np.flatnonzero(np.concatenate([[True], (np.diff(w.text) != 0) | (np.diff(w.line) != 0)])) if len(w.text) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(new, len(w.text)))
        new, lengths = new[lengths >= min_words], lengths[lengths >= min_words]
        doc, line, full = first + w.text[new], w.line[new], np.maximum(lengths, width)
        total, i = np.cumsum(full), 0
        while i < len(new):
            before = total[i - 1] if i else 0
            j = min(max(i + 1, int(np.searchsorted(total, before + BLOCK_WORDS, "right"))), i + BLOCK_PARAGRAPHS)
            words = np.zeros(total[j - 1] - before, np.uint64)  # lines of fewer than width words are filled up
            place = np.arange(lengths[i:j].sum()) - np.repeat(np.cumsum(lengths[i:j]) - lengths[i:j], lengths[i:j])
            words[np.repeat(total[i:j] - full[i:j] - before, lengths[i:j]) + place] = w.hashes[np.repeat(new[i:j], lengths[i:j]) + place]
            yield Paragraphs(doc[i:j], line[i:j], words, full[i:j])
            i = j


def paragraph_rows(docs: DataFrame, bands: int, rows: int = ROWS, min_words: int = MIN_WORDS, width: int = WIDTH) -> DataFrame:
    """A row for each paragraph (line of min_words words or more): doc_id, mark, line, pid, size, b0, b1, ..., s0, s1, ...

    b are the keys of the bands, s is the odd sketch; pid is the 64-bit hash of the words, size the number of shingles.
    Every document has a row with line -1, no pid and its number of paragraphs as size too.
    """
    names = ["doc_id", "mark", "line", "pid", "size", *(f"b{i}" for i in range(bands)), *(f"s{i}" for i in range(SKETCH))]

    def run(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for p in paragraph_blocks(batch.column(2), min_words, width):
                p.cut(width)
                n += np.bincount(p.doc, minlength=len(n))
                at = pa.array(p.doc)
                longs = [*p.band_keys(bands, rows), *p.odd_sketches().T]
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(p.line, pa.int32()), pa.array(p.pid), pa.array(p.size, pa.int32()), *(pa.array(np.ascontiguousarray(x)) for x in longs)], names)
            none = pa.nulls(len(n), pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.full(len(n), -1), pa.int32()), none, pa.array(n, pa.int32()), *[none] * (bands + SKETCH)], names)

    base = docs.select("doc_id", "mark", F.col("text").cast("binary").alias("text"))
    return base.mapInArrow(run, "doc_id long, mark long, line int, pid long, size int, " + ", ".join(f"{c} long" for c in names[5:]))


def _shingle_sets(docs: DataFrame, wanted: DataFrame, min_words: int, width: int) -> DataFrame:
    """pid, shingles of the paragraphs whose pid is in wanted. Few pids are sent to the tasks, more are joined with all paragraphs."""
    few = wanted.limit(SENT_PARAGRAPHS + 1).toArrow()["pid"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(few)) if len(few) <= SENT_PARAGRAPHS else None

    def run(batches):
        seen = set()
        for batch in batches:
            for p in paragraph_blocks(batch.column(0), min_words, width):
                p = p.only(np.isin(p.pid, sent.value)) if sent is not None else p
                if p is None:
                    continue
                p.cut(width)
                pids, sets = [], []
                for i in range(len(p.pid)):
                    if p.pid[i] not in seen:
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(p.pid[i])
                        pids.append(p.pid[i])
                        sets.append(p.shingles[p.begins[i] : p.begins[i] + p.size[i]].view(np.int64))
                if pids:
                    yield pa.record_batch([pa.array(pids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["pid", "shingles"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "pid long, shingles array<long>")
    return (found if sent is not None else found.join(wanted, "pid", "left_semi")).dropDuplicates(["pid"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, and what they carry) whose shingle sets have at least the Jaccard similarity."""
    joined = pairs.join(sets.select(F.col("pid").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("pid").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.withColumn("both", both).where(F.col("both") >= similarity * (F.size("sa") + F.size("sb") - F.col("both")) - 1e-9).drop("sa", "sb", "both")


def _may_be_similar(a: str, b: str, similarity: float) -> Column:
    """False only for pairs below the similarity: by their sizes, or by the elements that their sketches show to be apart."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(SKETCH)])
    x, y = F.col(a + "size"), F.col(b + "size")
    return (F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9) & (apart * (1 + similarity) <= (1 - similarity) * (x + y) + 1e-9)


def link_paragraphs(rows: DataFrame, docs: DataFrame, bands: int, similarity: float, min_words: int, width: int) -> DataFrame:
    """(pid, component) for every paragraph with a verified link to another paragraph.

    Only (key, pid) go through the bands; sizes and sketches are joined to what collides. In each bucket of a band the
    commonest paragraph is compared with all others; members that end in its component need no comparisons with one
    another, the rest of the bucket is compared with the bucket. No bucket is gathered in a task.
    """
    sketch = [f"s{i}" for i in range(SKETCH)]
    keys = [f"b{i}" for i in range(bands)]
    distinct = rows.where("pid is not null").groupBy("pid").agg(F.count(F.lit(1)).alias("weight"), *(F.first(c).alias(c) for c in ["size", *sketch, *keys]))
    distinct = materialize(distinct, "paragraphs")
    keyed = distinct.select("pid", F.explode(F.array(*keys)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    multi = materialize(keyed.join(shared.hint("shuffle_hash"), "key"), "colliding")
    known = materialize(distinct.select("pid", "weight", "size", *sketch).join(multi.select("pid").distinct(), "pid", "left_semi"), "known")
    discard(distinct)
    sets = materialize(_shingle_sets(docs, known.select("pid"), min_words, width), "shingles")
    full = multi.join(known, "pid")
    heads = full.groupBy("key").agg(F.max_by(F.struct(F.col("pid").alias("hpid"), *(F.col(c).alias("h" + c) for c in ("size", *sketch))), F.struct("weight", "pid")).alias("head")).select("key", "head.*")
    star = full.join(heads, "key").where((F.col("pid") != F.col("hpid")) & _may_be_similar("", "h", similarity)).select(F.col("pid").alias("a"), F.col("hpid").alias("b")).distinct()
    first = connected_components(_verified(star, sets, similarity))
    named = multi.join(heads.select("key", "hpid"), "key").join(first.select(F.col("node").alias("pid"), F.col("component").alias("c")), "pid", "left").join(
        first.select(F.col("node").alias("hpid"), F.col("component").alias("hc")), "hpid", "left"
    )
    named = materialize(named.select("key", "pid", "hpid", F.coalesce("c", "pid").alias("c"), F.coalesce("hc", "hpid").alias("hc")), "labelled")
    strays = named.where("c <> hc")
    open_keys = strays.select("key").distinct()
    labelled = named.join(open_keys, "key", "left_semi").join(known.drop("weight"), "pid")
    strays = strays.join(known.drop("weight"), "pid").select("key", F.col("pid").alias("opid"), *(F.col(c).alias("o" + c) for c in ("size", *sketch)), F.col("c").alias("oc"))
    pairs = labelled.join(
        strays,
        (labelled["key"] == strays["key"]) & (F.col("c") != F.col("oc")) & ((F.col("c") == F.col("hc")) | (F.col("pid") < F.col("opid"))) & (F.col("pid") != F.col("hpid")) & _may_be_similar("", "o", similarity),
    ).select(F.col("pid").alias("a"), F.col("opid").alias("b"), "c", "oc").distinct()
    links = _verified(pairs, sets, similarity).select(F.col("c").alias("a"), F.col("oc").alias("b"))
    second = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("top"))
    ends = first.select(F.col("node").alias("pid"), "component").unionByName(second.select(F.col("component").alias("pid"), "component")).distinct()
    answer = materialize(ends.join(second, "component", "left").groupBy("pid").agg(F.min(F.coalesce("top", "component")).alias("component")), "links")
    for table in (multi, known, sets, named):
        discard(table)
    return answer


def chosen_windows(hashes: np.ndarray, step: int) -> np.ndarray:
    """Positions of the least hash of every ``step`` neighbours: the same in each copy, whatever stands around it.

    The largest value means no window. Of a run of equal ones (one word again and again) the first is taken.
    """
    none = np.iinfo(np.uint64).max
    edge = np.full(step - 1, none, np.uint64)

    def extreme(x: np.ndarray, best) -> np.ndarray:
        size = 1
        while 2 * size <= step:
            x, size = best(x[:-size], x[size:]), 2 * size
        rest = step - size
        return best(x[:-rest], x[rest:]) if rest else x

    if not len(hashes):
        return np.zeros(0, np.int64)
    least = extreme(np.concatenate([edge, hashes, edge]), np.minimum)
    largest = extreme(np.where(least == none, np.uint64(0), least), np.maximum)
    again = np.concatenate([[False], hashes[1:] == hashes[:-1]])
    return np.flatnonzero((hashes == largest) & (hashes != none) & ~again)


def window_batches(batches, passage: int, step: int):
    """The rows of passage_rows for Arrow batches of doc_id, mark, text (binary)."""
    for batch in batches:
        for first, w in word_blocks(batch.column(2)):
            grams = run_hashes(w.hashes, passage)
            if not len(grams):
                continue
            # Windows over the end of a text are none; there are passage - 1 of them in a row, so texts never meet.
            grams[w.text[: len(grams)] != w.text[passage - 1 :]] = np.iinfo(np.uint64).max
            check = run_hashes(_mixed(~w.hashes), passage, CHECK_BASE)
            at = chosen_windows(grams, step)
            rows = pa.array(first + w.text[at])
            ints = [pa.array(x, pa.int32()) for x in (at - np.searchsorted(w.text, w.text[at]), w.line[at], w.line[at + passage - 1])]
            longs = [pa.array(x[at].view(np.int64)) for x in (grams, check)]
            yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), *ints, *longs], ["doc_id", "mark", "at", "line", "last", "gram", "check"])


def passage_rows(docs: DataFrame, passage: int = PASSAGE, step: int = STEP) -> DataFrame:
    """doc_id, mark, at, line, last, gram, check for every chosen window of the whole text.

    ``at`` is the number of its first word, ``line`` and ``last`` are the lines of its first and last word, all from 0;
    ``gram`` is the hash by which windows are chosen and meet, ``check`` another of the same words, which verifies them.
    """
    if step > passage:
        raise ValueError("windows of neighbouring texts would meet: step must not be above passage")
    base = docs.select("doc_id", "mark", F.col("text").cast("binary").alias("text"))
    return base.mapInArrow(lambda batches: window_batches(batches, passage, step), "doc_id long, mark long, at int, line int, last int, gram long, check long")


def _spans(places: DataFrame, passage: int) -> DataFrame:
    """doc_id, mark, spans (of words to remove, end excluded), passages_in, n_shared: the windows gone, less the words of windows that stay."""
    kind = "doc_id long, mark long, passages array<struct<start: int, end: int>>, passages_in array<long>, n_shared long"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def covered(at: list, size: int) -> np.ndarray:
        ends = np.zeros(size + 1, np.int64)
        np.add.at(ends, np.array(at, np.int64), 1)
        np.add.at(ends, np.array(at, np.int64) + passage, -1)
        return np.cumsum(ends) > 0

    def run(batches):
        for batch in batches:
            out, shared = [], []
            for gone, stay in zip(batch.column("gone").to_pylist(), batch.column("stay").to_pylist()):
                size = max([*gone, *stay]) + passage
                cut = np.diff((covered(gone, size) & ~covered(stay, size)).astype(np.int8), prepend=0)
                out.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(cut == 1).tolist(), np.flatnonzero(cut == -1).tolist())])
                shared.append(len(gone) + len(stay))
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(out, spans_type), batch.column("passages_in"), pa.array(shared, pa.int64())], ["doc_id", "mark", "passages", "passages_in", "n_shared"])

    return places.mapInArrow(run, kind)


def repeated_passages(docs: DataFrame, removed: DataFrame, passage: int = PASSAGE, step: int = STEP) -> DataFrame:
    """doc_id, mark, passages, passages_in, n_shared for texts with a window that has several places, across line breaks and inside longer lines.

    docs: doc_id, mark, text; removed: doc_id, mark, removed_lines of paragraphs that go. Windows wholly inside these take no
    part; those that reach into shorter lines beside them do, else the short lines of near copies would stay. Of equal
    windows (by two independent hashes) the smallest (doc_id, mark, at) stays; its words stay even where another window is a
    repeat. Windows are equal or not: below 49 words one other word inside takes a window under Jaccard 0.8 anyway, and longer
    passages that reach it have equal windows on one side of their changes (see PASSAGE); the changed words stay.
    """
    rows = materialize(passage_rows(docs, passage, step), "windows")
    # Written, so that the join deals both sides out anew and can split a very common window.
    several = materialize(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "several")
    gone = removed.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "removed_lines")
    hits = rows.join(several.hint("shuffle_hash"), "gram").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")
    inside = F.size(F.filter("removed_lines", lambda x: (x >= F.col("line")) & (x <= F.col("last")))) > F.col("last") - F.col("line")
    hits = materialize(hits.where(~F.coalesce(inside, F.lit(False))).select("doc_id", "mark", "at", "gram", "check"), "hits")
    discard(rows)
    discard(several)
    place = F.struct("doc_id", "mark", "at")
    kept = hits.groupBy("gram", "check").agg(F.min(place).alias("keeper"), F.max(place).alias("other")).where(~F.col("keeper").eqNullSafe(F.col("other"))).select("gram", "check", "keeper")
    kept = materialize(kept, "keepers")  # for the same reason
    marked = hits.join(kept.hint("shuffle_hash"), ["gram", "check"]).select("doc_id", "mark", "at", place.eqNullSafe(F.col("keeper")).alias("stays"), F.col("keeper.doc_id").alias("keeper"))
    places = marked.groupBy("doc_id", "mark").agg(
        F.collect_set(F.when(~F.col("stays"), F.col("at"))).alias("gone"),
        F.collect_set(F.when(F.col("stays"), F.col("at"))).alias("stay"),
        F.sort_array(F.collect_set(F.when(~F.col("stays"), F.col("keeper")))).alias("passages_in"),
    )
    found = materialize(_spans(places, passage), "passages")
    discard(hits)
    discard(kept)
    return found


def _repeats(docs: DataFrame, similarity: float, min_words: int, width: int, rows: int, miss: float, passage: int, step: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paragraph rows, the lines that have several places (doc_id, mark, line, gone, kept_in), and repeated_passages of the rest."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("mark"), F.col(text_col).alias("text"))
    bands = bands_for(similarity, rows, miss)
    found = materialize(paragraph_rows(base, bands, rows, min_words, width), "lines")
    links = link_paragraphs(found, base, bands, similarity, min_words, width)
    place = F.struct("doc_id", "mark", "line")
    occurrences = found.where("pid is not null").select("doc_id", "mark", "line", "pid").join(links, "pid", "left").select("doc_id", "mark", "line", F.coalesce("component", "pid").alias("class"))
    kept = occurrences.groupBy("class").agg(F.min(place).alias("keeper"), F.max(place).alias("other")).where(~F.col("keeper").eqNullSafe(F.col("other"))).select("class", "keeper")
    gone = ~place.eqNullSafe(F.col("keeper"))
    lines = occurrences.join(kept, "class").select("doc_id", "mark", "line", gone.alias("gone"), F.when(gone, F.col("keeper.doc_id")).alias("kept_in"))
    lines = materialize(lines, "repeated")
    removed = lines.where("gone").groupBy("doc_id", "mark").agg(F.collect_set("line").alias("removed_lines"))
    return found, lines, repeated_passages(base, removed, passage, step)


def repeated_paragraphs(
    docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, width: int = WIDTH, rows: int = ROWS, miss: float = MISS, passage: int = PASSAGE, step: int = STEP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each document (distinct id and text): which of its paragraphs and passages are repeats to remove.

    A paragraph is a line of min_words words or more. Of each component of linked paragraphs the occurrence with the
    smallest (doc_id, line) stays; all others, in any document, are removals. Passages are found in what then is left.
    Returns doc_id, mark (hash of the text), n_paragraphs, n_repeated (in a component with several places, the one that
    stays included), n_removed, removed_lines (sorted, from 0), kept_in (ids of the documents that keep them), n_shared
    (compared windows with several places, those that stay included), n_matches (n_repeated and n_shared together: above 0
    where a paragraph or passage has another place), n_passage_words, passages (start and end of their words in the whole
    text, from 0, end excluded; parts of removed lines may be among them) and passages_in.

    Null and blank texts have no paragraphs. Null ids sort first. Rows that repeat id and text are one document. Texts of
    any length are compared whole. Empty table: no rows.
    """
    found, lines, passages = _repeats(docs, similarity, min_words, width, rows, miss, passage, step, id_col, text_col)
    none = {"n_paragraphs": "int", "line": "int", "gone": "boolean", "kept_in": "long", "passages": "array<struct<start: int, end: int>>", "passages_in": "array<long>", "n_shared": "long"}
    parts = [found.where("line = -1").select("doc_id", "mark", F.col("size").alias("n_paragraphs")), lines, passages]
    every = reduce(DataFrame.unionByName, [p.select("doc_id", "mark", *(F.col(c) if c in p.columns else F.lit(None).cast(t).alias(c) for c, t in none.items())) for p in parts])
    whole = every.groupBy("doc_id", "mark").agg(
        F.max("n_paragraphs").cast("long").alias("n_paragraphs"),
        F.size(F.collect_set("line")).cast("long").alias("n_repeated"),
        F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("line")))).alias("removed_lines"),
        F.sort_array(F.collect_set("kept_in")).alias("kept_in"),
        F.coalesce(F.max("n_shared"), F.lit(0)).alias("n_shared"),
        F.coalesce(F.max("passages"), F.array().cast(none["passages"])).alias("passages"),
        F.coalesce(F.max("passages_in"), F.array().cast(none["passages_in"])).alias("passages_in"),
    )
    words = F.aggregate("passages", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return whole.select("doc_id", "mark", "n_paragraphs", "n_repeated", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", "kept_in", "n_shared", (F.col("n_repeated") + F.col("n_shared")).alias("n_matches"), words.alias("n_passage_words"), "passages", "passages_in")


def cut_text(text: bytes, lines, spans) -> bytes:
    """The text without the lines of these numbers and the words in these spans (start, end, start, end, ...) of the whole text.

    Words go with the white space before them; a line that loses its last word goes too, other lines stay as they are.
    """
    lines, spans = set(lines), sorted(zip(spans[::2], spans[1::2]))
    out, first, k = [], 0, 0
    for number, line in enumerate(text.split(b"\n")):
        n = len(line.split())
        while k < len(spans) and spans[k][1] <= first:
            k += 1
        if number not in lines:
            if k < len(spans) and spans[k][0] < first + n:
                left, at, j = [], 0, k
                for i, m in enumerate(WORD.finditer(line), first):
                    while j < len(spans) and spans[j][1] <= i:
                        j += 1
                    if j == len(spans) or i < spans[j][0]:
                        left.append(line[at : m.end()])
                    at = m.end()
                if left:
                    out.append(b"".join(left) + line[at:])
            else:
                out.append(line)
        first += n
    return b"\n".join(out)


def remove_repeats(
    docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, width: int = WIDTH, rows: int = ROWS, miss: float = MISS, passage: int = PASSAGE, step: int = STEP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs without the repeated lines and the passages repeated in what is left; all else stays as it is."""
    _, lines, passages = _repeats(docs, similarity, min_words, width, rows, miss, passage, step, id_col, text_col)
    own, gone, words, at, mark = (fresh(docs, c) for c in ("own_mark", "gone_lines", "gone_words", "at_id", "at_mark"))
    flat = F.flatten(F.transform("passages", lambda s: F.array(s["start"], s["end"])))
    parts = lines.where("gone").select("doc_id", "mark", "line", F.lit(None).cast("array<int>").alias("words")).unionByName(
        passages.where(F.size("passages") > 0).select("doc_id", "mark", F.lit(None).cast("int").alias("line"), flat.alias("words"))
    )
    cuts = parts.groupBy(F.col("doc_id").alias(at), F.col("mark").alias(mark)).agg(F.collect_set("line").alias(gone), F.coalesce(F.max("words"), F.array().cast("array<int>")).alias(words))

    @F.pandas_udf("string")
    def cut(text: pd.Series, gone: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_text(t.encode(), list(a), list(b)).decode() for t, a, b in zip(text, gone, words)], dtype=object)

    joined = docs.withColumn(own, F.coalesce(F.xxhash64(text_col), F.lit(0))).join(cuts, F.col(id_col).cast("long").eqNullSafe(F.col(at)) & (F.col(own) == F.col(mark)), "left")
    touched = F.col(gone).isNotNull()
    left = F.when(touched, cut(F.when(touched, F.col(text_col)), gone, words)).otherwise(F.col(text_col))
    return joined.select(*(left.alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns))
