"""Conversation structure repair: weighted CYK parsing with a repair grammar over spans of turns."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, discard, first_row_key, materialize

RETYPE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Initials of roles that may follow each other.
LEGAL = ("su", "ua", "au")
#: The grammar in Chomsky normal form. A nonterminal is a span's first and last role left by the edits ("" for none left);
#: two join if the last of one and the first of the other may follow each other.
KINDS = ("", "ss", "uu", "ua", "au", "aa", "su", "sa")
RULES = {("", k): k for k in KINDS} | {(k, ""): k for k in KINDS} | {(a, b): a[0] + b[1] for a in KINDS for b in KINDS if a and b and a[1] + b[0] in LEGAL}
#: What a whole conversation may be: (s?(ua)+)?
START = ("", "ua", "sa")
#: Turns whose spans are all charted with all their splits; longer spans are joined out of such blocks.
BLOCK = 12
#: Turns and characters of a conversation that one task holds at once; longer ones are parsed in pieces.
HELD_TURNS = 4096
HELD_CHARS = 16_000_000

Cell = dict[str, tuple[int, str]]


def join(left: Cell, right: Cell) -> Cell:
    """The least (cost, audit) of every nonterminal over a span parted into these two.

    Audits of one span and equal cost are never prefixes of each other (a further letter would be an insertion, which
    costs), so the least parts make the least whole. Joining is associative: a span's cell is the same at every split.
    """
    out: Cell = {}
    for a, (cost_a, audit_a) in left.items():
        for b, (cost_b, audit_b) in right.items():
            kind = RULES.get((a, b))
            if kind is not None and (kind not in out or cost_a + cost_b <= out[kind][0]):
                found = (cost_a + cost_b, audit_a + audit_b)
                if kind not in out or found < out[kind]:
                    out[kind] = found
    return out


def least(*cells: Cell) -> Cell:
    out: Cell = {}
    for cell in cells:
        for kind, found in cell.items():
            if kind not in out or found < out[kind]:
                out[kind] = found
    return out


def closed(cell: Cell) -> Cell:
    """With the turns that may be inserted before and after it. Cells of single turns are closed, and so are those joined of them."""
    inserted = {"uu": (INSERT, "I"), "aa": (INSERT, "I")}
    while True:
        more = least(cell, join(inserted, cell), join(cell, inserted))
        if more == cell:
            return cell
        cell = more


#: Before the first turn.
EMPTY = closed({"": (0, "")})


def leaf(symbol: str) -> Cell:
    """A turn: D must go; u, a, s have that initial, any other letter none of them; a capital is a turn that is cut off."""
    cell = {"": (DELETE, "D")}
    if symbol != "D":
        extra, low = TRUNCATED * symbol.isupper(), symbol.lower()
        cell = least(cell, {"uu": (RETYPE + extra, "R"), "aa": (RETYPE + extra, "R")}, {low * 2: (extra, "K")} if low in "uas" else {})
    return closed(cell)


@lru_cache(maxsize=20_000)
def charted(symbols: str) -> Cell:
    """The cell of a block: every span of it from the shortest to the longest, every span over all its splits."""
    n = len(symbols)
    chart = {(i, i + 1): leaf(c) for i, c in enumerate(symbols)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            chart[i, i + length] = least(*(join(chart[i, k], chart[k, i + length]) for k in range(i + 1, i + length)))
    return chart.get((0, n), EMPTY)


class Spans:
    """The cell of a row of turns that grows: neighbouring spans of one length are joined as soon as both are there."""

    def __init__(self):
        self.spans: list[tuple[int, Cell]] = []
        self.waiting = ""

    def _push(self, cell: Cell) -> None:
        length = 1
        while self.spans and self.spans[-1][0] == length:
            cell = join(self.spans.pop()[1], cell)
            length *= 2
        self.spans.append((length, cell))

    def add(self, symbols: str) -> None:
        self.waiting += symbols
        whole = len(self.waiting) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._push(charted(self.waiting[i : i + BLOCK]))
        self.waiting = self.waiting[whole:]

    def cell(self) -> Cell:
        out = charted(self.waiting)
        for _, cell in reversed(self.spans):
            out = join(cell, out)
        return out


def parse(symbols: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits that leave a legal conversation; of equal ones the least audit."""
    spans = Spans()
    spans.add(symbols)
    cell = spans.cell()
    return min(cell[k] for k in START if k in cell)


def edited(turns, audit: str):
    """(role, text) of every turn that is left or inserted; turns: (role, text) in order."""
    turns, last = iter(turns), ""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        if letter != "K":
            role = "assistant" if last == "u" else "user"
        last = role[:1]
        yield role, text


def damage_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: test damage by crc32("conv_id:turn") % 20. Nulls count as one space.

    0 drops the row (kept here as gone, so that its conversation stays known), 1 empties the text, 2 removes its sentence
    ends, 3 repeats the row, 4 sets role user.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    found = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    )
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return found.select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"), times.alias("copy")).drop("copy")


def _states(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and state: G gone, B blank, else u, a, s or o (other) by the role's initial, as a capital if the text is cut off."""
    trimmed = F.btrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("u", "a", "s"), initial).otherwise("o")
    state = F.when(F.col("gone"), "G").when(trimmed == "", "B").when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), known).otherwise(F.upper(known))
    return turns.select("conv_id", "turn", "role", "text", state.alias("state"))


SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = "conv_id long, " + ", ".join(f"{c} long" for c in SUMMARY) + ", audit string, repaired_sha256 string"
_TURNS = "conv_id long, place long, role string, text string"
_FRAGMENT = (
    "conv_id long, part long, rows long, turns long, least long, most long, blank long, duplicate long, truncated long, illegal long, head string, tail string, cell array<struct<kind: string, cost: long, audit: string>>"
)
_CELL = pa.list_(pa.struct([("kind", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))


def _ordered(df: DataFrame, *before: str) -> DataFrame:
    return df.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *before, F.col("turn").asc_nulls_first(), "role", "text")


def _stream(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class Tally:
    """What is counted over turns in their order, and their cell."""

    def __init__(self):
        self.rows = self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.head = self.tail = None
        self.spans = Spans()

    def add(self, turn, role: str, state: str, again: bool, copies: int = 1) -> None:
        """Equal neighbouring rows; all but the first of them are duplicates, and so is that if it came ``again``."""
        if state == "G":
            return
        initial = role[:1]
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        self.illegal += (copies - 1 if initial * 2 not in LEGAL else 0) + (self.rows > 0 and self.tail + initial not in LEGAL)
        self.head = initial if self.rows == 0 else self.head
        self.tail, self.rows = initial, self.rows + copies
        if state == "B":
            self.blank += copies
            symbols = "D" * copies
        else:
            self.duplicate += copies - (not again)
            self.truncated += not again and state.isupper()
            symbols = "D" * copies if again else state + "D" * (copies - 1)
        self.spans.add(symbols)


def summary(t: dict, cell: Cell) -> dict:
    cost, audit = min(cell[k] for k in START if k in cell)
    gaps = t["most"] - t["least"] + 1 - t["turns"] if t["turns"] else 0
    return {"gaps": gaps, **{c: t[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}


class Results:
    """Rows of answers, handed out in batches: a summary for each conversation, or its repaired turns."""

    def __init__(self, as_turns: bool):
        self.as_turns, self.rows = as_turns, []
        names = ["conv_id", "place", "role", "text"] if as_turns else ["conv_id", *SUMMARY, "audit", "repaired_sha256"]
        self.schema = pa.schema([(c, pa.string() if c in ("role", "text", "audit", "repaired_sha256") else pa.int64()) for c in names])

    def batch(self):
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist([dict(zip(self.schema.names, r)) for r in rows], self.schema)

    def add(self, conv, found: dict, turns):
        """Yields batches that are full. A digest is taken turn by turn, so that only the audit is held."""
        if self.as_turns:
            for place, (role, text) in enumerate(edited(turns, found["audit"])):
                self.rows.append((conv, place, role, text))
                if len(self.rows) >= 2000:
                    yield self.batch()
        else:
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(edited(turns, found["audit"])):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            self.rows.append((conv, *(found[c] for c in SUMMARY), found["audit"], digest.hexdigest()))
            if len(self.rows) >= 2000:
                yield self.batch()


def _whole(as_turns: bool, held_turns: int, held_chars: int):
    """mapInArrow over sorted turns: answers for conversations that lie inside a task and fit; the ids of all others, with null in every other field.

    The first and last conversation of a task may go on in its neighbours.
    """

    def held(turns):
        kept, chars = [], 0
        for row in turns:
            kept.append(row)
            chars += len(row[3])
            if len(kept) > held_turns or chars > held_chars:
                return None
        return kept

    def run(batches):
        out = Results(as_turns)

        def answer(conv, rows):
            tally, seen = Tally(), set()
            for _, turn, role, text, state in rows:
                again = state not in "GB" and (role, text) in seen
                tally.add(turn, role, state, again)
                if state not in "GB":
                    seen.add((role, text))
            yield from out.add(conv, summary(vars(tally), tally.spans.cell()), ((r[2], r[3]) for r in rows if r[4] != "G"))

        def left(conv):
            out.rows.append((conv, *[None] * (len(out.schema) - 1)))

        waiting, first = None, True
        for conv, turns in groupby(_stream(batches), key=lambda r: r[0]):
            if waiting is not None:
                yield from answer(*waiting)
                waiting = None
            rows = None if first else held(turns)
            if rows is None:
                left(conv)
            else:
                waiting = (conv, rows)
            first = False
        if waiting is not None:
            left(waiting[0])
        if out.rows:
            yield out.batch()

    return run


def _fragments(batches):
    """mapInArrow over sorted turns (with again, copies): one row for each conversation in the task."""
    part = first_row_key() >> 40
    names = [f.split()[0] for f in _FRAGMENT.split(", cell ")[0].split(", ")]
    for conv, turns in groupby(_stream(batches), key=lambda r: r[0]):
        tally = Tally()
        for _, turn, role, _, state, again, copies in turns:
            tally.add(turn, role, state, again, copies)
        found = {"conv_id": conv, "part": part, **{k: v for k, v in vars(tally).items() if k in names}}
        yield pa.RecordBatch.from_arrays([pa.array([found[c]], pa.string() if c in ("head", "tail") else pa.int64()) for c in names] + [_packed(tally.spans.cell())], [*names, "cell"])


def _packed(cell: Cell) -> pa.Array:
    return pa.array([[{"kind": k, "cost": c, "audit": a} for k, (c, a) in cell.items()]], _CELL)


def _joined(table: pa.Table) -> pa.Table:
    """Neighbouring fragments of one conversation made one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    for r in rows:
        r["cell"] = {c["kind"]: (c["cost"], c["audit"]) for c in r["cell"]}

    def two(x, y):
        both = {c: x[c] + y[c] for c in ("rows", "turns", "blank", "duplicate", "truncated", "illegal")}
        both["turns"] -= x["most"] is not None and x["most"] == y["least"]
        both["illegal"] += x["rows"] > 0 and y["rows"] > 0 and x["tail"] + y["head"] not in LEGAL
        both |= {"conv_id": x["conv_id"], "part": x["part"], "least": y["least"] if x["least"] is None else x["least"], "most": x["most"] if y["most"] is None else y["most"]}
        both |= {"head": x["head"] if x["rows"] else y["head"], "tail": y["tail"] if y["rows"] else x["tail"]}
        return both | {"cell": join(x["cell"], y["cell"])}

    while len(rows) > 1:
        rows = [two(*rows[i : i + 2]) if i + 1 < len(rows) else rows[i] for i in range(0, len(rows), 2)]
    cell = _packed(rows[0].pop("cell"))
    schema = table.schema
    return pa.table([cell if f.name == "cell" else pa.array([rows[0][f.name]], f.type) for f in schema], schema=schema)


def _parsed_in_pieces(turns: DataFrame, as_turns: bool) -> DataFrame:
    """Answers for conversations of any length: turns are dealt by ranges, so that one conversation lies in many tasks.

    Rows that repeat are counted first. Each task joins the turns it has into one cell for each conversation; then 16
    neighbouring tasks' cells at a time are joined, until each conversation has one. The repaired text is then read once
    more in order, with the audit before it: a task holds one audit (a letter for each edit, which is the answer itself)
    and a batch of turns.
    """
    counted = materialize(turns.groupBy("conv_id", "turn", "role", "text", "state").agg(F.count(F.lit(1)).alias("copies")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    spoken = counted.where(~F.col("state").isin("G", "B")).select("conv_id", "role", F.sha2("text", 256).alias("digest"), place.alias("place"))
    repeated = materialize(spoken.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first <> last"), "repeated")
    c, r = counted.withColumn("digest", F.sha2("text", 256)).alias("c"), repeated.alias("r")
    same = F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("c.role") == F.col("r.role")) & (F.col("c.digest") == F.col("r.digest"))
    again = F.coalesce(F.struct(F.col("turn").isNotNull().alias("some"), "turn") > F.col("first"), F.lit(False))
    marked = c.join(r, same, "left").select("c.conv_id", "turn", "c.role", "text", "state", again.alias("again"), "copies")
    ranged = _ordered(marked.repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"))
    pieces = materialize(ranged.mapInArrow(_fragments, _FRAGMENT), "pieces")
    last, shift = pieces.agg(F.max("part")).first()[0] or 0, 0
    while last >> shift:  # a round leaves 16 times fewer cells of a conversation
        shift += 4
        joined = materialize(pieces.groupBy("conv_id", F.shiftright("part", shift)).applyInArrow(_joined, _FRAGMENT), "pieces")
        discard(pieces)
        pieces = joined
    head = pieces.select("conv_id", F.lit(0).alias("is_turn"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct(*(c for c in pieces.columns if c != "conv_id")).alias("piece"))
    body = turns.where("state <> 'G'").select("conv_id", F.lit(1).alias("is_turn"), "turn", "role", "text", F.lit(None).cast(head.schema["piece"].dataType).alias("piece"))
    dealt = _ordered(head.unionByName(body).repartition("conv_id"), "is_turn")

    def run(batches):
        out = Results(as_turns)
        for conv, rows in groupby(_stream(batches), key=lambda x: x[0]):
            piece = next(rows)[5]
            found = summary(piece, {k["kind"]: (k["cost"], k["audit"]) for k in piece["cell"]})
            yield from out.add(conv, found, ((x[3], x[4]) for x in rows))
        if out.rows:
            yield out.batch()

    return dealt.mapInArrow(run, _TURNS if as_turns else _RESULT)


def _repaired(turns: DataFrame, as_turns: bool, held_turns: int, held_chars: int) -> DataFrame:
    states = _states(turns)
    # Rows of one conversation, even equal ones, may lie in several tasks; the last column parts equal rows.
    ranged = states.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "any").drop("any")
    inside = materialize(_ordered(ranged).mapInArrow(_whole(as_turns, held_turns, held_chars), _TURNS if as_turns else _RESULT), "conversations")
    mark = "place" if as_turns else "cost"
    left = materialize(inside.where(F.col(mark).isNull()).select(F.col("conv_id").alias("left_id")).distinct(), "left")
    rest = states.join(left, F.col("conv_id").eqNullSafe(F.col("left_id")), "left_semi")
    return inside.where(F.col(mark).isNotNull()).unionByName(_parsed_in_pieces(rest, as_turns))


def repair_conversations(turns: DataFrame, held_turns: int = HELD_TURNS, held_chars: int = HELD_CHARS) -> DataFrame:
    """A row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    turns: conv_id, turn (longs), role, text (not null), gone (rows that only make their conversation known). Turns stand
    in the order of turn (nulls first), role and text. A turn's first fault counts: blank, duplicate (role and text seen
    earlier), truncated (does not end in ``.``, ``!`` or ``?``). Keep costs nothing, Rerole 3, Delete 4, Insert 3, a truncated
    turn that stays 3 more; blank and duplicate turns must go. The cheapest edits that leave ``(s?(ua)+)?`` are found by CYK:
    a span's cell holds the least (cost, audit) of every nonterminal; blocks of 12 turns are charted over all spans and
    splits, and longer spans are joined out of spans of equal length, where any one split gives the cell.

    Conversations that a task has whole and that fit (HELD_TURNS, HELD_CHARS) are answered in one pass over sorted turns;
    the others, whatever their length, in pieces spread over tasks, with the same result. Their text is hashed in order by
    one task that reads it turn by turn, since SHA-256 can't be parted.

    A null conv_id is a conversation. An empty role has no initial and can't stay as it is. gaps leaves null turns out.
    Rows that repeat are duplicates. No rows but gone ones: zeros, an empty audit, the hash of the empty string. Empty
    table: no rows. Other columns are not read.
    """
    return _repaired(turns, False, held_turns, held_chars)


def repaired_turns(turns: DataFrame, held_turns: int = HELD_TURNS, held_chars: int = HELD_CHARS) -> DataFrame:
    """conv_id, place (from 0), role, text: the turns of every conversation after the edits of repair_conversations."""
    return _repaired(turns, True, held_turns, held_chars)
