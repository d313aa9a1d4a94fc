import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolume.llm import conversations as conv

SPACES = " \t\n\x0b\x0c\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(turns):
    """(cost, audit, left) by the shortest path over (turns read, last role left); turns: (initial, must go, cut off)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, left = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(turns) and last in ("", "a"):
            return cost, audit, left
        for role in "ua":
            if (last, role) in NEXT:
                heapq.heappush(heap, (cost + 3, audit + "I", i, role, (*left, (None, role))))
        if i < len(turns):
            initial, must_go, cut = turns[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, left))
            if not must_go:
                if (last, initial) in NEXT:
                    heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, initial, (*left, (i, None))))
                for role in "ua":
                    if (last, role) in NEXT:
                        heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, role, (*left, (i, role))))


def by_hand(turns):
    """The same by trying all edits, with two insertions in a row at most."""
    best = None
    inserts = [c for n in range(3) for c in itertools.product("ua", repeat=n)]
    choices = [["D"] if must_go else ["D", "K", "Ru", "Ra"] for _, must_go, _ in turns]
    for picks in itertools.product(*choices):
        for gaps in itertools.product(inserts, repeat=len(turns) + 1):
            cost, audit, roles = 3 * len(gaps[0]), "I" * len(gaps[0]), "".join(gaps[0])
            for (initial, _, cut), pick, gap in zip(turns, picks, gaps[1:]):
                cost += {"D": 4, "K": 0}.get(pick, 3) + (3 if cut and pick != "D" else 0) + 3 * len(gap)
                audit += pick[0] + "I" * len(gap)
                roles += ("" if pick == "D" else initial if pick == "K" else pick[1]) + "".join(gap)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def turns_of(symbols):
    return [(c.lower(), c == "D", c.isupper()) for c in symbols]


@pytest.mark.parametrize("symbols", ["", "u", "a", "s", "D", "o", "uu", "as", "Sa", "uD", "Us", "oA", "aUs", "uDa"])
def test_parse_equals_all_edits(symbols):
    assert conv.parse(symbols) == by_hand(turns_of(symbols)) == cheapest(turns_of(symbols))[:2]


@settings(max_examples=300, deadline=None)
@given(st.text("uasoUASOD", max_size=70))
def test_parse_equals_shortest_path(symbols):
    assert conv.parse(symbols) == cheapest(turns_of(symbols))[:2]


@settings(max_examples=100, deadline=None)
@given(st.text("uasoUASOD", min_size=1, max_size=12), st.integers(0, 12))
def test_cells_are_closed_and_the_same_at_every_split(symbols, at):
    cell = conv.charted(symbols)
    assert conv.closed(cell) == cell
    assert conv.join(conv.charted(symbols[:at]), conv.charted(symbols[at:])) == cell


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(c)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(c, turn, role, text, kind)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    groups = defaultdict(list)
    for c, turn, role, text, kind in damaged(rows):
        groups[c].append((turn, role, text, kind))
    out, texts = Counter(), {}
    for c, turns in groups.items():
        turns = sorted(((turn is not None, turn or 0, role, text) for turn, role, text, kind in turns if kind != 0))
        seen, states, count = set(), [], Counter()
        for _, _, role, text in turns:
            solid = text.strip(SPACES)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            states.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [t for some, t, _, _ in turns if some]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, left = cheapest(states)
        full = {"u": "user", "a": "assistant"}
        texts[c] = [(turns[i][2] if role is None else full[role], "" if i is None else turns[i][3]) for i, role in left]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in texts[c]).encode()).hexdigest()
        out[c, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest] += 1
    return out, texts


def awkward(rng):
    text = lambda: rng.choice([None, "", " \n", "Yes.", "No!", "so", "well, then?  ", "a.b", "日本。", "long " * 300 + "end."])
    rows = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "umpire", "User"]), text()) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, t, r, f"{r} {t}.") for t, r in enumerate(["system", "user", "assistant", "assistant"])]
    rows += [(50, None, "user", "first?"), (50, None, "user", "first?"), (50, 7, "assistant", "x"), (50, 3, "user", "y.")]
    rows += [(51, t // 2, rng.choice(["user", "assistant"]), rng.choice(["again.", f"text {t}."])) for t in range(150)]
    rows += [(52, 1, "user", "the same.")] * 80
    rows += [(c, 5, "user", "one.") for c in range(100, 160)]
    return rows


KIND = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("held_turns, parts", [(conv.HELD_TURNS, 3), (5, 7), (0, 40)])
def test_equals_brute_force(spark, held_turns, parts):
    rows = awkward(random.Random(9))
    df = spark.createDataFrame([(*r, 1, "g") for r in rows], KIND + ", `gone.x` int, state string").repartition(parts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        turns = conv.damage_turns(df)
        want, texts = brute(rows)
        assert Counter(map(tuple, conv.repair_conversations(turns, held_turns).collect())) == want
        got = defaultdict(list)
        for r in sorted(conv.repaired_turns(turns, held_turns).where("place is not null").collect(), key=lambda r: r.place):
            got[r.conv_id].append((r.role, r.text))
        assert got == {c: t for c, t in texts.items() if t}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_dropped_and_empty_table(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "gone.")], KIND)
    assert list(map(tuple, conv.repair_conversations(conv.damage_turns(df)).collect())) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conv.repair_conversations(conv.damage_turns(df.limit(0))).count() == 0
    assert conv.repaired_turns(conv.damage_turns(df)).count() == 0
