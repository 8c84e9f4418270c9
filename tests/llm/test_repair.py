"""Operator 12: the search against Dijkstra, whole results against a plain re-computation, cut conversations against whole ones."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from gridbill.llm import repair as R

SPACE = " \t\n\x0b\x0c\r"
ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 2, "user", "Hi."), (1, 3, "assistant", "no end"),
    (2, 0, "system", "Rules!"), (2, 0, "system", "Rules!"), (2, 5, "assistant", "a?"), (2, None, "user", "first."),
    (3, None, None, None), (None, 1, "user", "null id."), (None, 2, "assistant", "\x0b \r"), (4, 7, "tool", "x."), (4, 8, "", "y."),
    (5, -3, "user", "é. \n\t"), (5, 1 << 40, "assistant", "　"), (6, 1, "user", "long " * 40_000 + "."), (6, 2, "assistant", "ok."),
    *[(7, i, ("user", "assistant")[i % 3 == 1], f"t{i % 11}" + "."[: i % 7]) for i in range(90)],
    *[(8, 4, "user", "same.")] * 30, *[(8, 4, "assistant", f"other {i}.") for i in range(30)],
    *[(9, None, "system", "s.")] * 5, *[(i, i, "user", "alone.") for i in range(20, 60)],
]


def dijkstra(codes, state=0, ends=R.ACCEPTED, tail=True):
    """(cost, edits, end state) of the cheapest path, then the ASCII-least."""
    heap, seen = [(0, "", 0, state, False)], set()
    while heap:
        cost, edits, i, q, over = heapq.heappop(heap)
        if over:
            return cost, edits, q
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(codes) and ends[q] < R.NEVER:
            heapq.heappush(heap, (cost + ends[q], edits, i, q, True))
        other = R.STEP[q, R.ROLE[q][0]]
        if i < len(codes) or tail:
            heapq.heappush(heap, (cost + 2, edits + "I", i, other, False))
        if i < len(codes):
            c = codes[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, q, False))
            if c != "-":
                stay = int(c.isupper())
                if (q, c.lower()) in R.STEP:
                    heapq.heappush(heap, (cost + stay, edits + "K", i + 1, R.STEP[q, c.lower()], False))
                heapq.heappush(heap, (cost + 2 + stay, edits + "R", i + 1, other, False))
    return R.NEVER, "", state


def test_search_is_the_cheapest_and_least():
    rng = random.Random(5)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8] * 60 + [40, 64, 120]:
        codes = "".join(rng.choices("suaxSUAX-", [1, 8, 8, 1, 1, 2, 2, 1, 3], k=n))
        assert R.cheapest(codes, 0, R.ACCEPTED) == dijkstra(codes), codes
        assert R.lower_bounds(codes)[0] <= dijkstra(codes)[0]


def test_search_between_states():
    rng = random.Random(6)
    for _ in range(300):
        codes = "".join(rng.choices("suaxUA-", k=rng.randint(1, 7)))
        a, ends = rng.randrange(4), tuple(rng.choice([0, 1, 4, R.NEVER]) for _ in range(4))
        assert R.cheapest(codes, a, ends, False) == dijkstra(codes, a, ends, False), (codes, a, ends)


def test_worst_cases_end():
    for codes in ("u" * 256, "-" * 256, "x" * 200, "aU" * 128, "s" * 256):
        assert R.cheapest(codes, 0, R.ACCEPTED) == dijkstra(codes)


def expected(rows):
    """The contract, row by row."""
    said = lambda v: " " if v is None else str(v)
    groups = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        group = groups.setdefault(conv, [])
        group += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        codes, seen, n = [], set(), dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in group:
            body = text.rstrip(SPACE)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not body:
                n["blank"] += 1
                codes.append("-")
            elif (role, text) in seen:
                n["duplicate"] += 1
                codes.append("-")
            elif body[-1] not in ".!?":
                n["truncated"] += 1
                codes.append(letter.upper())
            else:
                codes.append(letter)
            seen.add((role, text))
        turns = {t for t, _, _ in group if t is not None}
        first = [r[:1] for _, r, _ in group]
        cost, audit, _ = dijkstra("".join(codes))
        lines, state, left = [], 0, iter(group)
        for e in audit:
            if e == "I":
                role, text = R.ROLE[state], ""
            else:
                _, role, text = next(left)
                if e == "D":
                    continue
                role = R.ROLE[state] if e == "R" else role
            lines.append(f"{role}:{text}")
            state = R.STEP[state, role[0]]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n.values(), sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def results(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


@pytest.fixture()
def conversations(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, code string, copy int, conv string")


@pytest.mark.parametrize(("long", "stretch"), [(256, 64), (3, 2), (0, 5)])
def test_odd_conversations(conversations, monkeypatch, long, stretch):
    monkeypatch.setattr(R, "LONG", long)
    monkeypatch.setattr(R, "STRETCH", stretch)
    got = results(R.repair(conversations(ODD).repartition(5)))
    assert got == expected(ODD)


def test_a_conversation_of_most_rows(conversations, monkeypatch):
    monkeypatch.setattr(R, "LONG", 40)
    monkeypatch.setattr(R, "STRETCH", 16)
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.7 else i % 100, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a", "b", "c"]) * rng.randint(0, 30) + rng.choice([".", "!", ""])) for i in range(3000)]
    assert results(R.repair(conversations(rows).repartition(7))) == expected(rows)


def test_no_conversations(conversations):
    assert R.repair(conversations([])).count() == 0


def test_op12_on_the_test_data(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(R.op12_repair(spark, tiny)) == expected(rows)
