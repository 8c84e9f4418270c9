"""Repair of conversation structure by iterative-deepening A* (operator 12).

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Edits: Keep a
row (0), Rerole it to user or assistant (2), Delete it (3; a must for blank and repeated rows)
and Insert an empty user or assistant row (2); a truncated row that stays adds 1. The
search goes through the rows depth first, takes edits in ASCII order (D, I, K, R), cuts
where cost so far plus a lower bound of the rest exceeds the bound, and begins again
with the least cost that exceeded it. A table remembers with how much left over a place has
failed. The first path that is accepted is the cheapest, and of these the ASCII-least.

Conversations of up to ``LONG`` rows are searched whole, in one pass over partitions sorted by
conversation. Longer ones (one may hold a third of all rows) are cut into stretches of ``STRETCH``
rows that lie in many tasks: each is searched between every two states of the grammar, the
costs (16 numbers a stretch) are chained backwards to what the rest costs from each state,
and each stretch is searched again towards these costs. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common
from gridbill.operators.common import key_join

LONG, STRETCH = 256, 32
#: States: nothing yet, after the system row, after a user row, after an assistant row.
STATES = START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role's initial; what is not here is not allowed.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The one role that may be inserted or taken by a rerole in a state.
ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NEVER = 1 << 30
LEGAL = ("su", "ua", "au")

#: White space of the contract.
SPACE = " \t\n\x0b\x0c\r"


# --------------------------------------------------------------------------- search
def lower_bounds(rows: str) -> list[int]:
    """For each place, what its remaining rows cost at least.

    Rows are coded by a letter: the initial of a row that may stay (``s``, ``u``, ``a``, any other ``x``), in
    upper case if it is truncated, or ``-`` for one that must go. A row that must go costs a
    Delete and a truncated one costs 1 whatever is done to it. Besides, an edit mends at most two
    of the neighbouring pairs (of rows that may stay) that are not allowed, and costs 2 or more beyond that.
    """
    out, base, wrong, after = [0] * (len(rows) + 1), 0, 0, ""
    for i in range(len(rows) - 1, -1, -1):
        c = rows[i]
        if c == "-":
            base += DELETE
        else:
            base += TRUNCATED * c.isupper()
            c = c.lower()
            wrong += bool(after) and c + after not in LEGAL
            after = c
        out[i] = base + 2 * ((wrong + 1) // 2)
    return out


@lru_cache(1 << 16)
def cheapest(rows: str, state: int, ends: tuple[int, int, int, int], tail: bool = True) -> tuple[int, str, int]:
    """(cost, edits, end state): the cheapest way through coded rows from a state, the ASCII-least of these.

    ``ends``: what ending in each state costs (``NEVER``: it may not end there); it counts in the cost. ``tail``:
    rows may be inserted after the last one. Edits are the letters D, I, K, R. Without any way the cost is ``NEVER``.
    """
    least, n, path = lower_bounds(rows), len(rows), []
    # The last states are reached from every state; the two first ones only by deleting all rows from
    # them on, and the second also from the first.
    last = min(ends[USER], ends[ASSISTANT])

    def at_least(i: int, state: int) -> int:
        found = least[i] + last
        if state == SYSTEM:
            return min(found, DELETE * (n - i) + ends[SYSTEM])
        if state == START:
            return min(found, least[i] + ends[SYSTEM], DELETE * (n - i) + ends[START])
        return found

    bound, failed, over = at_least(0, state), {}, NEVER
    if bound >= NEVER:
        return NEVER, "", state
    # Deleting all rows that need not stay and inserting two reaches each end that can be reached.
    most = DELETE * n + 3 * INSERT + max(e for e in ends if e < NEVER)

    def search(i: int, state: int, left: int) -> int:
        """The end state of the first path from here that costs no more than ``left``, or -1."""
        nonlocal over
        if (rest := at_least(i, state)) > left:
            over = min(over, bound - left + rest)
            return -1
        if failed.get((i, state), -1) >= left:
            return -1
        c = rows[i] if i < n else ""
        stays = TRUNCATED * c.isupper()
        if i == n:
            if ends[state] <= left:
                return state
            over = min(over, bound - left + ends[state])
        else:
            path.append("D")
            if (end := search(i + 1, state, left - DELETE)) >= 0:
                return end
            path.pop()
        if i < n or tail:
            path.append("I")
            if (end := search(i, STEP[state, ROLE[state][0]], left - INSERT)) >= 0:
                return end
            path.pop()
        if c not in ("", "-"):
            kept = STEP.get((state, c.lower()))
            if kept is not None:
                path.append("K")
                if (end := search(i + 1, kept, left - KEEP - stays)) >= 0:
                    return end
                path.pop()
            path.append("R")
            if (end := search(i + 1, STEP[state, ROLE[state][0]], left - REROLE - stays)) >= 0:
                return end
            path.pop()
        # deeper places may have failed on this bound only; the least cost beyond it is kept in ``over``
        failed[i, state] = max(failed.get((i, state), -1), left)
        return -1

    while True:
        end = search(0, state, bound)
        if end >= 0:
            return bound, "".join(path), end
        if over > most:
            return NEVER, "", state
        bound, over = over, NEVER
        failed.clear()


ACCEPTED = (0, NEVER, NEVER, 0)


def repaired(edits: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[bytes]:
    """``role:text`` of each row that the edits leave, from a state on; ``rows`` gives (role, text)."""
    for e in edits:
        if e == "I":
            role, text = ROLE[state], ""
        else:
            role, text = next(rows)
            if e == "D":
                continue
            role = ROLE[state] if e == "R" else role
        state = STEP[state, role[0]]
        yield f"{role}:{text}".encode()


# --------------------------------------------------------------------------- rows
def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, copy): the rows after damage; nulls of role and text are one space.

    By crc32 of ``conv_id:turn`` (nulls: one space) mod 20: 0 drops a row, 1 empties its text, 2 removes
    its ``.``, ``!`` and ``?``, 3 repeats it (copy 1), 4 makes it a user's. A dropped row
    stays as a mark of its conversation, with a null ``copy``. ``conv``: the id as text, '' for null.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat_ws(":", text["conv_id"], text["turn"])) % 20
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "conv_id", "turn",
                                text["role"].alias("role"), text["text"].alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 0, F.array(F.lit(None).cast("int"))).when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv", "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    )


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``code``: ``-`` blank, else the row's initial (other than s, u, a: x), in upper case where it is truncated.

    A role that is empty has no initial and is an x.
    """
    last = F.rtrim("text", F.lit(SPACE)).substr(-1, 1)
    letter = F.substring("role", 1, 1)
    letter = F.when(letter.isin("s", "u", "a"), letter).otherwise("x")
    code = F.when(last == "", "-").when(~last.isin(".", "!", "?"), F.upper(letter)).otherwise(letter)
    return rows.withColumn("code", F.when(F.col("copy").isNotNull(), code))


OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def one(conv_id: int | None, rows: list[tuple]) -> tuple:
    """``OUT`` of a whole conversation from its rows (turn, role, text, copy, code) in order."""
    rows = [r for r in rows if r[3] is not None]
    said, codes, repeats = set(), [], 0
    for _, role, text, _, code in rows:
        again = code != "-" and (role, text) in said
        said.add((role, text))
        repeats += again
        codes.append("-" if again else code)
    first = [r[1][:1] for r in rows]
    illegal = sum(a + b not in LEGAL for a, b in zip(first, first[1:], strict=False))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    cost, audit, _ = cheapest("".join(codes), START, ACCEPTED)
    digest = hashlib.sha256(b"\n".join(repaired(audit, START, ((r[1], r[2]) for r in rows)))).hexdigest()
    return conv_id, gaps, codes.count("-") - repeats, repeats, sum(c.isupper() for c in codes), illegal, cost, audit, digest


def in_runs(df: DataFrame, key: str, columns: list[str], make: Callable[[], Callable[[tuple | None], list[tuple]]], schema: str) -> DataFrame:
    """Rows of ``df``, whose partitions are sorted with ``key`` first, told one by one to a function of the task.

    The function gets each row (columns in order) and None after the last one of a run of equal keys, and answers
    with rows of ``schema``. It alone says what is kept in memory.
    """
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    out = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tell, last, done = make(), None, []
        for b in batches:
            for s in common.slices(b, "text") if "text" in columns else [b]:
                for k, *row in zip(*(c.to_pylist() for c in s.columns), strict=True):
                    if last is not None and k != last:
                        done += tell(None)
                    last = k
                    done += tell(tuple(row))
                if done:
                    yield packed(done)
                    done = []
        if last is not None:
            done += tell(None)
        if done:
            yield packed(done)

    return df.select(key, *columns).mapInArrow(run, schema)


def in_order(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in order]


def repair_short(rows: DataFrame) -> DataFrame:
    """``OUT`` of conversations of at most ``LONG`` rows, each searched whole."""

    def make():
        held: list[tuple] = []

        def tell(row: tuple | None) -> list[tuple]:
            if row is not None:
                held.append(row)
                return []
            done = [one(held[0][0], [r[1:] for r in held])]
            held.clear()
            return done

        return tell

    dealt = rows.repartition("conv").sortWithinPartitions(*in_order(["conv", "turn", "role", "text", "copy"]))
    return in_runs(dealt, "conv", ["conv_id", "turn", "role", "text", "copy", "code"], make, OUT)


# --------------------------------------------------------------------------- long conversations
def stretched(rows: DataFrame) -> DataFrame:
    """Rows of long conversations in order, with their place: (pid, k, seq) by which they sort in a conversation.

    Rows are dealt out by ranges of their order, so a conversation lies in as many tasks as it needs; in a
    task each ``STRETCH`` rows of a conversation are a stretch ``k``. Rows that agree in conversation, turn,
    role and the first 32 characters stay in one task, which streams them. Stored, so places are fixed.
    """

    def make():
        from pyspark import TaskContext

        pid, k, seq = TaskContext.get().partitionId(), 0, 0

        def tell(row: tuple | None) -> list[tuple]:
            nonlocal k, seq
            if row is None or seq == STRETCH:
                k, seq = k + 1, 0
            if row is None:
                return []
            conv, role, text, code = row
            seq += 1
            return [(conv, pid, k, seq, role, text, code, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest())]

        return tell

    order = ["conv", "turn", "role", "text", "copy"]
    ranged = rows.withColumn("text32", F.substring("text", 1, 32)).repartitionByRange(*in_order([*order[:3], "text32", "copy"]))
    placed = in_runs(ranged.withColumn("own", F.col("conv")).sortWithinPartitions(*in_order(order)), "conv", ["own", "role", "text", "code"], make,
                     "conv string, pid int, k int, seq int, role string, text string, code string, said string")
    return common.stored(placed, "stretched")


def stretches(placed: DataFrame) -> DataFrame:
    """(conv, pid, k, codes, blank, duplicate, illegal, head, tail) of each stretch, without texts.

    A row is repeated unless its place is the first one of its role and text in the conversation. The
    first places are found by one aggregate and joined back by place, which no two rows share.
    """
    place = F.struct("pid", "k", "seq")
    firsts = placed.groupBy("conv", "said").agg(F.min(place).alias("p")).select("p.*", F.lit(True).alias("first"))
    light = placed.select("conv", "pid", "k", "seq", "code", F.substring("role", 1, 1).alias("initial")).join(firsts, ["pid", "k", "seq"], "left")
    again = F.col("first").isNull() & (F.col("code") != "-")
    final = F.when(again, "-").otherwise(F.col("code"))
    per = light.groupBy("conv", "pid", "k").agg(
        F.array_sort(F.collect_list(F.struct("seq", final.alias("code"), "initial"))).alias("r"),
        F.count_if(F.col("code") == "-").alias("blank"), F.count_if(again).alias("duplicate"))
    pairs = F.zip_with(F.slice("r", 1, F.size("r") - 1), F.slice("r", 2, F.size("r")), lambda a, b: F.concat(a["initial"], b["initial"]))
    illegal = F.when(F.size("r") > 1, F.size(F.filter(pairs, lambda x: ~x.isin(*LEGAL)))).otherwise(0)
    return per.select("conv", "pid", "k", F.array_join(F.transform("r", lambda x: x["code"]), "").alias("codes"), "blank", "duplicate",
                      illegal.cast("long").alias("illegal"), F.col("r")[0]["initial"].alias("head"), F.element_at("r", -1)["initial"].alias("tail"))


def _sole(state: int) -> tuple[int, ...]:
    return tuple(0 if s == state else NEVER for s in STATES)


#: What is inserted after the last row, by state, and its cost.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
TAIL_COSTS = tuple(INSERT * len(TAIL[s]) for s in STATES)


def crossings(cut: DataFrame) -> DataFrame:
    """Stretches with ``m``: what each costs from state to state, 16 numbers row by row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(m=[[min(NEVER, cheapest(c, a, _sole(b), False)[0]) for a in STATES for b in STATES] for c in f["codes"]])

    return cut.select("conv", "pid", "k", "codes").mapInPandas(run, "conv string, pid int, k int, codes string, m array<int>")


def backwards(crossed: DataFrame) -> DataFrame:
    """(conv, pid, k, codes, g0..g3): what all that follows a stretch costs from each state; 16 numbers a stretch pass in order."""

    def make():
        after = list(TAIL_COSTS)

        def tell(row: tuple | None) -> list[tuple]:
            nonlocal after
            if row is None:
                after = list(TAIL_COSTS)
                return []
            conv, pid, k, codes, *m = row
            out = (conv, pid, k, codes, *after)
            after = [min(NEVER, min(m[4 * a + b] + after[b] for b in STATES)) for a in STATES]
            return [out]

        return tell

    wide = crossed.select("conv", F.col("conv").alias("own"), "pid", "k", "codes", *[F.col("m")[i].alias(f"m{i}") for i in range(16)])
    dealt = wide.repartition("conv").sortWithinPartitions("conv", F.col("pid").desc(), F.col("k").desc())
    return in_runs(dealt, "conv", dealt.columns[1:], make, "conv string, pid int, k int, codes string, g0 int, g1 int, g2 int, g3 int")


def forwards(aimed: DataFrame) -> DataFrame:
    """(conv, pid, k, entry, edits, cost): each stretch with the state it is entered in and its edits."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ways = [[cheapest(r.codes, a, (r.g0, r.g1, r.g2, r.g3), False) for a in STATES] for r in f.itertuples()]
            yield pd.DataFrame({"conv": f["conv"], "pid": f["pid"], "k": f["k"], "ways": [[w[1] for w in x] for x in ways], "ends": [[w[2] for w in x] for x in ways],
                                "costs": [[w[0] for w in x] for x in ways]})

    found = aimed.mapInPandas(search, "conv string, pid int, k int, ways array<string>, ends array<int>, costs array<int>")

    def make():
        state, first = START, True

        def tell(row: tuple | None) -> list[tuple]:
            nonlocal state, first
            if row is None:
                state, first = START, True
                return []
            conv, pid, k, ways, ends, costs = row
            out = (conv, pid, k, state, ways[state], ends[state], costs[state] if first else 0)
            state, first = ends[state], False
            return [out]

        return tell

    dealt = found.withColumn("own", F.col("conv")).repartition("conv").sortWithinPartitions("conv", "pid", "k")
    return in_runs(dealt, "conv", ["own", "pid", "k", "ways", "ends", "costs"], make, "conv string, pid int, k int, entry int, edits string, leaves int, cost int")


def digests(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): the rows of a conversation pass its task in order and only the hash is kept.

    A digest of a whole conversation can only be taken in order, so this step streams a conversation through one task.
    """

    def make():
        hashed, started, edits, state, held = hashlib.sha256(), False, "", START, []
        conv = place = None

        def flush() -> None:
            nonlocal started, held
            for line in repaired(edits, state, iter(held)):
                hashed.update(b"\n" + line if started else line)
                started = True
            held = []

        def tell(row: tuple | None) -> list[tuple]:
            nonlocal hashed, started, edits, state, place, conv, leaves
            if row is None:
                flush()
                for role in [ROLE[leaves]] * bool(TAIL[leaves]) + ["assistant"] * (len(TAIL[leaves]) - 1):
                    hashed.update(f"\n{role}:".encode())
                done = [(conv, hashed.hexdigest())]
                hashed, started, place = hashlib.sha256(), False, None
                return done
            if row[1:3] != place:
                if place is not None:
                    flush()
                conv, place, edits, state, leaves = row[0], row[1:3], row[5], row[6], row[7]
            held.append(row[3:5])
            return []

        leaves = START
        return tell

    rows = placed.join(chosen.select("pid", "k", "edits", "entry", "leaves"), ["pid", "k"])
    dealt = rows.withColumn("own", F.col("conv")).repartition("conv").sortWithinPartitions("conv", "pid", "k", "seq")
    return in_runs(dealt, "conv", ["own", "pid", "k", "role", "text", "edits", "entry", "leaves"], make, "conv string, repaired_sha256 string")


def repair_long(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``OUT`` of long conversations; ``ids``: their (conv, conv_id)."""
    rows = rows.where(F.col("copy").isNotNull())
    placed = stretched(rows)
    cut = common.stored(stretches(placed), "stretches")
    chosen = common.stored(forwards(backwards(crossings(cut))), "edits")
    turns = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    inside = cut.groupBy("conv").agg(
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("illegal").alias("illegal"),
        F.sum(F.length(F.regexp_replace("codes", "[^SUAX]", ""))).alias("truncated"))
    audits = chosen.join(cut.select("pid", "k", "head", "tail"), ["pid", "k"]).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("pid", "k", "edits", "leaves", "head", "tail"))).alias("e"), F.sum("cost").alias("cost"))
    ends = F.element_at("e", -1)["leaves"]
    borders = F.zip_with(F.slice("e", 1, F.size("e") - 1), F.slice("e", 2, F.size("e")), lambda a, b: F.concat(a["tail"], b["head"]))
    audits = audits.select(
        "conv", "cost", F.when(F.size("e") > 1, F.size(F.filter(borders, lambda x: ~x.isin(*LEGAL)))).otherwise(0).alias("between"),
        F.concat(F.array_join(F.transform("e", lambda x: x["edits"]), ""), F.when(ends == SYSTEM, "II").when(ends == USER, "I").otherwise("")).alias("audit"))
    whole = ids.join(turns, "conv", "left").join(inside, "conv", "left").join(audits, "conv", "left").join(digests(placed, chosen), "conv", "left")
    zero = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated")]
    return whole.select("conv_id", *zero, F.coalesce(F.col("illegal") + F.col("between"), F.lit(0)).cast("long").alias("illegal"),
                        F.coalesce(F.col("cost").cast("long"), F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def repair(conversations: DataFrame) -> DataFrame:
    """``OUT`` of every conversation (conv_id, turn, role, text) after damage, null ids being one conversation.

    Rows go by turn (nulls first), ties by role, then text. A conversation without rows
    after damage has zeros, an empty audit and the digest of nothing. Other columns are ignored.
    """
    rows = coded(damaged(conversations))
    sizes = rows.groupBy("conv", "conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LONG).drop("n")
    ids = common.stored(sizes, "long-conversations")
    if ids.isEmpty():
        return repair_short(rows)
    short = key_join(rows, ids.select("conv"), "conv", "left_anti")
    return repair_short(short).unionByName(repair_long(key_join(rows, ids.select("conv"), "conv"), ids))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: its faults after damage, the cheapest edits that repair it and the digest of what they give."""
    return repair(common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
