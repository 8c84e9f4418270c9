"""Exact Jaccard self-join of documents on word shingles by a size-aware light-heavy join (operator 3).

Documents with equal shingle sets form a class; classes are joined. Every set is put
into one global order of shingles (rare ones first), so linked sets must meet in
their prefixes. Light (small) sets enumerate all 2-subsets of their prefix and meet
where a subset is equal; heavy (large) sets scan the inverted lists of the shingles
in their prefix. The size that divides them is the one of the least cost under the
sizes and list lengths of the corpus.

A list of sets that share a key is not expanded into its pairs. Its most central
member (the one with the fewest rare shingles of its own) is verified against the
others; only lists that are not one component after that are compared further, and
there only pairs of different components whose sizes and positions allow a link.
A sketch of each set proves most of the other pairs too different; the links of the
rest are verified exactly on the whole sets, where each text is moved to the tasks
of the classes that it is compared with, and never stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridbill.llm import common

WORDS = 5
#: Frequent shingles, known to every task: those of the largest document counts, about this many at most.
FREQUENT, FREQUENT_FROM = 500_000, 8
#: Shingles in one range of the count, about.
RANGE = 4 << 20
#: Bits of a shingle's place in its range: sets of equal places only count as more frequent.
SLOT_BITS = 24
#: Ids of classes whose sketches or texts are fetched are broadcast up to this number, else joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Classes that a task remembers, so that it makes the entries of equal texts once.
KNOWN = 200_000
#: Classes compared with one copy of a class's text, about.
CHUNK = 32
#: Parts that the list of a frequent key is dealt to, by class.
PARTS = 4096
#: Sizes above this are always heavy.
LIGHT_MOST = 64

_K = [np.uint64(k | 1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K[0]
    h = (h ^ (h >> np.uint64(29))) * _K[1]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct 5-word shingles, A-Z lower-cased.

    Words are runs of bytes other than the six ASCII white-space characters. Fewer
    than five words are one shingle of all of them; no words, no shingle.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    common.held("shingles", bool)  # lets go of what other operators have left in this process
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < WORDS:
        return _mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64))
    out = h[: n - WORDS + 1] * _K[0]
    for i in range(1, WORDS):
        out = out + h[i : n - WORDS + 1 + i] * _K[i]
    return np.unique(_mix(out))


def identity(tokens: np.ndarray) -> int:
    """A class's key: a signed 64-bit hash of its set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)))))


def linked(common_size: int | np.ndarray | Column, a, b):
    """100 * intersection >= 80 * union."""
    return 9 * common_size >= 4 * (a + b)


def sketch(tokens: np.ndarray) -> bytes:
    """For each of 64 or more places, at most two a shingle, whether an odd number of shingles falls on it."""
    places = 1 << max(6, len(tokens).bit_length())
    odd = np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """No more than the shingles that are in one of two sets only: each changes one place of their sketches."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(p), len(q))
    p, q = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (p, q))
    return int(np.unpackbits(p ^ q).sum())


def prefix(n: int, k: int) -> int:
    """Shingles of a set of size ``n``, first in the order, among which it shares ``k`` with any set it links to."""
    return n - -(-4 * n // 5) + k


def boundary(sizes: dict[int, int], length: float) -> int:
    """The smallest heavy size: cost is a row for each subset of a light set, and the scanned list for each
    prefix shingle of a heavy one (sets just below the boundary, which may link to heavy ones, are in both)."""

    def cost(x: int) -> float:
        light = sum(c * prefix(n, 2) * (prefix(n, 2) - 1) / 2 for n, c in sizes.items() if 4 <= n < x)
        return light + sum(c * prefix(n, 1) * length for n, c in sizes.items() if 5 * n >= 4 * x and n >= 4)

    return min(range(4, LIGHT_MOST + 2), key=lambda x: (cost(x), x))


def classed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cls, sketch): the size, key and sketch of each document's set."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([identity(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())],
                ["doc_id", "n", "cls", "sketch"],
            )

        return one

    return common.map_batches(docs, "text", make, "doc_id bigint, n long, cls long, sketch binary", 4 << 20)


def _slot(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """Range (above bit 32) and the place in it of each shingle."""
    return ((tokens >> np.uint64(32)) % np.uint64(ranges) << np.uint64(32)) | (tokens & np.uint64((1 << SLOT_BITS) - 1))


#: The longest step between two places that takes one number of a pack.
_STEP = 0xFFFF


def packed(slots: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The ranges in sorted slots, and for each the steps from place to place in 16 bits; a longer step takes several."""
    owner, places = (slots >> np.uint64(32)).astype(np.int64), (slots & np.uint64(0xFFFFFFFF)).astype(np.int64)
    own, start = np.unique(owner, return_index=True)
    steps = np.diff(places, prepend=0)
    steps[start] = places[start]
    ends = np.cumsum(steps // _STEP + 1)
    out = np.full(ends[-1] if len(ends) else 0, _STEP, "<u2")
    out[ends - 1] = steps % _STEP
    return own, [x.tobytes() for x in np.split(out, ends[start[1:] - 1])][: len(own)]


def unpacked(pack: bytes) -> np.ndarray:
    """The places of a pack, sorted."""
    steps = np.frombuffer(pack, "<u2")
    return np.cumsum(steps, dtype=np.int64)[steps != _STEP]


def frequencies(docs: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted slots, counts) of the most frequent shingles, and the mean list length met by a shingle of the rest.

    All shingles of all documents are counted: each task packs its shingles by range,
    a range's packs meet in one task. Ranges are hashes, so a frequent shingle is
    one number in each pack, and packs are of even size.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in common.pieces(batches, "text", 8 << 20):
            sets = [shingles(t) for t in s.column("text").to_pylist()]
            own, packs = packed(np.sort(_slot(np.concatenate(sets), ranges)) if sets else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(packs, pa.binary())], ["r", "pack"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        low, n = np.unique(np.concatenate([unpacked(x).astype(np.uint32) for x in table.column("pack").to_pylist()]), return_counts=True)
        often = n >= FREQUENT_FROM
        rest = n[~often].astype(float)
        slot = [int(key[0].as_py()) << 32 | int(x) for x in low[often]]
        return pa.table({
            "slot": pa.array([*slot, None], pa.int64()), "c": pa.array([*n[often].tolist(), 0], pa.int64()),
            "s1": pa.array([0.0] * len(slot) + [rest.sum()]), "s2": pa.array([0.0] * len(slot) + [(rest * rest).sum()]),
        })

    counted = common.stored(docs.mapInArrow(pack, "r long, pack binary").groupBy("r").applyInArrow(count, "slot long, c long, s1 double, s2 double"), "frequencies")
    s1, s2 = counted.agg(F.coalesce(F.sum("s1"), F.lit(0.0)), F.coalesce(F.sum("s2"), F.lit(0.0))).first()
    often = counted.where("slot is not null").select("slot", "c")
    n = often.count()
    if n > FREQUENT:  # which ones are left out at the border changes only costs
        often = often.where(F.col("c") > often.agg(F.percentile_approx("c", 1 - FREQUENT / n, 100_000)).first()[0])
    slot, c = (x.to_numpy() for x in often.toArrow().columns)
    order = np.argsort(slot)
    return slot[order].astype(np.uint64), c[order], s2 / s1 if s1 else 1.0


def entries(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], ranges: int, heavy: int) -> DataFrame:
    """(key, cls, n, pos, part): for each class the subsets of its prefix (light) and the shingles of its prefix
    with their places in the order (heavy, or just below); once in a task, if that remembers it. ``part``: 0, or a
    part by class if all shingles of the key are frequent. Keys are cut to 48 bits: equal ones only propose pairs."""
    slots, counts = frequent
    rank = np.log2(counts).astype(np.int8)

    def keys(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(tokens)
        if n < 4:  # links to equal sets only
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        level = np.zeros(n, np.int64)
        if len(slots):
            own = _slot(tokens, ranges)
            at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
            level = np.where(slots[at] == own, rank[at], 0)
            if level.any():
                order = np.argsort(level, kind="stable")
                tokens, level = tokens[order], level[order]
        found: list[tuple] = []
        if n < heavy:
            i, j = np.triu_indices(prefix(n, 2), 1)
            found.append((_mix(tokens[i] * _K[2] + tokens[j]), np.zeros(len(i), np.int64), (level[i] > 0) & (level[j] > 0)))
        if 5 * n >= 4 * heavy:
            p = prefix(n, 1)
            found.append((tokens[:p], np.arange(p), level[:p] > 0))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def make():
        seen: set[int] = set()

        def rows(texts: list) -> Iterator[tuple]:
            for tokens in map(shingles, texts):
                own = identity(tokens)
                if own not in seen:
                    if len(seen) >= KNOWN:
                        seen.clear()
                    seen.add(own)
                    yield len(tokens), own, *keys(tokens)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            new = list(rows(b.column("text").to_pylist()))
            sizes = [len(r[2]) for r in new]
            column = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0, kind), pa.from_numpy_dtype(kind))
            return pa.RecordBatch.from_arrays([
                column([r[2].view(np.int64) >> 16 for r in new], np.int64),
                pa.array(np.repeat(np.array([r[1] for r in new], np.int64), sizes)),
                pa.array(np.repeat(np.array([r[0] for r in new], np.int32), sizes)),
                column([r[3].astype(np.int32) for r in new], np.int32),
                column([np.where(r[4], 1 + r[1] % PARTS, 0).astype(np.int32) for r in new], np.int32),
            ], ["key", "cls", "n", "pos", "part"])

        return one

    return common.map_batches(docs, "text", make, "key long, cls long, n int, pos int, part int", 2 << 20)


def lists(found: DataFrame) -> DataFrame:
    """(key, cls, n, pos) of all keys that two classes or more share, one of the keys where several have the same members.

    Rare keys have few members (their document counts are below those of the frequent
    ones), so they meet in one shuffle; frequent keys are dealt by class and never gathered.
    The members of a key lie together after that, and are summed up before they are shuffled.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("key", "part").orderBy("cls", "pos")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = found.withColumns({"lo": F.first("cls").over(whole), "hi": F.last("cls").over(whole), "before": F.lag("cls").over(by)})
    members = common.stored(both.where("(lo <> hi or part > 0) and not (before <=> cls)").select("key", "cls", "n", "pos"), "members")
    # keys with the same members; of those the first in the order, where positions are smallest, bounds overlaps rightly
    hashed = F.xxhash64("cls").cast("decimal(38,0)")
    same = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("m"), F.sum(hashed).alias("s"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x"),
        F.sum("pos").alias("places"), F.min(F.struct("pos", "n", "cls")).alias("hub"),
    ).where("m > 1")
    kept = same.groupBy("m", "s", "x").agg(F.min(F.struct("places", "key", "hub")).alias("k")).select("k.key", "k.hub")
    return members.join(common.stored(kept, "keys"), "key")


def _may_link(a: str, b: str) -> Column:
    """Sizes and positions allow a link: no more than what follows the shared shingle can be common."""
    n, k = F.col(f"{a}n"), F.col(f"{b}n")
    return (5 * F.least(n, k) >= 4 * F.greatest(n, k)) & linked(F.least(n - F.col(f"{a}pos"), k - F.col(f"{b}pos")), n, k)


def _near(pairs: DataFrame, sized: DataFrame, reps: DataFrame, clean: bool) -> DataFrame:
    """(a, b, may): whether the sketches of two classes allow a link: 100 * intersection >= 80 * union is
    9 * (shingles in one set only) <= sum of both sizes."""
    both = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    asked = common.stored(reps.join(both, "cls").select(F.col("rep").alias("doc_id"), "cls"), "asked")
    found = sized.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, ["doc_id", "cls"]).select("cls", "n", "sketch")
    found = common.stored(found if clean else found.dropDuplicates(["cls"]), "sketches")
    a, b = (found.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in common.pieces(batches, "sketch_a", 4 << 20, "sketch_b"):
            rows = zip(*(s.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")), strict=True)
            may = [9 * apart(x, y) <= n + m for n, m, x, y in rows]
            yield pa.RecordBatch.from_arrays([s.column("a"), s.column("b"), pa.array(may, pa.bool_())], ["a", "b", "may"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, may boolean")


def _dealt(pairs: DataFrame) -> DataFrame:
    """(hub, chunk, member): of each pair the class with more pairs, whose pairs are dealt to chunks, and the other one."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("pairs"))
    a, b = (degree.select(F.col("cls").alias(x), F.col("pairs").alias(f"pairs_{x}")) for x in "ab")
    turned = F.col("pairs_b") > F.col("pairs_a")
    hub, member = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    chunks = F.ceil(F.greatest("pairs_a", "pairs_b") / CHUNK)
    return pairs.join(a, "a").join(b, "b").select(hub.alias("hub"), F.pmod(F.xxhash64(member), chunks).alias("chunk"), member.alias("member"))


def verified(pairs: DataFrame, docs: DataFrame, sized: DataFrame, reps: DataFrame, clean: bool) -> DataFrame:
    """(a, b, ok), stored: whether the whole sets of two classes link. Only texts of pairs whose sketches allow it are moved."""
    near = common.stored(_near(common.stored(pairs, "pairs"), sized, reps, clean), "near")
    dealt = common.stored(_dealt(near.where("may").select("a", "b")), "dealt")
    moved = dealt.select(F.col("member").alias("cls"), "hub", "chunk").unionByName(dealt.select(F.col("hub").alias("cls"), "hub", "chunk").distinct())
    texts = _texts(docs, common.stored(reps.join(moved, "cls").select("rep", "cls", "hub", "chunk"), "moved"), clean)
    # the text of a hub comes first in each of its chunks
    texts = texts.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("cls") != F.col("hub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, first = None, np.zeros(0, np.uint64)
        for s in common.pieces(batches, "text"):
            found: list[tuple] = []
            for key, own, text in zip(s.column("hub").to_pylist(), s.column("cls").to_pylist(), s.column("text"), strict=True):
                tokens = shingles(text.as_py())
                if own == key:
                    hub, first = key, tokens
                elif hub == key:
                    same = len(np.intersect1d(first, tokens, assume_unique=True))
                    found.append((min(key, own), max(key, own), bool(linked(same, len(first), len(tokens)))))
                else:
                    raise ValueError(f"no text of class {key} before those that it is compared with")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["a", "b", "ok"])

    compared = texts.select("hub", "cls", "text").mapInArrow(run, "a long, b long, ok boolean")
    return common.stored(near.where(~F.col("may")).select("a", "b", F.lit(False).alias("ok")).unionByName(compared), "verified")


def components(links: DataFrame) -> DataFrame:
    """(cls, label): the smallest class reachable by links (a, b), for each class that has a link.

    Each round every class takes the smallest label among its own and its
    neighbours', then the label of its label; a round's result is a table in the shared folder.
    """
    edges = common.stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = common.stored(edges.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("cls", "a"), "a").groupBy(F.col("b").alias("cls")).agg(F.min("label").alias("near"))
        least = common.stored(labels.join(near, "cls").select("cls", F.col("label").alias("old"), F.least("label", "near").alias("label")), "least")
        jump = least.select(F.col("cls").alias("label"), F.col("label").alias("further"))
        after = common.stored(least.join(jump, "label").select("cls", "old", F.col("further").alias("label")), "labels")
        labels = after.select("cls", "label")
        if after.where("old <> label").isEmpty():
            return labels


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links, its own included. A
    null or empty text, or one without words, has no shingles and no links. Rows with
    equal texts are linked. Rows with a null id take no part in links, and have a null component.
    """
    every = docs.select("doc_id", "text")
    docs = every.where("doc_id is not null")
    sized = common.stored(classed(every), "classes")
    total, sizes = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], {
        r["k"]: r["count"] for r in sized.groupBy(F.least("n", F.lit(LIGHT_MOST + 1)).alias("k")).count().collect()
    }
    ranges = max(64, -(-total // RANGE))
    slots, counts, length = frequencies(docs.select("text"), ranges)
    members = common.stored(lists(entries(docs.select("text"), (slots, counts), ranges, boundary(sizes, length))), "lists")
    reps = common.stored(sized.where("n > 0 and doc_id is not null").groupBy("cls", "n").agg(F.min("doc_id").alias("rep")), "reps")
    clean = sized.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()

    star = members.where(F.col("cls") != F.col("hub.cls")).select("cls", "n", "pos", *(F.col(f"hub.{c}").alias(f"h{c}") for c in ("cls", "n", "pos")))
    pairs = star.where(_may_link("", "h")).select(F.least("cls", "hcls").alias("a"), F.greatest("cls", "hcls").alias("b")).distinct()
    first = verified(pairs, docs, sized, reps, clean)
    rest = _rest(members, components(first.where("ok")), first)
    links = first.unionByName(verified(rest, docs, sized, reps, clean)).where("ok").select("a", "b")
    labels = components(links)

    own = reps.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    smallest = common.stored(own.groupBy("label").agg(F.min("rep").alias("component_id")), "smallest")
    of_class = common.stored(own.join(smallest, "label").select("cls", "n", "component_id"), "components")
    joined = sized.join(of_class, ["cls", "n"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _rest(members: DataFrame, labels: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): pairs in lists of several components that may still link and were not verified yet."""
    placed = members.select("key", "cls", "n", "pos").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    placed = common.stored(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    left = common.stored(placed.join(common.stored(open_keys, "open"), "key"), "open-lists")
    a, b = (left.select("key", *(F.col(c).alias(f"{side}{c}") for c in ("cls", "n", "pos", "label"))) for side in "ab")
    met = a.join(b, "key").where((F.col("acls") < F.col("bcls")) & (F.col("alabel") != F.col("blabel")) & _may_link("a", "b"))
    return met.select(F.col("acls").alias("a"), F.col("bcls").alias("b")).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")


def _texts(docs: DataFrame, asked: DataFrame, clean: bool) -> DataFrame:
    """(cls, hub, chunk, text): for each row of ``asked`` (rep, cls, hub, chunk) a text of the class, from its smallest document.

    ``clean``: each id has one row; else only rows of the class count, and one of them.
    """
    ids = asked.withColumnRenamed("rep", "doc_id")
    few = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id").select("cls", "hub", "chunk", "text")
    if clean:
        return few

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            keys = b.column("cls").to_pylist()
            fits = [identity(shingles(t)) == k for t, k in zip(b.column("text").to_pylist(), keys, strict=True)]
            return b.filter(pa.array(fits, pa.bool_()))

        return one

    return common.map_batches(few, "text", make, "cls long, hub long, chunk long, text string", 4 << 20).dropDuplicates(["cls", "hub", "chunk"])


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the size of its shingle set and the smallest document of its component."""
    return groups(common.table(spark, sf_dir, "documents", "doc_id", "text"))
