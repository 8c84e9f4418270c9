"""Operators 2, 3, 9 and 10 against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridbill.llm import decontam, jaccard, mtree, sharding


# --- 2: sharding -------------------------------------------------------------------------------


def test_lookup_table_is_even_and_stable(spark):
    names = tuple(f"s{i}" for i in range(5))
    full = {r.slot: r.shard for r in sharding.lookup_table(spark, names, 211).collect()}
    assert sorted(full) == list(range(211))
    counts = [list(full.values()).count(n) for n in names]
    assert max(counts) - min(counts) <= 1
    less = {r.slot: r.shard for r in sharding.lookup_table(spark, names[:4], 211).collect()}
    moved = sum(full[s] != less[s] for s in full if full[s] != "s4")
    assert moved <= 0.25 * 211  # few slots besides those of the shard that went


def test_lookup_table_by_turns(spark):
    import hashlib

    names, m = ("a", "b", "c"), 13
    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    owner, nexts = {}, [0, 0, 0]
    while len(owner) < m:
        for i, n in enumerate(names):
            if len(owner) == m:
                break
            while (slot := (h(f"{n}:start") % m + nexts[i] * (h(f"{n}:stride") % (m - 1) + 1)) % m) in owner:
                nexts[i] += 1
            owner[slot] = n
    assert {r.slot: r.shard for r in sharding.lookup_table(spark, names, m).collect()} == owner


def test_place_nulls_and_repeats(spark):
    table = sharding.lookup_table(spark, ("a", "b"), 13)
    rows = sharding.place(spark.createDataFrame([(1, "x"), (1, "y"), (None, "z")], "k int, shard string"), "k", table, 13).collect()
    assert len(rows) == 3 and len({(r.slot, r.shard) for r in rows if r.k == 1}) == 1
    assert sharding.place(spark.createDataFrame([], "k int"), "k", table, 13).count() == 0


@pytest.mark.parametrize(("names", "slots"), [(("a",), 12), ((), 13), (("a", "a"), 13)])
def test_bad_tables(spark, names, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(spark, names, slots)


# --- 3: Jaccard join ---------------------------------------------------------------------------


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted((i, len(sets[i]), label[i]) for i in sets)


def edited(words, rng, edits):
    words = list(words)
    for _ in range(edits):
        k = rng.randrange(max(1, len(words)))
        words[k : k + 1] = rng.choice([[], [f"e{rng.randrange(99)}"], [*words[k : k + 1], f"e{rng.randrange(99)}"]])
    return " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(documents, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 3)  # frequent keys in a small corpus too
    rng = random.Random(seed)
    rows, next_id = [], 0
    for size in (1, 3, 5, 8, 9, 12, 25, 60, 60, 120, 300):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for _ in range(12):
            rows.append((next_id, edited(base, rng, rng.choice([0, 0, 1, 1, 2, 3, size // 20]))))
            next_id += 1
    chain = [f"c{k}" for k in range(150)]
    for k in range(8):  # each links to the next, the ends do not link
        rows.append((next_id, " ".join(chain[3 * k : 3 * k + 100])))
        next_id += 1
    rows += [(next_id, None), (next_id + 1, ""), (next_id + 2, " \n\t"), (next_id + 3, "É é"), (next_id + 4, "É É"), (next_id + 5, rows[-1][1].upper())]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in jaccard.groups(documents(rows)).collect())
    assert got == brute(rows)


def test_repeated_and_null_ids(documents):
    text = "one two three four five six seven"
    got = sorted(tuple(r) for r in jaccard.groups(documents([(1, text), (1, text), (2, text), (None, text), (3, "else")])).collect() if r[0] is not None)
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 1, 3)]
    assert jaccard.groups(documents([])).count() == 0


def test_sketches_never_deny_a_link():
    rng = random.Random(5)
    for size in (0, 1, 5, 31, 32, 33, 100, 700):
        x = np.array([rng.getrandbits(64) for _ in range(size)], np.uint64)
        for share in (0, 0.05, 0.11, 0.5, 1):
            y = np.concatenate([x[int(size * share) :], np.array([rng.getrandbits(64) for _ in range(int(size * share))], np.uint64)])
            y = y[: size - int(size * share * 0.1)]
            least, real = jaccard.apart(jaccard.sketch(x), jaccard.sketch(y)), len(np.setxor1d(x, y))
            assert least <= real
            assert jaccard.linked(len(np.intersect1d(x, y)), len(x), len(y)) == (9 * real <= len(x) + len(y))
    assert jaccard.apart(jaccard.sketch(x), jaccard.sketch(x + np.uint64(1))) * 9 > 2 * len(x)


def test_packs_hold_every_place():
    places = np.array([0, 0, 5, 65534, 65535, 65536, 1 << 24, (1 << 24) + 65535 * 3, (1 << 32) - 1], np.uint64)
    slots = np.concatenate([np.uint64(r << 32) | places[k:] for r, k in ((0, 0), (3, 0), (4, 8), (9, 2))])
    own, packs = jaccard.packed(slots)
    assert own.tolist() == [0, 3, 4, 9]
    assert [jaccard.unpacked(p).tolist() for p in packs] == [places[k:].astype(int).tolist() for k in (0, 0, 8, 2)]
    assert [len(x) for x in jaccard.packed(np.zeros(0, np.uint64))] == [0, 0]
    even = np.arange(10_000, dtype=np.uint64) * np.uint64(1500)
    assert len(jaccard.packed(even)[1][0]) == 2 * len(even)


@pytest.mark.parametrize("rows_broadcast", [0, 1000])
def test_texts_are_moved_for_likely_pairs_only(documents, monkeypatch, rows_broadcast):
    """Hubs of many members in several chunks, ids that repeat; texts are not stored."""
    from gridbill.llm import common

    names, moved, stored = [], [], common.stored

    def watched(df, what):
        names.append(what)
        out = stored(df, what)
        if what == "moved":
            moved.append(out.count())
        return out

    monkeypatch.setattr(common, "stored", watched)
    monkeypatch.setattr(jaccard, "CHUNK", 3, raising=False)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", rows_broadcast)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, edited(base, rng, 1)) for i in range(20)]
    rows += [(100 + i, " ".join([f"v{k}" for k in range(8)] + [f"u{i}x{k}" for k in range(60)])) for i in range(20)]  # share a rare passage
    got = sorted(tuple(r) for r in jaccard.groups(documents(rows)).collect())
    assert got == brute(rows)
    assert "texts" not in names and 0 < sum(moved) < 100
    again = jaccard.groups(documents([*rows, rows[0], rows[-1]]))
    assert sorted(tuple(r) for r in again.distinct().collect()) == got


def test_boundary_follows_cost():
    assert jaccard.boundary({10: 1000}, 1.0) <= 10  # short lists: scan
    assert jaccard.boundary({10: 1000, 40: 10}, 1e6) > 10  # long lists: enumerate


def test_prefix_lemma():
    for n in range(4, 200):
        for m in range(n, n * 5 // 4 + 1):
            least = -(-4 * (n + m) // 9)
            assert jaccard.prefix(n, 2) >= n - least + 2 and jaccard.prefix(m, 1) >= m - least + 1 and least >= 2


# --- 9: decontamination ------------------------------------------------------------------------

ITEM = "so then Anna drove 120 km in about 3 hours while Boris slowly walked 10 km behind Anna and stopped twice on the way home"


def leaks(spark, documents, docs, items=((7, ITEM),)):
    """The pairs found, which the query's SQL finds on the same rows with the same numbers of windows."""
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, window string")
    found = sorted((r.doc_id, r.item_id, r.n_windows) for r in decontam.contaminated(documents(docs), bench).collect())
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    assert found == sorted(con.execute(decontam.ORACLE).fetchall())
    return [(d, i) for d, i, _ in found]


def test_reparameterised_questions(spark, documents):
    other = ITEM.replace("Anna", "Clara").replace("Boris", "David").replace("120", "75").replace("3 hours", "2 days").replace("km", "miles").replace("10", "8,5")
    docs = [
        (1, f"before it. {ITEM} after it"),
        (2, f"words, and {other}!"),
        (3, other.replace("Clara and stopped", "Emil and stopped")),  # one name for two
        (4, other.replace("walked", "ran").replace("stopped", "went").replace("while", "as").replace("drove", "flew").replace("in", "within").replace("on", "upon")),
        (5, "a clean text of some words that says nothing of the kind at all, and no more"),
        (6, None), (7, ""), (8, " | | "), (2, f"words, and {other}!"), (None, ITEM),
        (9, "x " * 3000 + ITEM.upper().lower() + " y" * 3000),  # names in lower case are words
    ]
    assert leaks(spark, documents, docs) == [(1, 7), (2, 7)]


def test_short_items_and_empty_tables(spark, documents):
    assert leaks(spark, documents, [(1, "say the magic word now please"), (2, "say the magic thing")], [(1, "the magic word"), (2, "12 km"), (3, None), (4, "")]) == [(1, 1)]
    assert leaks(spark, documents, []) == []
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(documents([(1, ITEM)]), bench).count() == 0


def test_quotes_of_a_part(spark, documents):
    rng = random.Random(4)
    item = [f"word{rng.randrange(900)}" for _ in range(100)]
    docs = [
        (1, " ".join(["before", *item[:40], "after"])), (2, " ".join(["x", *item[60:71], "y"])),  # far less than half
        (3, " ".join(["x", *item[60:70], "y"])), (4, " ".join(w for k in range(0, 90, 20) for w in [*item[k : k + 8], "else"])),  # no run
    ]
    assert leaks(spark, documents, docs, [(1, " ".join(item))]) == [(1, 1), (2, 1)]


def test_edited_values_and_items_of_placeholders(spark, documents):
    short = "then Anna gave her 3 apples to Boris and 5 to Clara"
    numbers, title = "12 24 36 48 60 72 84 96 108 120", "The Quick Brown Fox Jumps Over The Lazy Dog Again"
    docs = [
        (1, ITEM.replace("Anna drove", "Boris drove")),  # one name edited to another of the item
        (2, ITEM.replace("120", "10")),  # two numbers become equal in a copy
        (3, f"x {numbers} y"), (4, f"see {title} now"), (5, numbers.replace("12 24", "24 12")), (6, "The Slow Brown Cat Runs Under The Lazy Cow Again"),
        (7, "about 12 km away"), (8, "about 13 km away"), (9, short.replace("Anna", "Boris")),
    ]
    items = [(7, ITEM), (1, numbers), (2, title), (3, "12 km"), (4, "alone"), (5, short)]
    assert leaks(spark, documents, docs, items) == [(1, 7), (2, 7), (3, 1), (4, 2), (7, 3), (9, 5)]


# --- 10: top-k ---------------------------------------------------------------------------------


def top(vectors, k):
    out = []
    for q, v in vectors:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "copies", "clustered", "huge"])
def test_top_k_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 8)
    rng = random.Random(3)
    centers = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(4)]
    make = {
        "random": lambda i: [rng.gauss(0, 1) for _ in range(6)],
        "copies": lambda i: [0.5] * 6 if i % 3 else [float(i % 7)] * 6,
        "clustered": lambda i: [c + rng.gauss(0, 0.05) for c in centers[i % 4]],
        "huge": lambda i: [rng.choice([-1, 1]) * 1e7 * rng.random() for _ in range(6)],
    }[kind]
    rows = [(i, make(i)) for i in range(240)]
    bad = [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 6), (1060, [float("inf")] * 6), (None, [1.0] * 6)]
    vectors = mtree.quantised(spark.createDataFrame([*rows, *bad], "vec_id long, e array<double>"), "vec_id", "e", 64)
    exact = [(i, [int(x * 64 // 1) for x in v]) for i, v in rows]
    got = sorted(map(tuple, mtree.search(vectors.where(F.col("vec_id") % 20 == 0), vectors, 5, block=50).collect()))
    assert got == top(exact, 5)


def test_scores_beyond_64_bits_saturate(spark):
    v = spark.createDataFrame([(0, [2**60]), (1, [2**60]), (2, [-(2**60)])], "vec_id long, v array<long>")
    assert sorted(map(tuple, mtree.search(v.where("vec_id = 0"), v, 2).collect())) == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_search_computes_less(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.floor(64 * (np.repeat(rng.normal(0, 3, (20, 16)), 200, 0) + rng.normal(0, 0.05, (4000, 16))))
    tree = mtree.Searcher(np.arange(4000), x)
    tree.top(0, x[0], 5)
    assert tree.computed < 2000


def test_queries_go_only_where_a_bound_reaches(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centers = rng.normal(0, 10, (30, 8))
    rows = [(i, (centers[i % 30] + rng.normal(0, 0.05, 8)).tolist()) for i in range(3000)]
    v = mtree.quantised(spark.createDataFrame(rows, "vec_id long, e array<double>"), "vec_id", "e", 64)
    queries = v.where("vec_id % 20 = 0")
    top_level = mtree.index(v, 50)
    assert top_level.rows.count() == 3000 and top_level.blocks.sum() >= 60
    sent = mtree.sent(top_level, mtree.first(top_level, queries, 5, 50)).count()
    assert sent < 0.3 * 150 * (top_level.blocks.sum() - 1), sent
    exact = [(i, [int(x * 64 // 1) for x in e]) for i, e in rows]
    assert sorted(map(tuple, mtree.search(queries, v, 5, block=50).collect())) == top(exact, 5)


def test_copies_repeated_ids_and_other_columns(spark):
    rows = [(i, [1.0, 2.0], 7, 7) for i in range(300)] + [(20, [1.0, 2.0], 7, 7)] * 300 + [(k, [0.5, k / 900], 7, 7) for k in range(300, 400)]
    e = spark.createDataFrame(rows, "vec_id long, e array<double>, region int, block int")
    v = mtree.quantised(e, "vec_id", "e", 64)
    assert max(r[0] for r in mtree.index(v, 64).rows.groupBy("region", "block").count().select("count").collect()) < 3 * 64
    got = mtree.search(v.where("vec_id % 20 = 0 and vec_id <> 20"), v, 3, block=64)
    want = {(q, r, i, 64 * 64 * 5) for q in range(0, 300, 20) if q != 20 for r, i in zip((1, 2, 3), [i for i in range(5) if i != q])}
    assert {tuple(r) for r in got.where("query_id < 300").collect()} == want
    assert got.count() == 3 * (14 + 5)


def test_fewer_rows_than_k(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [2.0, 3.0]), (2, [])], "vec_id long, e array<double>")
    v = mtree.quantised(rows, "vec_id", "e", 64)
    assert sorted(map(tuple, mtree.search(v.where("vec_id = 0"), v, 20).collect())) == [(0, 1, 1, 64 * 128), (0, 2, 2, 0)]
    assert mtree.search(v.where("vec_id > 5"), v.where("vec_id > 5"), 20).count() == 0
