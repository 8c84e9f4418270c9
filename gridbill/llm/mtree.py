"""Exact top-k inner products by best-first search in M-trees (operator 10).

The top level of the tree is made by Spark: each vector goes to the nearest of at most
``PIVOTS`` pivots; a region has its pivot, a covering radius and its largest norm, and a
region of more than ``BLOCK`` vectors is dealt into blocks. A query is searched in one block
of its own region first. The score of its k-th best there is a floor for the
rest: it is sent to another region only if that region's bound reaches the floor.

Each block is an M-tree: pages of at most ``PAGE`` entries, each with a routing vector, a
covering radius, the largest norm below it and its distance to the routing vector
of its parent. A search goes through the leaves in order of their bounds on the
score. Before a distance is computed, the stored ones bound it by the triangle
inequality: |d(q, parent) - d(parent, x)| <= d(q, x), which bounds the inner
product by (|q|^2 + |x|^2 - d^2) / 2; below a page also q.x <= q.c + |q| radius.
The queries of a block go on together: those that come to a leaf at the same time are one matrix product.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridbill.llm import common

PAGE = 512
#: Vectors in a block, about (a task holds one block of vectors and one of queries).
BLOCK = 8192
#: Regions of the top level at most; fewer where vectors are long (``PIVOT_VALUES`` components together, 8 MB).
PIVOTS = 1024
PIVOT_VALUES = 1 << 20
#: Queries of a block that are searched together.
TOGETHER = 1024
#: Integers up to here are exact in floating point; beyond, whole numbers of any size are used.
EXACT = 2.0**52


@dataclass
class Page:
    """A node: its routing vector, covering radius, largest squared norm; entries are vectors (leaf) or pages."""

    center: np.ndarray
    radius: float
    norm2: float
    rows: np.ndarray | None  # of a leaf: rows of the block
    own: np.ndarray | None  # of a leaf: their vectors
    to_center: np.ndarray  # distance of each entry's (routing) vector to this routing vector
    pages: list[Page]
    centers: np.ndarray | None = None
    center2: np.ndarray | None = None
    radii: np.ndarray | None = None
    norms2: np.ndarray | None = None


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


def build(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> Page:
    """The M-tree of some rows of ``x``: rows go to the nearest of a few routing rows, level by level."""
    own = x[rows]
    mean = own.mean(0)
    center = own[_distances(own, mean).argmin()]
    far, norm2 = _distances(own, center), float((own**2).sum(1).max())
    if len(rows) <= PAGE:
        return Page(center, float(far.max()), norm2, rows, own, far, [])
    routing = own[rng.choice(len(rows), min(PAGE, -(-len(rows) // (PAGE // 2))), replace=False)]
    nearest = ((routing**2).sum(1) - 2 * own @ routing.T).argmin(1)
    parts = [np.flatnonzero(nearest == k) for k in range(len(routing))]
    if max(map(len, parts)) > 0.9 * len(rows):  # many copies of a vector: by distance instead
        parts = np.array_split(np.argsort(far, kind="stable"), len(routing))
    pages = [build(x, rows[p], rng) for p in parts if len(p)]
    centers = np.array([p.center for p in pages])
    return Page(
        center, float(far.max()), norm2, None, None, _distances(centers, center), pages,
        centers, (centers**2).sum(1), np.array([p.radius for p in pages]), np.array([p.norm2 for p in pages]),
    )


class Searcher:
    """Best-first search of one block. ``computed`` counts inner products with entries of leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids = ids
        self.x2 = (x**2).sum(1)
        self.computed = 0
        self.root = build(x, np.arange(len(ids)), np.random.default_rng(len(ids))) if len(ids) else None

    def top(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, id) of one query."""
        return self.tops(np.array([query_id]), q[None, :], k)[0]

    def tops(self, query_ids: np.ndarray, qs: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each query the ``k`` best (score, id), ties to smaller ids, without rows of its own id; best first.

        Of a query with a floor, only scores that reach it are looked for.
        """
        floors = np.full(len(qs), -np.inf) if floors is None else floors
        if self.root is None or k < 1:
            return [[] for _ in qs]
        return [r for i in range(0, len(qs), TOGETHER) for r in self._some(query_ids[i : i + TOGETHER], qs[i : i + TOGETHER], k, floors[i : i + TOGETHER])]

    def _leaves(self, qs: np.ndarray, q2: np.ndarray, slack: np.ndarray, floors: np.ndarray) -> tuple[list[Page], np.ndarray, np.ndarray]:
        """The leaves that some query's bound reaches, each query's bound on their scores, and distances to their centers."""
        norm = np.sqrt(q2)
        root = self.root
        away = np.sqrt(np.maximum(0, ((qs - root.center) ** 2).sum(1)))
        below, found = [(root, np.full(len(qs), np.inf), away)], []
        while below:
            page, bound, d = below.pop()
            if page.rows is not None:
                found.append((page, bound, d))
                continue
            gap = np.maximum(0, np.abs(d[:, None] - page.to_center) - page.radii)
            first = np.minimum(bound[:, None], (q2[:, None] + page.norms2 - gap * gap) / 2 + slack[:, None])
            for i in np.flatnonzero((first >= floors[:, None]).any(0)).tolist():  # the others need no distance
                own = qs @ page.centers[i]
                away = np.sqrt(np.maximum(0, q2 + page.center2[i] - 2 * own))
                gap = np.maximum(0, away - page.radii[i])
                b = np.minimum(np.minimum(first[:, i], own + norm * page.radii[i] + slack), (q2 + page.norms2[i] - gap * gap) / 2 + slack)
                if (b >= floors).any():
                    below.append((page.pages[i], b, away))
        if not found:
            return [], np.empty((len(qs), 0)), np.empty((len(qs), 0))
        return [f[0] for f in found], np.stack([f[1] for f in found], 1), np.stack([f[2] for f in found], 1)

    def _some(self, query_ids: np.ndarray, qs: np.ndarray, k: int, floors: np.ndarray) -> list[list[tuple[int, int]]]:
        q2 = (qs**2).sum(1)
        slack = 1e-6 * (1 + q2 + float(self.x2.max()))
        leaves, bounds, away = self._leaves(qs, q2, slack, floors)
        order = np.argsort(-bounds, axis=1, kind="stable")
        best, best_ids = np.full((len(qs), k), -np.inf), np.zeros((len(qs), k), np.int64)
        least = floors.copy()
        going = np.arange(len(qs))
        for step in range(len(leaves)):
            at = order[going, step]
            going = going[bounds[going, at] >= least[going]]  # bounds only fall from here: the others are done
            at = order[going, step]
            for leaf in np.unique(at).tolist():
                self._visit(leaves[leaf], going[at == leaf], away[:, leaf], query_ids, qs, q2, slack, k, best, best_ids, least)
        return [[(int(s), int(v)) for s, v in zip(b, i, strict=True) if s > -np.inf] for b, i in zip(best.tolist(), best_ids.tolist(), strict=True)]

    def _visit(self, page: Page, g: np.ndarray, d: np.ndarray, query_ids: np.ndarray, qs: np.ndarray, q2: np.ndarray, slack: np.ndarray, k: int,
               best: np.ndarray, best_ids: np.ndarray, least: np.ndarray) -> None:
        """Take the entries of a leaf that the stored distances do not exclude for queries ``g`` into their best ones."""
        wide = np.sqrt(np.maximum(0, q2[g] + page.norm2 + 2 * slack[g] - 2 * least[g]))
        entries = np.flatnonzero((page.to_center >= (d[g] - wide).min() - 1e-6) & (page.to_center <= (d[g] + wide).max() + 1e-6))
        if not len(entries):
            return
        rows, own = (page.rows, page.own) if len(entries) == len(page.rows) else (page.rows[entries], page.own[entries])
        ids = self.ids[rows]
        self.computed += len(rows) * len(g)
        scores = qs[g] @ own.T
        if np.isin(query_ids[g], ids).any():
            scores[query_ids[g][:, None] == ids] = -np.inf
        floor = least[g]
        if len(ids) > k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
        row, col = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, k), row])
        s = np.concatenate([best[g[touched]].ravel(), scores[row[len(touched) * k :], col]])
        v = np.concatenate([best_ids[g[touched]].ravel(), ids[col]])
        sort = np.lexsort((v, -s, row))
        row, s, v = row[sort], s[sort], v[sort]
        start = np.searchsorted(row, touched)
        take = start[:, None] + np.arange(k)  # each has k rows at least
        best[g[touched]], best_ids[g[touched]] = s[take], v[take]
        least[g[touched]] = np.maximum(least[g[touched]], s[take[:, -1]])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _whole(ids: np.ndarray, vectors: list[list[int]], query_id: int, q: list[int], k: int) -> list[tuple[int, int]]:
    """The search without bounds, in whole numbers, for components too large for floating point."""
    scored = [(sum(a * b for a, b in zip(q, v, strict=False)), int(i)) for i, v in zip(ids, vectors, strict=True) if i != query_id]
    return heapq.nsmallest(k, scored, key=lambda r: (-r[0], r[1]))


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) of each vector that takes part.

    Null ids, null vectors and vectors with null or non-finite components take no part.
    """
    bad: Column = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    take = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad
    return vectors.where(take).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


@dataclass
class Index:
    """The top level: ``rows`` (region, block, vec_id, v) on file; pivot, covering radius, largest squared norm and blocks of each region."""

    rows: DataFrame
    pivots: np.ndarray
    radii: np.ndarray
    norms2: np.ndarray
    blocks: np.ndarray


def _padded(pivots: np.ndarray, width: int) -> np.ndarray:
    return np.pad(pivots, ((0, 0), (0, max(0, width - pivots.shape[1]))))


def _near(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, region, away, norm2): the nearest pivot of each vector, the distance to it, and the squared norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                s = b.slice(at, 2048)
                sizes = s.column("v").value_lengths().to_numpy(zero_copy_only=False)
                x = _matrix(s.column("v"), max(pivots.shape[1], int(sizes.max())))
                p = _padded(pivots, x.shape[1])
                region = ((p**2).sum(1) - 2 * x @ p.T).argmin(1)
                away = np.sqrt(((x - p[region]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([s.column("vec_id"), s.column("v"), pa.array(region.astype(np.int32)), pa.array(away), pa.array((x**2).sum(1))], ["vec_id", "v", "region", "away", "norm2"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, region int, away double, norm2 double")


def index(vectors: DataFrame, block: int = BLOCK) -> Index | None:
    """Deal all of ``vectors`` (vec_id, v) to the regions of the nearest pivots; none for an empty table.

    The pivots are the vectors with the smallest hashes, twice as many as blocks of ``block`` vectors and ``PIVOTS``
    at most; regions are exact whatever they are. Rows of a large region, or of many copies of one vector, are dealt by a row number.
    """
    n, longest = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    most = max(1, min(PIVOTS, -(-2 * n // block), PIVOT_VALUES // max(1, longest)))
    some = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(most).toArrow()
    pivots = np.unique(_matrix(some.column("v"), longest), axis=0)
    near = common.stored(_near(vectors, pivots).withColumn("row", F.monotonically_increasing_id()), "regions")
    stats = near.groupBy("region").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm2").alias("norm2")).toPandas()  # at most PIVOTS rows
    radii, norms2, blocks = np.full(len(pivots), -1.0), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    radii[stats["region"]], norms2[stats["region"]], blocks[stats["region"]] = stats["radius"], stats["norm2"], -(-stats["n"] // block)
    dealt = F.pmod(F.xxhash64("row"), _of_region(blocks)).cast("int")
    return Index(near.select("region", dealt.alias("block"), "vec_id", "v"), pivots, radii, norms2, blocks)


def _of_region(values: np.ndarray) -> Column:
    return F.element_at(F.lit(values.tolist()), F.col("region") + 1)


_FOUND = "query_id long, v array<long>, region int, block int, floor double, found array<struct<vec_id: long, score: long>>"


def _met(rows: DataFrame, asked: DataFrame, k: int, block: int, again: bool) -> DataFrame:
    """Each of ``asked`` (query_id, v, region, block, floor) searched in its block; ``floor`` is then the score of its k-th best there.

    A block that is asked by more than four times ``block`` queries is copied, and they are dealt to the copies.
    """
    where = ["region", "block"]
    parts = asked.groupBy(where).agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("parts"))
    left = rows.join(parts, where).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dealt = F.pmod(F.xxhash64("query_id", "v"), F.col("parts")).cast("int")
    right = asked.join(parts, where).select("query_id", "v", *where, "floor", dealt.alias("part"))

    def one(key: tuple, own: pa.Table, queries: pa.Table) -> pa.Table:
        ids, query_ids = own.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        floors = queries.column("floor").to_numpy()
        results: list[list[tuple[int, int]]] = [[] for _ in query_ids]
        if own.num_rows and queries.num_rows:
            width = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max()) for t in (own, queries))
            x, q = _matrix(own.column("v"), width), _matrix(queries.column("v"), width)
            if width and max(np.abs(x).max(), np.abs(q).max()) ** 2 * width * 4 >= EXACT:
                lists = own.column("v").to_pylist()
                results = [_whole(ids, lists, i, v, k) for i, v in zip(query_ids.tolist(), queries.column("v").to_pylist(), strict=True)]
            else:
                results = Searcher(ids, x).tops(query_ids, q, k, floors)
        low, high = -(1 << 63), (1 << 63) - 1
        found = [[{"vec_id": v, "score": max(low, min(s, high))} for s, v in r] for r in results]
        # a little less than the k-th best, for what floating point rounds; a score below 64 bits is no floor
        last = [r[-1][0] if len(r) == k and r[-1][0] > low else None for r in results]
        floors = [-np.inf if s is None else float(min(s, high)) - 1e-9 * abs(float(s)) for s in last]
        return pa.table({
            "query_id": queries.column("query_id"), "v": queries.column("v") if again else pa.nulls(len(results), pa.list_(pa.int64())),
            "region": pa.array([key[0].as_py()] * len(results), pa.int32()), "block": pa.array([key[1].as_py()] * len(results), pa.int32()),
            "floor": pa.array(floors, pa.float64()), "found": pa.array(found, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.int64())]))),
        })

    by = ["region", "block", "part"]
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(one, _FOUND)


def first(top: Index, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Each of ``queries`` (vec_id, v) searched in one block of the region of its nearest pivot."""
    one = F.pmod(F.xxhash64("vec_id", "v"), F.greatest(_of_region(top.blocks), F.lit(1))).cast("int")
    asked = _near(queries, top.pivots).select(F.col("vec_id").alias("query_id"), "v", "region", one.alias("block"), F.lit(float("-inf")).alias("floor"))
    return common.stored(_met(top.rows, common.stored(asked, "asked"), k, block, True), "first")


def sent(top: Index, done: DataFrame) -> DataFrame:
    """(query_id, v, region, block, floor): each query once for each further block whose region's bound reaches its floor."""
    pivots, radii, norms2, blocks = top.pivots, top.radii, top.norms2, top.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                sizes = s.column("v").value_lengths().to_numpy(zero_copy_only=False)
                q = _matrix(s.column("v"), max(pivots.shape[1], int(sizes.max())))
                p = _padded(pivots, q.shape[1])
                q2, own = (q**2).sum(1)[:, None], q @ p.T
                slack = 1e-6 * (1 + q2 + norms2)
                gap = np.maximum(0, np.sqrt(np.maximum(0, q2 + (p**2).sum(1) - 2 * own)) - radii - np.sqrt(slack))
                bound = np.minimum(own + np.sqrt(q2) * radii, (q2 + norms2 - gap * gap) / 2) + slack
                reach = (bound >= s.column("floor").to_numpy(zero_copy_only=False)[:, None]) & (blocks > 0)
                row, region = np.nonzero(reach)
                n = blocks[region]
                row, region = np.repeat(row, n), np.repeat(region, n)
                block = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                new = (region != s.column("region").to_numpy()[row]) | (block != s.column("block").to_numpy()[row])
                row, region, block = row[new], region[new], block[new]
                for i in range(0, len(row), 8192):
                    t = s.select(["query_id", "v", "floor"]).take(pa.array(row[i : i + 8192]))
                    yield pa.RecordBatch.from_arrays(
                        [t.column(0), t.column(1), pa.array(region[i : i + 8192].astype(np.int32)), pa.array(block[i : i + 8192].astype(np.int32)), t.column(2)],
                        ["query_id", "v", "region", "block", "floor"],
                    )

    return done.select("query_id", "v", "region", "block", "floor").mapInArrow(run, "query_id long, v array<long>, region int, block int, floor double")


def search(queries: DataFrame, vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of ``vectors`` (vec_id, v) for each of ``queries`` (vec_id, v).

    Rows with the query's own id are left out; vectors of different lengths count as
    padded with zeros; ties go to the smaller id, equal rows are ranked one by one;
    a score beyond 64 bits is ranked as it is and given as the nearest 64-bit integer; empty tables give no rows.
    """
    top = index(vectors, block)
    if top is None or k < 1:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    done = first(top, queries, k, block)
    rest = _met(top.rows, common.stored(sent(top, done), "sent"), k, block, False)
    best = done.unionByName(rest).select("query_id", F.inline("found"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of floor(64 * x) for each vector whose id is divisible by 20."""
    vectors = quantised(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 64)
    return search(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
