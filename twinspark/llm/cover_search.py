"""Exact top-k inner products by dual-tree search: cover trees over blocks of rows and over strips of queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspark.llm.shared import cut_lineage

#: Rows under one tree, and queries under one, about.
BLOCK_ROWS, STRIP_ROWS = 4096, 8192
#: Rows near which blocks and strips are formed, at most, for each length of vectors.
PIVOTS = 256
#: A node that covers no more rows is not split further; queries are searched for together up to this number.
LEAF, GROUP = 16, 64
#: Whole numbers up to here are exact as doubles.
EXACT = float(1 << 53)


def scaled(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, as doubles; null if the vector, or a component, is null or not finite."""
    def floored(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(finite, F.transform(embedding, floored))


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order, parent, size and radius of the nodes of a cover tree over the rows of `x`, each row one node.

    Level by level, with half the distance at each: rows farther than that from all nodes so far
    become nodes below the nearest node of the level above, the farthest first.  So nodes of a level
    are apart by its distance, and within twice of it from their parents.  Nodes that cover at most
    LEAF rows keep these as they are.  In the order given, a node's rows follow it: `size` of them
    with itself; `parent` counts in that order; `radius` is the distance of the farthest.
    """
    n, norms = len(x), (x * x).sum(axis=1)

    def distances(k: int) -> np.ndarray:
        return np.sqrt(np.maximum(norms + norms[k] - 2 * (x @ x[k]), 0))

    parent, owner = np.full(n, -1), np.zeros(n, np.int64)
    if np.isfinite(norms).all() and norms.max(initial=0) < EXACT:
        best = distances(0)
        best[0] = 0
        apart = 2.0 ** math.floor(math.log2(best.max())) if best.max() > 0 else 0.0
        is_node = np.zeros(n, bool)
        is_node[0] = True
        while apart > 0:
            above = owner.copy()
            large = np.bincount(owner, minlength=n)[owner] > LEAF
            if not (large & (best > 0)).any():
                break
            open_ = large & (best > apart)
            while open_.any():
                k = int(np.argmax(np.where(open_, best, -1)))
                parent[k], is_node[k] = above[k], True
                d = distances(k)
                nearer = (d < best) & ~is_node
                owner[nearer], best[nearer] = k, d[nearer]
                owner[k], best[k] = k, 0
                open_ &= best > apart
            apart /= 2
        rest = ~is_node
        parent[rest] = owner[rest]
    else:
        parent[1:] = 0
    children: list[list[int]] = [[] for _ in range(n)]
    for k, p in enumerate(parent.tolist()):
        if p >= 0:
            children[p].append(k)
    order, stack = [], [0] if n else []
    while stack:
        k = stack.pop()
        order.append(k)
        stack.extend(reversed(children[k]))
    order = np.array(order, np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    parent = np.where(parent[order] >= 0, place[parent[order]], -1)
    size = np.ones(n, np.int64)
    for k in range(n - 1, 0, -1):
        size[parent[k]] += size[k]
    radius, x = np.zeros(n), x[order]
    for k in np.flatnonzero(size > 1):
        radius[k] = np.sqrt(((x[k + 1 : k + size[k]] - x[k]) ** 2).sum(axis=1).max())
    return order, parent, size, radius


class Tree:
    """A cover tree read back from its rows."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("place")
        self.row, self.size, self.radius = (table.column(c).to_numpy() for c in ("row", "size", "radius"))
        ids = table.column("vec_id").combine_chunks()
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = np.where(self.no_id, np.iinfo(np.int64).max, ids.fill_null(0).to_numpy())
        self.x = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(len(self.row), -1)
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        parent = table.column("parent").to_numpy()
        self.kids = np.argsort(parent, kind="stable")
        self.first = np.searchsorted(parent[self.kids], np.arange(len(parent) + 1))

    def children(self, nodes: np.ndarray) -> np.ndarray:
        counts = self.first[nodes + 1] - self.first[nodes]
        begin = np.repeat(self.first[nodes] - (np.cumsum(counts) - counts), counts)
        return self.kids[begin + np.arange(counts.sum())]


class Search:
    """The best k rows of `rows` for each query of `queries`, no worse than the scores that are known to be reached."""

    def __init__(self, queries: Tree, rows: Tree, k: int, reached: np.ndarray) -> None:
        self.q, self.r, self.k = queries, rows, k
        self.kth = reached.copy()  # of each query: the k-th score so far, here or elsewhere
        n = len(reached)
        most = queries.norm.max(initial=0) * rows.norm.max(initial=0)
        self.exact, self.slack = most < EXACT, 1e-9 * most
        self.score, self.at = np.full((n, k), -np.inf, None if self.exact else object), np.full((n, k), -1, np.int64)
        if n and len(rows.row):
            self.visit(0, np.zeros(1, np.int64), np.ones(1, bool))

    def products(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products; as Python's whole numbers where doubles could be inexact."""
        if self.exact:
            return queries @ rows.T
        q, r = ([[int(v) for v in x] for x in y] for y in (queries, rows))
        out = np.empty((len(q), len(r)), object)
        for i, j in np.ndindex(out.shape):
            out[i, j] = sum(a * b for a, b in zip(q[i], r[j], strict=True))
        return out

    def visit(self, node: int, rows: np.ndarray, open_: np.ndarray) -> None:
        """Search for all queries under `node` among `rows`, the open ones with all that is under them."""
        q, r, n = self.q, self.r, int(self.q.size[node])
        if n <= GROUP:
            return self.group(node, node + n, rows, open_)
        while True:
            # No query under the node can score more with any row under the other node.
            reach = np.where(open_, r.radius[rows], 0)
            bound = r.x[rows] @ q.x[node] + q.radius[node] * r.norm[rows] + reach * (q.norm[node] + q.radius[node]) + self.slack
            keep = ~(bound < self.kth[node : node + n].min())
            rows, open_ = rows[keep], open_[keep]
            wide = open_ & (r.radius[rows] > q.radius[node])
            if not wide.any():
                break
            below = r.children(rows[wide])
            rows, open_ = np.concatenate([rows, below]), np.concatenate([open_ & ~wide, r.size[below] > 1])
        self.group(node, node + 1, rows, open_)
        start = at = node + 1
        while at < node + n:  # small neighbours go together
            after = at + int(q.size[at])
            if after - start > GROUP and at > start:
                self.group(start, at, rows, open_)
                start = at
            if q.size[at] > GROUP:
                self.visit(at, rows, open_)
                start = after
            at = after
        if at > start:
            self.group(start, at, rows, open_)

    def group(self, start: int, end: int, rows: np.ndarray, open_: np.ndarray) -> None:
        """Scores of a few queries with `rows`, and with what is under the open ones, as long as it can be among the best."""
        q, r = self.q, self.r
        x, norm = q.x[start:end], q.norm[start:end, None]
        while len(rows):
            below = []
            for some in np.array_split(np.arange(len(rows)), -(-len(rows) // BLOCK_ROWS)):
                nodes = rows[some]
                scores = self.products(x, r.x[nodes])
                others = q.row[start:end, None] != r.row[nodes]
                self.offer(start, nodes, np.where(others, scores, -np.inf))
                can = ((scores + r.radius[nodes] * norm + self.slack) >= self.kth[start:end, None]).any(axis=0)
                below.append(nodes[open_[some] & can])
            rows = r.children(np.concatenate(below))
            open_ = r.size[rows] > 1

    def offer(self, start: int, nodes: np.ndarray, scores: np.ndarray) -> None:
        good = (scores >= self.kth[start : start + len(scores), None]) & (scores > -np.inf)
        for j in np.flatnonzero(good.any(axis=1)):
            new, query = np.flatnonzero(good[j]), start + j
            score = np.concatenate([self.score[query], scores[j, new]])
            at = np.concatenate([self.at[query], nodes[new]])
            order = (self.r.row[at], self.r.no_id[at], self.r.id[at], -score)
            best = np.lexsort(order)[: self.k] if self.exact else np.array(sorted(range(len(at)), key=lambda i: tuple(o[i] for o in reversed(order)))[: self.k])
            self.score[query], self.at[query] = score[best], at[best]
            self.kth[query] = max(self.kth[query], self.score[query, -1])

    def best(self) -> pa.Table:
        query, place = np.nonzero(self.at >= 0)
        at = self.at[query, place]
        ids = pa.array(self.r.id[at], mask=self.r.no_id[at])
        return pa.table({"query": self.q.row[query], "query_id": pa.array(self.q.id[query], mask=self.q.no_id[query]), "row": self.r.row[at], "vec_id": ids, "score": pa.array([int(x) for x in self.score[query, place]], pa.int64())})


FOUND = "query long, query_id long, row long, vec_id long, score long"
NODE = "part int, dim int, place int, parent long, size long, radius double, row long, vec_id long, v array<double>"


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """`rows` with the part they go to: rows near one pivot, of about `size` rows; large neighbourhoods are split by hash, small ones joined."""
    counts = sorted(rows.groupBy("dim", "pivot").count().collect())  # at most PIVOTS for each length
    parts, part, held, before = [], -1, 0, None
    for dim, pivot, n in counts:
        if n > size or held + n > size or dim != before:
            part, held = part + 1, 0
        split = -(-n // size)
        parts.append((dim, pivot, part, split))
        part, held, before = part + split - 1, held + n if split == 1 else size, dim
    names = F.broadcast(rows.sparkSession.createDataFrame(parts, "dim int, pivot int, part int, split int"))
    return rows.join(names, ["dim", "pivot"]).withColumn("part", (F.col("part") + F.pmod(F.xxhash64("row"), F.col("split"))).cast("int")).drop("pivot", "split")


def _trees(rows: DataFrame) -> DataFrame:
    """A cover tree for each part, a row for each node."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        x = np.asarray(group.column("v").combine_chunks().flatten(), np.float64).reshape(group.num_rows, -1)
        order, parent, size, radius = cover_tree(x)
        group = group.take(pa.array(order))
        own = {"place": pa.array(np.arange(len(order), dtype=np.int32)), "parent": parent, "size": size, "radius": radius}
        return pa.table({c: own.get(c, group.column(c) if c in group.column_names else None) for c in (f.split()[0] for f in NODE.split(", "))})

    return cut_lineage(rows.groupBy("part").applyInArrow(build, NODE))


def _searched(trees: DataFrame, queries: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """FOUND for each cell: the best rows of a block for each query of a strip, if they reach the query's `reached`."""
    n = max(int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions")), trees.sparkSession.sparkContext.defaultParallelism)
    left = trees.withColumnRenamed("part", "block").join(cells, "block").repartition(n, "block", "strip")
    right = queries.withColumnRenamed("part", "strip").join(cells, "strip").repartition(n, "block", "strip")

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("place")
        reached = asked.column("reached").combine_chunks().fill_null(-np.inf).to_numpy(zero_copy_only=False)
        return Search(Tree(asked), Tree(rows), k, reached).best()

    return left.groupBy("block", "strip").cogroup(right.groupBy("block", "strip")).applyInArrow(search, FOUND)


def _pivot_of(rows: DataFrame) -> DataFrame:
    """`rows` with the nearest pivot of their length; the pivots are the rows of the least hashes."""
    per_dim = Window.partitionBy("dim").orderBy(F.xxhash64("v"), "row")
    chosen = rows.withColumn("pivot", F.row_number().over(per_dim)).where(F.col("pivot") <= PIVOTS).select("dim", "pivot", "v").collect()
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    pivots: dict[int, list] = {}
    for r in sorted(chosen, key=lambda r: r["pivot"]):
        if r["pivot"] <= max(1, sizes[r["dim"]] // BLOCK_ROWS):
            pivots.setdefault(r["dim"], []).append(r["v"])
    matrices = {d: np.array(v, np.float64).reshape(len(v), d) for d, v in pivots.items()}

    def nearest(v: pa.Array) -> pa.Array:
        sizes = np.diff(v.offsets.to_numpy())
        out = np.zeros(len(v), np.int32)
        values = np.asarray(v.flatten(), np.float64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        for d in np.unique(sizes):
            some = np.flatnonzero(sizes == d)
            x, p = values[at[some][:, None] + np.arange(d)], matrices[int(d)]
            with np.errstate(over="ignore", invalid="ignore"):
                out[some] = np.argmin(np.nan_to_num((p * p).sum(axis=1) - 2 * (x @ p.T)), axis=1)
        return pa.array(out)

    return rows.withColumn("pivot", F.arrow_udf(nearest, "int")("v"))


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, embedding: str = "embedding", vec_id: str = "vec_id", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `is_query` holds, the k rows of the highest inner products.

    Components are taken as floor(scale * x), so that scores are whole numbers; they are exact, and
    an error is raised if one is beyond a long.  Every row but the query's own is a candidate, rows that
    repeat it or share its id too; ties go to the smaller id, a null id counts as the largest, and
    rows that repeat have ranks one after the other.  A query needs an id if `is_query` reads it.
    Vectors that are null, or hold a null or a component that is not finite, take no part; vectors
    of other lengths than the query's are no candidates.  Fewer candidates give fewer rows, an
    empty table none; no other column is read.

    Rows are dealt into blocks of about BLOCK_ROWS near each other, queries into strips, each under
    a cover tree; at most PIVOTS rows of each length, those of the least hashes, are the points
    around which they are formed, whatever the result.  Each strip first searches the block that
    its root's bound favours, which gives every query a k-th score that it reaches; then only the
    blocks whose root can still hold a better row go to the strip.  Within a block pairs of nodes
    are dropped by their covering radii against the worst k-th score of the queries under the node.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), scaled(F.col(embedding), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")).where("v is not null")
    rows = cut_lineage(rows.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("v")}))
    placed = _pivot_of(rows)
    trees, queries = _trees(_dealt(placed, BLOCK_ROWS)), _trees(_dealt(placed.where("asked"), STRIP_ROWS))

    def root(part: str, of: DataFrame) -> DataFrame:
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        return of.where("place = 0").select(F.col("part").alias(part), "dim", *(c.alias(f"{part}_{n}") for c, n in ((F.col("v"), "v"), (norm, "norm"), (F.col("radius"), "radius"))))

    # A row for each block and each strip; no rows of theirs.
    product = F.aggregate(F.zip_with("block_v", "strip_v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    bound = product + F.col("strip_radius") * F.col("block_norm") + F.col("block_radius") * (F.col("strip_norm") + F.col("strip_radius"))
    slack = 1e-9 * (F.col("strip_norm") + F.col("strip_radius")) * (F.col("block_norm") + F.col("block_radius"))
    cells = cut_lineage(root("block", trees).join(root("strip", queries), "dim").select("block", "strip", (bound + slack).alias("bound")))
    first = cells.groupBy("strip").agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    found = cut_lineage(_searched(trees, queries.withColumn("reached", F.lit(None).cast("double")), first, k))
    kth = found.groupBy("query").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("reached")).where(F.col("n") >= k).select(F.col("query").alias("row"), "reached")
    asked = cut_lineage(queries.join(kth, "row", "left"))
    worst = asked.groupBy(F.col("part").alias("strip")).agg(F.when(F.count("reached") == F.count("*"), F.min("reached")).alias("worst"))
    open_ = cells.join(first, ["strip", "block"], "left_anti").join(worst, "strip").where("worst is null or not bound < worst").select("block", "strip")
    found = found.unionByName(_searched(trees, asked, open_, k))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
