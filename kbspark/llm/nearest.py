"""Nearest neighbours by inner product in vantage-point trees, one for each shard.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm of their length (0 for a query), which makes the order of inner
products the order of Euclidean distances, a metric. A bounded sample of the rows gives two things: pivots, the vantage points of the
shards (each row goes to the shard of its nearest pivot), and for each query a first bound, its k-th best inner product in the sample.
A query goes to those shards only that the triangle inequality can't rule out, and within a shard's tree a child is passed over likewise:
if all of it is farther than `factor` times the distance of the worst neighbour known. Factor 1 loses nothing, a smaller one prunes more.

The vectors are shuffled once, each to its shard; a shard of more than `shard_rows` rows (a hot region) is dealt out by hash into several
trees. Within a task a tree is built once and the queries stream past it in batches; the trees' best are merged by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.llm.common import materialize

LEAF = 48
#: Scores that the order of additions may set apart count as equal until they are worked out exactly.
ROUNDING = 1e-9


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), float).reshape(len(vectors), -1)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """x with the component that makes all rows as long as the largest (squared) norm."""
    return np.column_stack([x, np.sqrt(np.maximum(0, largest - (x**2).sum(axis=1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T))


class Tree:
    """Vantage-point tree over the rows of x. For each node the vantage point and the ranges of distance of the near and the far half."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.root = self.build(np.arange(len(x)))

    def build(self, rows: np.ndarray) -> tuple:
        if len(rows) <= LEAF:
            return (rows,)
        part = self.x[rows]
        point = part[((part - part.mean(axis=0)) ** 2).sum(axis=1).argmax()]  # at the rim: distances to it vary most
        d = np.sqrt(((part - point) ** 2).sum(axis=1))
        inner = d <= np.median(d)
        if inner.all():
            inner = d < d.max()
        if not inner.any():  # all at one distance
            return (rows,)
        return (point, (d[inner].min(), d[inner].max()), self.build(rows[inner]), (d[~inner].min(), d[~inner].max()), self.build(rows[~inner]))


class Search:
    """For each row of q all points of the tree that may be among its k best, by walks that many queries take together. `bound` is an inner
    product that the k-th best is known to reach (-inf: unknown); visited counts the points whose inner product was worked out."""

    def __init__(self, tree: Tree, q: np.ndarray, largest: float, k: int, factor: float, bound: np.ndarray) -> None:
        self.tree, self.q, self.factor, self.k, self.visited = tree, q, factor, k, 0
        self.lifted = np.column_stack([q, np.zeros(len(q))])
        self.square = (q**2).sum(axis=1) + largest
        self.best = np.full((len(q), k), -np.inf)
        self.bound = bound.copy()
        self.margin = ROUNDING * np.maximum(1.0, self.square)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.go(tree.root, np.arange(len(q)))

    def worst(self, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.square[at] - 2 * (self.bound[at] - self.margin[at])))

    def go(self, node: tuple, at: np.ndarray) -> None:
        if not len(at):
            return
        if len(node) == 1:
            rows = node[0]
            self.visited += len(rows) * len(at)
            s = self.q[at] @ self.tree.x[rows, :-1].T
            good = s >= (self.bound[at] - self.margin[at])[:, None]
            i, j = np.nonzero(good)
            if len(i):
                self.found.append((at[i], rows[j], s[i, j]))
                some = np.flatnonzero(good.any(axis=1))
                both = np.concatenate([self.best[at[some]], np.where(good[some], s[some], -np.inf)], axis=1)
                top = -np.partition(-both, self.k - 1, axis=1)[:, : self.k]
                self.best[at[some]] = top
                self.bound[at[some]] = np.maximum(self.bound[at[some]], top.min(axis=1))
            return
        point, near, inner, far, outer = node
        d = np.sqrt(np.maximum(0, ((self.lifted[at] - point) ** 2).sum(axis=1)))
        first = d < (near[1] + far[0]) / 2
        for mine, order in ((first, ((near, inner), (far, outer))), (~first, ((far, outer), (near, inner)))):
            for (lo, hi), child in order:
                a, da = at[mine], d[mine]
                least = np.maximum(0, np.maximum(lo - da, da - hi))
                self.go(child, a[least <= self.factor * self.worst(a) + 1e-9])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of what reaches the last bound."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j, s = (np.concatenate(v) for v in zip(*self.found, strict=True))
        good = s >= self.bound[i] - self.margin[i]
        return i[good], j[good]


class Shard:
    """The rows of one shard as a tree. Equal vectors are one point."""

    def __init__(self, rows: pd.DataFrame, largest: float) -> None:
        points, which = np.unique(rows["vector"].to_numpy(object), return_inverse=True)
        self.x = np.frombuffer(b"".join(points), float).reshape(len(points), -1)
        self.largest, self.tree = largest, Tree(lifted(self.x, largest))
        order = np.lexsort((rows["rid"], rows["vec_id"], which))
        self.ids, self.rids = rows["vec_id"].to_numpy()[order], rows["rid"].to_numpy()[order]
        self.starts = np.searchsorted(which[order], np.arange(len(points) + 1))

    def search(self, queries: pd.DataFrame, k: int, factor: float) -> tuple[pd.DataFrame, int]:
        """The k best rows of the shard for each query, and how many points were visited."""
        q = stacked(queries["vector"])
        found = Search(self.tree, q, self.largest, k + 1, factor, queries["bound"].to_numpy())
        i, j = found.pairs()
        exact = np.zeros(len(i))
        for c in range(q.shape[1]):  # the sum in the order of the components
            exact += q[i, c] * self.x[j, c]
        n = np.minimum(self.starts[j + 1] - self.starts[j], k + 1)  # of equal vectors no more can count
        at = np.repeat(self.starts[j] - np.cumsum(n) + n, n) + np.arange(n.sum())
        i, exact = np.repeat(i, n), np.repeat(exact, n)
        own = self.rids[at] == queries["rid"].to_numpy()[i]
        i, exact, at = i[~own], exact[~own], at[~own]
        order = np.lexsort((self.ids[at], -exact, i))
        i, exact, at = i[order], exact[order], at[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, exact, at = i[keep], exact[keep], at[keep]
        out = pd.DataFrame({"query": queries["rid"].to_numpy()[i], "query_id": queries["vec_id"].to_numpy()[i], "vec_id": self.ids[at], "rid": self.rids[at], "score": exact})
        return out, found.visited


def choose_pivots(x: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """n points spread over the rows of x: means of the rows nearest to them, a few times over."""
    pivots = x[np.random.default_rng(3).permutation(len(x))[:n]]
    for _ in range(rounds):
        near = distances(x, pivots).argmin(axis=1)
        size = np.bincount(near, minlength=len(pivots))
        sums = np.stack([np.bincount(near, c, len(pivots)) for c in x.T], axis=1)
        pivots = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], pivots)
    return pivots


def streamed(k: int, factor: float, largest: dict[int, float], counting: bool):
    """For rows sorted by shard, points before queries: the best of each query in each shard (or with counting what it cost: queries,
    points, visited points). A tree is dropped when its shard ends."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, points, shard = None, [], None
        for page in pages:
            if not len(page):
                continue
            key = page[["dim", "shard", "sub", "is_point"]].to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(page)], strict=True):
                part, mine = page.iloc[a:b], tuple(key[a, :3])
                if mine != name:
                    name, points, shard = mine, [], None
                if key[a, 3]:
                    points.append(part)
                    continue
                if not points and shard is None:
                    continue
                if shard is None:
                    shard, points = Shard(pd.concat(points), largest[int(mine[0])]), []
                out, visited = shard.search(part, k, factor)
                yield pd.DataFrame({"queries": [len(part)], "pairs": [len(part) * len(shard.x)], "visited": [visited]}) if counting else out

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, shard_rows: int = 4096, sample_numbers: int = 1_000_000, max_pivots: int = 2000, counting: bool = False) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank (from 1), vec_id, score: for the rows where is_query holds, the k rows with the largest
    inner products, in double precision on the vectors as given; ties to the smaller vec_id (then any order of rows); the query's own row is
    left out. With counting the result is queries, pairs and visited instead: visits of shards, points there, and points looked at.

    Rows take no part if the id or the vector is null, or the vector is empty, zero or holds a null or a number that isn't finite. Rows
    with one vec_id are rows like others, as queries too. Vectors of different lengths don't meet. Other columns are ignored, whatever
    their names; an empty table gives no rows. sample_numbers bounds the numbers of the sample (rows times components) that the driver and
    the tasks hold, max_pivots the shards before hot ones are dealt out."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    wide = F.col("embedding").cast("array<double>")
    v = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    v = v.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("e"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.size("embedding").alias("dim"))
    v = materialize(v.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    sizes = v.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).collect()  # a row for each length
    largest = {r["dim"]: r["m"] for r in sizes}
    share = sample_numbers / max(1, sum(r["n"] * r["dim"] for r in sizes))
    drawn = v.filter(F.pmod(F.xxhash64("rid"), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)).select("dim", "rid", "e").toPandas()  # about sample_numbers numbers
    sample = {dim: (np.array(g["e"].tolist(), float), g["rid"].to_numpy()) for dim, g in drawn.groupby("dim")}
    pivots = {r["dim"]: choose_pivots(lifted(sample[r["dim"]][0], r["m"]), min(max_pivots, -(-r["n"] // shard_rows))) if r["dim"] in sample else np.zeros((1, r["dim"] + 1)) for r in sizes}
    if not sizes:
        empty = "queries long, pairs long, visited long" if counting else "query_id long, rank int, vec_id long, score double"
        return vectors.sparkSession.createDataFrame([], empty)

    def assign(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for dim, g in page.groupby("dim"):
                x = np.array(g["e"].tolist(), float)
                g = g.drop(columns="e").assign(vector=[r.tobytes() for r in x])
                # Of equal vectors the k + 1 smallest ids are all that can count (queries stay, so that they are asked).
                spare = ~(g.sort_values(["vec_id", "rid"]).groupby("vector").cumcount().reindex(g.index) <= k).to_numpy() & ~g["is_query"].to_numpy()
                g, x = g[~spare], x[~spare]
                d = distances(lifted(x, largest[dim]), pivots[dim])
                near = d.argmin(axis=1)
                yield g.assign(shard=near, d=d[np.arange(len(g)), near])

    schema = "vec_id long, is_query boolean, dim int, rid long, vector binary, shard int, d double"
    rows = materialize(v.select("vec_id", "is_query", "dim", "rid", "e").mapInPandas(assign, schema), "assigned")
    stats = rows.groupBy("dim", "shard").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).toPandas()  # a row for each pivot
    stats["subs"] = -(-stats["n"] // shard_rows)
    shards = {dim: g.sort_values("shard") for dim, g in stats.groupby("dim")}

    def route(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for dim, g in page.groupby("dim"):
                for a in range(0, len(g), 512):
                    part = g.iloc[a : a + 512]
                    q = stacked(part["vector"])
                    bound = np.full(len(q), -np.inf)
                    if dim in sample and len(sample[dim][0]) > k:
                        s = q @ sample[dim][0].T
                        s[sample[dim][1] == part["rid"].to_numpy()[:, None]] = -np.inf
                        bound = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                    f = shards[dim]
                    square = (q**2).sum(axis=1) + largest[dim]
                    worst = np.sqrt(np.maximum(0, square - 2 * (bound - ROUNDING * np.maximum(1.0, square))))
                    d = distances(np.column_stack([q, np.zeros(len(q))]), pivots[dim][f["shard"].to_numpy()])
                    least = np.maximum(0, np.maximum(f["lo"].to_numpy() - d, d - f["hi"].to_numpy()))
                    i, j = np.nonzero(least <= factor * worst[:, None] + 1e-6 * np.sqrt(largest[dim]))
                    n = f["subs"].to_numpy()[j]
                    i, j, sub = np.repeat(i, n), np.repeat(j, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield part.iloc[i][["vec_id", "dim", "rid", "vector"]].assign(shard=f["shard"].to_numpy()[j], sub=sub, bound=bound[i], is_point=False)

    asked = rows.filter("is_query").select("vec_id", "dim", "rid", "vector").mapInPandas(route, "vec_id long, dim int, rid long, vector binary, shard int, sub int, bound double, is_point boolean")
    subs = rows.sparkSession.createDataFrame(stats[["dim", "shard", "subs"]].astype("int32"))
    points = rows.join(F.broadcast(subs), ["dim", "shard"])  # as many rows as pivots
    points = points.select("vec_id", "dim", "rid", "vector", "shard", F.pmod(F.xxhash64("rid"), F.col("subs")).cast("int").alias("sub"), F.lit(0.0).alias("bound"), F.lit(True).alias("is_point"))
    key = ["dim", "shard", "sub"]
    both = points.unionByName(asked).repartition(*key).sortWithinPartitions(*key, F.col("is_point").desc())
    if counting:
        return both.mapInPandas(streamed(k, factor, largest, True), "queries long, pairs long, visited long")
    best = both.mapInPandas(streamed(k, factor, largest, False), "query long, query_id long, vec_id long, rid long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "rid"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select row_number() over () rid, vec_id, [x::double for x in embedding] e from embeddings
           where vec_id is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
s as (select q.rid, q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e) score from v q join v c on q.vec_id % 20 = 0 and q.rid <> c.rid and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by rid order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
