"""Approximate vector search over layered small-world graphs, one for each shard of the vectors.

Equal vectors are one node, so copies neither crowd a node's links nor hide what lies behind them. A shard's nodes are linked one after the
other: each goes to a random number of layers, finds its nearest nodes by a beam of `ef_construction` and links to those of them that are
nearer to it than to each other. The graph is a table in the shared folder, kept for any number of searches. A search sends blocks of
queries to every shard; each walks down the layers and then along a beam of `ef`, and the shards' best are ranked together.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kbspark.operators.retrieval import top, with_limit
from kbspark.sources.tables import materialize

GRAPH = "shard int, node int, x long, y long, links array<array<int>>, embedding array<float>"


def beam(unit: np.ndarray, links: list[list[int]], q: np.ndarray, start: list[int], ef: int) -> list[tuple[float, int]]:
    """The ef nearest nodes that the walk from start meets in one layer, nearest first."""
    first = unit[start] @ q
    best = list(zip(first.tolist(), start, strict=True))
    heapq.heapify(best)
    waiting, seen = [(-s, n) for s, n in best], set(start)
    heapq.heapify(waiting)
    while waiting:
        s, n = heapq.heappop(waiting)
        if len(best) >= ef and -s < best[0][0]:
            break
        new = [i for i in links[n] if i not in seen]
        seen.update(new)
        for sim, i in zip((unit[new] @ q).tolist(), new, strict=True) if new else ():
            if len(best) < ef or sim > best[0][0]:
                heapq.heappush(best, (sim, i))
                heapq.heappush(waiting, (-sim, i))
                if len(best) > ef:
                    heapq.heappop(best)
    return sorted(best, reverse=True)


def spread(unit: np.ndarray, near: list[tuple[float, int]], most: int) -> list[int]:
    """Up to `most` of the nodes, nearest first, without those that are nearer to one already taken; then the nearest of the others."""
    taken: list[int] = []
    for sim, i in near:
        if len(taken) < most and (not taken or (unit[taken] @ unit[i]).max() < sim):
            taken.append(i)
    return (taken + [i for _, i in near if i not in taken])[:most]


def build(unit: np.ndarray, m: int, ef: int, seed: int) -> list[list[list[int]]]:
    """links[layer][node]; a node that isn't in a layer has no links there. Node 0 is in all layers and the start of every walk."""
    levels = np.minimum((-np.log(np.random.default_rng(seed).random(len(unit))) / np.log(m)).astype(int), 8)
    levels[0] = levels.max()
    links: list[list[list[int]]] = [[[] for _ in unit] for _ in range(levels[0] + 1)]
    for n in range(1, len(unit)):
        start = [0]
        for layer in range(levels[0], -1, -1):
            near = beam(unit, links[layer], unit[n], start, ef if layer <= levels[n] else 1)
            start = [i for _, i in near]
            if layer > levels[n]:
                continue
            own, most = links[layer], 2 * m if layer == 0 else m
            own[n] = spread(unit, near, m)
            for i in own[n]:
                own[i].append(n)
                if len(own[i]) > most:
                    sims = unit[own[i]] @ unit[i]
                    own[i] = spread(unit, sorted(zip(sims.tolist(), own[i], strict=True), reverse=True), most)
    return links


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding has a direction: not null, and not zero."""
    return vectors.filter("embedding is not null and not exists(embedding, v -> v is null or isnan(v)) and exists(embedding, v -> v <> 0)")


def unit_rows(rows: pd.Series) -> np.ndarray:
    x = np.stack(rows.to_list()).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def build_graph(vectors: DataFrame, m: int = 16, ef_construction: int = 64, shard_rows: int = 5000) -> tuple[DataFrame, DataFrame]:
    """vectors (chunk_id, embedding) -> (graph, members (x, y, chunk_id)), both in the shared folder. x and y name a vector.

    Null vectors, those of zeros and those with nulls in them are left out; all must have one length. An empty table gives an empty graph."""
    v = usable(vectors.select("chunk_id", F.col("embedding").cast("array<float>").alias("embedding")))
    v = v.withColumns({"x": F.xxhash64("embedding"), "y": F.xxhash64(F.lit(1), "embedding")})
    members = materialize(v.select("x", "y", "chunk_id"))
    nodes = materialize(v.groupBy("x", "y").agg(F.first("embedding").alias("embedding")))
    shards = max(1, -(-nodes.count() // shard_rows))
    nodes = nodes.withColumn("shard", F.pmod("x", F.lit(shards)).cast("int"))

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"]).reset_index(drop=True)
        links = build(unit_rows(rows["embedding"]), m, ef_construction, int(rows["shard"].iloc[0]))
        return rows.assign(node=range(len(rows)), links=[[layer[n] for layer in links] for n in range(len(rows))])[["shard", "node", "x", "y", "links", "embedding"]]

    return materialize(nodes.groupBy("shard").applyInPandas(link, GRAPH)), members


def search(queries: DataFrame, graph: DataFrame, members: DataFrame, k: int | str = 30, ef: int = 200, query_rows: int = 4096) -> DataFrame:
    """queries (query_id, embedding) -> query_id, chunk_id, score (cosine), rank of the k best chunks found; k is a number or a column of queries.
    Queries without a direction find nothing."""
    q = usable(queries)
    most = k if isinstance(k, int) else q.agg(F.max(k)).first()[0] or 0
    shards = (graph.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, -(-q.count() // query_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")).withColumn("shard", every(shards))
    dealt = graph.withColumn("block", every(blocks))

    def walk(a: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(g):
            g = g.sort_values("node")
            unit, n_layers = unit_rows(g["embedding"]), len(g["links"].iloc[0])
            links = [[list(map(int, node[layer])) for node in g["links"]] for layer in range(n_layers)]
            x, y = g["x"].to_numpy(), g["y"].to_numpy()
            for query_id, v in zip(a["query_id"], unit_rows(a["embedding"]), strict=True):
                start = [0]
                for layer in range(n_layers - 1, -1, -1):
                    near = beam(unit, links[layer], v, start, max(ef, most) if layer == 0 else 1)
                    start = [n for _, n in near]
                out += [(query_id, x[n], y[n], round(s, 6)) for s, n in near[: max(ef, most)]]
        return pd.DataFrame(out, columns=["query_id", "x", "y", "score"]).astype({"query_id": "int64", "x": "int64", "y": "int64", "score": float})

    found = asked.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(walk, "query_id long, x long, y long, score double")
    near = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "x", "y"))).filter(F.col("r") <= 2 * most).drop("r")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("x", "y").orderBy("chunk_id"))).filter(F.col("r") <= most).drop("r")
    return top(with_limit(near.join(first, ["x", "y"]).select("query_id", "chunk_id", "score"), queries, k), k).select("query_id", "chunk_id", "score", "rank")
