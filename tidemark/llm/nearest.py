"""Approximate nearest neighbours (operator 10).

Vectors are dealt out to shards of bounded size. Each shard becomes a directed graph: greedy searches over the graph so
far propose a vector's neighbours, and pruning with a relaxed distance keeps those edges that no kept edge covers, so a
few long edges stay beside the short ones. Beam search answers the queries on each shard; its candidates are then
measured exactly in double precision, and each query keeps the nearest over all shards.

Graphs are rows of a table in the shared folder. Queries meet shards in blocks: a task holds one shard and one block. Every
query goes to every shard: routing queries by centroids would lose neighbours (README).
A graph's nodes are distinct vectors with all their ids, so a vector that many rows share costs one node a shard.

Vectors that are null, zero, or hold a null or non-finite component take no part, as queries or candidates; vectors of
another dimension than the query's are no candidates. Rows of one vec_id and one vector count once; of a vec_id with
several vectors each is indexed, the id is as far as its nearest one, and a query asks with the first in the order of
components. Ties go to the smaller vec_id. Columns beside vec_id and embedding are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import written

INDEX = "dim int, shard int, node int, ids array<long>, vector array<double>, edges array<int>, entry int"


class Graph:
    """A directed graph over the rows of ``vectors``; ``edges`` has a row of neighbours each, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray, entry: int):
        self.vectors, self.edges, self.entry = vectors, edges, entry
        self.near = vectors.astype(np.float32)
        self.square = np.einsum("ij,ij->i", self.near, self.near)

    def _distance(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances up to the query's own square, (queries, nodes)."""
        return self.square[nodes] - 2 * np.einsum("qd,qnd->qn", queries, self.near[nodes])

    def beam(self, queries: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that a beam search of that width finds for each query, nearest first, and their
        distances. All queries advance together, each expanding its ``step`` nearest open nodes in a turn."""
        q = queries.astype(np.float32)
        n, rows = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((n, len(self.near)), bool)
        nodes = np.full((n, width), -1)
        d = np.full((n, width), np.inf, np.float32)
        done = np.ones((n, width), bool)
        nodes[:, 0], done[:, 0] = self.entry, False
        d[:, 0] = self._distance(q, nodes[:, :1])[:, 0]
        seen[:, self.entry] = True
        while True:
            live = np.flatnonzero(~done.all(1))
            if not len(live):
                return nodes, d
            at = np.arange(len(live))[:, None]
            open_d = np.where(done[live], np.inf, d[live])
            pick = np.argsort(open_d, axis=1)[:, :step]
            chosen = np.where(np.isfinite(np.take_along_axis(open_d, pick, 1)), np.take_along_axis(nodes[live], pick, 1), -1)
            done[live[:, None], pick] = True
            new = np.where(chosen[:, :, None] >= 0, self.edges[chosen], -1).reshape(len(live), -1)
            new.sort(axis=1)
            fresh = (new >= 0) & ~seen[live[:, None], new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            most = int(fresh.sum(1).max()) if fresh.size else 0
            if not most:
                continue
            order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
            new = np.where(np.take_along_axis(fresh, order, 1), np.take_along_axis(new, order, 1), -1)
            seen[live[:, None].repeat(most, 1)[new >= 0], new[new >= 0]] = True
            far = np.where(new >= 0, self._distance(q[live], new), np.inf)
            both = np.concatenate([d[live], far], 1)
            keep = np.argsort(both, axis=1, kind="stable")[:, :width]
            d[live] = both[at, keep]
            nodes[live] = np.concatenate([nodes[live], new], 1)[at, keep]
            done[live] = np.concatenate([done[live], ~np.isfinite(far)], 1)[at, keep]

    def prune(self, of: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> np.ndarray:
        """For each node of ``of``, up to ``degree`` of the candidates in its row of ``nodes`` (-1: none): the nearest
        first, and none that a kept one is nearer to by the factor ``alpha``."""
        nodes = np.sort(nodes, axis=1)
        nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
        nodes[nodes == of[:, None]] = -1
        x = self.near[nodes]
        d = np.where(nodes >= 0, ((x - self.near[of][:, None]) ** 2).sum(2), np.inf)
        order = np.argsort(d, axis=1)
        nodes, d, x = np.take_along_axis(nodes, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(x, order[:, :, None], 1)
        alive, rows = np.isfinite(d), np.arange(len(of))
        square = (x**2).sum(2)
        out = np.full((len(of), degree), -1)
        for k in range(degree):
            best = alive.argmax(1)
            some = alive[rows, best]
            if not some.any():
                break
            out[some, k] = nodes[rows, best][some]
            chosen = x[rows, best]
            between = square + square[rows, best][:, None] - 2 * np.einsum("bd,bcd->bc", chosen, x)
            alive &= ~((alpha * alpha * between <= d) & some[:, None])
            alive[rows, best] = False
        return out


def build(vectors: np.ndarray, degree: int = 32, width: int = 64, alpha: float = 1.2, batch: int = 256, seed: int = 7) -> Graph:
    """The graph of a shard. Vectors join in random order, in batches that at most double what is there; a second pass
    with the relaxed distance goes over all of them."""
    n = len(vectors)
    g = Graph(vectors, np.full((n, 2 * degree), -1), 0)
    g.entry = int(((g.near - g.near.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[g.entry], order[order != g.entry]])
    for a in (1.0, alpha):
        start = 1 if a == 1.0 else 0
        while start < n:
            size = min(batch, start) if a == 1.0 else batch
            new = order[start : start + max(1, size)]
            found, _ = g.beam(vectors[new], width)
            kept = g.prune(new, np.concatenate([found, g.edges[new]], 1), degree, a)
            g.edges[new] = -1
            g.edges[new, :degree] = kept
            _add_back(g, new, kept, degree, a)
            start += len(new)
    return g


def _add_back(g: Graph, new: np.ndarray, kept: np.ndarray, degree: int, alpha: float) -> None:
    """Edges back from the neighbours of new nodes; a node whose room is used up is pruned."""
    source = np.repeat(new, kept.shape[1])[kept.ravel() >= 0]
    target = kept.ravel()[kept.ravel() >= 0]
    if not len(target):
        return
    by = np.lexsort((source, target))
    source, target = source[by], target[by]
    first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
    counts = np.diff(first, append=len(target))
    nth = np.arange(len(target)) - np.repeat(first, counts)
    heads = target[first]
    more = np.full((len(heads), counts.max(initial=1)), -1)
    more[np.repeat(np.arange(len(heads)), counts), nth] = source
    all_ = np.concatenate([g.edges[heads], more], 1)
    all_.sort(axis=1)
    all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
    used = (all_ >= 0).sum(1)
    room = g.edges.shape[1]
    fits = used <= room
    g.edges[heads[fits]] = np.sort(all_[fits], axis=1)[:, -room:] if all_.shape[1] >= room else all_[fits]
    full = heads[~fits]
    for k in range(0, len(full), 512):
        g.edges[full[k : k + 512]] = -1
        g.edges[full[k : k + 512], :degree] = g.prune(full[k : k + 512], all_[~fits][k : k + 512], degree, alpha)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector as doubles, dim) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"), F.size(v).alias("dim"))


def index(rows: DataFrame, shards: int, degree: int = 32, width: int = 64) -> DataFrame:
    """The graph table of ``rows`` (vec_id, vector, dim), every row in it, written to the shared folder."""

    def shard_graph(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        distinct, inverse = np.unique(x, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        ids: list = [set() for _ in range(len(distinct))]
        for k, i in zip(inverse.tolist(), pdf["vec_id"].tolist()):
            ids[k].add(i)
        g = build(distinct, degree, width)
        return pd.DataFrame({"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "node": np.arange(len(distinct)), "ids": [sorted(s) for s in ids], "vector": list(distinct), "edges": [e[e >= 0] for e in g.edges], "entry": g.entry})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("dim", "shard").applyInPandas(shard_graph, INDEX), "graph")


def search(graphs: DataFrame, queries: DataFrame, shards: int, k: int = 10, width: int = 96, block: int = 1 << 15) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each row of ``queries`` (vec_id, vector, dim)."""
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))
    blocks = max(1, math.ceil(queries.count() / block))

    def nearest(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list = [[], [], []]
        if len(graph) and len(asked):
            graph = graph.sort_values("node")
            vectors = np.stack(graph["vector"].to_numpy())
            edges = np.full((len(graph), max(1, graph["edges"].map(len).max())), -1)
            for n, e in zip(graph["node"], graph["edges"]):
                edges[n, : len(e)] = e
            g, ids = Graph(vectors, edges, int(graph["entry"].iloc[0])), graph["ids"].tolist()
            names, want = asked["vec_id"].to_numpy(), np.stack(asked["vector"].to_numpy())
            for at in range(0, len(want), 256):
                found, _ = g.beam(want[at : at + 256], min(max(width, k), len(vectors)))
                for name, q, nodes in zip(names[at : at + 256].tolist(), want[at : at + 256], found):
                    nodes = nodes[nodes >= 0]
                    exact = np.sqrt(((vectors[nodes] - q) ** 2).sum(1))
                    best: dict = {}  # the distance of each id, that of its nearest vector
                    far = 0.0
                    for j in np.argsort(exact, kind="stable").tolist():
                        if len(best) >= k and exact[j] > far:
                            break
                        # Of equal vectors the smallest ids: k, one more as the query itself may be among them, and as
                        # many as stand already.
                        for i in ids[nodes[j]][: k + 1 + len(best)]:
                            if i != name and i not in best:
                                best[i] = far = exact[j]
                    for d, i in sorted((d, i) for i, d in best.items())[:k]:
                        out[0].append(name)
                        out[1].append(i)
                        out[2].append(d)
        return pd.DataFrame({"query_id": np.array(out[0], np.int64), "vec_id": np.array(out[1], np.int64), "score": np.array(out[2], np.float64)})

    key = ["dim", "shard", "block"]
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(nearest, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, queries_where, k: int = 10, shard_rows: int = 8192, degree: int = 32, width: int = 96) -> DataFrame:
    """Index all of ``vectors`` (vec_id, embedding) and search those rows for which ``queries_where`` holds."""
    rows = usable(vectors)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    graphs = index(rows, shards, degree)
    return search(graphs, rows.where(queries_where), shards, k, width)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
