"""Approximate nearest neighbours: robust-pruned directed graphs per shard and band of norms, searched by beam."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written
from .vectors import distinct_vectors, met, parts, stack

TOP = 20
SHARD_ROWS = 8192
TILE_QUERIES = 4096
DEGREE, SLACK = 32, 44
BUILD_BEAM, QUERY_BEAM, WIDTH = 64, 144, 4
ALPHA = 1.2
CHUNK = 256
#: Norms of the vectors of one graph differ by at most this factor.
BAND = 1.1
INDEX = "shard int, top double, nodes int, dims int, vectors binary, graph binary, start int, ids binary, ends binary"


class Graph:
    """Rows of `points` with up to SLACK out-edges each; -1 stands for none. Distances are squared Euclidean."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None, start: int = 0):
        self.points = np.ascontiguousarray(points, np.float32)
        self.norms = np.einsum("nd,nd->n", self.points, self.points)
        self.edges = np.full((len(points), SLACK), -1, np.int32) if edges is None else edges
        self.start = start

    def beam(self, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The `size` nearest nodes that a greedy beam search reaches: (ids, distances without the query's norm), nearest first."""
        m, n = len(queries), len(self.points)
        ids = np.full((m, size), -1, np.int32)
        far = np.full((m, size), np.inf, np.float32)
        open_ = np.zeros((m, size), bool)
        ids[:, 0], open_[:, 0] = self.start, True
        far[:, 0] = self.norms[self.start] - 2 * queries @ self.points[self.start]
        seen = np.zeros((m, n), bool)
        seen[:, self.start] = True
        rows = np.arange(m)
        while len(rows):
            first = np.argsort(~open_[rows], axis=1, kind="stable")[:, :WIDTH]
            chosen = np.take_along_axis(open_[rows], first, 1)
            at = np.where(chosen, np.take_along_axis(ids[rows], first, 1), -1)
            open_[rows[:, None], first] = False
            near = np.where(at[:, :, None] >= 0, self.edges[at], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[rows[:, None], near]
            r, c = np.nonzero(fresh)
            new = near[r, c]
            seen[rows[r], new] = True
            gap = np.full(near.shape, np.inf, np.float32)
            gap[r, c] = self.norms[new] - 2 * np.einsum("nd,nd->n", queries[rows[r]], self.points[new])
            all_far = np.concatenate([far[rows], gap], axis=1)
            keep = np.argsort(all_far, axis=1, kind="stable")[:, :size]
            far[rows] = np.take_along_axis(all_far, keep, 1)
            ids[rows] = np.where(np.isfinite(far[rows]), np.take_along_axis(np.concatenate([ids[rows], near], axis=1), keep, 1), -1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], fresh], axis=1), keep, 1)
            rows = rows[open_[rows].any(axis=1)]
        return ids, far

    def prune(self, nodes: np.ndarray, pool: np.ndarray, degree: int = DEGREE) -> np.ndarray:
        """Up to `degree` diverse neighbours of each node out of its row of `pool` (-1: none): nearest first, and a
        candidate falls once a chosen neighbour is nearer to it by the factor ALPHA than the node is."""
        own = self.points[nodes]
        near = self.points[pool]
        gap = self.norms[pool] + self.norms[nodes][:, None] - 2 * np.einsum("md,mpd->mp", own, near)
        gap[(pool < 0) | (pool == nodes[:, None])] = np.inf
        order = np.argsort(gap, axis=1, kind="stable")
        pool, gap = np.take_along_axis(pool, order, 1), np.take_along_axis(gap, order, 1)
        near = np.take_along_axis(near, order[:, :, None], 1)
        norms, alive, at = self.norms[pool], np.isfinite(gap), np.arange(len(nodes))
        out = np.full((len(nodes), degree), -1, np.int32)
        for i in range(degree):
            pick = alive.argmax(axis=1)
            has = alive[at, pick]
            if not has.any():
                break
            out[has, i] = pool[at, pick][has]
            between = norms + norms[at, pick][:, None] - 2 * np.einsum("md,mpd->mp", near[at, pick], near)
            alive &= ~((ALPHA * ALPHA * between <= gap) & has[:, None])
            alive[at, pick] = False
        return out

    def insert(self, nodes: np.ndarray) -> None:
        pool, _ = self.beam(self.points[nodes], BUILD_BEAM)
        picked = self.prune(nodes, pool)
        self.edges[nodes] = -1
        self.edges[nodes, :DEGREE] = picked
        source, target = np.repeat(nodes, DEGREE), picked.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        begin = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, int)
        place = np.arange(len(target)) - np.repeat(begin, np.diff(np.r_[begin, len(target)]))
        hosts = target[begin]
        width = int(place.max(initial=-1)) + 1
        incoming = np.full((len(hosts), width), -1, np.int32)
        incoming[np.repeat(np.arange(len(hosts)), np.diff(np.r_[begin, len(target)])), place] = source
        degree = (self.edges[hosts] >= 0).sum(1)
        fits = degree + (incoming >= 0).sum(1) <= SLACK
        merged = np.concatenate([self.edges[hosts], incoming], axis=1)
        tidy = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)
        self.edges[hosts[fits]] = tidy[fits][:, :SLACK]
        crowded = np.flatnonzero(~fits)
        for i in range(0, len(crowded), CHUNK):
            some = crowded[i:i + CHUNK]
            self.edges[hosts[some]] = -1
            self.edges[hosts[some], :DEGREE] = self.prune(hosts[some], tidy[some])


def build_graph(points: np.ndarray, seed: int = 7) -> Graph:
    """Points enter in seeded order in growing batches, each linked to the pruned finds of a search in the graph so far."""
    graph = Graph(points)
    graph.start = int(np.argmin(graph.norms - 2 * graph.points @ graph.points.mean(axis=0)))
    order = np.random.RandomState(seed).permutation(len(points))
    order = order[order != graph.start]
    done = 0
    while done < len(order):
        size = min(max(8, done // 4), CHUNK)
        graph.insert(order[done:done + size])
        done += size
    return graph


def lifted(vectors: np.ndarray) -> np.ndarray:
    """With one more component that makes all norms equal, so that nearness is largest inner product."""
    squares = np.einsum("nd,nd->n", vectors, vectors)
    return np.hstack([vectors, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None]])


def log_norms(vectors: np.ndarray) -> np.ndarray:
    """Logarithms of the norms, -inf for zero; neither large nor small components overflow."""
    most = np.abs(vectors).max(axis=1, initial=0)
    unit = vectors / np.where(most > 0, most, 1)[:, None]
    with np.errstate(divide="ignore"):
        return np.log(most) + np.log(np.sqrt(np.einsum("nd,nd->n", unit, unit)))


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """Graphs over the distinct vectors of a shard, one for each band of similar norms; equal vectors are one node with
    their ids in order. `top` is the logarithm of a band's largest norm."""
    rows = rows.sort_values("vec_id")
    ids = rows["vec_id"].to_numpy(np.int64)
    vectors, node = np.unique(stack(list(rows["vec"])).astype(float), axis=0, return_inverse=True)
    node, norms = node.ravel(), log_norms(vectors)
    band = np.floor((norms.max() - norms) / np.log(BAND)).astype(np.int64)
    out = []
    for b in np.unique(band):
        own = band == b
        held, place = vectors[own], np.cumsum(own) - 1
        mine = own[node]
        at = place[node[mine]]
        scale = np.abs(held).max(initial=0) or 1.0
        graph = build_graph(lifted(held / scale))
        out.append({"shard": int(rows["shard"].iloc[0]), "top": float(norms[own].max()), "nodes": len(held), "dims": held.shape[1], "vectors": held.tobytes(),
                    "graph": graph.edges.tobytes(), "start": graph.start, "ids": ids[mine][np.argsort(at, kind="stable")].tobytes(),
                    "ends": np.cumsum(np.bincount(at, minlength=len(held))).astype(np.int64).tobytes()})
    return pd.DataFrame(out)


def build_index(vectors: DataFrame, rows: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """Every row of `vectors` (vec_id, vec), dealt by a hash of its id into shards of about `shard_rows`, one graph each."""
    n_shards = parts(rows, shard_rows)
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInPandas(_index, INDEX), "graph-index"), n_shards


class Band:
    """One graph of the index, ready to be asked."""

    def __init__(self, row):
        self.vectors = np.frombuffer(row.vectors).reshape(row.nodes, row.dims)
        self.ids, self.ends, self.top = np.frombuffer(row.ids, np.int64), np.frombuffer(row.ends, np.int64), row.top
        self.begins = np.r_[0, self.ends[:-1]]
        scale = np.abs(self.vectors).max(initial=0) or 1.0
        self.graph = Graph(lifted(self.vectors / scale), np.frombuffer(row.graph, np.int32).reshape(-1, SLACK), int(row.start))

    def found(self, queries: np.ndarray, size: int) -> np.ndarray:
        """Nodes near each query by beam; all of them where a beam could hold them all."""
        if len(self.vectors) <= size:
            return np.tile(np.arange(len(self.vectors)), (len(queries), 1))
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        flat = np.hstack([queries / np.where(length > 0, length, 1), np.zeros((len(queries), 1))]).astype(np.float32)
        return self.graph.beam(flat, size)[0]

    def members(self, nodes: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the nodes' vectors; of equal vectors only the k + 1 smallest ids can be among the k best."""
        scores = np.einsum("nd,d->n", self.vectors[nodes], query)
        ids = [self.ids[b:min(e, b + k + 1)] for b, e in zip(self.begins[nodes], self.ends[nodes], strict=True)]
        near, score = np.concatenate(ids), np.repeat(scores, [len(x) for x in ids])
        return near[near != own], score[near != own]


def _ask(index: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of a shard for each query. Bands are asked from the largest norms down, and a query is done once the
    largest product that a band's norms allow is below its k-th score."""
    out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    if len(index) and len(queries):
        bands = [Band(row) for row in index.sort_values("top", ascending=False).itertuples()]
        asked = stack(list(queries["vec"]), int(index["dims"].iloc[0])).astype(float)
        own, lengths = queries["vec_id"].to_numpy(np.int64), log_norms(asked)
        for i in range(0, len(asked), CHUNK):
            places = np.arange(i, min(i + CHUNK, len(asked)))
            best = {p: (np.zeros(0, np.int64), np.zeros(0)) for p in places}
            for band in bands:
                with np.errstate(over="ignore"):
                    bound = np.exp(lengths[places] + band.top) * (1 + 1e-9)
                last = np.array([best[p][1][-1] if len(best[p][1]) == k else -np.inf for p in places])
                places = places[~(bound < last)]
                if not len(places):
                    break
                for p, nodes in zip(places, band.found(asked[places], max(QUERY_BEAM, k + 1)), strict=True):
                    near, score = (np.concatenate(x) for x in zip(best[p], band.members(nodes[nodes >= 0], asked[p], own[p], k), strict=True))
                    first = np.lexsort((near, -score))[:k]
                    best[p] = near[first], score[first]
            for p, (near, score) in best.items():
                out["query_id"].append(np.full(len(near), own[p]))
                out["vec_id"].append(near)
                out["score"].append(score)
    return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()})


def nearest(index: DataFrame, n_shards: int, queries: DataFrame, n_queries: int, k: int = TOP) -> DataFrame:
    left, right = met(index, n_shards, queries, parts(n_queries, TILE_QUERIES))
    found = left.cogroup(right).applyInPandas(lambda a, b: _ask(a, b, k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def graph_search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP,
                 shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The `k` rows of largest inner product found for each query: query_id, rank, vec_id, score.

    Every usable row of `vectors` is a node of a graph of its shard, one for each band of norms within a factor BAND,
    and every query searches every shard, band by band as far as norms allow a product among its best. A query's own
    id is no candidate of it, ties go to the smaller id, scores are inner products of the original vectors in doubles.
    Rows without id, and vectors that are null, empty, zero or hold null or non-finite components, take no part; of
    rows with the same id the smallest vector stands; a shorter vector ends in zeros. Empty tables give no rows.
    """
    rows = written(distinct_vectors(vectors, id_col, vec_col, zero=False), "graph-rows")
    asked = written(distinct_vectors(queries, id_col, vec_col, zero=False), "graph-queries")
    index, n_shards = build_index(rows, rows.count(), shard_rows)
    return nearest(index, n_shards, asked, asked.count(), k)


def op8_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return graph_search(rows, rows.where(F.col("vec_id") % 20 == 0))
