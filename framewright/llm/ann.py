"""Approximate nearest neighbours by inner product: balanced posting lists with a graph over their centroids."""

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, Window as W

from framewright.llm.common import scan
from framewright.session import cut

#: Vectors per list on average; lists at most; rows that centroids are fitted on; copies of a boundary vector at most;
#: distance ratio within which a vector is copied; rows per search block; queries that the ratio is set with; recall aimed at;
#: lists of a query that are searched first, whose k-th best score the other lists must reach.
LIST_ROWS, MAX_LISTS, SAMPLE_ROWS, COPIES, CLOSE, BLOCK, PROBE_QUERIES, AIM, NEAR = 512, 4096, 16_384, 2, 0.1, 4096, 200, 0.97, 8
DEGREE = 16


def balanced_centroids(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means whose assignment charges every list for being larger than the average, so that sizes draw near."""
    rng = np.random.default_rng(7)
    centroids = sample[rng.choice(len(sample), k, replace=False)].copy()
    charge = np.zeros(k)
    for _ in range(rounds):
        nearest, spread = [], []
        for block in np.array_split(sample, math.ceil(len(sample) / 1024)):
            d = (centroids**2).sum(1) - 2 * block @ centroids.T
            nearest.append((d + charge).argmin(1))
            spread.append(d.std())
        label = np.concatenate(nearest)
        size = np.bincount(label, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, label, sample)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
        charge += 0.1 * np.mean(spread) * (size / max(size.mean(), 1e-9) - 1).clip(-1, 2)
    return centroids.astype(np.float32)


class Centroids:
    """Centroids and the graph that leads from any of them to those near a vector."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        d = ((points[:, None] - points[None]) ** 2).sum(-1) if len(points) <= 512 else None
        near = []
        for i in range(len(points)):
            row = d[i] if d is not None else ((points - points[i]) ** 2).sum(1)
            near.append(np.argsort(row, kind="stable")[1 : DEGREE + 1])
        width = max((len(r) for r in near), default=0)
        rng = np.random.default_rng(11)
        far = rng.integers(0, len(points), (len(points), 2))  # long edges keep the graph connected
        ring = (np.arange(len(points))[:, None] + 1) % len(points)
        self.edges = np.hstack([np.array(near, np.int64).reshape(len(points), width), far, ring])
        self.entries = np.unique(rng.integers(0, len(points), 8))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, distance) of the `width` nearest found for every row of q, by best-first search over the graph."""
        n, k = len(q), len(self.points)
        width = min(width, k)
        seen = np.zeros((n, k), bool)
        ids = np.tile(self.entries, (n, 1))
        seen[:, self.entries] = True
        dist = ((q[:, None] - self.points[ids]) ** 2).sum(-1)
        done = np.zeros(ids.shape, bool)
        while True:
            open_ = np.where(done, np.inf, dist)
            best = np.argsort(open_, axis=1)[:, :4]
            active = np.flatnonzero(np.isfinite(np.take_along_axis(open_, best[:, :1], 1)[:, 0]))
            if not len(active):
                break
            best = best[active]
            row = active[:, None]
            new = self.edges[ids[row, best]].reshape(len(active), -1)
            new = np.where(np.isfinite(open_[row, best]).repeat(self.edges.shape[1], axis=1), new, -1)
            done[row, best] = True
            new = np.sort(new, axis=1)
            fresh = (new >= 0) & ~seen[row, new]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            d = np.where(fresh, ((q[active][:, None] - self.points[new]) ** 2).sum(-1), np.inf)
            seen[np.broadcast_to(row, new.shape)[fresh], new[fresh]] = True
            all_ids, all_dist = np.full((n, ids.shape[1] + new.shape[1]), 0), np.full((n, ids.shape[1] + new.shape[1]), np.inf)
            all_ids[:, : ids.shape[1]], all_dist[:, : ids.shape[1]] = ids, dist
            all_ids[active, ids.shape[1] :], all_dist[active, ids.shape[1] :] = new, d
            all_done = np.ones(all_ids.shape, bool)
            all_done[:, : done.shape[1]] = done
            all_done[active, done.shape[1] :] = ~fresh
            order = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = (np.take_along_axis(a, order, 1) for a in (all_ids, all_dist, all_done))
        return ids, np.sqrt(dist)

    def homes(self, x: np.ndarray) -> list[list[int]]:
        """Lists of every vector: its nearest, and for a vector on a boundary the next ones that are hardly farther."""
        ids, dist = self.search(x, 4 * COPIES)
        near = dist[:, :COPIES] <= (1 + CLOSE) * dist[:, :1]
        return [row[keep].tolist() for row, keep in zip(ids[:, :COPIES], near)]

    def probes(self, q: np.ndarray, ratio: float, sizes: np.ndarray, least: int) -> list[list[int]]:
        """The nearest lists that hold `least` rows by `sizes`, and all within `ratio` of the last one's distance; the search widens until that is passed."""
        out: list[list[int]] = [[] for _ in q]
        todo, width = np.arange(len(q)), 64
        while len(todo):
            ids, dist = self.search(q[todo], width)
            held = np.cumsum(sizes[ids], axis=1) >= least
            last = np.where(held.any(axis=1), held.argmax(axis=1), dist.shape[1] - 1)
            near = dist <= ratio * np.take_along_axis(dist, last[:, None], 1) + 1e-12
            near |= np.arange(dist.shape[1]) <= last[:, None]
            full = near.all(axis=1) & (ids.shape[1] < len(self.points)) & (width < len(self.points))
            for t, row, keep in zip(todo[~full], ids[~full], near[~full]):
                out[t] = row[keep & np.isfinite(row)].tolist()
            todo, width = todo[full], width * 2
        return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added up in the order of the components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def best_pairs(queries: np.ndarray, q_ids: np.ndarray, base: np.ndarray, b_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> pd.DataFrame:
    """The k best of `base` for every query but itself, largest product first, ties to the smaller id; none below `least` of the query."""
    out = []
    least = np.full(len(queries), -np.inf) if least is None else least
    (q_ids, i), (b_ids, j) = np.unique(q_ids, return_index=True), np.unique(b_ids, return_index=True)
    queries, least, base = queries[i], least[i], base[j]  # repeated rows count once
    for begin in range(0, len(queries), 512):
        q, own = queries[begin : begin + 512], q_ids[begin : begin + 512]
        rough = q @ base.T
        rough[own[:, None] == b_ids[None]] = -np.inf
        kth = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
        kth = np.maximum(kth, least[begin : begin + 512])
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(kth), kth, 0)))
        i, j = np.nonzero((rough >= (kth - slack)[:, None]) & np.isfinite(rough))
        out.append(pd.DataFrame({"query_id": own[i], "vec_id": b_ids[j], "score": exact(q[i], base[j])}))
    found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id").head(k)


FOUND = "query_id bigint, vec_id bigint, score double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact neighbours of a bounded set of queries: it is sent to every batch of the vectors."""
    few = queries.toPandas()
    if not len(few):
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    q, ids = np.stack(few["v"].to_list()), few["vec_id"].to_numpy()

    def make():
        def work(vec_ids, vs):
            yield best_pairs(q, ids, np.array(vs, float), np.array(vec_ids), k).to_dict("list")

        return work

    return ranked(scan(vectors.select("vec_id", "v"), FOUND, make), k)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) in double precision: vectors of the commonest length without null, non-finite or only zero components."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    v = v.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    return v.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, aim: float = AIM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of `vectors` (vec_id, embedding) for each of `queries` (same columns).

    Inner products become distances by one more component that gives all vectors the largest norm. Centroids are fitted to
    a sample of at most 16,384 rows; every row is indexed, boundary vectors in two lists. A query reads its nearest lists until
    they hold k other vectors, and the lists whose centroid is within a ratio of the last one's distance; the nearest eight are searched first, and from the others only
    vectors are taken that reach the k-th best score found there, which loses none of the k best. The ratio is set so that a share `aim` of the true neighbours of 200
    sampled queries, found by brute force, lies in such lists. Lists are searched in blocks of at most about 4,096 vectors by
    as many queries, so neither a large list nor a popular one is a large task, and no rows are left out.

    Nulls, zero vectors, and those with null or non-finite components or another length than the commonest take no part. Rows
    repeated with their vec_id count once. Ties go to the smaller vec_id; scores are exact. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    rows, asked = cut(usable(vectors)), cut(usable(queries))
    stats = rows.agg(F.count(F.lit(1)), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)"))).first()
    n, top = stats[0], stats[1] or 1.0
    if not n or asked.isEmpty():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    share = min(1.0, SAMPLE_ROWS / n)
    uniform = lambda c, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = rows.where(uniform("vec_id", 3) < share).select("v").limit(2 * SAMPLE_ROWS).toPandas()
    base = np.stack(sample["v"].to_list()) if len(sample) else np.stack(rows.select("v").limit(1).toPandas()["v"].to_list())
    lifted = lambda x: np.hstack([x, np.sqrt(np.maximum(0, top - (x**2).sum(1)))[:, None]]).astype(np.float32)
    flat = lambda x: np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32)
    lists = int(min(MAX_LISTS, len(base), max(1, n // LIST_ROWS)))
    centroids = Centroids(balanced_centroids(lifted(base), lists))
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(centroids))  # with its class, so that workers need not have this package

    def indexer():
        model = pickle.loads(packed.value)

        def work(ids, vs):
            for i in range(0, len(ids), 1024):
                x = np.array(vs[i : i + 1024], float)
                homes = model.homes(lifted(x))
                yield {"list": [c for h in homes for c in h], "vec_id": [v for v, h in zip(ids[i : i + 1024], homes) for _ in h], "v": [v for v, h in zip(vs[i : i + 1024], homes) for _ in h]}

        return work

    postings = cut(scan(rows, "list int, vec_id bigint, v array<double>", indexer))
    ratio = calibrated(rows, postings, asked, centroids, flat, k, aim)
    sizes = np.zeros(lists, np.int64)
    for r in postings.select("list", "vec_id").distinct().groupBy("list").count().collect():  # a row per list, at most 4,096
        sizes[r["list"]] = r["count"]
    enough = COPIES * (k + 1)  # as rows of lists, so that k vectors besides the query's own are among them

    def prober():
        model = pickle.loads(packed.value)

        def work(ids, vs):
            for i in range(0, len(ids), 1024):
                near = model.probes(flat(np.array(vs[i : i + 1024], float)), ratio, sizes, enough)
                yield {
                    "list": [c for p in near for c in p],
                    "query_id": [v for v, p in zip(ids[i : i + 1024], near) for _ in p],
                    "q": [v for v, p in zip(vs[i : i + 1024], near) for _ in p],
                    "place": [j for p in near for j in range(len(p))],
                }

        return work

    probes = cut(scan(asked, "list int, query_id bigint, q array<double>, place int", prober))
    first = cut(ranked(tiled(postings, probes.where(F.col("place") < NEAR).withColumn("least", F.lit(-math.inf)), k), k))
    bound = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    others = probes.where(F.col("place") >= NEAR).join(bound, "query_id", "left").fillna(-math.inf, ["least"])
    return ranked(first.select("query_id", "vec_id", "score").unionByName(tiled(postings, others, k)), k)


def tiled(postings: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each list for the queries that read it, `least` at least, by blocks of both."""
    blocks = lambda t, name: t.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    shape = F.broadcast(blocks(postings, "nb").join(blocks(probes, "nq"), "list"))  # a row per list, at most 4,096
    spread = lambda c, m, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = postings.join(shape, "list").select("list", spread("vec_id", "nb", 5).alias("b"), every("nq").alias("p"), "vec_id", "v")
    right = probes.join(shape, "list").select("list", every("nb").alias("b"), spread("query_id", "nq", 6).alias("p"), "query_id", "q", "least")

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        arrays = np.stack(b["q"].to_list()), b["query_id"].to_numpy(), np.stack(a["v"].to_list()), a["vec_id"].to_numpy()
        return best_pairs(*arrays, k, b["least"].to_numpy(float))

    return left.groupBy("list", "b", "p").cogroup(right.groupBy("list", "b", "p")).applyInPandas(tile, FOUND)


def calibrated(rows: DataFrame, postings: DataFrame, asked: DataFrame, model: Centroids, flat, k: int, aim: float) -> float:
    """The distance ratio within which the share `aim` of the true neighbours of sampled queries is listed."""
    some = asked.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(PROBE_QUERIES)
    truth = brute_force(some, rows, k).toPandas()
    if not len(truth):
        return math.inf
    wanted = asked.sparkSession.createDataFrame(pd.DataFrame({"vec_id": truth["vec_id"].unique()}), "vec_id bigint")
    home = postings.select("vec_id", "list").join(F.broadcast(wanted), "vec_id").toPandas().groupby("vec_id")["list"].agg(list)
    queries = some.toPandas().drop_duplicates("vec_id")
    dist = {i: np.sqrt(((model.points - q) ** 2).sum(1)) for i, q in zip(queries["vec_id"], flat(np.stack(queries["v"].to_list())))}
    need = [min(dist[q][c] for c in home[v]) / max(dist[q].min(), 1e-12) for q, v in zip(truth["query_id"], truth["vec_id"])]
    return float(np.quantile(need, aim)) + 1e-6
