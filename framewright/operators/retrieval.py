"""Nearest neighbours, inverted files and k-means over vectors grouped by any keys.

Scoring is cut into tiles: a block of queries against a block of base vectors of the same group, each a bounded
matrix product. A group of any size becomes many tiles on many tasks, and a tile emits only its k best per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from framewright.functions.noise import digest, uniform
from framewright.operators.blocks import hashed_ordinal, join_on
from framewright.operators.vectors import blend
from framewright.session import cut

TILE = 2048
#: Times that the rows of two equal sides are sent at most, while blocks of so many bytes of vectors allow it.
SPREAD, BLOCK_BYTES = 8, 32 << 20
#: Scores that are held at a time.
SCORES = 1 << 21
#: Centroids of at most so many bytes, as measured, are broadcast; more meet the vectors in tiles.
BROADCAST_BYTES = 32 << 20
#: So many probed cells at most are named in a filter on the postings; with more, nearly all are read anyway.
PRUNED_CELLS = 10_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def _arrays(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(offsets, rows.ravel())


def _tiles(queries: DataFrame, base: DataFrame, keys: list[str], q: str, b: str, tile: int, v: str = "v"):
    """Both sides with block numbers; every query block meets every base block of its group exactly once.

    A row is sent once per block of the other side. Blocks have `tile` rows while they are few; where rows would be sent more than
    `SPREAD` times as often as there are rows on both sides, blocks grow instead, up to `BLOCK_BYTES`.
    """
    rows, fit = F.count(F.lit(1)), F.expr(f"ceil(count(1) * 8 * coalesce(max(size(`{v}`)), 0) / {BLOCK_BYTES})")
    sized = lambda df, out: df.agg(F.struct(rows.alias("n"), fit.alias("fit")).alias(out))
    number = lambda own, other: F.expr(
        f"CAST(greatest(least(ceil({own}.n / {tile}), ceil({SPREAD} * greatest({own}.n / greatest({other}.n, 1), 1))), {own}.fit, 1) AS BIGINT)"
    )
    if keys:
        sizes = sized(queries.groupBy(*keys), "_sq").join(sized(base.groupBy(*keys), "_sb"), keys)
        meet = lambda df: df.join(sizes, keys)
    else:
        sq, sb = sized(queries, "_sq").scalar(), sized(base, "_sb").scalar()
        meet = lambda df: df.withColumn("_sq", sq).withColumn("_sb", sb)
    attach = lambda df: meet(df).withColumn("_nq", number("_sq", "_sb")).withColumn("_nb", number("_sb", "_sq")).drop("_sq", "_sb")
    left = attach(queries).select(
        *queries.columns,
        F.expr(f"pmod(xxhash64({q}), _nq)").alias("_qb"),
        F.explode(F.expr("sequence(0L, _nb - 1)")).alias("_vb"),
    )
    right = attach(base).select(
        *[F.col(n).alias(n) for n in base.columns],
        F.explode(F.expr("sequence(0L, _nq - 1)")).alias("_qb"),
        F.expr(f"pmod(xxhash64({b}), _nb)").alias("_vb"),
    )
    return left, right


def _closest(rows: np.ndarray, base: np.ndarray, ids: np.ndarray, base_sq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in `base`, squared distance) of the k nearest of each row, nearest first, ties to the lower id."""
    rough = (rows**2).sum(1)[:, None] + base_sq - 2.0 * (rows @ base.T)
    kth = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
    slack = 1e-9 * (1.0 + (rows**2).sum(1) + base_sq.max())
    qi, bi = np.nonzero(rough <= (kth + slack)[:, None])
    exact = ((rows[qi] - base[bi]) ** 2).sum(1)
    order = np.lexsort((ids[bi], exact, qi))
    qi, bi, exact = qi[order], bi[order], exact[order]
    first = np.searchsorted(qi, np.arange(len(rows)))
    keep = np.arange(len(qi)) - first[qi] < k
    return qi[keep], bi[keep], exact[keep]


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    keys: list[str] | None = None,
    q: str = "q",
    b: str = "vec_id",
    v: str = "v",
    carry: str | None = None,
    tile: int = TILE,
    per: list[str] | None = None,
) -> DataFrame:
    """The k nearest base vectors of each query by squared L2 within the same group, ties to the lower id.

    Columns: keys, q, b, d2, rank (from 1). `carry` adds the vector of the "base" or the "query" row as `v`.
    Exact: there is no candidate limit, every pair of a group is scored in one of its tiles. `per` names the keys that
    identify a query together with `q`, if they are fewer than `keys`.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    keys = keys or []
    left, right = _tiles(queries.select(*keys, q, v), base.select(*keys, b, v), keys, q, b, tile, v)
    group = [*keys, "_qb", "_vb"]
    fields = [f for f in queries.schema.fields if f.name in keys]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{q}` bigint", f"`{b}` bigint", "d2 double"]
    )
    if carry:
        schema += f", `{v}` array<double>"
    held = SCORES

    def score(qs: pa.Table, bs: pa.Table) -> pa.Table:
        if qs.num_rows == 0 or bs.num_rows == 0:
            return pa.table({})
        base_rows, base_ids = _matrix(bs[v]), bs[b].to_numpy()
        base_sq = (base_rows**2).sum(1)
        picked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        all_queries = _matrix(qs[v])
        step = max(1, min(256, held // len(base_rows)))
        for start in range(0, len(all_queries), step):
            qi, bi, exact = _closest(all_queries[start : start + step], base_rows, base_ids, base_sq, k)
            picked.append((qi + start, bi, exact))
        qi, bi, exact = (np.concatenate(p) for p in zip(*picked))
        out = {key: pa.chunked_array([qs[key].combine_chunks().take(pa.array(qi))]) for key in keys}
        out[q] = pa.array(qs[q].to_numpy()[qi].astype(np.int64))
        out[b] = pa.array(base_ids[bi].astype(np.int64))
        out["d2"] = pa.array(exact)
        if carry:
            out[v] = _arrays(base_rows[bi] if carry == "base" else all_queries[qi])
        return pa.table(out)

    scored = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(score, schema)
    best = W.partitionBy(*(keys if per is None else per), q).orderBy("d2", b)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def soft_codes(queries: DataFrame, codes: DataFrame, temperature: float = 0.1, tile: int = TILE) -> DataFrame:
    """Best code of each query and its softmax probability, from cosine / temperature against every code.

    Columns: q, code, logit, prob. Each tile adds up its exponentials relative to its own best logit, and the tiles of a
    query are put together relative to the best of all, so that no temperature overflows.
    """
    left, right = _tiles(queries.select("q", "v"), codes.select("code", "v"), [], "q", "code", tile)
    held = SCORES

    def score(qs: pa.Table, cs: pa.Table) -> pa.Table:
        if qs.num_rows == 0 or cs.num_rows == 0:
            return pa.table({})
        order = np.argsort(cs["code"].to_numpy())
        ids, c = cs["code"].to_numpy()[order], _matrix(cs["v"])[order]
        m = _matrix(qs["v"])
        m, c = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (m, c))
        top, best, total = np.empty(len(m), np.int64), np.empty(len(m)), np.empty(len(m))
        step = max(1, held // len(c))
        for start in range(0, len(m), step):
            part = slice(start, start + step)
            logits = (m[part] @ c.T) / temperature
            top[part], best[part] = logits.argmax(1), logits.max(1)
            total[part] = np.exp(logits - best[part, None]).sum(1)
        return pa.table(
            {
                "q": pa.array(qs["q"].to_numpy().astype(np.int64)),
                "code": pa.array(ids[top].astype(np.int64)),
                "logit": pa.array(best),
                "total": pa.array(total),
            }
        )

    scored = left.groupBy("_qb", "_vb").cogroup(right.groupBy("_qb", "_vb")).applyInArrow(
        score, "q bigint, code bigint, logit double, total double"
    )
    shifted = scored.withColumn("_top", F.max("logit").over(W.partitionBy("q")))
    return shifted.groupBy("q").agg(
        F.expr("max_by(code, struct(logit, -code))").alias("code"),
        F.max("logit").alias("logit"),
        (1.0 / F.sum(F.col("total") * F.exp(F.col("logit") - F.col("_top")))).alias("prob"),
    )


def assign_cells(vectors: DataFrame, centroids: DataFrame, keys: list[str] | None = None, vec: str = "vec_id") -> DataFrame:
    """Postings: each vector with its nearest centroid. `centroids` has keys, cell, v."""
    near = nearest(vectors, centroids, 1, keys, q=vec, b="cell", carry="query")
    return near.select(*(keys or []), vec, "cell", "d2", "v")


def knn_ivf(
    queries: DataFrame, postings: DataFrame, centroids: DataFrame, k: int, keys: list[str] | None = None, carry=None
) -> DataFrame:
    """k nearest vectors inside the one cell closest to each query.

    The queries with their cell are written once, as both their number per cell and their vectors are needed. Only the cells that some query
    probes are read from `postings`; where these are partitioned by cell, the others' files are not touched. Ids are ranked
    first: with `carry` "base", the vectors of the k best are fetched by id afterwards.
    """
    keys = keys or []
    probes = cut(nearest(queries, centroids, 1, keys, b="cell", carry="query").select(*keys, "cell", "q", "v"))
    probed = [r["cell"] for r in probes.select("cell").distinct().limit(PRUNED_CELLS + 1).collect()]
    if len(probed) <= PRUNED_CELLS:
        postings = postings.where(F.col("cell").isin(probed))
    near = nearest(probes, postings, k, [*keys, "cell"], per=keys, carry="query" if carry == "query" else None)
    if carry != "base":
        return near
    return join_on(near, postings.select(*keys, "cell", "vec_id", "v"), [*keys, "cell", "vec_id"])


def inverse_square_weights(neighbours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds `w`: (1/d2)² normalised per query. An exact match shares all the weight among the exact matches."""
    query = W.partitionBy(*(keys or []), "q")
    raw = F.when(F.col("d2") == 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), F.col("d2") * F.col("d2")))
    exact = F.max(F.when(F.col("d2") == 0, 1).otherwise(0)).over(query) == 1
    weighted = neighbours.withColumn("_e", exact).withColumn(
        "_w", F.when(F.col("_e") & (F.col("d2") > 0), F.lit(0.0)).otherwise(raw)
    )
    return weighted.withColumn("w", F.col("_w") / F.sum("_w").over(query)).drop("_e", "_w")


def weighted_neighbour(weighted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per query: the weighted sum `neighbour` of its k neighbours' vectors.

    The neighbours of a query already lie together after ranking, so nothing is shuffled here.
    """
    packed = weighted.groupBy(*(keys or []), "q").agg(F.array_sort(F.collect_list(F.struct("rank", "w", "v"))).alias("_p"))
    total = """aggregate(_p, transform(_p[0].v, t -> 0D), (acc, e) -> zip_with(acc, e.v, (a, t) -> a + e.w * t))"""
    return packed.select(*(keys or []), "q", F.expr(total).alias("neighbour"))


def retrieval_blend(
    queries: DataFrame,
    postings: DataFrame,
    centroids: DataFrame,
    ratio: float = 0.5,
    k: int = 3,
    keys: list[str] | None = None,
    enabled: bool = True,
) -> DataFrame:
    """keys, q, v: `(1 - ratio) · query + ratio · neighbour`; a pass-through when disabled or nothing was found."""
    keys = keys or []
    mixed = blend("v", "neighbour", ratio)
    own = queries.select(*keys, "q", "v")
    if not enabled:
        return own
    found = knn_ivf(queries, postings, centroids, k, keys, carry="base")
    near = weighted_neighbour(inverse_square_weights(found, keys), keys)
    return own.join(near, [*keys, "q"], "left").select(*keys, "q", F.coalesce(mixed, "v").alias("v"))


def _held(centroids: DataFrame, keys: list[str]) -> dict | None:
    """Per group (cells, vectors, squared lengths), if they take no more than BROADCAST_BYTES; `centroids` is a written table."""
    rows, longest = centroids.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if rows * (longest or 0) * 8 > BROADCAST_BYTES:
        return None
    groups: dict[tuple, list] = {}
    for r in centroids.select(*keys, "cell", "v").collect():
        groups.setdefault(tuple(r[: len(keys)]), []).append((r["cell"], r["v"]))
    found = {}
    for key, held in groups.items():
        m = np.array([v for _, v in held], np.float64)
        found[key] = (np.array([c for c, _ in held], np.int64), m, (m**2).sum(1))
    return found


def _beside(vectors: DataFrame, keys: list[str], held: dict) -> Callable[[pa.RecordBatch], Iterator[tuple]]:
    """Function over batches of (keys, vec_id, v): (key, rows, their cells, squared distances, vectors) of every group in a batch."""
    known = vectors.sparkSession.sparkContext.broadcast(held)

    def cells(batch: pa.RecordBatch) -> Iterator[tuple]:
        table = pa.Table.from_batches([batch])
        names = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))])) if keys else [()] * batch.num_rows
        rows_of: dict[tuple, list[int]] = {}
        for i, name in enumerate(names):
            rows_of.setdefault(name, []).append(i)
        matrix = _matrix(table["v"])
        for name, rows in rows_of.items():
            if name not in known.value:
                continue
            ids, base, base_sq = known.value[name]
            rows = np.array(rows)
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                qi, bi, exact = _closest(matrix[part], base, ids, base_sq, 1)
                yield name, part[qi], ids[bi], exact, matrix[part[qi]]

    return cells


def cell_distances(vectors: DataFrame, centroids: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vec_id, cell, d2: the nearest centroid of every vector of a group that has centroids. `centroids` is a written table."""
    rows = vectors.select(*keys, "vec_id", "v")
    held = _held(centroids, keys)
    if held is None:
        return nearest(rows, centroids, 1, keys, q="vec_id", b="cell").select(*keys, "vec_id", "cell", "d2")
    cells, ddl = _beside(vectors, keys, held), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, cell, d2, _ in cells(batch):
                own = [batch.column(n).take(pa.array(at)) for n in range(len(keys) + 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(cell), pa.array(d2)], names=[*keys, "vec_id", "cell", "d2"])

    return rows.mapInArrow(run, f"{ddl}, cell bigint, d2 double")


def cell_means(vectors: DataFrame, centroids: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cell, m: the mean of the vectors nearest to each centroid that has any.

    Every task adds its vectors up by cell; one shuffle brings the sums of a cell, one array per task, together.
    """
    rows = vectors.select(*keys, "vec_id", "v")
    ddl = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{ddl + ', ' if keys else ''}cell bigint, n bigint, s array<double>"
    held = _held(centroids, keys)
    if held is None:
        rows = nearest(rows, centroids, 1, keys, q="vec_id", b="cell", carry="query").select(*keys, "vec_id", "v", "cell")
        found = lambda batch: _by_cell(batch, keys)
    else:
        found = _beside(vectors, keys, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        kinds: list[pa.DataType] = []

        def flush() -> pa.RecordBatch:
            names, totals = list(sums), list(sums.values())
            columns = [pa.array([n[i] for n in names], kinds[i]) for i in range(len(keys))]
            columns += [pa.array([n[-1] for n in names], pa.int64()), pa.array([t[0] for t in totals], pa.int64())]
            columns.append(_arrays(np.array([t[1] for t in totals])))
            sums.clear()
            return pa.RecordBatch.from_arrays(columns, names=[*keys, "cell", "n", "s"])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(keys))]
            for name, _, cell, _, matrix in found(batch):
                distinct, place = np.unique(cell, return_inverse=True)
                part = np.zeros((len(distinct), matrix.shape[1]))
                np.add.at(part, place, matrix)
                for c, n, s in zip(distinct.tolist(), np.bincount(place).tolist(), part):
                    if (*name, c) in sums:
                        held_sum = sums[(*name, c)]
                        held_sum[0] += n
                        held_sum[1] += s
                    else:
                        sums[(*name, c)] = [n, s.copy()]
                if sums and len(sums) * matrix.shape[1] * 8 > 2 * BROADCAST_BYTES:
                    yield flush()
        if sums:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        mean = _matrix(table["s"]).sum(0) / sum(table["n"].to_pylist())
        return table.slice(0, 1).select([*keys, "cell"]).append_column("m", _arrays(mean[None, :]))

    partial = rows.mapInArrow(run, schema)
    return partial.groupBy(*keys, "cell").applyInArrow(add, f"{ddl + ', ' if keys else ''}cell bigint, m array<double>")


def _by_cell(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple]:
    """Rows that know their cell, in the form that `_beside` gives them."""
    matrix = _matrix(pa.Table.from_batches([batch])["v"])
    cell = batch.column(len(keys) + 2).to_numpy(zero_copy_only=False)
    names = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))])) if keys else [()] * batch.num_rows
    rows_of: dict[tuple, list[int]] = {}
    for i, name in enumerate(names):
        rows_of.setdefault(name, []).append(i)
    for name, rows in rows_of.items():
        at = np.array(rows)
        yield name, at, cell[at], None, matrix[at]


def sampled_seeds(vectors: DataFrame, counts: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """As many rows of each group as `counts` asks for, by the order of a digest of their id."""
    ranked = hashed_ordinal(
        vectors.select(*keys, "vec_id", "v").withColumn("_h", digest(seed, "vec_id")), keys, "_h", "vec_id", "cell"
    )
    return ranked.join(counts, keys).where(F.col("cell") < F.col("k")).select(*keys, "cell", "v")


def spread_seeds(vectors: DataFrame, counts: DataFrame, keys: list[str], seed: int, rounds: int = 4, factor: float = 1.0) -> DataFrame:
    """Centroids (keys, cell, v) far apart, by oversampling (k-means||).

    Each round draws every vector with probability `factor` · k · d2 / (sum of d2 in its group), d2 being its squared distance to
    the candidates so far, so it adds some `factor` · k of them in one pass; rounds go on while a group has fewer than k. The
    candidates, a few k per group, are weighted by how many vectors are nearest to them, and k of them are picked
    one after the other: the heaviest, then each time the one of largest weight times squared distance to those picked. A
    group with fewer than k distinct vectors gets one cell for each.
    """
    rows = vectors.select(*keys, "vec_id", "v")
    first = F.min_by(F.struct("vec_id", "v"), F.struct(digest(seed, "vec_id"), F.col("vec_id")))
    found = cut(rows.groupBy(*keys).agg(first.alias("c")).select(*keys, F.col("c.vec_id").alias("cell"), "c.v"))
    turn = 0
    while True:
        near = cut(cell_distances(rows, found, keys))
        if turn >= rounds:
            have = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
            left = near.where("d2 > 0").select(*keys).distinct()
            wanting = join_on(join_on(counts, have, keys), left, keys, "left_semi") if keys else counts.crossJoin(have).where(F.lit(not left.isEmpty()))
            if wanting.where("_have < k").isEmpty():
                break
        cost = near.groupBy(*keys).agg(F.sum("d2").alias("_cost"))
        drawn = join_on(join_on(near, cost, keys), counts, keys).where(
            (F.col("d2") > 0) & (uniform(f"{seed}r{turn}", "vec_id") * F.col("_cost") < factor * F.col("k") * F.col("d2"))
        )
        more = rows.join(drawn.select(*keys, "vec_id"), [*keys, "vec_id"], "left_semi").select(*keys, F.col("vec_id").alias("cell"), "v")
        found = cut(found.unionByName(more).dropDuplicates([*keys, "cell"]))
        turn += 1
    weights = near.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("w"))
    weighed = join_on(join_on(found, weights, [*keys, "cell"]), counts, keys)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "cell"], ascending=[False, True], ignore_index=True)
        m, w, ids = np.stack([np.asarray(v, np.float64) for v in pdf["v"]]), pdf["w"].to_numpy(np.float64), pdf["cell"].to_numpy()
        picked, least = [0], ((m - m[0]) ** 2).sum(1)
        while len(picked) < int(pdf["k"].iloc[0]):
            worth = w * least
            best = np.flatnonzero(worth == worth.max())
            at = int(best[np.argmin(ids[best])])
            if not worth[at] > 0:
                break
            picked.append(at)
            least = np.minimum(least, ((m - m[at]) ** 2).sum(1))
        return pdf.iloc[picked][[*keys, "v"]].assign(cell=np.arange(len(picked)))[[*keys, "cell", "v"]]

    ddl = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return weighed.groupBy(*keys).applyInPandas(pick, f"{ddl}cell bigint, v array<double>")


SEEDS = {"spread": spread_seeds, "sample": sampled_seeds}


def kmeans(
    vectors: DataFrame, counts: DataFrame, keys: list[str], iterations: int = 10, seed: int = 0, seeding: str = "spread", tolerance: float = 0.0, **options
) -> DataFrame:
    """Centroids (keys, cell, v) of every group at once.

    `counts` gives the number of cells `k` of each group. `seeding` is "spread" (k-means||, with its options) or "sample" (a seeded random choice
    of rows). A round assigns every vector and takes the means: vectors meet broadcast centroids where they are, or tiles
    of centroids beyond a measured size, and one shuffle of sums per cell and task follows. It ends after `iterations` rounds, or
    when no centroid moves by a squared distance of more than `tolerance`. A cell that loses all its vectors keeps its place.
    """
    centroids = cut(SEEDS[seeding](vectors, counts, keys, seed, **options))
    for _ in range(iterations):
        moved = join_on(centroids, cell_means(vectors, centroids, keys), [*keys, "cell"], "left")
        step = F.expr("aggregate(zip_with(m, v, (a, b) -> (a - b) * (a - b)), 0D, (s, t) -> s + t)")
        stored = cut(moved.select(*keys, "cell", F.coalesce("m", "v").alias("v"), F.coalesce(step, F.lit(0.0)).alias("_step")))
        centroids = stored.drop("_step")
        if (stored.agg(F.max("_step")).first()[0] or 0.0) <= tolerance:
            break
    return centroids


def compress(vectors: DataFrame, keys: list[str], threshold: int = 200_000, clusters: int = 10_000, **options) -> DataFrame:
    """Groups above `threshold` vectors are replaced by `clusters` centroids; the others pass through."""
    sizes = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = vectors.join(sizes.where(F.col("_n") > threshold), keys, "left_semi")
    small = vectors.join(sizes.where(F.col("_n") <= threshold), keys, "left_semi").select(*keys, "vec_id", "v")
    counts = sizes.where(F.col("_n") > threshold).select(*keys, F.lit(clusters).alias("k"))
    centroids = kmeans(big, counts, keys, **options)
    return small.unionByName(centroids.select(*keys, F.col("cell").alias("vec_id"), "v"))


def build_index(vectors: DataFrame, keys: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """Centroids and postings of every group, the number of cells following the group's size."""
    from framewright.functions.scalars import ivf_cells

    sizes = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    centroids = kmeans(vectors, sizes.select(*keys, ivf_cells("_n").alias("k")), keys, **options)
    return centroids, assign_cells(vectors, centroids, keys)


def save_index(centroids: DataFrame, postings: DataFrame, path: str, keys: list[str], rewrite: bool = False) -> None:
    """Write both tables partitioned by group, and the postings by cell within it. An existing index is an error unless `rewrite`.

    Centroids come last: an index whose saving failed has none, cannot be loaded, and is saved again with `rewrite`.
    """
    if not rewrite:  # an existing index fails here, before any row is written
        centroids.limit(0).write.mode("errorifexists").partitionBy(*keys).parquet(f"{path}/centroids")
    spread = postings.repartition(*keys, "cell") if keys else postings.repartition("cell")
    spread.write.mode("overwrite").partitionBy(*keys, "cell").parquet(f"{path}/postings")
    centroids.write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/centroids")


def load_index(spark: SparkSession, path: str, keys: dict[str, str], where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Centroids and postings of a saved index. `keys` are its group columns and their types.

    `where` is a condition on the group columns, such as one speaker, some features or a prefix; only the folders
    of groups that meet it are read.
    """

    def part(name: str) -> DataFrame:
        columns = spark.read.parquet(f"{path}/{name}").schema
        kinds = keys | {"cell": "bigint"}
        ddl = ", ".join(f"`{c.name}` {kinds.get(c.name, c.dataType.simpleString())}" for c in columns)
        found = spark.read.schema(ddl).parquet(f"{path}/{name}")
        return found if where is None else found.where(where)

    return part("centroids"), part("postings")
