"""Queries over embeddings, checkpoints and the inverted-file index."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import manifest as M, retrieval as R, vectors as X
from framewright.plans import views as V
from framewright.plans.on_scalars import r6
from framewright.plans.registry import query
from framewright.session import cut, scratch

c = F.col
LONG = "SELECT vec_id, spk, v, unnest(generate_series(0, len(v) - 1)) AS d, unnest(v) AS c FROM vecs"
MEANS = "SELECT spk, d, avg(c) AS m FROM vlong GROUP BY spk, d"
MEAN_ARR = "SELECT spk, list(m ORDER BY d) AS mv FROM means GROUP BY spk"


def big(name: str):
    return c(name).cast("bigint").alias(name)


def dist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def cos(a: str, b: str) -> str:
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


def centroids(spark, d):
    """One cell per speaker at the speaker's mean embedding."""
    return X.group_mean(V.vecs(spark, d), ["spk"], "v", "v").select(c("spk").cast("bigint").alias("cell"), "v")


def saved_index(spark, d):
    """The index over a folder's embeddings, partitioned by cell. The first query of a session builds and saves it, the others load it."""
    known = vars(saved_index).setdefault("paths", {})
    place = (spark.sparkContext.applicationId, d)
    if place not in known:
        path = scratch(spark, "index")
        cents = cut(centroids(spark, d))
        R.save_index(cents, R.assign_cells(V.vecs(spark, d), cents), path, [])
        known[place] = path
    cents, postings = R.load_index(spark, known[place], {})
    return postings, cents


def queries_of(spark, d):
    """Every embedding read back to front: vectors near the corpus but not in it."""
    return V.vecs(spark, d).select(c("vec_id").alias("q"), F.reverse("v").alias("v"))


IVF = dict(
    means=MEANS,
    cents="SELECT CAST(spk AS BIGINT) AS cell, list(m ORDER BY d) AS cv FROM means GROUP BY spk",
    post=f"""SELECT vec_id, v, arg_min(cell, (dd, cell)) AS cell, min(dd) AS d2 FROM
        (SELECT vec_id, v, cell, {dist('v', 'cv')} AS dd FROM vecs, cents) GROUP BY vec_id, v""",
    qs="SELECT vec_id AS q, list_reverse(v) AS qv FROM vecs",
    probes=f"""SELECT q, qv, arg_min(cell, (dd, cell)) AS cell FROM
        (SELECT q, qv, cell, {dist('qv', 'cv')} AS dd FROM qs, cents) GROUP BY q, qv""",
    near=f"""SELECT q, qv, vec_id, v, d2, row_number() OVER (PARTITION BY q ORDER BY d2, vec_id) AS rank FROM
        (SELECT q, qv, vec_id, v, {dist('qv', 'v')} AS d2 FROM probes JOIN post USING (cell))
        QUALIFY row_number() OVER (PARTITION BY q ORDER BY d2, vec_id) <= 3""",
    weighted="""SELECT *, CASE WHEN bool_or(d2 = 0) OVER (PARTITION BY q) THEN (d2 = 0)::INT::DOUBLE /
        sum((d2 = 0)::INT) OVER (PARTITION BY q) ELSE 1 / (d2 * d2) / sum(1 / (d2 * d2)) OVER (PARTITION BY q) END AS w
        FROM near""",
    mixed="""SELECT q, d, sum(w * x) AS nb FROM (SELECT q, w, unnest(generate_series(0, len(v) - 1)) AS d,
        unnest(v) AS x FROM weighted) GROUP BY q, d""",
)


def ivf(body: str, upto: str) -> str:
    names = list(IVF)
    return V.sql("vlong", body, **{n: IVF[n] for n in names[: names.index(upto) + 1]})


@query("speaker_mean", V.sql("vlong", "SELECT spk, d, round(avg(c), 6) AS mean FROM vlong GROUP BY spk, d"))
def speaker_mean(spark, d):
    return X.mean_long(V.vecs(spark, d), ["spk"], "v").select("spk", big("d"), r6("mean").alias("mean"))


@query(
    "speaker_rewrite",
    V.sql(
        "vlong",
        f"""SELECT vec_id, d, hit AS rewritten, round(CASE WHEN hit THEN mv[d + 1] ELSE c END, 6) AS c FROM vlong
        JOIN (SELECT vec_id, mv, {cos('v', 'mv')} > 0.1 AS hit FROM vecs JOIN marr USING (spk)) USING (vec_id)""",
        means=MEANS,
        marr=MEAN_ARR,
    ),
)
def speaker_rewrite(spark, d):
    v = V.vecs(spark, d)
    rewritten = M.rewrite_by_mean(v, X.group_mean(v, ["spk"], "v"), 0.1)
    return rewritten.select("vec_id", "rewritten", F.posexplode("v").alias("d", "c")).select(
        "vec_id", big("d"), "rewritten", r6("c").alias("c")
    )


MIX = {0: 0.5, 3: 0.3, 7: 0.4}


@query(
    "singer_mix",
    V.sql(
        "vlong",
        """SELECT d, round(sum(m * CASE spk WHEN 0 THEN 0.5 WHEN 3 THEN 0.3 ELSE 0.4 END), 6) AS c FROM means
        WHERE spk IN (0, 3, 7) GROUP BY d""",
        means=MEANS,
    ),
)
def singer_mix(spark, d):
    return M.mix_singers(X.mean_long(V.vecs(spark, d), ["spk"], "v"), MIX).select(big("d"), r6("c").alias("c"))


KLONG = "SELECT model, key, unnest(generate_series(0, len(w) - 1)) AS pos, unnest(w) AS w FROM ckpt"


@query(
    "checkpoint_average",
    V.sql(
        "ckpt",
        """SELECT key, pos, round(sum(w) / 2.0, 6) AS w FROM k WHERE key IN (SELECT key FROM ckpt WHERE model = 0)
        GROUP BY key, pos""",
        k=KLONG,
    ),
)
def checkpoint_average(spark, d):
    out = M.average_checkpoints(V.ckpt(spark, d), first=0, models=2)
    return out.select("key", big("pos"), r6("w").alias("w"))


@query(
    "checkpoint_merge",
    V.sql(
        "ckpt",
        """SELECT a.key, a.pos, round(0.3 * a.w + 0.7 * b.w, 6) AS w FROM k a JOIN k b USING (key, pos)
        WHERE a.model = 0 AND b.model = 1""",
        k=KLONG,
    ),
)
def checkpoint_merge(spark, d):
    ck = V.ckpt(spark, d)
    merged = M.merge_checkpoints(ck.where("model = 0"), ck.where("model = 1"), 0.3)
    return merged.select("key", F.posexplode("w").alias("pos", "w")).select("key", big("pos"), r6("w").alias("w"))


@query(
    "checkpoint_overlay",
    V.sql(
        "vecs",
        """SELECT vec_id AS key, s.doc_id IS NULL AS absent, round(CASE WHEN s.doc_id IS NULL THEN list_sum(v)
        ELSE 2 * list_sum(v) END, 6) AS total FROM vecs LEFT JOIN labels s ON vec_id = s.doc_id""",
    ),
)
def checkpoint_overlay(spark, d):
    model = V.vecs(spark, d).select(c("vec_id").alias("key"), c("v").alias("w"))
    kept = V.table(spark, d, "labels").select(c("doc_id").alias("key"))
    saved = model.join(kept, "key", "left_semi").select("key", F.expr("transform(w, t -> 2 * t)").alias("w"))
    over = M.overlay_checkpoint(model, saved)
    return over.select("key", "absent", r6(F.expr("aggregate(w, 0D, (s, t) -> s + t)")).alias("total"))


@query(
    "cosine",
    V.sql(
        "vlong",
        f"SELECT vec_id, round({cos('v', 'mv')}, 6) AS cos FROM vecs JOIN marr USING (spk)",
        means=MEANS,
        marr=MEAN_ARR,
    ),
)
def cosine(spark, d):
    v = V.vecs(spark, d)
    return v.join(X.group_mean(v, ["spk"], "v"), "spk").select("vec_id", r6(X.cosine("v", "mean")).alias("cos"))


@query(
    "l2_normalise",
    V.sql("vlong", f"SELECT vec_id, d, round(3 * c / greatest(3 * sqrt({dot('v', 'v')}), 1e-12), 6) AS c FROM ({LONG})"),
)
def l2_normalise(spark, d):
    scaled = V.vecs(spark, d).select("vec_id", F.expr("transform(v, t -> 3 * t)").alias("v"))
    out = scaled.select("vec_id", F.posexplode(X.l2_normalise("v")).alias("d", "c"))
    return out.select("vec_id", big("d"), r6("c").alias("c"))


@query(
    "cosine_embedding_loss",
    V.sql(
        "vlong",
        f"""SELECT spk, count(*) AS n, round(avg(1 - {cos('v', 'mv')}), 6) AS loss FROM vecs JOIN marr USING (spk)
        GROUP BY spk""",
        means=MEANS,
        marr=MEAN_ARR,
    ),
)
def cosine_embedding_loss(spark, d):
    v = V.vecs(spark, d)
    pairs = v.join(X.group_mean(v, ["spk"], "v"), "spk")
    return pairs.groupBy("spk").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(1 - X.cosine("v", "mean"))).alias("loss")
    )


@query(
    "scalar_fit_stats",
    V.sql("vlong", "SELECT d, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std FROM vlong GROUP BY d"),
)
def scalar_fit_stats(spark, d):
    stats = X.dimension_stats(V.vlong(spark, d))
    return stats.select(big("d"), r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "feature_matrix",
    V.sql(
        "vlong",
        """SELECT spk, count(DISTINCT vec_id) AS rows, CAST(max(d) + 1 AS BIGINT) AS width, count(*) AS cells,
        round(sum(c), 6) AS total FROM vlong GROUP BY spk""",
    ),
)
def feature_matrix(spark, d):
    per_vector = V.vecs(spark, d).selectExpr("spk", "size(v) AS w", "aggregate(v, 0D, (s, t) -> s + t) AS t")
    return per_vector.groupBy("spk").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("w").cast("bigint").alias("width"),
        F.sum("w").alias("cells"),
        r6(F.sum("t")).alias("total"),
    )


@query("speaker_list", V.sql("vecs", "SELECT DISTINCT spk FROM vecs"))
def speaker_list(spark, d):
    from framewright.sources.catalog import speaker_list as listing

    return listing(V.vecs(spark, d))


@query(
    "singer_mode_join",
    V.sql(
        "vlong",
        """SELECT vec_id, 'utterance' AS mode, d, round(c, 6) AS c FROM vlong UNION ALL
        SELECT vec_id, 'singer', d, round(m, 6) FROM vecs JOIN means USING (spk)""",
        means=MEANS,
    ),
)
def singer_mode_join(spark, d):
    v = V.vecs(spark, d)
    mean = X.group_mean(v, ["spk"], "v", "v")
    own = M.with_timbre(v.select("vec_id", "spk"), v, by_singer=False)
    singer = M.with_timbre(v.select("vec_id", "spk"), mean, by_singer=True)
    both = own.withColumn("mode", F.lit("utterance")).unionByName(singer.withColumn("mode", F.lit("singer")))
    return both.select("vec_id", "mode", F.posexplode("v").alias("d", "c")).select("vec_id", "mode", big("d"), r6("c").alias("c"))


@query(
    "soft_codes",
    V.sql(
        "vlong",
        f"""SELECT vec_id AS q, arg_max(cell, (z, -cell)) AS code, round(max(z), 6) AS logit,
        round(exp(max(z)) / sum(exp(z)), 6) AS prob
        FROM (SELECT vec_id, cell, {cos('v', 'cv')} / 0.1 AS z FROM vecs, cents) GROUP BY vec_id""",
        means=MEANS,
        cents=IVF["cents"],
    ),
)
def soft_codes(spark, d):
    frames = V.vecs(spark, d).select(c("vec_id").alias("q"), "v")
    out = R.soft_codes(frames, centroids(spark, d).select(c("cell").alias("code"), "v"))
    return out.select("q", "code", r6("logit").alias("logit"), r6("prob").alias("prob"))


@query("ivf_assign", ivf("SELECT vec_id, cell, round(d2, 6) AS d2 FROM post", "post"))
def ivf_assign(spark, d):
    return R.assign_cells(V.vecs(spark, d), centroids(spark, d)).select("vec_id", "cell", r6("d2").alias("d2"))


@query(
    "knn_exact",
    V.sql(
        "vecs",
        f"""SELECT q, vec_id, round(d2, 6) AS d2, row_number() OVER (PARTITION BY q ORDER BY d2, vec_id) AS rank
        FROM (SELECT a.vec_id AS q, b.vec_id, {dist('a.v', 'b.v')} AS d2 FROM vecs a, vecs b)
        QUALIFY row_number() OVER (PARTITION BY q ORDER BY d2, vec_id) <= 3""",
    ),
)
def knn_exact(spark, d):
    v = V.vecs(spark, d)
    near = R.nearest(v.select(c("vec_id").alias("q"), "v"), v, 3)
    return near.select("q", "vec_id", r6("d2").alias("d2"), big("rank"))


@query("knn_ivf", ivf("SELECT q, vec_id, round(d2, 6) AS d2, rank FROM near", "near"))
def knn_ivf(spark, d):
    near = R.knn_ivf(queries_of(spark, d), *saved_index(spark, d), 3)
    return near.select("q", "vec_id", r6("d2").alias("d2"), big("rank"))


@query("inverse_square_weights", ivf("SELECT q, d, round(nb, 6) AS c FROM mixed", "mixed"))
def inverse_square_weights(spark, d):
    near = R.knn_ivf(queries_of(spark, d), *saved_index(spark, d), 3, carry="base")
    mixed = R.weighted_neighbour(R.inverse_square_weights(near))
    return mixed.select("q", F.posexplode("neighbour").alias("d", "c")).select("q", big("d"), r6("c").alias("c"))


@query(
    "retrieval_blend",
    ivf(
        """SELECT q, d, round(coalesce(0.5 * qv[d + 1] + 0.5 * nb, qv[d + 1]), 6) AS c
        FROM (SELECT q, qv, unnest(generate_series(0, len(qv) - 1)) AS d FROM qs) LEFT JOIN mixed USING (q, d)""",
        "mixed",
    ),
)
def retrieval_blend(spark, d):
    out = R.retrieval_blend(queries_of(spark, d), *saved_index(spark, d))
    return out.select("q", F.posexplode("v").alias("d", "c")).select("q", big("d"), r6("c").alias("c"))


@query(
    "even_batches",
    V.sql(
        "vecs",
        """SELECT vec_id, spk, CASE WHEN p < r * (w + 1) THEN p // (w + 1) ELSE r + (p - r * (w + 1)) // w END AS batch
        FROM (SELECT vec_id, spk, p, n // k AS w, n % k AS r FROM (SELECT *, CAST(ceil(n / 8) AS BIGINT) AS k FROM
        (SELECT vec_id, spk, row_number() OVER (PARTITION BY spk ORDER BY vec_id) - 1 AS p,
        count(*) OVER (PARTITION BY spk) AS n FROM vecs)))""",
    ),
)
def even_batches(spark, d):
    return M.even_batches(V.vecs(spark, d).select("vec_id", "spk"), ["spk"], "vec_id", 8).select("vec_id", "spk", "batch")


def kmeans_ctes(src: str, k: str, keys: str, rounds: int) -> dict[str, str]:
    """k-means unrolled: `src` has keys, vec_id, v; `k` is an expression over the group's size n."""
    ctes = dict(
        src=src,
        c0=f"""SELECT {keys}, cell, v AS cv FROM (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY
            md5('0|' || vec_id), vec_id) - 1 AS cell, count(*) OVER (PARTITION BY {keys}) AS n FROM src) WHERE cell < {k}""",
    )
    for r in range(rounds + 1):
        ctes[f"a{r}"] = f"""SELECT {keys}, vec_id, v, arg_min(cell, (dd, cell)) AS cell, min(dd) AS d2 FROM (SELECT {keys}, vec_id, v,
            cell, {dist('v', 'cv')} AS dd FROM src JOIN c{r} USING ({keys})) GROUP BY {keys}, vec_id, v"""
        ctes[f"m{r}"] = f"""SELECT {keys}, cell, list(m ORDER BY d) AS mv FROM (SELECT {keys}, cell, d, avg(x) AS m FROM (SELECT {keys},
            cell, unnest(generate_series(0, len(v) - 1)) AS d, unnest(v) AS x FROM a{r}) GROUP BY {keys}, cell, d)
            GROUP BY {keys}, cell"""
        ctes[f"c{r + 1}"] = f"SELECT {keys}, cell, coalesce(mv, cv) AS cv FROM c{r} LEFT JOIN m{r} USING ({keys}, cell)"
    return ctes


CELLS = "greatest(least(CAST(floor(16 * sqrt(n)) AS BIGINT), n // 39), 1)"


@query(
    "compress_conditional",
    V.sql(
        "vecs",
        """SELECT spk, vec_id, CAST(d AS BIGINT) AS d, round(c, 6) AS c FROM (SELECT spk, vec_id, unnest(generate_series(0, len(v) - 1))
        AS d, unnest(v) AS c FROM (SELECT spk, vec_id, v FROM small UNION ALL SELECT spk, cell, cv FROM c3))""",
        sized="SELECT *, count(*) OVER (PARTITION BY spk) AS n FROM vecs",
        small="SELECT spk, vec_id, v FROM sized WHERE n <= 50",
        **kmeans_ctes("SELECT spk, vec_id, v FROM sized WHERE n > 50", "16", "spk", 3),
    ),
)
def compress_conditional(spark, d):
    out = R.compress(V.vecs(spark, d), ["spk"], threshold=50, clusters=16, iterations=3, seeding="sample")
    return out.select("spk", "vec_id", F.posexplode("v").alias("d", "c")).select("spk", "vec_id", big("d"), r6("c").alias("c"))


@query(
    "ivf_train",
    V.sql(
        "vecs",
        """SELECT cell, CAST(d AS BIGINT) AS d, round(c, 6) AS c FROM (SELECT cell, unnest(generate_series(0, len(cv) - 1)) AS d,
        unnest(cv) AS c FROM c3)""",
        **kmeans_ctes("SELECT 'hubert' AS feature, vec_id, v FROM vecs", CELLS, "feature", 3),
    ),
)
def ivf_train(spark, d):
    from framewright.functions.scalars import ivf_cells

    v = V.vecs(spark, d).withColumn("feature", F.lit("hubert"))
    sizes = v.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    cents = R.kmeans(v, sizes.select("feature", ivf_cells("n").alias("k")), ["feature"], iterations=3, seeding="sample")
    return cents.select("cell", F.posexplode("v").alias("d", "c")).select("cell", big("d"), r6("c").alias("c"))


@query(
    "index_build_all",
    V.sql(
        "vecs",
        "SELECT spk, feature, vec_id, cell, round(d2, 6) AS d2 FROM a3",
        **kmeans_ctes(
            "SELECT spk, 'hubert' AS feature, vec_id, v FROM vecs UNION ALL SELECT spk, 'whisper', vec_id, list_reverse(v) FROM vecs",
            CELLS, "spk, feature", 3,
        ),
    ),
)
def index_build_all(spark, d):
    """Both features of every speaker in one grouped build: the embedding as it is and back to front."""
    v = V.vecs(spark, d)
    features = v.withColumn("feature", F.lit("hubert")).unionByName(
        v.withColumn("v", F.reverse("v")).withColumn("feature", F.lit("whisper"))
    )
    _, postings = R.build_index(features, ["spk", "feature"], iterations=3, seeding="sample")
    return postings.select("spk", "feature", "vec_id", "cell", r6("d2").alias("d2"))


def spread_ctes(k: int, rounds: int, iterations: int) -> dict[str, str]:
    """k-means|| unrolled over `src` (spk, vec_id, v): drawn candidates, their weights, the picks, and the rounds of means."""
    ctes = dict(src="SELECT spk, vec_id, v FROM vecs", s0="SELECT spk, arg_min(vec_id, (md5('0|' || vec_id), vec_id)) AS cell FROM src GROUP BY spk")
    for r in range(rounds + 1):
        ctes[f"n{r}"] = f"""SELECT spk, a.vec_id, arg_min(cell, (dd, cell)) AS cell, min(dd) AS d2 FROM (SELECT a.spk, a.vec_id, s.cell, {dist('a.v', 'b.v')} AS dd
            FROM src a JOIN s{r} s USING (spk) JOIN src b ON b.spk = a.spk AND b.vec_id = s.cell) a GROUP BY spk, a.vec_id"""
        ctes[f"s{r + 1}"] = f"""SELECT spk, cell FROM s{r} UNION SELECT spk, vec_id FROM (SELECT *, sum(d2) OVER (PARTITION BY spk) AS cost FROM n{r})
            WHERE d2 > 0 AND {V.uniform_sql(f"'0r{r}|' || vec_id")} * cost < {k} * d2"""
    ctes["wt"] = f"SELECT spk, cell, v, w FROM (SELECT spk, cell, count(*) AS w FROM n{rounds} GROUP BY spk, cell) JOIN (SELECT spk, vec_id AS cell, v FROM src) USING (spk, cell)"
    pick = "(PARTITION BY spk ORDER BY w * least DESC, cell)"
    ctes["gr"] = f"""SELECT spk, cell, v, w, {dist('v', 'pv')} AS least, 0 AS step, pick FROM (SELECT *, first_value(v) OVER o AS pv, first_value(cell) OVER o AS pick
        FROM wt WINDOW o AS (PARTITION BY spk ORDER BY w DESC, cell)) UNION ALL SELECT spk, cell, v, w, least(least, {dist('v', 'pv')}), step + 1, pick FROM
        (SELECT spk, cell, v, w, least, step, first_value(v) OVER {pick} AS pv, first_value(cell) OVER {pick} AS pick FROM gr WHERE step < {k - 1})"""
    ctes["c0"] = "SELECT spk, step AS cell, v AS cv FROM (SELECT DISTINCT spk, step, pick FROM gr) JOIN (SELECT spk, vec_id AS pick, v FROM src) USING (spk, pick)"
    return ctes | {n: q for n, q in kmeans_ctes("", "0", "spk", iterations).items() if n not in ("src", "c0")}


@query(
    "kmeans_spread",
    V.sql(
        "vecs",
        """SELECT spk, CAST(cell AS BIGINT) AS cell, CAST(d AS BIGINT) AS d, round(c, 6) AS c FROM (SELECT spk, cell, unnest(generate_series(0, len(cv) - 1)) AS d,
        unnest(cv) AS c FROM c2)""",
        **spread_ctes(4, 4, 2),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def kmeans_spread(spark, d):
    """Four cells per speaker, seeded by oversampling."""
    v = V.vecs(spark, d)
    cents = R.kmeans(v, v.select("spk").distinct().withColumn("k", F.lit(4)), ["spk"], iterations=2)
    return cents.select("spk", "cell", F.posexplode("v").alias("d", "c")).select("spk", "cell", big("d"), r6("c").alias("c"))
