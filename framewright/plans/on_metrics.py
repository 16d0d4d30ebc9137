"""Queries over metrics, logs and decoded scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions.pitch import nearest_bin
from framewright.operators import decode as D, frames as FR, metrics as M
from framewright.operators.blocks import framed
from framewright.plans import views as V
from framewright.plans.on_scalars import r6
from framewright.plans.registry import query

c = F.col


@query(
    "voiced_stats",
    V.sql(
        "pitch0",
        """SELECT sid, round(avg(f0) FILTER (WHERE f0 > 0), 6) AS mean, round(min(f0) FILTER (WHERE f0 > 0), 6) AS low,
        round(max(f0) FILTER (WHERE f0 > 0), 6) AS high FROM pitch0 GROUP BY sid""",
    ),
)
def voiced_stats(spark, d):
    s = M.voiced_stats(V.pitch_samples(spark, d), ["sid"], "f0")
    return s.select("sid", *[r6(n).alias(n) for n in ("mean", "low", "high")])


@query(
    "mel_l1",
    V.sql(
        "spec",
        """SELECT count(*) AS items, round(avg(s / n), 4) AS mean_of_means, round(sum(s) / sum(n), 4) AS mean FROM
        (SELECT g, sum(abs(r - f)) AS s, count(*) AS n FROM spec GROUP BY g)""",
    ),
)
def mel_l1(spark, d):
    out = M.l1_summary(V.spec(spark, d), ["g"], "r", "f")
    return out.select("items", F.round("mean_of_means", 4).alias("mean_of_means"), F.round("mean", 4).alias("mean"))


@query("spectral_convergence", V.sql("spec", "SELECT g, round(sqrt(sum(pow(r - f, 2))) / sqrt(sum(r * r)), 6) AS sc FROM spec GROUP BY g"))
def spectral_convergence(spark, d):
    return V.spec(spark, d).groupBy("g").agg(r6(M.spectral_convergence(c("r"), c("f"))).alias("sc"))


@query(
    "log_mag_l1",
    V.sql("spec", "SELECT g, round(avg(abs(ln(greatest(r, sqrt(1e-7))) - ln(greatest(f, sqrt(1e-7))))), 6) AS mag FROM spec GROUP BY g"),
)
def log_mag_l1(spark, d):
    return V.spec(spark, d).groupBy("g").agg(r6(M.log_magnitude_l1(c("r"), c("f"))).alias("mag"))


@query(
    "multi_resolution",
    V.sql(
        "series",
        """SELECT sid, round(avg(sc), 6) AS sc, round(avg(mag), 6) AS mag FROM (SELECT sid, size,
        sqrt(sum(pow(r - f, 2))) / sqrt(sum(r * r)) AS sc, avg(abs(ln(r) - ln(f))) AS mag FROM (SELECT sid, size,
        sqrt(greatest(sum(x * x), 1e-7)) AS r, sqrt(greatest(sum(y * y), 1e-7)) AS f FROM (SELECT sid, idx, x,
        coalesce(lag(x) OVER (PARTITION BY sid ORDER BY idx), 0) AS y FROM series), (VALUES (4), (8), (16)) AS t(size)
        GROUP BY sid, size, idx // size) GROUP BY sid, size) GROUP BY sid""",
    ),
)
def multi_resolution(spark, d):
    pairs = FR.delay(V.series(spark, d), ["sid"], "idx", "x")
    out = M.multi_resolution(pairs, ["sid"], "idx", "x", "y", [4, 8, 16])
    return out.select("sid", r6("sc").alias("sc"), r6("mag").alias("mag"))


POINT = """(l_discount - l_tax - 0.5 + 0.5 * pow(l_quantity / 10.0 - l_extendedprice / 100000.0, 2) * exp(-2.0 * l_discount))
    * CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE 1.0 END"""


@query(
    "masked_kl",
    f"""SELECT l_suppkey, round((sum({POINT}) - sum(l_tax)) / sum(CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE 1.0 END), 6) AS kl,
    round(sum({POINT}) / sum(CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE 1.0 END), 6) AS kl_back FROM lineitem GROUP BY l_suppkey""",
)
def masked_kl(spark, d):
    mask = F.when(c("l_returnflag") == "N", 0.0).otherwise(1.0)
    args = (c("l_quantity") / 10.0, c("l_tax"), c("l_extendedprice") / 100000.0, c("l_discount"), mask)
    return V.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        r6(M.masked_kl(*args, c("l_tax"))).alias("kl"), r6(M.masked_kl(*args)).alias("kl_back")
    )


@query(
    "gaussian_kl",
    """SELECT o_orderstatus, round((lq - lp) - 0.5 + 0.5 * (exp(2 * lp) + pow(mp - mq, 2)) * exp(-2 * lq), 6) AS kl FROM
    (SELECT o_orderstatus, avg(o_totalprice) AS mp, ln(stddev_pop(o_totalprice)) AS lp FROM orders GROUP BY o_orderstatus),
    (SELECT avg(o_totalprice) AS mq, ln(stddev_pop(o_totalprice)) AS lq FROM orders)""",
)
def gaussian_kl(spark, d):
    return M.drift_from_all(V.table(spark, d, "orders"), "o_orderstatus", "o_totalprice").select("o_orderstatus", r6("kl").alias("kl"))


@query(
    "attentive_stats",
    V.sql(
        "samples",
        """SELECT sid, round(mu, 6) AS mean, round(sqrt(greatest(sq - mu * mu, 1e-5)), 6) AS std FROM (SELECT sid,
        sum(e * x) / sum(e) AS mu, sum(e * x * x) / sum(e) AS sq FROM (SELECT sid, x,
        exp(x / 10.0 - max(x / 10.0) OVER (PARTITION BY sid)) AS e FROM samples) GROUP BY sid)""",
    ),
)
def attentive_stats(spark, d):
    out = M.attentive_stats(V.samples(spark, d), ["sid"], "x", c("x") / 10.0)
    return out.select("sid", r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "multi_crop_mean",
    V.sql(
        "series",
        """SELECT sid, round(avg(a / l), 6) AS mean, round(avg(b / l), 6) AS low, round(avg(h / l), 6) AS high FROM
        (SELECT *, greatest(sqrt(a * a + b * b + h * h), 1e-12) AS l FROM (SELECT sid, j, avg(x) AS a, min(x) AS b, max(x) AS h
        FROM (SELECT *, least(8, n) AS w FROM (SELECT *, count(*) OVER (PARTITION BY sid) AS n FROM series)),
        generate_series(0, 3) AS t(j) WHERE idx >= floor(j * ((n - w) / 3.0)) AND idx < floor(j * ((n - w) / 3.0)) + w
        GROUP BY sid, j)) GROUP BY sid""",
    ),
)
def multi_crop_mean(spark, d):
    pools = {"mean": F.avg("x"), "low": F.min("x"), "high": F.max("x")}
    out = M.multi_crop_mean(V.series(spark, d), ["sid"], "idx", pools, 8, 4)
    return out.select("sid", *[r6(n).alias(n) for n in pools])


@query(
    "log_unpivot",
    V.sql(
        "log",
        """SELECT step // 10 AS step, tag, round(avg(val), 6) AS val FROM log WHERE (step // 10) % 5 = 0 GROUP BY step // 10, tag""",
    ),
)
def log_unpivot(spark, d):
    wide = V.log(spark, d).groupBy(F.expr("step div 10").alias("step")).pivot("tag").agg(F.avg("val"))
    return M.log_rows(wide, "step", 5).select("step", "tag", r6("val").alias("val"))


@query(
    "param_histogram",
    V.sql(
        "log",
        """SELECT tag, CAST(least(floor((val - lo) * 32.0 / (hi - lo)), 31) AS BIGINT) AS bin, count(*) AS n FROM
        (SELECT tag, val, min(val) OVER (PARTITION BY tag) AS lo, max(val) OVER (PARTITION BY tag) AS hi FROM log)
        GROUP BY ALL""",
    ),
)
def param_histogram(spark, d):
    return M.histogram(V.log(spark, d), ["tag"], "val", 32)


POWER = """SELECT l_orderkey AS t, CAST(floor(12.0 * log2(l_extendedprice / 100.0 / 55.0) + 0.5) AS BIGINT) AS bin,
    sum(l_quantity * l_quantity) AS power FROM lineitem WHERE l_extendedprice / 100.0 >= 55.0
    AND l_extendedprice / 100.0 < 1760.0 GROUP BY ALL"""


def binned(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        c("l_orderkey").alias("t"), (c("l_extendedprice") / 100.0).alias("hz"), (c("l_quantity") * c("l_quantity")).alias("p")
    )
    return M.log_bin_power(rows, ["t"], "hz", "p", 100.0, 55.0, 1760.0)


@query("log_bin_power", POWER)
def log_bin_power(spark, d):
    return binned(spark, d)


WEIGHTS = M.harmonic_weights(100.0, 3, 0.8, 5)
HARMONICS = """SELECT CAST(round(log2(k + 1) * 12) AS BIGINT) + o AS o, sum(pow(0.8, k) * pow(cos(o * pi() / 4), 2)) AS w
    FROM range(3) a(k), range(-1, 2) b(o) GROUP BY ALL"""


@query(
    "harmonic_sum",
    V.sql(
        "",
        "SELECT t, bin - o AS bin, round(sum(power * w), 6) AS salience FROM power, h WHERE bin - o BETWEEN 0 AND 60 GROUP BY t, bin - o",
        power=POWER,
        h=HARMONICS,
    ),
)
def harmonic_sum(spark, d):
    out = M.harmonic_sum(binned(spark, d), ["t"], WEIGHTS, M.bin_count(100.0, 55.0, 1760.0))
    return out.select("t", "bin", r6("salience").alias("salience"))


CUT = lambda x: f"""CASE WHEN 20 * log10({x} / max({x}) OVER (PARTITION BY clip) + 1.1920928955078125e-07) < -3 THEN sqrt({x})
    ELSE 0 END"""


@query(
    "salience_levels",
    V.sql(
        "",
        f"""SELECT clip, t, bin, round({CUT('v')}, 6) AS salience FROM (SELECT clip, t, bin - o AS bin, sum(p * w) AS v FROM
        (SELECT t // 64 AS clip, t, bin, {CUT('power')} AS p FROM (SELECT t // 64 AS clip, * FROM power)), h
        WHERE bin - o BETWEEN 0 AND 60 GROUP BY clip, t, bin - o)""",
        power=POWER,
        h=HARMONICS,
    ),
)
def salience_levels(spark, d):
    """Harmonic sum with the power and threshold steps before and after it."""
    spectrum = binned(spark, d).withColumn("clip", F.expr("t div 64"))
    out = M.salience(spectrum, ["clip"], ["t"], WEIGHTS, M.bin_count(100.0, 55.0, 1760.0), 0.5, -3.0)
    return out.select("clip", "t", "bin", r6("salience").alias("salience"))


@query(
    "retention_latest_n",
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_orderpriority <> '1-URGENT') WHERE r > 2""",
)
def retention_latest_n(spark, d):
    rows = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    gone = M.retention(rows, ["o_custkey"], "o_orderkey", newest, 2, c("o_orderpriority") == "1-URGENT")
    return gone.select("o_custkey", "o_orderkey")


ARGMAX = "SELECT g, CAST(arg_max(c, (z, -c)) AS INTEGER) AS bin, max(z) AS periodicity FROM logits GROUP BY g"


@query("argmax_decode", V.sql("logits", ARGMAX))
def argmax_decode(spark, d):
    return D.argmax(V.logits(spark, d), ["g"], "c", "z")


@query(
    "freq_range_mask",
    V.sql("logits", ARGMAX.replace("FROM logits", "FROM logits WHERE c >= 2 AND c < 6")),
)
def freq_range_mask(spark, d):
    return D.argmax(D.in_range(V.logits(spark, d), "c", 32.5, 33.8), ["g"], "c", "z")


@query(
    "group_softmax",
    V.sql(
        "logits",
        """SELECT g, c, round(exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY g), 6) AS p,
        round(z - m - ln(sum(exp(z - m)) OVER (PARTITION BY g)), 6) AS logp
        FROM (SELECT *, max(z) OVER (PARTITION BY g) AS m FROM logits)""",
    ),
)
def group_softmax(spark, d):
    return D.softmax(V.logits(spark, d), ["g"], "z").select("g", "c", r6("p").alias("p"), r6("logp").alias("logp"))


@query(
    "label_top_n",
    V.sql(
        "logits",
        """SELECT g, c, round(p, 2) AS p, rank FROM (SELECT g, c, exp(z) / sum(exp(z)) OVER (PARTITION BY g) AS p,
        row_number() OVER (PARTITION BY g ORDER BY z DESC, c) AS rank FROM logits WHERE c IN (1, 2, 3, 5, 7)) WHERE rank <= 2""",
    ),
)
def label_top_n(spark, d):
    return D.top_labels(V.logits(spark, d), ["g"], "c", "z", 2, [1, 2, 3, 5, 7])


RANKED = """SELECT conv_id, turn, lp / n AS a, lp / pow((5.0 + n) / 6.0, 0.6) AS b, lp / (n + 1) AS avg FROM
    (SELECT conv_id, turn, -0.05::DOUBLE * length(text) AS lp, len(string_split(text, ' ')) AS n FROM conversations)"""


@query(
    "length_penalised_best",
    V.sql(
        "",
        """SELECT 'plain' AS rule, conv_id, arg_max(turn, (a, -turn)) AS turn, round(max(a), 6) AS score,
        round(arg_max(avg, (a, -turn)), 6) AS avg_logprob FROM ranked GROUP BY conv_id UNION ALL
        SELECT 'penalty', conv_id, arg_max(turn, (b, -turn)), round(max(b), 6), round(arg_max(avg, (b, -turn)), 6)
        FROM ranked GROUP BY conv_id""",
        ranked=RANKED,
    ),
)
def length_penalised_best(spark, d):
    rows = V.table(spark, d, "conversations").select(
        "conv_id", "turn", (-0.05 * F.length("text")).alias("lp"), F.size(F.split("text", " ")).alias("n")
    )
    pick = lambda name, alpha: D.ranked_best(rows, ["conv_id"], "turn", "lp", "n", alpha).select(
        F.lit(name).alias("rule"), "conv_id", "turn", r6("score").alias("score"), r6("avg_logprob").alias("avg_logprob")
    )
    return pick("plain", None).unionByName(pick("penalty", 0.6))


WEIGHTED = """SELECT g, round(10.0 * pow(2.0, sum(w * (c * 20.0 + 1997.3794084376191)) / sum(w) / 1200.0), 6) AS hz,
    any_value(b) AS bin FROM (SELECT g, c, b, 1 / (1 + exp(-z)) AS w FROM logits JOIN (SELECT g, arg_max(c, (z, -c)) AS b
    FROM logits GROUP BY g) USING (g) WHERE abs(c - b) <= 4) GROUP BY g"""


@query("weighted_argmax", V.sql("logits", WEIGHTED))
def weighted_argmax(spark, d):
    return D.weighted_argmax(V.logits(spark, d), ["g"], "c", "z").select("g", "bin", r6("hz").alias("hz"))


@query(
    "temperature_sample",
    V.sql(
        "logits",
        f"""SELECT g, arg_max(c, (z / 2.0 - ln(-ln({V.uniform_sql("'17|' || g || '|' || c")} * 0.99998 + 1e-5)), -c)) AS c,
        arg_max(c, (z, -c)) AS cold FROM logits GROUP BY g""",
    ),
)
def temperature_sample(spark, d):
    rows = V.logits(spark, d)
    cold = D.temperature_sample(rows, ["g"], "c", "z", 0, 17).withColumnRenamed("c", "cold")
    return D.temperature_sample(rows, ["g"], "c", "z", 2.0, 17).join(cold, "g")


TRIANGLE = [1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9]


@query(
    "transition_matrices",
    V.sql(
        "pitch",
        """SELECT sid, idx, i, j, round(greatest(3 - abs(i - j), 0) / list_sum(list_transform(range(8),
        lambda t: greatest(3 - abs(i - t), 0))), 6) AS band, CASE WHEN abs(i - j) <= 1 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END
        AS tol, round(CASE WHEN vi <> vj THEN CASE WHEN i = j THEN 0.01::DOUBLE ELSE 0 END
        WHEN abs(i - j) > 2 OR (i < 2 AND j = i + 2) THEN 0
        ELSE 0.99::DOUBLE * (3 - abs(i - j)) / CASE i WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 6 THEN 8 WHEN 7 THEN 6 ELSE 9 END END, 6)
        AS voicing FROM (SELECT sid, idx, j, vj, lag(j) OVER w AS i, lag(vj) OVER w AS vi FROM (SELECT sid, idx, f0 > 0 AS vj,
        CASE WHEN f0 > 0 THEN CAST(least(greatest(round_even(log2(nullif(f0, 0) / 50.0) * 3.0, 0), 0), 7) AS BIGINT) ELSE 0 END
        AS j FROM pitch) WINDOW w AS (PARTITION BY sid ORDER BY idx)) WHERE i IS NOT NULL""",
    ),
)
def transition_matrices(spark, d):
    """The weight each transition matrix gives to every step between consecutive frames of every track."""
    state = F.coalesce(nearest_bin(c("f0"), 400.0, 50.0, 8), F.lit(0))
    steps = framed(
        V.pitch(spark, d).select("sid", "idx", state.alias("j"), (c("f0") > 0).alias("vj")), ["sid"], "idx", 1, 0,
        lambda w: {"i": F.lag("j").over(w), "vi": F.lag("vj").over(w)},
    ).where("i IS NOT NULL")
    return steps.select(
        "sid", "idx", "i", "j",
        r6(D.triangular_transition(c("i"), c("j"), 8, 3)).alias("band"),
        r6(D.voicing_transition(c("i"), c("vi"), c("j"), c("vj"), 8, TRIANGLE)).alias("voicing"),
        D.tolerance_transition(c("i"), c("j"), 1).alias("tol"),
    )
