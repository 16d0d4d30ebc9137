"""Queries over recurrences, spectra, user models and audio bytes."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import functions as F

from framewright.functions import scalars as S
from framewright.operators import decode as D, frames as FR, plugins as PL, retrieval as R, sequence as SQ, spectral as SP
from framewright.plans import views as V
from framewright.plans.on_frames import SEG, found_segments
from framewright.plans.on_metrics import ARGMAX, WEIGHTED
from framewright.plans.on_scalars import r6
from framewright.plans.on_vectors import centroids, ivf
from framewright.plans.registry import query
from framewright.session import cut, scratch
from framewright.sources import catalog, wav

c = F.col
KEY = ["sid"]


def big(name, alias=None):
    return c(name).cast("bigint").alias(alias or name)


def state_scores(spark, d):
    """Eight states along the value axis, scored by squared distance."""
    gap = F.expr("transform(sequence(0, 7), s -> x / 25D - s)")
    return V.series(spark, d).select("sid", "idx", SQ.c_library(gap, lambda v: pc.divide(pc.negate(pc.power(v, 2.0)), 2.0)).alias("lp"))


def paths_sql(lp: str, initial: str, weight: str, body: str, tables: str, **ctes: str) -> str:
    """SQL of best paths: `lp` gives (sid, region, idx, lp), `weight` the score of a step from i to j."""
    reach = "list_transform(range(8), lambda i: f.best[i + 1] + w[i * 8 + j + 1])"
    text = V.sql(
        tables,
        body,
        **ctes,
        lp=lp,
        w=f"SELECT list(w ORDER BY i, j) AS w FROM (SELECT i, j, {weight} AS w FROM range(8) a(i), range(8) b(j))",
        fw=f"""SELECT sid, region, idx, list_transform(lp, lambda v: v + {initial}) AS best, list_transform(range(8), lambda j: 0)
            AS back FROM lp WHERE idx = 0 UNION ALL SELECT e.sid, e.region, e.idx, list_transform(range(8), lambda j:
            list_max({reach}) + e.lp[j + 1]), list_transform(range(8), lambda j: list_position({reach}, list_max({reach})) - 1)
            FROM fw f JOIN lp e ON e.sid = f.sid AND e.region = f.region AND e.idx = f.idx + 1, w""",
        ends="SELECT sid, region, max(idx) AS idx FROM lp GROUP BY sid, region",
        bw="""SELECT sid, region, idx, list_position(best, list_max(best)) - 1 AS state, back FROM fw JOIN ends
            USING (sid, region, idx) UNION ALL SELECT f.sid, f.region, f.idx, b.back[b.state + 1], f.back FROM bw b JOIN fw f
            ON f.sid = b.sid AND f.region = b.region AND f.idx = b.idx - 1""",
    )
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "viterbi",
    paths_sql(
        "SELECT sid, 0 AS region, idx, list_transform(range(8), lambda s: -pow(x / 25.0 - s, 2) / 2.0) AS lp FROM series",
        "ln(1 / 8.0)",
        """ln(greatest(3 - abs(i - j), 0)::DOUBLE / sum(greatest(3 - abs(i - j), 0)) OVER (PARTITION BY i)
        + 2.2250738585072014e-308)""",
        "SELECT sid, idx, CAST(state AS BIGINT) AS state FROM bw",
        "series",
    ),
)
def viterbi(spark, d):
    return SQ.viterbi(state_scores(spark, d), KEY, "idx", "lp", SQ.band_matrix(8, 3), np.log(np.full(8, 1 / 8)))


@query(
    "trajectory_dp",
    paths_sql(
        """SELECT s.sid, seg_no AS region, idx - start AS idx, list_transform(range(8), lambda s:
        ln(exp(-pow(x / 25.0 - s, 2) / 2.0) + 1.1920928955078125e-07)) AS lp FROM series s JOIN sg ON sg.sid = s.sid
        AND idx >= start AND idx < "end\"""",
        "0.0",
        "ln(CASE WHEN abs(i - j) <= 1 THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END + 1.1920928955078125e-07)",
        """SELECT s.sid, s.idx, CAST(coalesce(state, -1) AS BIGINT) AS state FROM series s LEFT JOIN (SELECT bw.sid,
        bw.idx + start AS idx, state FROM bw JOIN sg ON bw.sid = sg.sid AND region = seg_no) p ON p.sid = s.sid AND p.idx = s.idx""",
        "series prob",
        **SEG,
    ),
)
def trajectory_dp(spark, d):
    grid = state_scores(spark, d).select("sid", "idx", SQ.c_library("lp", pc.exp).alias("z"))
    regions = found_segments(spark, d).select("sid", c("seg_no").alias("region"), "start", "end")
    return SQ.trajectory(grid, KEY, "idx", "z", 8, tol=1, regions=regions).select("sid", "idx", "state")


TRACKS = """SELECT g, g // 64 AS sid, 0 AS region, row_number() OVER (PARTITION BY g // 64 ORDER BY g) - 1 AS idx FROM
    (SELECT DISTINCT g FROM logits)"""


@query(
    "decoder_plugin",
    paths_sql(
        """SELECT sid, region, idx, list_transform(range(8), lambda s: coalesce(list_max(list_transform(held, lambda e:
        CASE WHEN e.c = s THEN e.z END)), '-inf'::DOUBLE)) AS lp FROM tr JOIN
        (SELECT g, list({'c': c, 'z': z}) AS held FROM logits GROUP BY g) USING (g)""",
        "ln(1 / 8.0)",
        """ln(greatest(3 - abs(i - j), 0)::DOUBLE / sum(greatest(3 - abs(i - j), 0)) OVER (PARTITION BY i)
        + 2.2250738585072014e-308)""",
        f"""SELECT 'weighted_argmax' AS decoder, g, hz FROM ({WEIGHTED}) UNION ALL SELECT 'argmax', g,
        round(10.0 * pow(2.0, (bin * 20.0 + 1997.3794084376191) / 1200.0), 6) FROM ({ARGMAX}) UNION ALL SELECT 'viterbi', g,
        round(10.0 * pow(2.0, (state * 20.0 + 1997.3794084376191) / 1200.0), 6) FROM bw JOIN tr USING (sid, region, idx)""",
        "logits",
        tr=TRACKS,
    ),
)
def decoder_plugin(spark, d):
    """All decoders; for the best path, 64 neighbouring groups make a track."""
    rows = V.logits(spark, d).withColumns({"track": F.expr("g div 64"), "at": F.expr("g % 64")})
    runs = [D.decode(rows, ["g"], "c", "z", n).select("g", "hz", F.lit(n).alias("decoder")) for n in ("argmax", "weighted_argmax")]
    path = D.decode(rows, ["track", "at"], "c", "z", "viterbi", states=8, width=3)
    runs.append(path.select(F.expr("track * 64 + at").alias("g"), "hz", F.lit("viterbi").alias("decoder")))
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).select("decoder", "g", r6("hz").alias("hz"))


@query(
    "inverse_preemphasis",
    V.sql(
        "series",
        """SELECT a.sid, a.idx, round(sum(b.x * pow(0.9701425001453319, a.idx - b.idx)), 6) AS y FROM series a JOIN series b
        ON a.sid = b.sid AND b.idx <= a.idx GROUP BY a.sid, a.idx""",
    ),
)
def inverse_preemphasis(spark, d):
    return SQ.inverse_preemphasis(V.series(spark, d), KEY, "idx", "x", 0.9701425001453319).select("sid", "idx", r6("y").alias("y"))


def frames32(spark, d):
    return FR.frame_arrays(FR.hop_frames(V.series(spark, d), KEY, "idx", "x", 32, 16), KEY)


F32 = """SELECT sid, frame, p + 16 - frame * 16 AS o, x FROM (SELECT p.sid, p.p, p.x, unnest(generate_series(greatest(
    CAST(ceil((p + 16 - 31) / 16.0) AS BIGINT), 0), least((p + 16) // 16, n // 16))) AS frame FROM
    (SELECT sid, idx AS p, x FROM series UNION ALL SELECT sid, unnest(generate_series(-16, -1)), 0.0 FROM len UNION ALL
    SELECT sid, unnest(generate_series(n, n + 15)), 0.0 FROM len) p JOIN len USING (sid))"""


@query(
    "period_cmndf",
    V.sql(
        "series",
        f"""SELECT sid, frame, k AS lag, round(d / (avg(d) OVER (PARTITION BY sid, frame ORDER BY k) + {FR.EPS!r}), 6) AS cmndf
        FROM (SELECT a.sid, a.frame, k, sum(pow(a.x - b.x, 2)) AS d FROM f32 a, generate_series(1, 12) AS t(k), f32 b
        WHERE a.sid = b.sid AND a.frame = b.frame AND b.o = a.o + k GROUP BY a.sid, a.frame, k)""",
        len="SELECT sid, count(*) AS n FROM series GROUP BY sid",
        f32=F32,
    ),
)
def period_cmndf(spark, d):
    out = frames32(spark, d).select("sid", "frame", F.posexplode(SQ.cmndf("f", 12)).alias("lag", "v"))
    return out.where("lag > 0").select("sid", "frame", big("lag"), r6("v").alias("cmndf"))


A_SQL = f"({FR.EPS!r} + (p + n - 2 * x) / 2)"
CMNDF_SQL = f"""SELECT sid, frame, k AS lag, {{}} AS x FROM (SELECT *, avg(d) OVER (PARTITION BY sid, frame ORDER BY k) + {FR.EPS!r}
    AS mean FROM (SELECT a.sid, a.frame, k, sum(pow(a.x - b.x, 2)) AS d FROM f32 a, generate_series(1, 12) AS t(k), f32 b
    WHERE a.sid = b.sid AND a.frame = b.frame AND b.o = a.o + k GROUP BY a.sid, a.frame, k))
    UNION ALL SELECT DISTINCT sid, frame, 0, 1.0 FROM f32"""
DIP = dict(
    len="SELECT sid, count(*) AS n FROM series GROUP BY sid",
    f32=F32,
    cm=CMNDF_SQL.format("round(d / mean, 9)"),
    nb="""SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM cm WINDOW w AS (PARTITION BY sid, frame ORDER BY lag)""",
    rg="SELECT *, x < p AND x < n AND x < 0.9 AS dip FROM nb WHERE lag >= 2 AND lag < 12",
    bs="SELECT sid, frame, min(lag) FILTER (WHERE dip) AS d, arg_min(lag, (x, lag)) AS m FROM rg GROUP BY sid, frame",
)


def period_dips(spark, d):
    """The first dip of the normalised difference of every frame, among lags 2 to 11."""
    lags = frames32(spark, d).select("sid", "frame", F.posexplode(SQ.cmndf("f", 12)).alias("lag", "v"))
    rows = lags.select("sid", "frame", big("lag"), F.round("v", 9).alias("v"))
    return FR.first_dip(rows, ["sid", "frame"], "lag", "v", 0.9, 2, 12)


@query(
    "period_estimate",
    V.sql(
        "series",
        f"""SELECT sid, frame, round(16000.0 / lag, 6) AS f0, round((avg(pow(x - moved, 2)) / 2)
        / ((avg(x * x) + avg(moved * moved)) / 2 + {FR.EPS!r}), 6) AS ap FROM (SELECT a.sid, a.frame, l.lag, a.x,
        (1 - (lag - floor(lag))) * b.x + (lag - floor(lag)) * e.x AS moved FROM f32 a JOIN l2 l USING (sid, frame)
        JOIN f32 b ON b.sid = a.sid AND b.frame = a.frame AND b.o = CASE WHEN a.o + floor(lag) < 32 THEN a.o + floor(lag)
        ELSE 63 - a.o - floor(lag) END JOIN f32 e ON e.sid = a.sid AND e.frame = a.frame AND e.o = CASE WHEN a.o + floor(lag) < 31
        THEN a.o + floor(lag) + 1 ELSE 62 - a.o - floor(lag) END) GROUP BY sid, frame, lag""",
        len=DIP["len"], f32=F32, cm=CMNDF_SQL.format("d / mean"), nb=DIP["nb"],
        b1="""SELECT sid, frame, coalesce(min(lag) FILTER (WHERE x < p AND x < n AND x < 0.15), -1) AS d, arg_min(lag, (x, lag)) AS m
            FROM nb WHERE lag >= 2 AND lag < 12 GROUP BY sid, frame""",
        l1=f"""SELECT sid, frame, d, CASE WHEN d < 0 THEN m ELSE d - ((n - p) / 2) / (2 * {A_SQL}) END AS lag,
            x - pow((n - p) / 2, 2) / (4 * {A_SQL}) AS depth FROM b1 JOIN nb USING (sid, frame)
            WHERE nb.lag = CASE WHEN d < 0 THEN m ELSE d END""",
        near="""SELECT *, greatest(round_even(lag * pow(2, -25 / 1200.0), 0), 2) AS lo,
            least(round_even(lag * pow(2, 25 / 1200.0), 0), 12) AS hi FROM l1""",
        n2="""SELECT *, lag(x) OVER w AS p, lead(x) OVER w AS n FROM (SELECT c.sid, c.frame, c.lag, lo, hi,
            CASE WHEN c.lag = d THEN depth ELSE x END AS x FROM cm c JOIN near USING (sid, frame))
            WINDOW w AS (PARTITION BY sid, frame ORDER BY lag)""",
        b2="""SELECT sid, frame, any_value(lo) AS lo, any_value(hi) AS hi, min(lag) FILTER (WHERE lag >= lo AND lag < hi AND x < p
            AND x < n) AS d, arg_min(lag, (x, lag)) FILTER (WHERE lag >= lo AND lag < hi) AS m FROM n2 GROUP BY sid, frame""",
        l2=f"""SELECT sid, frame, CASE WHEN b2.lo = b2.hi THEN b2.lo WHEN d IS NULL THEN m ELSE d - ((n - p) / 2) / (2 * {A_SQL}) END
            AS lag FROM b2 JOIN n2 USING (sid, frame) WHERE n2.lag = CASE WHEN b2.lo = b2.hi THEN b2.lo ELSE coalesce(d, m) END""",
    ),
)
def period_estimate(spark, d):
    found = SQ.period_estimate(frames32(spark, d), ["sid", "frame"], "f", 16000.0, 1400.0, 8000.0)
    return found.select("sid", "frame", r6("f0").alias("f0"), r6("ap").alias("ap"))


@query("local_minima", V.sql("series", "SELECT sid, frame, coalesce(d, m) AS lag, d IS NOT NULL AS dip FROM bs", **DIP))
def local_minima(spark, d):
    return period_dips(spark, d).select("sid", "frame", "lag", "dip")


@query(
    "parabolic_refine",
    V.sql(
        "series",
        f"""SELECT sid, frame, round(CASE WHEN d IS NULL THEN m ELSE d - ((n - p) / 2) / (2 * {A_SQL}) END, 6) AS vertex,
        round(CASE WHEN d IS NULL THEN x ELSE x - pow((n - p) / 2, 2) / (4 * {A_SQL}) END, 6) AS depth
        FROM bs JOIN nb USING (sid, frame) WHERE lag = coalesce(d, m)""",
        **DIP,
    ),
)
def parabolic_refine(spark, d):
    return period_dips(spark, d).select("sid", "frame", r6("vertex").alias("vertex"), r6("depth").alias("depth"))


SPEC = dict(
    len="SELECT sid, count(*) AS n FROM series GROUP BY sid",
    rp="""SELECT sid, idx + 6 AS p, x FROM series UNION ALL SELECT sid, 6 - idx, x FROM series WHERE idx BETWEEN 1 AND 6 UNION ALL
        SELECT sid, 2 * (n - 1) - idx + 6, x FROM series JOIN len USING (sid) WHERE idx BETWEEN n - 7 AND n - 2""",
    fr="""SELECT sid, frame, p - frame * 4 AS o, x FROM (SELECT rp.*, unnest(generate_series(greatest(CAST(ceil((p - 15) / 4.0)
        AS BIGINT), 0), least(p // 4, (n + 12 - 16) // 4))) AS frame FROM rp JOIN len USING (sid))""",
    sp="""SELECT sid, frame, k, sqrt(pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * o / 16)) * cos(2 * pi() * k * o / 16)), 2) +
        pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * o / 16)) * sin(2 * pi() * k * o / 16)), 2) + 1e-6) AS m
        FROM fr, generate_series(0, 8) AS t(k) GROUP BY sid, frame, k""",
)


@query("framed_spectrum", V.sql("series", "SELECT sid, frame, k AS bin, round(m, 6) AS mag FROM sp", **SPEC))
def framed_spectrum(spark, d):
    out = SP.spectrum(V.series(spark, d), KEY, "idx", "x", 16, 4)
    return out.select("sid", "frame", F.posexplode("mag").alias("bin", "m")).select("sid", "frame", big("bin"), r6("m").alias("mag"))


FILTERS = SP.mel_filters(16000.0, 16, 4, 0.0, 8000.0)
# the same filters from their definition: edges evenly spaced in mels, triangles of equal area
MEL = dict(
    edge="""SELECT i, CASE WHEN m < 15 THEN 200 * m / 3 ELSE 1000 * exp(ln(6.4) / 27 * (m - 15)) END AS hz
        FROM (SELECT i, i * (15 + ln(8) / (ln(6.4) / 27)) / 5 AS m FROM range(6) t(i))""",
    h="""SELECT CAST(a.i AS BIGINT) AS mel, k, greatest(0, least((k * 1000.0 - a.hz) / (b.hz - a.hz), (e.hz - k * 1000.0) / (e.hz - b.hz))) * 2 / (e.hz - a.hz) AS w
        FROM edge a JOIN edge b ON b.i = a.i + 1 JOIN edge e ON e.i = a.i + 2, range(9) t(k)""",
)


@query(
    "mel_project",
    V.sql(
        "series",
        """SELECT sid, frame, mel, round(ln(greatest(e, 1e-5)), 6) AS level, round((greatest(log10(greatest(e, 1e-10)),
        max(log10(greatest(e, 1e-10))) OVER (PARTITION BY sid) - 8) + 4) / 4, 6) AS scaled FROM (SELECT sid, frame, mel,
        sum(m * w) AS e FROM sp JOIN h USING (k) GROUP BY sid, frame, mel)""",
        **SPEC,
        **MEL,
    ),
)
def mel_project(spark, d):
    from framewright.operators.blocks import with_group

    spectra = SP.spectrum(V.series(spark, d), KEY, "idx", "x", 16, 4)
    mels = cut(SP.mel_project(spectra, ["sid", "frame"], "mag", FILTERS))
    long = with_group(mels, KEY, peak=F.max(F.array_max("mel"))).select("sid", "frame", "peak", F.posexplode("mel").alias("mel", "e"))
    return long.select(
        "sid", "frame", big("mel"), r6(S.compress_range(c("e"))).alias("level"), r6(S.log_floor_scale(c("e"), c("peak"))).alias("scaled")
    )


# decibels of the A curve at k kHz from its four poles, at least -80, less 20 for the reference level
A_WEIGHTS = """SELECT k, greatest(CASE WHEN k = 0 THEN -80 ELSE 2 + 20 * (log10(c0) + 2 * log10(s) - log10(s + c0) - log10(s + c1) - log10(s + c2) / 2 - log10(s + c3) / 2) END,
    -80) - 20 AS w FROM (SELECT k, pow(k * 1000.0, 2) AS s, pow(12194.217, 2) AS c0, pow(20.598997, 2) AS c1, pow(107.65265, 2) AS c2, pow(737.86223, 2) AS c3 FROM range(9) t(k))"""


@query(
    "a_weighted_loudness",
    V.sql(
        "series",
        """SELECT sid, frame, round(avg(greatest(greatest(db, top - 80) + w, -100)), 6) AS loudness FROM (SELECT *,
        max(db) OVER (PARTITION BY sid) AS top FROM (SELECT sid, frame, k, 20 * log10(greatest(sqrt(
        pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * o / 16)) * cos(2 * pi() * k * o / 16)), 2) +
        pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * o / 16)) * sin(2 * pi() * k * o / 16)), 2)), 1e-5)) AS db
        FROM fz, generate_series(0, 8) AS t(k) GROUP BY sid, frame, k)) JOIN h USING (k)
        GROUP BY sid, frame""",
        h=A_WEIGHTS,
        len="SELECT sid, count(*) AS n FROM series GROUP BY sid",
        fz="""SELECT sid, frame, idx + 8 - frame * 4 AS o, x FROM (SELECT s.*, unnest(generate_series(greatest(CAST(ceil(
            (idx + 8 - 15) / 4.0) AS BIGINT), 0), least((idx + 8) // 4, n // 4))) AS frame FROM series s JOIN len USING (sid))""",
    ),
)
def a_weighted_loudness(spark, d):
    out = SP.loudness(V.series(spark, d), KEY, "idx", "x", 16, 4, 16000.0)
    return out.select("sid", "frame", r6("loudness").alias("loudness"))


def projection():
    """A deterministic stand-in for a network: 64 inputs to 8 outputs."""
    weights = np.cos(np.arange(64)[:, None] * 8.0 + np.arange(8))

    def model(pdf):
        return pdf[["vec_id"]].assign(y=list(np.stack(pdf["v"]) @ weights))

    return model


@query(
    "batch_model_apply",
    V.sql("vlong", "SELECT vec_id, j, round(sum(c * cos(d * 8.0 + j)), 6) AS y FROM vlong, generate_series(0, 7) AS t(j) GROUP BY vec_id, j"),
)
def batch_model_apply(spark, d):
    out = PL.apply_model(V.vecs(spark, d).select("vec_id", "v"), projection, "vec_id bigint, y array<double>")
    return out.select("vec_id", F.posexplode("y").alias("j", "y")).select("vec_id", big("j"), r6("y").alias("y"))


@query(
    "transform_plugin",
    V.sql(
        "vecs",
        """SELECT 'identity' AS name, spk, count(*) AS n FROM vecs GROUP BY spk UNION ALL
        SELECT 'conditional', spk, CASE WHEN count(*) > 50 THEN 16 ELSE count(*) END FROM vecs GROUP BY spk""",
    ),
)
def transform_plugin(spark, d):
    runs = [
        PL.transform_vectors(V.vecs(spark, d), ["spk"], n, threshold=50, clusters=16, iterations=1).withColumn("name", F.lit(n))
        for n in ("identity", "conditional")
    ]
    return runs[0].unionByName(runs[1]).groupBy("name", "spk").agg(F.count(F.lit(1)).alias("n"))


@query(
    "frames_udtf",
    V.sql(
        "vlong",
        """SELECT vec_id, frame, d - frame * 8 AS "offset", round(c, 6) AS x FROM (SELECT vec_id, d, c, unnest(generate_series(
        greatest(CAST(ceil((d - 15) / 8.0) AS BIGINT), 0), least(d // 8, 6))) AS frame FROM vlong)""",
    ),
)
def frames_udtf(spark, d):
    spark.udtf.register("frames", PL.Frames)
    V.vecs(spark, d).createOrReplaceTempView("frame_source")
    return spark.sql("SELECT id AS vec_id, frame, offset, round(x, 6) AS x FROM frames(TABLE(SELECT vec_id AS id, v, 16 AS size, 8 AS hop FROM frame_source))")


@query(
    "pcm_ingest",
    V.sql(
        "series",
        """SELECT sid, idx, CAST(16000 AS BIGINT) AS rate, round(trunc(least(greatest((x / 50.0 - 1.0) * 32768.0, -32768.0),
        32767.0)) / 32768.0, 6) AS x FROM series""",
    ),
)
def pcm_ingest(spark, d):
    """Series written as WAV files of at most 480,000 samples and read back from them."""
    rows = wav.read_wavs(spark, written_wavs(spark, d))
    place = F.expr("CAST(utt AS BIGINT) * 480000 + idx")
    return rows.select(c("speaker").cast("bigint").alias("sid"), place.alias("idx"), big("rate"), r6(c("x").cast("double")).alias("x"))


def written_wavs(spark, d):
    """The corpus as files: a folder per series, a file per 480,000 samples."""
    root = scratch(spark, "wavs")
    levels = V.series(spark, d).select(
        c("sid").cast("string").alias("speaker"), F.expr("CAST(idx div 480000 AS STRING)").alias("utt"), F.expr("idx % 480000").alias("idx"),
        S.pcm16(c("x") / 50.0 - 1.0).alias("level"),
    )
    wav.write_wavs(levels, root, 16000)
    return root


@query("corpus_files", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS speaker, CAST(0 AS VARCHAR) AS utt FROM events")
def corpus_files(spark, d):
    """The catalogue of the files that `pcm_ingest` reads."""
    return catalog.scan_corpus(spark, written_wavs(spark, d)).select("speaker", "utt")


@query("index_sink_guard", ivf("SELECT CAST(cell AS INTEGER) AS spk, count(*) AS n FROM post GROUP BY cell", "post"))
def index_sink_guard(spark, d):
    """Save the index to the shared folder and count what is read back."""
    cents = centroids(spark, d)
    postings = R.assign_cells(V.vecs(spark, d), cents).withColumn("spk", c("cell").cast("int"))
    path = scratch(spark, "index")
    R.save_index(cents.withColumn("spk", c("cell").cast("int")), postings, path, ["spk"])
    return spark.read.parquet(f"{path}/postings").groupBy("spk").agg(F.count(F.lit(1)).alias("n"))
