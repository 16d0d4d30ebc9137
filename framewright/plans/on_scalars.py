"""Queries over single rows: pitch units, levels, coding, text functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewright.functions import noise, pitch as P, scalars as S, text as X
from framewright.operators.blocks import with_group
from framewright.plans import views as V
from framewright.plans.registry import query

c = F.col


def r6(column):
    return F.round(column, 6)


LOW_MEL = "1127.0 * ln(1.0 + 50.0 / 700.0)"
HIGH_MEL = "1127.0 * ln(1.0 + 1100.0 / 700.0)"


@query(
    "f0_coarse",
    V.sql(
        "pitch0",
        f"""SELECT event_id, f0, CAST(floor(least(greatest(CASE WHEN mel > 0 THEN
        (mel - {LOW_MEL}) * 254 / ({HIGH_MEL} - {LOW_MEL}) + 1.0 ELSE mel END, 1.0), 255.0) + 0.5) AS BIGINT) AS code
        FROM (SELECT event_id, f0, 1127.0 * ln(1.0 + f0 / 700.0) AS mel FROM pitch0)""",
    ),
)
def f0_coarse(spark, d):
    return V.pitch_samples(spark, d).select("event_id", "f0", P.coarse(c("f0")).alias("code"))


@query(
    "hz_cents",
    V.sql(
        "pitch0",
        """SELECT event_id, round(1200 * log2(nullif(f0, 0) / 10.0), 6) AS cents,
        round(10.0 * pow(2.0, 1200 * log2(nullif(f0, 0) / 10.0) / 1200), 6) AS hz FROM pitch0""",
    ),
)
def hz_cents(spark, d):
    cents = P.hz_to_cents(c("f0"))
    return V.pitch_samples(spark, d).select("event_id", r6(cents).alias("cents"), r6(P.cents_to_hz(cents)).alias("hz"))


@query(
    "hz_cents_ref",
    V.sql(
        "pitch0",
        """SELECT event_id, round(1200 * log2(nullif(f0, 0) / 55.0), 6) AS cents,
        round(coalesce(55.0 * pow(2.0, 1200 * log2(nullif(f0, 0) / 55.0) / 1200), 0), 6) AS hz FROM pitch0""",
    ),
)
def hz_cents_ref(spark, d):
    cents = P.hz_to_cents(c("f0"), 55.0)
    back = F.coalesce(P.cents_to_hz(cents, 55.0), F.lit(0.0))
    return V.pitch_samples(spark, d).select("event_id", r6(cents).alias("cents"), r6(back).alias("hz"))


@query(
    "cents_bins",
    V.sql(
        "pitch0",
        """SELECT event_id, CAST(floor(p + 1e-9) AS BIGINT) AS bin_floor, CAST(ceil(p - 1e-9) AS BIGINT) AS bin_ceil,
        round(floor(p + 1e-9) * 20.0 + 1997.3794084376191, 6) AS cents FROM (SELECT event_id,
        (1200 * log2(nullif(f0, 0) / 10.0) - 1997.3794084376191) / 20.0 AS p FROM pitch0)""",
    ),
)
def cents_bins(spark, d):
    cents = P.hz_to_cents(c("f0"))
    low = P.cents_to_bin(cents)
    return V.pitch_samples(spark, d).select(
        "event_id",
        low.alias("bin_floor"),
        P.cents_to_bin(cents, up=True).alias("bin_ceil"),
        r6(P.bin_to_cents(low)).alias("cents"),
    )


@query(
    "dither",
    V.sql(
        "pitch0",
        f"""SELECT event_id, round(1200 * log2(nullif(f0, 0) / 10.0) + 20.0 * ({V.uniform_sql("'dithera|' || event_id")}
        + {V.uniform_sql("'ditherb|' || event_id")} - 1.0), 6) AS cents FROM pitch0""",
    ),
)
def dither(spark, d):
    noisy = P.hz_to_cents(c("f0")) + noise.triangular("dither", "event_id", half_width=20.0)
    return V.pitch_samples(spark, d).select("event_id", r6(noisy).alias("cents"))


@query("semitone_shift", V.sql("pitch0", "SELECT event_id, round(f0 * pow(2.0, 3 / 12.0), 6) AS f0 FROM pitch0"))
def semitone_shift(spark, d):
    return V.pitch_samples(spark, d).select("event_id", r6(P.semitones(c("f0"), 3)).alias("f0"))


@query(
    "erb_scale",
    V.sql(
        "pitch0",
        """SELECT event_id, round(21.4 * log10(1 + f0 / 229.0), 6) AS erb,
        round((pow(10.0, 21.4 * log10(1 + f0 / 229.0) / 21.4) - 1) * 229.0, 6) AS hz FROM pitch0""",
    ),
)
def erb_scale(spark, d):
    erb = P.hz_to_erb(c("f0"))
    return V.pitch_samples(spark, d).select("event_id", r6(erb).alias("erb"), r6(P.erb_to_hz(erb)).alias("hz"))


@query(
    "log_bin_index",
    V.sql(
        "pitch0",
        "SELECT event_id, CAST(floor(120.0 * log2(nullif(f0, 0) / 55.0) + 0.5) AS BIGINT) AS bin FROM pitch0",
    ),
)
def log_bin_index(spark, d):
    return V.pitch_samples(spark, d).select("event_id", P.log_bin(c("f0"), 10.0, 55.0).alias("bin"))


@query(
    "nearest_bin_quantise",
    V.sql(
        "pitch0",
        """SELECT event_id, CASE WHEN f0 > 0 THEN CAST(least(greatest(round_even(log2(nullif(f0, 0) / 55.0) * 120.0, 0),
        0), 479) AS BIGINT) END AS bin FROM pitch0""",
    ),
)
def nearest_bin_quantise(spark, d):
    return V.pitch_samples(spark, d).select("event_id", P.nearest_bin(c("f0"), 10.0, 55.0, 480).alias("bin"))


@query(
    "amp_db",
    V.sql(
        "samples",
        """SELECT event_id, round(20 * log10(greatest(x, 1e-5)), 6) AS db, round(20 * ln(greatest(x, 1e-5)), 6) AS nat,
        round(pow(10.0, log10(greatest(x, 1e-5))), 6) AS amp,
        round(greatest(20 * log10(greatest(x, 1e-5) / max(greatest(x, 1e-5)) OVER (PARTITION BY sid)), -80), 6) AS below
        FROM samples""",
    ),
)
def amp_db(spark, d):
    s = with_group(V.samples(spark, d).select("event_id", "sid", "x"), ["sid"], peak=F.max("x"))
    db = S.amp_to_db(c("x"))
    return s.select(
        "event_id",
        r6(db).alias("db"),
        r6(S.amp_to_db(c("x"), base=None)).alias("nat"),
        r6(S.db_to_amp(db)).alias("amp"),
        r6(S.level_below_peak(c("x"), c("peak"))).alias("below"),
    )


DB_SQL = "20 * log10(greatest(x, 1e-5))"


@query(
    "range_normalise",
    V.sql(
        "samples",
        f"""SELECT event_id, round(least(greatest(8.0 * u - 4.0, -4.0), 4.0), 6) AS sym,
        round(least(greatest(4.0 * u, 0), 4.0), 6) AS pos, round(8.0 * u - 4.0, 6) AS open
        FROM (SELECT event_id, ({DB_SQL} - 20.0 + 100.0) / 100.0 AS u FROM samples)""",
    ),
)
def range_normalise(spark, d):
    db = S.amp_to_db(c("x"))
    return V.samples(spark, d).select(
        "event_id",
        r6(S.range_normalise(db)).alias("sym"),
        r6(S.range_normalise(db, symmetric=False)).alias("pos"),
        r6(S.range_normalise(db, clipped=False)).alias("open"),
    )


@query(
    "range_denormalise",
    V.sql(
        "samples",
        """SELECT event_id, round((least(greatest(y, -4.0), 4.0) + 4.0) * 100.0 / 8.0 - 100.0 + 20.0, 6) AS sym,
        round(least(greatest(y, 0), 4.0) * 100.0 / 4.0 - 100.0 + 20.0, 6) AS pos
        FROM (SELECT event_id, x / 10.0 - 5.0 AS y FROM samples)""",
    ),
)
def range_denormalise(spark, d):
    y = c("x") / 10.0 - 5.0
    return V.samples(spark, d).select(
        "event_id",
        r6(S.range_denormalise(y)).alias("sym"),
        r6(S.range_denormalise(y, symmetric=False)).alias("pos"),
    )


@query(
    "standard_scale",
    V.sql(
        "vlong",
        """SELECT vec_id, d, round((c - m) / s, 6) AS scaled, round((c - m) / s * s + m, 6) AS back
        FROM vlong JOIN (SELECT d, avg(c) AS m, stddev_pop(c) AS s FROM vlong GROUP BY d) USING (d)""",
    ),
)
def standard_scale(spark, d):
    from framewright.operators.vectors import dimension_stats

    long = V.vlong(spark, d)
    scaled = long.join(dimension_stats(long), "d").withColumn("z", S.standard_scale(c("c"), c("mean"), c("std")))
    return scaled.select(
        "vec_id", c("d").cast("bigint").alias("d"), r6("z").alias("scaled"), r6(c("z") * c("std") + c("mean")).alias("back")
    )


@query(
    "dynamic_range",
    V.sql(
        "samples",
        """SELECT event_id, round(ln(greatest(x, 1e-5) * 2.0), 6) AS squeezed,
        round(exp(ln(greatest(x, 1e-5) * 2.0)) / 2.0, 6) AS back FROM samples""",
    ),
)
def dynamic_range(spark, d):
    y = S.compress_range(c("x"), 2.0)
    return V.samples(spark, d).select("event_id", r6(y).alias("squeezed"), r6(S.expand_range(y, 2.0)).alias("back"))


@query(
    "whisper_log_scale",
    V.sql(
        "samples",
        """SELECT event_id, round((greatest(log10(greatest(x, 1e-10)), max(log10(greatest(x, 1e-10)))
        OVER (PARTITION BY sid) - 8.0) + 4.0) / 4.0, 6) AS y FROM samples""",
    ),
)
def whisper_log_scale(spark, d):
    s = with_group(V.samples(spark, d).select("event_id", "sid", "x"), ["sid"], peak=F.max("x"))
    return s.select("event_id", r6(S.log_floor_scale(c("x"), c("peak"))).alias("y"))


@query(
    "mulaw",
    V.sql(
        "samples",
        """SELECT event_id, CAST(floor((sign(s) * ln(1 + 255.0 * abs(s)) / ln(256.0) + 1) / 2 * 255.0 + 0.5) AS BIGINT)
        AS code, round(sign(s) / 255.0 * (pow(256.0, abs(s)) - 1), 6) AS wave
        FROM (SELECT event_id, least(x / 50.0, 2.0) - 1.0 AS s FROM samples)""",
    ),
)
def mulaw(spark, d):
    wave = F.least(c("x") / 50.0, F.lit(2.0)) - 1.0
    return V.samples(spark, d).select(
        "event_id", S.mulaw_encode(wave, 8).alias("code"), r6(S.mulaw_decode(wave, 8)).alias("wave")
    )


@query(
    "pcm16",
    V.sql(
        "samples",
        """SELECT event_id, CAST(trunc(least(greatest((x / 50.0 - 1.0) * 32768.0, -32768.0), 32767.0)) AS BIGINT) AS pcm
        FROM samples""",
    ),
)
def pcm16(spark, d):
    return V.samples(spark, d).select("event_id", S.pcm16(c("x") / 50.0 - 1.0).alias("pcm"))


@query(
    "quantise_bits",
    V.sql(
        "samples",
        """SELECT event_id, round((s + 1.0) * 1023.0 / 2, 6) AS level, round(2 * ((s + 1.0) * 1023.0 / 2) / 1023.0 - 1, 6)
        AS back FROM (SELECT event_id, x / 250.0 - 1.0 AS s FROM samples)""",
    ),
)
def quantise_bits(spark, d):
    level = S.quantise(c("x") / 250.0 - 1.0, 10)
    return V.samples(spark, d).select("event_id", r6(level).alias("level"), r6(S.dequantise(level, 10)).alias("back"))


@query(
    "frame_time",
    V.sql(
        "samples",
        """SELECT event_id, round(event_id * 160.0 / 16000.0, 6) AS seconds, event_id * 10 AS ms,
        round(event_id * 16000.0 / 1024.0, 6) AS hz,
        printf('%dm %ds %3d,%d', (event_id * 10) // 60000, ((event_id * 10) // 1000) % 60, (event_id * 10) % 1000,
        CAST(trunc(x) AS BIGINT)) AS label FROM samples""",
    ),
)
def frame_time(spark, d):
    return V.samples(spark, d).select(
        "event_id",
        r6(S.frame_seconds(c("event_id"), 160, 16000)).alias("seconds"),
        (c("event_id") * 10).alias("ms"),
        r6(S.coefficient_hz(c("event_id"), 1024, 16000)).alias("hz"),
        S.clock_label("event_id", c("x")).alias("label"),
    )


def stamp_sql(seconds: str, always: bool, mark: str) -> str:
    ms = f"CAST(round_even({seconds} * 1000, 0) AS BIGINT)"
    tail = f"printf('%02d:%02d{mark}%03d', ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"
    hours = f"printf('%02d:', {ms} // 3600000)"
    if always:
        return f"{hours} || {tail}"
    return f"CASE WHEN {ms} // 3600000 > 0 THEN {hours} ELSE '' END || {tail}"


@query(
    "format_timestamp",
    V.sql(
        "segs",
        f"""SELECT conv_id, turn, {stamp_sql('start_s * 371.0', False, '.')} AS short,
        {stamp_sql('end_s * 371.0', True, ',')} AS full FROM segs""",
    ),
)
def format_timestamp(spark, d):
    return V.segs(spark, d).select(
        "conv_id",
        "turn",
        X.format_timestamp("(start_s * 371D)").alias("short"),
        X.format_timestamp("(end_s * 371D)", True, ",").alias("full"),
    )


@query(
    "subtitle_sanitise",
    V.sql(
        "segs",
        r"""SELECT conv_id, turn, replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '-->', '->') AS cue,
        replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(9), ' ') AS cell
        FROM (SELECT conv_id, turn, '  ' || replace(replace(text, ', ', ' --> '), '. ', chr(9)) || chr(10) AS t FROM segs)""",
    ),
)
def subtitle_sanitise(spark, d):
    marked = F.expr("concat('  ', replace(replace(text, ', ', ' --> '), '. ', '\\t'), '\\n')")
    s = V.segs(spark, d).withColumn("t", marked)
    return s.select(
        "conv_id", "turn", X.sanitise(c("t"), arrow=True).alias("cue"), X.sanitise(c("t"), tab=True).alias("cell")
    )


@query("compression_ratio")
def compression_ratio(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", X.compression_ratio("text").alias("ratio"))


@query(
    "optional_casts",
    V.sql(
        "samples",
        """SELECT event_id, CAST(nullif(t, 'None') AS BIGINT) AS i, CAST(nullif(u, 'None') AS DOUBLE) AS f,
        CASE WHEN b = 'True' THEN true WHEN b = 'False' THEN false END AS b FROM (SELECT event_id,
        CASE WHEN event_type = 'signup' THEN 'None' ELSE CAST(event_id AS VARCHAR) END AS t,
        CASE WHEN event_type = 'view' THEN 'None' ELSE CAST(event_id AS VARCHAR) || '.5' END AS u,
        CASE event_type WHEN 'click' THEN 'True' WHEN 'error' THEN 'False' ELSE 'true' END AS b FROM samples)""",
    ),
)
def optional_casts(spark, d):
    s = V.samples(spark, d).selectExpr(
        "event_id",
        "CASE WHEN event_type = 'signup' THEN 'None' ELSE CAST(event_id AS STRING) END AS t",
        "CASE WHEN event_type = 'view' THEN 'None' ELSE concat(CAST(event_id AS STRING), '.5') END AS u",
        "CASE event_type WHEN 'click' THEN 'True' WHEN 'error' THEN 'False' ELSE 'true' END AS b",
    )
    return s.select(
        "event_id",
        X.optional_number("t", "bigint").alias("i"),
        X.optional_number("u").alias("f"),
        X.exact_bool(c("b")).alias("b"),
    )


@query(
    "speaker_from_path",
    r"""SELECT page_id, regexp_replace(n, '\..*$', '') AS speaker,
    CASE WHEN regexp_extract(n, '(\..*)$', 1) = '' THEN n ELSE rtrim(n, regexp_extract(n, '(\..*)$', 1)) END AS legacy
    FROM (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) || '.spk.npy' AS n FROM pages)""",
)
def speaker_from_path(spark, d):
    path = F.concat(F.regexp_extract("url", "([^/]*)/*$", 1), F.lit(".spk.npy"))
    pages = V.table(spark, d, "pages").select("page_id", path.alias("path"))
    return pages.select(
        "page_id", X.speaker_from_path(c("path")).alias("speaker"), X.speaker_from_path(c("path"), True).alias("legacy")
    )


@query(
    "even_offsets",
    V.sql(
        "frames",
        """SELECT doc_id, j AS k, CAST(floor(j * (greatest(n - 250, 0) / 9.0::DOUBLE)) AS BIGINT) AS start
        FROM frames, generate_series(0, 9) AS t(j)""",
    ),
)
def even_offsets(spark, d):
    starts = V.frames(spark, d).select("doc_id", F.posexplode(S.even_offsets("n", 250, 10)).alias("k", "start"))
    return starts.select("doc_id", c("k").cast("bigint").alias("k"), "start")


@query(
    "ivf_cells",
    V.sql(
        "vecs",
        """SELECT spk, n, greatest(least(CAST(floor(16 * sqrt(n)) AS BIGINT), n // 39), 1) AS cells
        FROM (SELECT spk, count(*) AS n FROM vecs GROUP BY spk)""",
    ),
)
def ivf_cells(spark, d):
    counts = V.vecs(spark, d).groupBy("spk").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("spk", "n", S.ivf_cells("n").alias("cells"))


STEP = math.log(1.0e4)


@query(
    "position_encoding",
    V.sql(
        "series",
        f"""SELECT sid, idx, round(x, 6) AS x, round(sin(idx), 6) AS c0, round(sin(idx * exp(-{STEP!r})), 6) AS c1,
        round(cos(idx), 6) AS c2, round(cos(idx * exp(-{STEP!r})), 6) AS c3 FROM series""",
    ),
)
def position_encoding(spark, d):
    s = V.series(spark, d)
    channels = [r6(S.timing_signal(c("idx"), k, 4)).alias(f"c{k}") for k in range(4)]
    return s.select("sid", "idx", r6("x").alias("x"), *channels)


@query(
    "gumbel_noise",
    V.sql(
        "samples",
        f"SELECT event_id, round(-ln(-ln({V.uniform_sql(chr(39) + 'g|' + chr(39) + ' || event_id')} * 0.99998 + 1e-5)), 6) AS g FROM samples",
    ),
)
def gumbel_noise(spark, d):
    return V.samples(spark, d).select("event_id", r6(noise.gumbel(noise.uniform("g", "event_id"))).alias("g"))


@query(
    "perturb",
    V.sql(
        "vlong",
        f"""SELECT vec_id, d, round(c + 0.1 * sqrt(-2.0 * ln(greatest({V.uniform_sql("'na|' || vec_id || '|' || d")},
        pow(2.0, -33)))) * cos(2.0 * pi() * {V.uniform_sql("'nb|' || vec_id || '|' || d")}), 6) AS c FROM vlong""",
    ),
)
def perturb(spark, d):
    noisy = c("c") + 0.1 * noise.gaussian("n", "vec_id", "d")
    return V.vlong(spark, d).select("vec_id", c("d").cast("bigint").alias("d"), r6(noisy).alias("c"))


@query("round_track", V.sql("pitch0", "SELECT event_id, round_even(f0, 1) AS f0 FROM pitch0"))
def round_track(spark, d):
    return V.pitch_samples(spark, d).select("event_id", F.bround("f0", 1).alias("f0"))


@query(
    "frame_params",
    V.sql(
        "frames",
        """SELECT doc_id, CAST(200 AS BIGINT) AS hop, CAST(800 AS BIGINT) AS win, (n // 200 + 1) * 200 - n AS right_pad,
        ((n // 200 + 1) * 200 - n) // 2 AS left_half,
        ((n // 200 + 1) * 200 - n) // 2 + ((n // 200 + 1) * 200 - n) % 2 AS right_half FROM frames""",
    ),
)
def frame_params(spark, d):
    hop, win = S.hop_and_window(12.5, 50.0, 16000)
    one, two = S.frame_padding("n", hop, 1), S.frame_padding("n", hop, 2)
    return V.frames(spark, d).select(
        "doc_id",
        F.lit(hop).cast("bigint").alias("hop"),
        F.lit(win).cast("bigint").alias("win"),
        one[1].alias("right_pad"),
        two[0].alias("left_half"),
        two[1].alias("right_half"),
    )
