"""The corpus shapes the queries use, derived from the given tables: once for Spark, once as SQL for checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framewright.operators.blocks import ORDINAL_SPAN, ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("sid"), "event_type", "ts", F.col("value").alias("x")
    )


def pitch_samples(spark, d) -> DataFrame:
    return samples(spark, d).select("event_id", "sid", *_pitch_columns())


def _pitch_columns() -> list[Column]:
    return [
        F.expr("CASE WHEN event_type = 'error' THEN 0D ELSE 50D + 2D * x END").alias("f0"),
        F.expr("least(x / 100D, 1D)").alias("per"),
    ]


def series(spark, d) -> DataFrame:
    """sid, idx (dense per sid), event_id, event_type, ts, x."""
    s = samples(spark, d)
    return ordinal(s, ["sid"], ["event_id"], F.expr(f"event_id div {ORDINAL_SPAN}"))


def prob(spark, d) -> DataFrame:
    return series(spark, d).selectExpr("sid", "idx", "least(x / 100D, 1D) AS p")


def pitch(spark, d) -> DataFrame:
    return series(spark, d).select("sid", "idx", *_pitch_columns())


def gappy(spark, d) -> DataFrame:
    return series(spark, d).selectExpr("sid", "idx", "CASE WHEN event_type = 'signup' THEN NULL ELSE x END AS x")


def frames(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", "CAST(floor(n_chars / 8) AS BIGINT) AS n")


MODALITIES = {
    "wave": ("documents", "doc_id"),
    "spec": ("labels", "doc_id"),
    "pitch": ("embeddings", "vec_id"),
    "hubert": ("pages", "page_id"),
    "whisper": ("conversations", "conv_id"),
    "spk": ("benchmark", "item_id"),
}


def modality(spark, d, name: str) -> DataFrame:
    source, key = MODALITIES[name]
    out = table(spark, d, source).select(F.col(key).alias("utt"))
    return out.distinct() if name == "whisper" else out


def vecs(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id", "label AS spk", "CAST(embedding AS ARRAY<DOUBLE>) AS v")


def vlong(spark, d) -> DataFrame:
    return vecs(spark, d).select("vec_id", "spk", F.posexplode("v").alias("d", "c"))


def ckpt(spark, d) -> DataFrame:
    return vecs(spark, d).selectExpr("vec_id % 2 AS model", "CAST(floor(vec_id / 2) AS BIGINT) AS key", "v AS w")


def spec(spark, d) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("b"))
        .agg(F.sum("l_extendedprice").alias("r"), F.expr("sum(l_extendedprice * (1 - l_discount))").alias("f"))
    )


def logits(spark, d) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("c"))
        .agg((F.max("l_quantity") / F.lit(10.0)).alias("z"))
    )


def log(spark, d) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id AS step", "event_type AS tag", "value AS val")


def segs(spark, d) -> DataFrame:
    return table(spark, d, "conversations").selectExpr(
        "conv_id", "turn", "turn * 2.5D AS start_s", "turn * 2.5D + 2.25D AS end_s", "text"
    )


SQL = {
    "samples": "SELECT event_id, user_id AS sid, event_type, ts, value AS x FROM events",
    "pitch0": """SELECT event_id, user_id AS sid,
        CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 50.0 + 2.0 * value END AS f0,
        least(value / 100.0, 1.0) AS per FROM events""",
    "series": """SELECT user_id AS sid, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT)
        AS idx, event_id, event_type, ts, value AS x FROM events""",
    "prob": "SELECT sid, idx, least(x / 100.0, 1.0) AS p FROM series",
    "pitch": """SELECT sid, idx, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 50.0 + 2.0 * x END AS f0,
        least(x / 100.0, 1.0) AS per FROM series""",
    "gappy": "SELECT sid, idx, CASE WHEN event_type = 'signup' THEN NULL ELSE x END AS x FROM series",
    "frames": "SELECT doc_id, CAST(floor(n_chars / 8) AS BIGINT) AS n FROM documents",
    "mod_wave": "SELECT doc_id AS utt FROM documents",
    "mod_spec": "SELECT doc_id AS utt FROM labels",
    "mod_pitch": "SELECT vec_id AS utt FROM embeddings",
    "mod_hubert": "SELECT page_id AS utt FROM pages",
    "mod_whisper": "SELECT DISTINCT conv_id AS utt FROM conversations",
    "mod_spk": "SELECT item_id AS utt FROM benchmark",
    "vecs": "SELECT vec_id, label AS spk, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "vlong": "SELECT vec_id, spk, unnest(generate_series(0, len(v) - 1)) AS d, unnest(v) AS c FROM vecs",
    "ckpt": "SELECT vec_id % 2 AS model, CAST(floor(vec_id / 2) AS BIGINT) AS key, v AS w FROM vecs",
    "spec": """SELECT l_orderkey AS g, l_linenumber AS b, sum(l_extendedprice) AS r,
        sum(l_extendedprice * (1 - l_discount)) AS f FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "logits": """SELECT l_orderkey AS g, l_linenumber AS c, max(l_quantity) / 10.0 AS z FROM lineitem
        GROUP BY l_orderkey, l_linenumber""",
    "log": "SELECT event_id AS step, event_type AS tag, value AS val FROM events",
    "segs": """SELECT conv_id, turn, turn * CAST(2.5 AS DOUBLE) AS start_s,
        turn * CAST(2.5 AS DOUBLE) + CAST(2.25 AS DOUBLE) AS end_s, text FROM conversations""",
}
NEEDS = {"prob": ["series"], "pitch": ["series"], "gappy": ["series"], "vlong": ["vecs"], "ckpt": ["vecs"]}


def sql(names: str, body: str, **more: str) -> str:
    """`body` with the named views, and any further ones given by keyword, in front of it."""
    order: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    parts = [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def uniform_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"
