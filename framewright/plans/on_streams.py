"""Streaming queries over the event table, run to the end of the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.plans import views as V
from framewright.plans.on_frames import SEG
from framewright.plans.on_scalars import r6
from framewright.plans.registry import query
from framewright.session import scratch
from framewright.streaming import ingest, vad

c = F.col


def chunks(spark, d):
    events = ingest.watch(spark, d, "events*.parquet")
    return events.select(
        c("user_id").alias("sid"), c("event_id").alias("pos"), F.expr("least(value / 100D, 1D)").alias("p"), c("value").alias("x")
    )


GROUPS = {k: SEG[k] for k in ("kk", "st", "cl", "nu")}


@query(
    "stream_vad",
    V.sql(
        "prob",
        """SELECT sid, 'start' AS kind, min(a) AS "at" FROM nu GROUP BY sid, g UNION ALL
        SELECT sid, 'end', cut + 2 FROM nu WHERE cut IS NOT NULL""",
        **GROUPS,
    ),
)
def stream_vad(spark, d):
    path = scratch(spark, "stream")
    return ingest.drain(vad.speech_events(chunks(spark, d)), path).unionByName(vad.events_left(spark, path))


@query(
    "stream_mask",
    V.sql(
        "series prob",
        """SELECT sid, event_id AS pos, CASE WHEN g.sid IS NOT NULL THEN x ELSE 0 END AS x FROM series LEFT JOIN
        (SELECT sid, idx FROM prob JOIN (SELECT sid, min(a) AS lo, max(shut) AS hi FROM shut GROUP BY sid, g) s USING (sid)
        WHERE idx >= lo AND (hi IS NULL OR idx < hi)) g USING (sid, idx)""",
        **GROUPS,
        shut="""SELECT nu.sid, nu.a, nu.g, (SELECT min(idx) FROM kk JOIN st ON kk.sid = st.sid AND kk.k = st.k
            WHERE st.sid = nu.sid AND st.a = nu.a AND p < 0.35 AND idx - n0 >= 2) AS shut FROM nu""",
    ),
)
def stream_mask(spark, d):
    path = scratch(spark, "stream")
    found = ingest.drain(vad.masked_samples(chunks(spark, d)), path).unionByName(vad.samples_left(spark, path))
    return found.select("sid", "pos", F.when(~c("late"), c("x")).alias("x"))


@query("stream_ingest_once", "SELECT event_id, user_id, value FROM events")
def stream_ingest_once(spark, d):
    stream = ingest.once(ingest.watch(spark, d, "events*.parquet")).select("event_id", "user_id", "value")
    return ingest.drain(stream, scratch(spark, "stream"))


@query(
    "stream_chunk_features",
    """SELECT event_type, w AS start_s, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS peak FROM
    (SELECT *, (epoch_us(ts) // 900000000) * 900 AS w FROM events) GROUP BY event_type, w""",
)
def stream_chunk_features(spark, d):
    """All windows of a finished input: those the stream put out, those it holds open, and those that rows missed."""
    path = scratch(spark, "stream")
    drained = ingest.drain(ingest.chunk_features(ingest.watch(spark, d, "events*.parquet"), ["event_type"]), path)
    events = V.table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    out = ingest.finished_features(spark, path, drained, events, ["event_type"])
    return out.select("event_type", "start_s", "n", r6("mean").alias("mean"), r6("peak").alias("peak"))
