"""Queries over utterance tables: listings, joins, splits, buckets, batches, rules, transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import languages
from framewright.operators import manifest as M, rules as RU
from framewright.operators.blocks import ordinal, with_group
from framewright.plans import views as V
from framewright.plans.on_scalars import r6, stamp_sql
from framewright.plans.registry import query
from framewright.session import scratch
from framewright.sources import catalog, filelists as FL, transcripts as TR
from framewright.sources.packed import read_packed

c = F.col
MODS = list(V.MODALITIES)
MOD_VIEWS = " ".join(f"mod_{m}" for m in MODS)


def big(name, alias=None):
    return c(name).cast("bigint").alias(alias or name)


def modalities(spark, d):
    return {m: V.modality(spark, d, m) for m in MODS}


@query(
    "catalog_scan",
    r"""SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) AS host, regexp_extract(url, '([^/]+)/[^/]+$', 1) AS speaker,
    regexp_extract(url, '([^/]+)\.html$', 1) AS utt FROM pages WHERE url LIKE '%.html'""",
)
def catalog_scan(spark, d):
    pages = V.table(spark, d, "pages").where(c("url").endswith(".html"))
    return pages.select(
        "page_id", F.regexp_extract("url", "//([^/]+)/", 1).alias("host"), *catalog.path_parts(c("url"), ".html")
    )


PATHS = {"wave": "wav", "spec": "pt", "pitch": "pit.npy", "hubert": "vec.npy", "whisper": "ppg.npy", "spk": "spk.npy"}
PATH_SQL = ", ".join(f"'{m}/' || utt || '.{s}' AS {m}" for m, s in PATHS.items())
JOINED = "SELECT utt FROM mod_wave " + " ".join(f"JOIN mod_{m} USING (utt)" for m in MODS[1:])


def manifest(spark, d):
    rows = M.manifest_join(modalities(spark, d), ["utt"])
    paths = [F.concat(F.lit(f"{m}/"), c("utt").cast("string"), F.lit(f".{s}")).alias(m) for m, s in PATHS.items()]
    return rows.select("utt", *paths)


@query("manifest_join", V.sql(MOD_VIEWS, f"SELECT utt, {PATH_SQL} FROM ({JOINED})"))
def manifest_join(spark, d):
    return manifest(spark, d)


@query(
    "filelist_write",
    V.sql(
        MOD_VIEWS,
        f"""SELECT CASE WHEN r <= 10 THEN 'valid' ELSE 'train' END AS split, concat_ws('|', {', '.join(MODS)}) AS line
        FROM (SELECT utt, {PATH_SQL}, row_number() OVER (ORDER BY md5('0|' || utt), utt) AS r FROM ({JOINED}))""",
    ),
)
def filelist_write(spark, d):
    return M.held_out(manifest(spark, d), "utt", 10).select("split", FL.manifest_line().alias("line"))


@query("filelist_read", V.sql(MOD_VIEWS, f"SELECT {PATH_SQL} FROM ({JOINED})"))
def filelist_read(spark, d):
    lines = manifest(spark, d).select(F.concat(FL.manifest_line(), F.lit(" \n")).alias("line"))
    return lines.select(*FL.split_line(c("line")))


@query(
    "missing_report",
    V.sql(
        MOD_VIEWS,
        " UNION ALL ".join(
            f"SELECT utt, '{m}' AS modality FROM mod_wave WHERE utt NOT IN (SELECT utt FROM mod_{m})" for m in MODS[1:]
        ),
    ),
)
def missing_report(spark, d):
    mods = modalities(spark, d)
    waves = mods.pop("wave")
    return M.missing_report(waves, mods, ["utt"])


@query(
    "dataset_audit",
    V.sql(
        MOD_VIEWS + " frames",
        f"""SELECT (SELECT count(*) FROM mod_wave) AS utterances, (SELECT count(*) FROM ({JOINED})) AS complete,
        {', '.join(f"(SELECT count(*) FROM mod_wave WHERE utt NOT IN (SELECT utt FROM mod_{m})) AS no_{m}" for m in MODS[1:])},
        (SELECT count(*) FROM frames WHERE n - 1 < 100) AS too_short,
        (SELECT count(*) FROM frames WHERE n - 1 > 400) AS capped""",
    ),
)
def dataset_audit(spark, d):
    from functools import reduce

    mods = modalities(spark, d)
    flags = lambda df, which, n: df.select(
        "utt", *[F.lit(1 if k == which else 0).alias(f"_{k}") for k in MODS], n.cast("bigint").alias("n")
    )
    waves = V.frames(spark, d).select(c("doc_id").alias("utt"), "n")
    rows = [flags(waves, "wave", c("n"))] + [flags(mods[m], m, F.lit(None)) for m in MODS[1:]]
    seen = reduce(lambda a, b: a.unionByName(b), rows).groupBy("utt").agg(
        *[F.max(f"_{k}").alias(k) for k in MODS], F.max("n").alias("n")
    )
    seen = seen.where("wave = 1")
    return seen.agg(
        F.count(F.lit(1)).alias("utterances"),
        F.count_if(F.least(*MODS) == 1).alias("complete"),
        *[F.count_if(c(m) == 0).alias(f"no_{m}") for m in MODS[1:]],
        F.count_if(c("n") - 1 < 100).alias("too_short"),
        F.count_if(c("n") - 1 > 400).alias("capped"),
    )


@query(
    "batch_audit",
    V.sql(
        "frames",
        """SELECT * FROM counts, (SELECT count(*) AS slots, count(*) FILTER (WHERE slot = 0) AS batches, CAST(coalesce(sum(use), 0) AS BIGINT) AS frames,
        CAST(coalesce(sum(top - use), 0) AS BIGINT) AS padding, count(*) - (SELECT count(*) FROM kept) AS repeats FROM
        (SELECT *, max(use) OVER (PARTITION BY bucket, replica, batch) AS top FROM dealt))""",
        kept="""SELECT doc_id, use, CASE WHEN use > 300 THEN 1 ELSE 0 END AS bucket FROM (SELECT doc_id, least(n - 1, 400) AS use FROM frames WHERE n - 1 >= 100)
            WHERE use > 150""",
        dealt="""SELECT bucket, use, pos % 2 AS replica, (pos // 2) // 4 AS batch, (pos // 2) % 4 AS slot FROM (SELECT bucket, use, unnest(generate_series(p,
            CAST(ceil(nn / 8.0) AS BIGINT) * 8 - 1, nn)) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS p,
            count(*) OVER (PARTITION BY bucket) AS nn FROM kept))""",
        counts="""SELECT count(*) AS items, count(*) FILTER (WHERE n - 1 < 100) AS too_short, count(*) FILTER (WHERE n - 1 > 400) AS capped,
            count(*) FILTER (WHERE n - 1 BETWEEN 100 AND 150) AS unbucketed FROM frames""",
    ),
)
def batch_audit(spark, d):
    """Items through buckets and batches, and what was counted on the way."""
    return M.audited_batches(V.frames(spark, d), "doc_id", "n", [150, 300, 450], 2, 4)[1]


@query(
    "pitch_csv_write",
    V.sql(
        "pitch",
        """SELECT sid, idx, printf('%dm %ds %3d,%d', (idx * 10) // 60000, ((idx * 10) // 1000) % 60, (idx * 10) % 1000,
        CAST(trunc(f0) AS BIGINT)) AS line FROM pitch""",
    ),
)
def pitch_csv_write(spark, d):
    return V.pitch(spark, d).select("sid", "idx", FL.pitch_line().alias("line"))


@query("pitch_csv_read", V.sql("pitch", "SELECT sid, idx, CAST(trunc(f0) AS BIGINT) AS f0 FROM pitch"))
def pitch_csv_read(spark, d):
    lines = V.pitch(spark, d).select("sid", "idx", FL.pitch_line().alias("line"))
    return lines.select("sid", "idx", FL.pitch_of_line(c("line")).alias("f0"))


COMMENTED = """CASE event_type WHEN 'click' THEN replace(props, '}', '// note' || chr(10) || '}')
    WHEN 'view' THEN replace(props, ':', ':' || chr(92) || chr(10)) ELSE props END"""


@query(
    "json_comments",
    f"""SELECT event_id, CAST(json_extract(regexp_replace(regexp_replace(t, '\\\\\\n', '', 'g'), '//.*\\n', chr(10), 'g'),
    '$.k') AS BIGINT) AS k FROM (SELECT event_id, {COMMENTED} AS t FROM events)""",
)
def json_comments(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.expr(COMMENTED).alias("t"))
    return e.select("event_id", FL.parse_json(c("t"), "k BIGINT")["k"].alias("k"))


SEGS = V.SQL["segs"].replace("conv_id,", "conv_id AS audio,")
STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
CHUNKS = {
    "txt": f"SELECT audio, part, {STRIP} AS chunk FROM seg",
    "vtt": f"""SELECT audio, part, {stamp_sql('start_s', False, '.')} || ' --> ' || {stamp_sql('end_s', False, '.')} || chr(10)
        || replace({STRIP}, '-->', '->') || chr(10) AS chunk FROM seg
        UNION ALL SELECT DISTINCT audio, 0::BIGINT, 'WEBVTT' || chr(10) FROM seg""",
    "srt": f"""SELECT audio, part, part || chr(10) || {stamp_sql('start_s', True, ',')} || ' --> ' ||
        {stamp_sql('end_s', True, ',')} || chr(10) || replace({STRIP}, '-->', '->') || chr(10) AS chunk FROM seg""",
    "tsv": f"""SELECT audio, part, CAST(round_even(1000 * start_s, 0) AS BIGINT) || chr(9) ||
        CAST(round_even(1000 * end_s, 0) AS BIGINT) || chr(9) || replace({STRIP}, chr(9), ' ') AS chunk FROM seg
        UNION ALL SELECT DISTINCT audio, 0::BIGINT, concat_ws(chr(9), 'start', 'end', 'text') FROM seg""",
    "json": """SELECT audio, part, CASE WHEN part > 1 THEN ',' ELSE '' END || CAST(json_object('start', start_s, 'end',
        end_s, 'text', text) AS VARCHAR) AS chunk FROM seg
        UNION ALL SELECT DISTINCT audio, 0::BIGINT, '{"audio":' || audio || ',"segments":[' FROM seg
        UNION ALL SELECT audio, max(part) + 1, ']}' FROM seg GROUP BY audio""",
}
NUMBERED = f"SELECT *, row_number() OVER (PARTITION BY audio ORDER BY turn) AS part FROM ({SEGS})"


def segments(spark, d):
    return V.segs(spark, d).select(c("conv_id").alias("audio"), c("turn").alias("seg_no"), "start_s", "end_s", "text")


def transcript_query(fmt):
    def run(spark, d):
        return TR.transcript(segments(spark, d), fmt)

    query(f"transcript_{fmt}", V.sql("", CHUNKS[fmt], seg=NUMBERED))(run)


for _fmt in CHUNKS:
    transcript_query(_fmt)


@query(
    "transcript_all",
    V.sql("", " UNION ALL ".join(f"SELECT *, '{f}' AS format FROM ({q})" for f, q in CHUNKS.items()), seg=NUMBERED),
)
def transcript_all(spark, d):
    return TR.transcript(segments(spark, d), "all")


@query(
    "transcript_packed",
    V.sql(
        "",
        "SELECT format, CAST(audio AS VARCHAR) AS audio, string_agg(chunk || chr(10), '' ORDER BY part) AS text FROM ("
        + " UNION ALL ".join(f"SELECT *, '{f}' AS format FROM ({q})" for f, q in CHUNKS.items()) + ") GROUP BY format, audio",
        seg=NUMBERED,
    ),
)
def transcript_packed(spark, d):
    """All formats written to few files and every audio read back by its offsets."""
    path = scratch(spark, "transcripts")
    TR.pack_transcripts(segments(spark, d), "all", path, files=8)
    pieces = read_packed(spark, path).groupBy("folder", "item").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    return pieces.select(c("folder").alias("format"), c("item").alias("audio"), F.expr("array_join(transform(p, e -> e.text), '')").alias("text"))


@query("skip_existing", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "source")
    return catalog.pending(docs, V.table(spark, d, "labels"), ["doc_id"])


@query(
    "length_filter_cap",
    V.sql("frames", "SELECT doc_id, n, least(n - 1, 400) AS use FROM frames WHERE n - 1 >= 100"),
)
def length_filter_cap(spark, d):
    return M.length_filter(V.frames(spark, d), "n")


BUCKET = "CASE WHEN use > 150 AND use <= 300 THEN 0 WHEN use > 300 AND use <= 450 THEN 1 END"
BUCKETED = f"""SELECT doc_id, use, CAST(b AS BIGINT) AS bucket FROM (SELECT *, {BUCKET} AS b FROM
    (SELECT doc_id, least(n - 1, 400) AS use FROM frames WHERE n - 1 >= 100)) WHERE b IS NOT NULL"""
BOUNDS = [150, 300, 450]


def bucketed(spark, d):
    items = M.length_filter(V.frames(spark, d), "n")
    return items.select("doc_id", "use", M.bucket_of(c("use"), BOUNDS).alias("bucket")).where("bucket IS NOT NULL")


@query("bucket_lookup", V.sql("frames", BUCKETED))
def bucket_lookup(spark, d):
    return bucketed(spark, d)


PADDED = """SELECT doc_id, bucket, unnest(generate_series(p, CAST(ceil(n / 16) * 16 AS BIGINT) - 1, n)) AS pos FROM
    (SELECT doc_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS p,
    count(*) OVER (PARTITION BY bucket) AS n FROM buckets)"""


@query("bucket_wrap_pad", V.sql("frames", PADDED, buckets=BUCKETED))
def bucket_wrap_pad(spark, d):
    return M.wrap_pad(bucketed(spark, d), "bucket", "doc_id", 16).select("doc_id", "bucket", "pos")


@query(
    "rank_batches",
    V.sql(
        "frames",
        f"SELECT doc_id, bucket, pos % 2 AS replica, (pos // 2) // 8 AS batch, (pos // 2) % 8 AS slot FROM ({PADDED})",
        buckets=BUCKETED,
    ),
)
def rank_batches(spark, d):
    padded = M.wrap_pad(bucketed(spark, d), "bucket", "doc_id", 16)
    return M.rank_batches(padded, 2, 8).select("doc_id", "bucket", "replica", "batch", "slot")


@query(
    "epoch_shuffle",
    V.sql(
        "frames",
        """SELECT doc_id, bucket, batch, dense_rank() OVER (ORDER BY md5('7|' || bucket || '|' || batch), bucket, batch) - 1
        AS place FROM (SELECT doc_id, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY md5('7|' || doc_id), doc_id)
        - 1) // 16 AS batch FROM buckets)""",
        buckets=BUCKETED,
    ),
)
def epoch_shuffle(spark, d):
    placed = M.shuffled(bucketed(spark, d), ["bucket"], "doc_id", 7, "pos")
    return M.shuffle_batches(placed.withColumn("batch", F.expr("pos div 16")), ["bucket", "batch"], 7).select(
        "doc_id", "bucket", "batch", "place"
    )


@query(
    "holdout_split",
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('0|' || doc_id), doc_id) <= 10 THEN 'valid' ELSE 'train' END
    AS split FROM documents""",
)
def holdout_split(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id")
    return M.held_out(docs, "doc_id", 10).select("doc_id", "split")


@query(
    "manifest_shuffle",
    "SELECT doc_id, row_number() OVER (ORDER BY md5('3|' || doc_id), doc_id) - 1 AS position FROM documents",
)
def manifest_shuffle(spark, d):
    return M.shuffled(V.table(spark, d, "documents").select("doc_id"), [], "doc_id", 3)


@query(
    "random_crop",
    V.sql(
        "frames",
        f"""SELECT doc_id, n, CASE WHEN n > 400 THEN CAST(floor({V.uniform_sql("'5|' || doc_id")} * (n - 400)) AS BIGINT)
        ELSE 0 END AS start, least(n, 400) AS size FROM frames""",
    ),
)
def random_crop(spark, d):
    start = M.random_start(c("n"), F.lit(400), 5, "doc_id")
    return V.frames(spark, d).select("doc_id", "n", start.alias("start"), F.expr("least(n, 400L)").alias("size"))


@query(
    "row_rules",
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, l_partkey, '{f}' AS field, '{p}' AS problem FROM lineitem WHERE {w}"
        for f, p, w in [
            ("l_quantity", "above maximum", "l_quantity > 48"),
            ("l_quantity", "below minimum", "l_quantity < 2"),
            ("l_returnflag", "not allowed", "l_returnflag NOT IN ('A', 'R')"),
            ("l_tax", "above maximum", "l_tax > 0.07 AND l_nothing IS NULL"),
            ("l_discount", "needs l_nothing", "l_discount IS NOT NULL AND l_nothing IS NULL"),
            ("l_nothing", "required", "l_nothing IS NULL"),
        ]
    ).replace("FROM lineitem", "FROM (SELECT *, CASE WHEN l_discount > 0.05 THEN 1 END AS l_nothing FROM lineitem)"),
)
def row_rules(spark, d):
    rows = V.table(spark, d, "lineitem").withColumn("l_nothing", F.when(c("l_discount") > 0.05, 1))
    rules = [
        RU.Rule("l_quantity", low=2, high=48),
        RU.Rule("l_returnflag", allowed=("a", "r")),
        RU.Rule("l_tax", high=0.07, instead_of="l_nothing"),
        RU.Rule("l_discount", needs=("l_nothing",)),
        RU.Rule("l_nothing", required=True),
    ]
    return RU.violations(rows, ["l_orderkey", "l_linenumber", "l_partkey"], rules)


@query(
    "stream_align",
    V.sql(
        "series",
        """SELECT sid, frame, round(max(CASE WHEN event_type = 'click' THEN x END), 6) AS pit,
        round(max(CASE WHEN event_type = 'view' THEN x END), 6) AS vec,
        round(max(CASE WHEN event_type = 'error' THEN x END), 6) AS ppg
        FROM (SELECT sid, event_type, x, row_number() OVER (PARTITION BY sid, event_type ORDER BY idx) - 1 AS frame FROM series)
        JOIN (SELECT sid, least(count(*) FILTER (WHERE event_type = 'click'), count(*) FILTER (WHERE event_type = 'view') - 2,
        count(*) FILTER (WHERE event_type = 'error') - 2) AS len FROM series GROUP BY sid) USING (sid)
        WHERE event_type IN ('click', 'view', 'error') AND frame < len GROUP BY sid, frame""",
    ),
)
def stream_align(spark, d):
    names = {"pit": "click", "vec": "view", "ppg": "error"}
    s = V.samples(spark, d).where(c("event_type").isin(list(names.values())))
    placed = ordinal(s, ["sid", "event_type"], ["event_id"], F.expr(f"event_id div {1 << 22}"), "frame")
    counts = {f"_{k}": F.count_if(c("event_type") == t) for k, t in names.items()}
    sized = with_group(placed, ["sid"], **counts)
    usable = M.align_lengths({k: f"_{k}" for k in names}, {"vec": 2, "ppg": 2})
    values = [r6(F.max(F.when(c("event_type") == t, c("x")))).alias(k) for k, t in names.items()]
    return sized.where(c("frame") < usable).groupBy("sid", "frame").agg(*values)


@query(
    "config_overlay",
    """SELECT o_orderkey, 'priority' AS key, o_orderpriority AS value, 'clerk' AS unknown FROM orders UNION ALL
    SELECT o_orderkey, 'status', o_orderstatus, 'clerk' FROM orders UNION ALL
    SELECT o_orderkey, 'segment', c_mktsegment, 'clerk' FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL
    SELECT o_orderkey, 'clerk', o_orderpriority || '!', 'clerk' FROM orders""",
)
def config_overlay(spark, d):
    base = V.table(spark, d, "customer").selectExpr(
        "c_custkey AS o_custkey", "map('priority', 'none', 'status', 'none', 'segment', c_mktsegment) AS base"
    )
    new = V.table(spark, d, "orders").selectExpr(
        "o_orderkey",
        "o_custkey",
        "map('status', o_orderstatus, 'priority', o_orderpriority, 'clerk', concat(o_orderpriority, '!')) AS new",
    )
    both = new.join(base, "o_custkey")
    unknown = F.array_join(RU.unknown_keys("base", "new"), ",")
    return both.select("o_orderkey", F.explode(RU.overlay_map("base", "new")), unknown.alias("unknown"))


@query(
    "language_dim",
    """SELECT doc_id, k AS field, CASE WHEN k = 'lang' THEN lang END AS code, CASE WHEN k = 'lang' THEN CASE lang
    WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE 'spanish' END END AS name,
    k = 'lang' AS known FROM documents, (VALUES ('lang'), ('source')) AS t(k)""",
)
def language_dim(spark, d):
    spelled = F.expr("CASE lang WHEN 'es' THEN 'Castilian' WHEN 'de' THEN 'GERMAN' WHEN 'fr' THEN 'FR' ELSE lang END")
    docs = V.table(spark, d, "documents").select("doc_id", F.explode(F.create_map(F.lit("lang"), spelled, F.lit("source"), c("source"))).alias("field", "text"))
    coded = docs.withColumn("code", languages.language_code(c("text")))
    return coded.select(
        "doc_id", "field", "code", languages.language_name(c("code")).alias("name"), c("code").isNotNull().alias("known")
    )


@query(
    "union_modalities",
    """SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL
    SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""",
)
def union_modalities(spark, d):
    a = V.table(spark, d, "customer").select(F.lit("customer").alias("kind"), c("c_custkey").alias("id"), c("c_acctbal").alias("balance"))
    b = V.table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), c("s_suppkey").alias("id"), c("s_acctbal").alias("balance"))
    return a.unionByName(b)


@query("distinct_ids", "SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_ids(spark, d):
    return V.table(spark, d, "lineitem").select("l_suppkey").distinct()


@query("intersect_ids", "SELECT o_orderkey AS id FROM orders INTERSECT SELECT l_orderkey FROM lineitem")
def intersect_ids(spark, d):
    orders = V.table(spark, d, "orders").select(c("o_orderkey").alias("id"))
    return orders.intersect(V.table(spark, d, "lineitem").select("l_orderkey"))


@query("except_ids", "SELECT page_id AS id FROM pages EXCEPT SELECT conv_id FROM conversations")
def except_ids(spark, d):
    ids = V.table(spark, d, "pages").select(c("page_id").alias("id"))
    return ids.join(V.table(spark, d, "conversations").select(c("conv_id").alias("id")), "id", "left_anti")
