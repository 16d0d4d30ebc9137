"""One query per operator of this folder, over its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from framewright.llm.common import fold, table
from framewright.session import scratch

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


@query("op3_simhash")
def op3(spark, sf_dir):
    from framewright.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.expr("lower(lpad(hex(fp), 16, '0'))").alias("fingerprint"), "component_id")


@query("op6_secret_scan")
def op6(spark, sf_dir):
    from framewright.llm.secret_scan import digest

    return digest(table(spark, sf_dir, "documents"))


@query("op7_token_files")
def op7(spark, sf_dir):
    from framewright.llm.token_files import read_token_files, write_token_files

    target = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), target, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op8_bpe_codec")
def op8(spark, sf_dir):
    from framewright.llm.bpe import digest

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_language_id")
def op4(spark, sf_dir):
    from framewright.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op5_toxicity")
def op5(spark, sf_dir):
    from framewright.llm.toxicity import learn, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(labels.where(fold("doc_id", 5) != 0).withColumn("label", F.col("toxic")), docs)
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_sharding")
def op1(spark, sf_dir):
    from framewright.llm.sharding import assign

    placed = assign(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_private_data")
def op2(spark, sf_dir):
    from framewright.llm.pii import digest

    return digest(table(spark, sf_dir, "documents"))


@query("op9_nearest_neighbours")
def op9(spark, sf_dir):
    from framewright.llm.ann import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP10_SQL = """
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), spans AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM spans
), lengths AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM docs, lengths WHERE len(w) >= n
), found AS (
  SELECT p.doc_id, p.i, p.n, x.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM places) p JOIN windows x ON x.n = p.n AND x.s = p.s
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op10_decontamination", OP10_SQL)
def op10(spark, sf_dir):
    from framewright.llm.decontaminate import digest

    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_katz")
def op11(spark, sf_dir):
    from framewright.llm.katz import score

    found = score(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return found.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op12_resampling")
def op12(spark, sf_dir):
    from framewright.llm.resample import draw

    return draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_whitening")
def op13(spark, sf_dir):
    from framewright.llm.whiten import whiten

    return whiten(table(spark, sf_dir, "embeddings"))
