"""Every registered query against its SQL on the smallest tables, and the shape of the plans that matter at scale."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, compare
from framewright.plans import views as V

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    verdict = compare(spark, con, name, SF)
    assert verdict.startswith(("ok", "rows-only")) and "TYPES" not in verdict and "NAN" not in verdict, verdict


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["segment_keep", "segment_drop", "interval_mask", "knn_exact", "knn_ivf", "soft_codes", "shift_crossjoin"])
def test_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["f0_coarse", "range_normalise", "pcm16", "random_crop", "length_filter_cap"])
def test_row_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))


def test_shifting_adds_no_shuffle_to_its_track(spark):
    exchanges = lambda df: plan(df).split("== Physical Plan ==")[1].count("Exchange")
    assert exchanges(QUERIES["shift_crossjoin"](spark, SF)) == exchanges(V.pitch(spark, SF))


def test_length_filter_reads_two_columns(spark):
    text = plan(QUERIES["length_filter_cap"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text


def test_ratios_are_positive(spark):
    out = QUERIES["compression_ratio"](spark, SF).agg(F.min("ratio"), F.count("ratio"), F.count(F.lit(1))).first()
    assert out[0] > 0 and out[1] == out[2] and math.isfinite(out[0])
