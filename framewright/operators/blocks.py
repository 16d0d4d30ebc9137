"""Ordered computation over keys of any length.

A window partitioned by key alone puts the whole key in one task. Here every key is cut into blocks of
consecutive positions: bounded frames copy a few rows across block borders, running aggregates add a carry
computed from one total per block. A task then sees at most one block of rows, or one row per block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from framewright.session import cut

BLOCK_ROWS = 1 << 16
ORDINAL_SPAN = 1 << 22
#: Blocks whose maps meet in one task.
FAN = 1024


def block_id(idx: str, rows: int) -> Column:
    return F.expr(f"CAST(floor(`{idx}` / {rows}) AS BIGINT)")


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key, as grouping has it; the keys of `left` stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], how).drop(*[f"_r_{k}" for k in keys])


def stretched(df: DataFrame, first: str, last: str, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Each row once for every whole number from `first` to `last` (SQL), as `out`; none where `last` is smaller.

    The numbers come in blocks of `rows`, so no array is longer than that, however long the stretch.
    """
    low, high = f"CAST({first} AS BIGINT)", f"CAST({last} AS BIGINT)"
    blocks = df.where(F.expr(f"{low} <= {high}")).withColumn("_from", F.explode(F.expr(f"sequence({low}, {high}, {rows}L)")))
    return blocks.withColumn(out, F.explode(F.expr(f"sequence(_from, least(_from + {rows - 1}, {high}))"))).drop("_from")


def present(df: DataFrame, *columns: str) -> DataFrame:
    """`df`, failing at the first NULL in one of its key or position columns: such a row has no place in a series."""
    checked = {c: F.expr(f"coalesce(`{c}`, raise_error('NULL in {c}: a row of a series needs its key and position'))") for c in columns}
    return df.withColumns(checked)


def ordinal(df: DataFrame, keys: list[str], order: list, block: Column, out: str = "idx") -> DataFrame:
    """Dense 0-based position of each row within `keys`.

    `block` must not decrease along `order`; it decides which rows are numbered together in one task. A NULL key or block
    is an error.
    """
    part = [*keys, "_b"]
    rows = present(df.withColumn("_b", block), *part)
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    local = rows.withColumn("_r", F.row_number().over(W.partitionBy(*part).orderBy(*order)) - 1)
    return (
        local.join(offsets, part)
        .withColumn(out, (F.col("_off") + F.col("_r")).cast("bigint"))
        .drop("_b", "_r", "_off")
    )


def hashed_ordinal(df: DataFrame, keys: list[str], digest: str, tie: str, out: str, digits: int = 3) -> DataFrame:
    """`ordinal` in the order of a hex digest column; blocks are digest prefixes, so they are even by construction."""
    return ordinal(df, keys, [digest, tie], F.substring(digest, 1, digits), out)


def halo(df: DataFrame, keys: list[str], idx: str, before: int, after: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Give each block the rows its first and last frames look at. `_own` marks the rows that belong to it.

    Rows without a position make a block of their own.
    """
    first = f"greatest(floor((`{idx}` - {after}) / {rows}), 0)"
    last = f"floor((`{idx}` + {before}) / {rows})"
    placed = df.withColumn("_blk", F.explode_outer(F.expr(f"sequence(CAST({first} AS BIGINT), CAST({last} AS BIGINT))")))
    return placed.withColumn("_own", F.col("_blk").eqNullSafe(block_id(idx, rows)))


def framed(
    df: DataFrame,
    keys: list[str],
    idx: str,
    before: int,
    after: int,
    *stages: Callable[[WindowSpec], dict[str, Column]],
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns whose frames reach at most `before` rows back and `after` rows ahead.

    `idx` must be dense within `keys`. Each stage gets a window ordered by `idx` and returns new columns, which the
    next stage may use; `before` and `after` are the reach of all stages together.
    """
    window = W.partitionBy(*keys, "_blk").orderBy(idx)
    out = halo(df, keys, idx, before, after, rows)
    for stage in stages:
        out = out.select("*", *[c.alias(n) for n, c in stage(window).items()])
    return out.where("_own").drop("_blk", "_own")


_TOTAL = {
    "sum": lambda c, i: F.sum(c),
    "max": lambda c, i: F.max(c),
    "min": lambda c, i: F.min(c),
    "last": lambda c, i: F.max_by(c, F.when(c.isNotNull(), F.col(i))),
}
_FOLD = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}
_MERGE = {
    "sum": lambda here, carry: F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)),
    "max": lambda here, carry: F.greatest(here, carry),
    "min": lambda here, carry: F.least(here, carry),
    "last": lambda here, carry: F.coalesce(here, carry),
}


def running(
    df: DataFrame,
    keys: list[str],
    idx: str,
    specs: dict[str, tuple],
    rows: int = BLOCK_ROWS,
    reverse: bool = False,
) -> DataFrame:
    """Running aggregates along an integer order column.

    `specs` maps an output name to `(kind, column)` or `(kind, column, "before")`; kind is sum, max, min or last
    (last non-null value). "before" leaves the current row out. `reverse` runs from the end to the start. A NULL key or
    position is an error.
    """
    part = [*keys, "_blk"]
    d = present(df, *keys, idx).withColumn("_blk", block_id(idx, rows))
    order = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    sign = f"(-`{idx}`)" if reverse else f"`{idx}`"
    d = d.withColumn("_ord", F.expr(sign))
    totals = d.groupBy(*part).agg(*[_TOTAL[s[0]](s[1], "_ord").alias(f"_t_{n}") for n, s in specs.items()])
    earlier = W.partitionBy(*keys).orderBy(order("_blk")).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*part, *[_FOLD[s[0]](F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}") for n, s in specs.items()])
    here = W.partitionBy(*part).orderBy(order(idx))
    local = d.select(
        "*",
        *[
            _FOLD[s[0]](s[1])
            .over(here.rowsBetween(W.unboundedPreceding, -1 if s[2:] == ("before",) else 0))
            .alias(f"_l_{n}")
            for n, s in specs.items()
        ],
    )
    names = [c for c in df.columns if c not in specs]
    return local.join(carry, part).select(
        *names, *[_MERGE[s[0]](F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, s in specs.items()]
    )


def chained(maps: DataFrame, keys: list[str], first: int | str, reverse: bool = False, fan: int = FAN) -> DataFrame:
    """(keys, _blk, _entry): with what every block of a key is entered, if each leads from an entry to an exit.

    `maps` has keys, _blk and m, the exit for every entry; an exit is the entry of the next block. `first` is the entry of
    the first block, or the column of `maps` that names it there; with `reverse`, blocks are entered from the last one on.
    Runs of `fan` blocks are summed up by the map of all of them, so a task sees the blocks of a run or one row per run. A
    block that is all of its key is entered with the first entry and takes no part in that. `maps` is read a few times and should be a written table.
    """
    ddl = ", ".join(f"`{k}` {maps.schema[k].dataType.simpleString()}" for k in keys)
    given = first if isinstance(first, str) else None

    def through(pdf: pd.DataFrame, by: str, entry: int) -> pd.DataFrame:
        pdf, entries = pdf.sort_values(by, ascending=not reverse), []
        for m in pdf["m"]:
            entries.append(entry)
            entry = int(m[entry])
        return pdf.assign(_entry=entries)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk", ascending=not reverse)
        whole = np.arange(len(pdf["m"].iloc[0]))
        for m in pdf["m"]:
            whole = np.asarray(m)[whole]
        head = pdf.iloc[:1]
        return head[[*keys, "_run"]].assign(m=[whole], _first=int(head[given].iloc[0]) if given else first)

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = pdf.sort_values("_run", ascending=not reverse)["_first"].iloc[0]
        return through(pdf, "_run", int(entry))[[*keys, "_run", "_entry"]]

    sized = join_on(maps, maps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_blocks")), keys)
    alone = sized.where("_blocks = 1").select(*keys, "_blk", (F.col(given) if given else F.lit(first)).cast("int").alias("_entry"))
    maps = cut(sized.where("_blocks > 1").drop("_blocks"))
    dealt = maps.withColumn("_run", F.expr(f"_blk div {fan}"))
    run_maps = dealt.groupBy(*keys, "_run").applyInPandas(fold, f"{ddl}, _run bigint, m array<int>, _first int")
    run_entry = run_maps.groupBy(*keys).applyInPandas(runs, f"{ddl}, _run bigint, _entry int")
    met = join_on(dealt, run_entry.withColumnRenamed("_entry", "_e"), [*keys, "_run"])
    schema = f"{ddl}, _blk bigint, _entry int"
    found = met.groupBy(*keys, "_run").applyInPandas(lambda pdf: through(pdf, "_blk", int(pdf["_e"].iloc[0]))[[*keys, "_blk", "_entry"]], schema)
    return cut(alone.unionByName(found))


def group_starts(batch: pa.RecordBatch, keys: list[str], before: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a group starts in a batch of rows ordered by `keys`, and the key of its last row; `before` is that of the batch before."""
    fresh = np.zeros(batch.num_rows, bool)
    for k in keys:
        here, last = batch[k].slice(1), batch[k].slice(0, batch.num_rows - 1)
        same = pc.or_(pc.fill_null(pc.equal(here, last), False), pc.and_(pc.is_null(here), pc.is_null(last)))
        fresh[1:] |= ~same.to_numpy(zero_copy_only=False)
    key = lambda row: tuple(batch[k][row].as_py() for k in keys)
    fresh[0] = before is None or key(0) != before
    return fresh, key(batch.num_rows - 1)


def with_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach per-key aggregates. The aggregate is combined before its shuffle and joined back as one row per key."""
    return join_on(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)


def in_spans(
    rows: DataFrame, spans: DataFrame, keys: list[str], idx: str, start: str, end: str, how: str = "inner", block: int = 4096
) -> DataFrame:
    """Rows joined to the span `[start, end)` of the same key that holds them; "left" keeps the others too.

    An equi-join on key and position block with the range as a residual: a long span is repeated once per block it
    crosses, and a key of any length spreads over its blocks.
    """
    first, last = f"CAST(floor(`{start}` / {block}) AS BIGINT)", f"CAST(floor((`{end}` - 1) / {block}) AS BIGINT)"
    pieces = spans.where(F.col(end) > F.col(start)).select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        *[c for c in spans.columns if c not in keys],
        F.explode(F.expr(f"sequence({first}, {last})")).alias("_sblk"),
    )
    on = [F.col(k) == F.col(f"_s_{k}") for k in keys]
    on += [block_id(idx, block) == F.col("_sblk"), F.col(idx) >= F.col(start), F.col(idx) < F.col(end)]
    if how in ("left_semi", "left_anti"):
        return rows.join(pieces, on, how)
    return rows.join(pieces, on, how).drop("_sblk", *[f"_s_{k}" for k in keys])
