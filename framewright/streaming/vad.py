"""Voice activity over unbounded streams, one state per key.

Rows of a key are worked on by position. As files may arrive in any order, the last `hold` rows of each key wait in the
state for earlier ones. What is still waiting when an input is finished is read from the state by `events_left` and
`samples_left`, which leave the state as it is, so that the stream may go on later.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState

#: The gate after `current` rows up to position `last_pos`, and the rows that wait, by position.
STATE = "triggered boolean, temp_end bigint, current bigint, last_pos bigint, pos array<bigint>, p array<double>, x array<double>"
START = (False, 0, 0, -(1 << 63), [], [], [])
EVENTS, SAMPLES = "sid bigint, kind string, at bigint", "sid bigint, pos bigint, x double, late boolean"
#: Rows of a key that wait for earlier ones unless the caller says otherwise.
HOLD = 4096
FAR = 1 << 62


def _advance(gate: tuple, rows: pd.DataFrame, threshold: float, min_silence: int, pad: int, mask: bool) -> tuple[tuple, pd.DataFrame]:
    """The gate after `rows`, which are in order, and what it puts out.

    It opens at a probability at or above the threshold and closes after enough silence. Only loud rows and the first
    quiet rows after them matter, so the work is on arrays of those.
    """
    triggered, temp_end, current = gate
    p, n = rows["p"].to_numpy(float), len(rows)
    at = current + 1 + np.arange(n)
    quiet = np.append(at[p < threshold - 0.15], FAR)
    # each loud row, or the one that opened the segment before: where silence begins after it, and where it shuts
    loud = np.concatenate([np.full(int(triggered), current), at[p >= threshold]]).astype(np.int64)
    silent = quiet[np.searchsorted(quiet, loud, side="right")]
    if triggered and temp_end:
        silent[0] = temp_end
    shut = quiet[np.searchsorted(quiet, np.minimum(silent + min_silence, FAR))]
    closes = shut < np.append(loud[1:], FAR)[: len(loud)]
    opens = np.concatenate([[not triggered], closes[:-1]])[: len(loud)].astype(bool)
    if mask:
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, loud[opens] - current - 1, 1)
        np.add.at(change, shut[closes] - current - 1, -1)
        on = int(triggered) + np.cumsum(change[:n]) > 0
        out = pd.DataFrame({"pos": rows["pos"].to_numpy(), "x": np.where(on, rows["x"].to_numpy(float), 0.0), "late": False})
    else:
        when = np.concatenate([loud[opens], shut[closes]])
        order = np.argsort(when, kind="stable")
        kinds = np.repeat(np.array(["start", "end"], object), [opens.sum(), closes.sum()])[order]
        out = pd.DataFrame({"kind": pd.Series(kinds, dtype=object), "at": np.concatenate([loud[opens] - pad, silent[closes] + pad])[order]})
    still = bool(len(loud)) and not closes[-1]
    waiting = int(silent[-1]) if still and silent[-1] < FAR else 0
    return (still, waiting, current + n), out


def _gate(key, batches: Iterator[pd.DataFrame], state: GroupState, hold: int, mask: bool, **rule):
    triggered, temp_end, current, last_pos, *held = state.get if state.exists else START
    new = pd.concat(list(batches), ignore_index=True)[["pos", "p", "x"]]
    timely = new["pos"] > last_pos
    late = new[~timely]  # or without a position
    waiting = pd.DataFrame({name: np.asarray(v, kind) for name, v, kind in zip(("pos", "p", "x"), held, (np.int64, float, float))})
    rows = pd.concat([waiting, new[timely].astype({"pos": np.int64})]).drop_duplicates("pos").sort_values("pos")
    ready, kept = rows.iloc[: max(0, len(rows) - hold)], rows.iloc[max(0, len(rows) - hold) :]
    gate, out = _advance((triggered, temp_end, current), ready, mask=mask, **rule)
    last_pos = int(ready["pos"].iloc[-1]) if len(ready) else last_pos
    state.update((*gate, last_pos, *[kept[c].tolist() for c in ("pos", "p", "x")]))
    if mask:
        side = late[["pos", "x"]].assign(late=True)
    else:
        side = pd.DataFrame({"kind": pd.Series("late", late.index, object), "at": late["pos"]})
    found = pd.concat([f for f in (out, side) if len(f)] or [out])
    found.insert(0, "sid", key[0])
    yield found


RULE = {"threshold": 0.5, "min_silence": 2, "pad": 1}


def _run(chunks: DataFrame, schema: str, hold: int, mask: bool, rule: dict) -> DataFrame:
    step = partial(_gate, hold=hold, mask=mask, **RULE | rule)
    return chunks.groupBy("sid").applyInPandasWithState(step, schema, STATE, "append", "NoTimeout")


def _left(spark: SparkSession, path: str, schema: str, mask: bool, rule: dict) -> DataFrame:
    files = f"{path}/checkpoint/state"
    target = spark._jvm.org.apache.hadoop.fs.Path(files)
    if not target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
        return spark.createDataFrame([], schema)  # no batch has run
    held = spark.read.format("statestore").load(f"{path}/checkpoint").selectExpr("key.sid AS sid", "value.groupState.*")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples():
                rows = pd.DataFrame({"pos": s.pos, "p": s.p, "x": s.x})
                _, out = _advance((s.triggered, s.temp_end, s.current), rows, mask=mask, **RULE | rule)
                out.insert(0, "sid", s.sid)
                yield out

    return held.mapInPandas(finish, schema)


def speech_events(chunks: DataFrame, hold: int = HOLD, **rule) -> DataFrame:
    """sid, kind ("start", "end" or "late"), at: from a stream of sid, pos, p, x. A segment still open emits no end.

    A row may come after up to `hold` rows of its key that follow it; the first arrival of a position counts. One that comes
    later still, or repeats a position worked on long ago, is put out as kind "late" with its position and changes nothing.
    """
    return _run(chunks, EVENTS, hold, False, rule)


def events_left(spark: SparkSession, path: str, **rule) -> DataFrame:
    """What `speech_events`, drained to `path` with the same rule, would put out if no row followed."""
    return _left(spark, path, EVENTS, False, rule)


def masked_samples(chunks: DataFrame, hold: int = HOLD, **rule) -> DataFrame:
    """sid, pos, x, late: samples zeroed while no segment is open. Rows later than `hold` allows keep their x and are marked."""
    return _run(chunks, SAMPLES, hold, True, rule)


def samples_left(spark: SparkSession, path: str, **rule) -> DataFrame:
    """What `masked_samples`, drained to `path` with the same rule, would put out if no row followed."""
    return _left(spark, path, SAMPLES, True, rule)
