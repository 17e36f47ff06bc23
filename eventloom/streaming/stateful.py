"""Recursive per-key operators: one step function serves tables (sorted partitions) and streams (keyed state)."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship

Step = Callable[[object, dict], tuple[object, tuple | None]]


class Operator(NamedTuple):
    """A fold over each key's rows: see ``run_keyed``; ``needs``: the members that ``step`` reads (None: all); ``expires``: the
    time (epoch seconds) after which a state is as good as none, given the state."""

    start: Callable[[], object]
    step: Step
    made: str
    needs: tuple[str, ...] | None = None
    expires: Callable[[object], float | None] | None = None


def run_keyed(df: DataFrame, key: str, start: Callable[[], object], step: Step, made: str, order: str = "event_id", needs: tuple[str, ...] | None = None) -> DataFrame:
    """Folds ``step(state, row) -> (state, new values or None to drop the row)`` over each key's rows in order.

    Rows stream through partitions dealt by key and sorted, so a task holds one key's state, never its rows; only the
    members in ``needs`` become Python values.
    """
    ship(df.sparkSession)
    extra = T._parse_datatype_string(made)
    out = T.StructType([*df.schema.fields, *extra.fields])
    names, new = df.columns, [f.name for f in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, begun = None, None, False
        for b in batches:
            rows = (b if needs is None else b.select(list(dict.fromkeys(needs)))).to_pylist()
            keep, values = [], []
            for i, (r, k) in enumerate(zip(rows, b.column(key).to_pylist(), strict=True)):
                if not begun or k != now:
                    state, now, begun = start(), k, True
                state, v = step(state, r)
                if v is not None:
                    keep.append(i)
                    values.append(v)
            if keep:
                kept = b.take(pa.array(keep))
                cols = [pa.array(list(c)) for c in zip(*values, strict=True)] if new else []
                cols = [c.cast(_arrow(f.dataType)) for c, f in zip(cols, extra, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *cols], names=[*names, *new])

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, out)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def run_stream(df: DataFrame, key: str, start: Callable[[], object], step: Step, made: str, order: str = "event_id", expires: Callable[[object], float | None] | None = None) -> DataFrame:
    """``run_keyed`` on a stream: the state lives in the state store, rows are ordered within a micro-batch.

    With ``expires`` on a stream with a watermark a key's state is dropped once the watermark has passed the time it gives.
    """
    timed = expires is not None and any("spark.watermarkDelayMs" in f.metadata for f in df.schema)
    extra = T._parse_datatype_string(made)
    out = T.StructType([*df.schema.fields, *extra.fields])
    names = df.columns

    def run(_key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        held = pickle.loads(state.get[0]) if state.exists else start()
        for pdf in [pd.concat(list(frames), ignore_index=True)]:
            pdf = pdf.sort_values(order, kind="stable")
            keep, values = [], []
            for i, r in zip(pdf.index, pdf.to_dict("records"), strict=True):
                held, v = step(held, {k: None if x is pd.NaT or (isinstance(x, float) and x != x) else x for k, x in r.items()})
                if v is not None:
                    keep.append(i)
                    values.append(v)
            state.update((pickle.dumps(held),))
            if timed and (at := expires(held)) is not None:
                state.setTimeoutTimestamp(max(int(at * 1000) + 1, state.getCurrentWatermarkMs() + 1))
            res = pdf.loc[keep, names].reset_index(drop=True)
            for k, f in enumerate(extra):
                res[f.name] = [v[k] for v in values]
            yield res

    return df.groupBy(key).applyInPandasWithState(run, out, "state binary", "append", "EventTimeTimeout" if timed else "NoTimeout")


# ---- step functions ----


def uniq_expire(seconds: float, time: str = "ts") -> Operator:
    """A key passes if it is new or the expiry set when it last passed is over; repeats don't extend it."""

    def step(state, row):
        now = row[time].timestamp()
        if state is None or state < now:
            return now + seconds, ()
        return state, None

    return Operator(lambda: None, step, "", (time,), lambda state: state)


def first_n_expire(n: int, seconds: float, time: str = "ts") -> Operator:
    """The first n rows of a key; counting starts again once ``seconds`` have passed since the first one."""

    def step(state, row):
        now = row[time].timestamp()
        if state is None or now >= state[1]:
            state = (0, now + seconds)
        state = (state[0] + 1, state[1])
        return state, ((state[0],) if state[0] <= n else None)

    return Operator(lambda: None, step, "COUNT long", (time,), lambda state: state and state[1])


def until_n_expire(n: int, seconds: float, time: str = "ts") -> Operator:
    """The rows of a key after the first n; counting starts again once ``seconds`` have passed since the first one."""
    counted = first_n_expire(n, seconds, time)

    def step(state, row):
        state, passed = counted.step(state, row)
        return state, None if passed is not None else ()

    return counted._replace(step=step, made="")


def clamped_climb(weight: Callable[[dict], float], threshold: float = 10, high: float = 100, low: float = -100, reset: bool = False, tag: bool = False) -> Operator:
    """A key's score, clamped after each step; rows where it exceeds the threshold before that (tag: all rows, with a flag)."""

    def step(state, row):
        s = state + weight(row)
        over = s > threshold
        if over and reset:
            s = 0.0
        s = max(low, min(high, s))
        return s, ((float(s), over) if tag or over else None)

    return Operator(lambda: 0.0, step, "SCORE double, CLIMB boolean")


def thinning(base: float = 2.0, seed: int = 0, key: str = "user_id", order: str = "event_id") -> Operator:
    """Probabilistic thinning: the first row of a key passes, later ones with probability base^-k after k passes. Seeded by key and row."""
    import hashlib

    def step(k, row):
        h = hashlib.md5(f"{seed}|{row[key]}|{row[order]}".encode(), usedforsecurity=False).hexdigest()
        if k == 0 or int(h[:12], 16) / 2**48 < base**-k:
            return k + 1, (k + 1,)
        return k, None

    return Operator(lambda: 0, step, "PASSES long", (key, order))


def periodic(bins: int = 4, hits: int = 4, tolerance: float = 0.1, floor: float = 1.0, time: str = "ts") -> Operator:
    """Inter-arrival times gather in at most ``bins`` most recently used bins; a bin with enough hits gives PERIOD and PERIOD_COUNT."""

    def step(state, row):
        now = row[time].timestamp()
        last, held = state
        if last is None:
            return (now, held), None
        d = now - last
        out = None
        for i, (mean, n) in enumerate(held):
            if abs(d - mean) <= max(floor, tolerance * mean):
                b = ((mean * n + d) / (n + 1), n + 1)
                held = [b, *held[:i], *held[i + 1 :]]
                if b[1] >= hits:
                    out = b
                break
        else:
            held = [(d, 1), *held][:bins]
        return (now, held), out

    return Operator(lambda: (None, []), step, "PERIOD double, PERIOD_COUNT long", (time,))


def edit_distance_of_key(value: str) -> Operator:
    """Levenshtein distance to the key's previous value, and over the longer length; for streams (tables: ``keyed.edit_distance``)."""

    def step(prev, row):
        v = row[value]
        if v is None:
            return prev, (None, None)
        if prev is None:
            return v, (None, None)
        d = list(range(len(v) + 1))
        for i, a in enumerate(prev, 1):
            e = [i]
            for j, b in enumerate(v, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (a != b)))
            d = e
        return v, (d[-1], d[-1] / max(1, len(v), len(prev)))

    return Operator(lambda: None, step, "EDITDISTANCE long, EDITNORM double", (value,))


def apply(df: DataFrame, key: str, operator: tuple, order: str = "event_id") -> DataFrame:
    """One of the operators above on a table or a stream."""
    op = Operator(*operator)
    rows = df.where(F.col(key).isNotNull())
    if df.isStreaming:
        return run_stream(rows, key, op.start, op.step, op.made, order, op.expires)
    return run_keyed(rows, key, op.start, op.step, op.made, order, op.needs)
