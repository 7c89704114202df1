"""Grouped aggregation, optionally resampled to calendar periods with gap filling."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.operators.ordered import same_keys
from stockflow.operators.quantiles import exact_quantiles

@dataclass(frozen=True)
class Mergeable:
    """A user's aggregate in steps that need no group in one place; a state is a list of numbers.

    ``update(state, values)`` takes some of a group's values (nulls left out, as doubles), ``merge(a, b)`` joins two states, ``finish``
    makes the result of one; ``init`` is the state of no values.
    """

    name: str
    init: Sequence[float]
    update: Callable[[list, np.ndarray], list]
    merge: Callable[[list, list], list]
    finish: Callable[[list], "float | None"]


Spec = dict[str, "str | Mergeable | Callable[[Column], Column] | Sequence"]
#: Groups that a task holds the states of before it passes them on.
HELD = 100_000

FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "nunique": F.count_distinct,
}
# What an empty calendar period yields; every other function yields NULL.
EMPTY = {"sum": 0, "count": 0, "nunique": 0}
TRUNC = {"D": "day", "W": "week", "M": "month"}


def _named(agg: Spec) -> list[tuple[str, str, Callable[[Column], Column] | None, str]]:
    """(column, function name, column factory, output name); one function per column keeps the column's name."""
    out = []
    for column, spec in agg.items():
        many, seen = not (isinstance(spec, str | Mergeable) or callable(spec)), Counter()
        for fn in spec if many else [spec]:
            name = fn if isinstance(fn, str) else fn.name if isinstance(fn, Mergeable) else getattr(fn, "__name__", "user")
            seen[name] += 1
            name += f"_{seen[name]}" if seen[name] > 1 else ""
            if isinstance(fn, str) and fn != "median" and fn not in FUNCTIONS:
                raise ValueError(f"unknown aggregate {fn!r}")
            factory = None if fn == "median" else FUNCTIONS[fn] if isinstance(fn, str) else fn
            out.append((column, name, factory, f"{column}_{name}" if many else column))
    return out


def _is_pandas(make: Callable) -> bool:
    """Whether an aggregate is a user's pandas function rather than a maker of built-in columns."""
    return hasattr(make, "evalType")


def _is_plain(make) -> bool:
    return make is not None and not isinstance(make, Mergeable) and not _is_pandas(make)


def merged(df: DataFrame, keys: Sequence[str], specs: Sequence[tuple[str, Mergeable, str]]) -> DataFrame:
    """``keys`` and a double for each (column, aggregate, output name).

    Each task turns its rows into one row of states for each of its groups (a task of many groups passes them on in portions of
    ``HELD``); these rows are sorted by key and merged as they stream by.  No task holds a group, however many rows it has.
    """
    keys, columns = list(keys), list(dict.fromkeys(c for c, _, _ in specs))
    names = [f"_state_{i}" for i in range(len(specs))]
    inputs = df.select(*keys, *[F.col(c).cast("double").alias(f"_in_{c}") for c in columns])
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def states(held: dict, kinds: list[pa.DataType]) -> pa.RecordBatch:
        arrays = [pa.array([k[i] for k in held], kind) for i, kind in enumerate(kinds)]
        arrays += [pa.array([v[i] for v in held.values()], pa.list_(pa.float64())) for i in range(len(specs))]
        return pa.RecordBatch.from_arrays(arrays, [*keys, *names])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = {}, []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            code = np.zeros(len(batch), np.int64)
            for k in keys:
                encoded = batch[k].dictionary_encode(null_encoding="encode")
                # Codes stay below the number of rows, so that they never overflow.
                _, code = np.unique(code * len(encoded.dictionary) + encoded.indices.to_numpy(), return_inverse=True)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            found = [tuple(x) for x in zip(*[batch[k].take(pa.array(order[starts])).to_pylist() for k in keys])]
            values = {c: batch[f"_in_{c}"].to_numpy(zero_copy_only=False)[order] for c in columns}
            known = {c: batch[f"_in_{c}"].is_valid().to_numpy(zero_copy_only=False)[order] for c in columns}
            for key, a, b in zip(found, starts, [*starts[1:], len(order)]):
                state = held.get(key) or [list(m.init) for _, m, _ in specs]
                held[key] = [list(m.update(own, values[c][a:b][known[c][a:b]])) for own, (c, m, _) in zip(state, specs)]
            if len(held) >= HELD:
                yield states(held, kinds)
                held = {}
        if held:
            yield states(held, kinds)

    def finished(done: list, kinds: list[pa.DataType]) -> pa.RecordBatch:
        arrays = [pa.array([k[i] for k, _ in done], kind) for i, kind in enumerate(kinds)]
        arrays += [pa.array([m.finish(state[i]) for _, state in done], pa.float64()) for i, (_, m, _) in enumerate(specs)]
        return pa.RecordBatch.from_arrays(arrays, [*keys, *[out for _, _, out in specs]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kinds = None, []
        for batch in batches:
            kinds, done = [batch.schema.field(k).type for k in keys], []
            for row in zip(zip(*[batch[k].to_pylist() for k in keys]), zip(*[batch[n].to_pylist() for n in names])):
                if last is not None and last[0] == row[0]:
                    last = (last[0], [list(m.merge(a, b)) for a, b, (_, m, _) in zip(last[1], row[1], specs)])
                else:
                    done += [last] if last is not None else []
                    last = row
            yield finished(done, kinds)
        if last is not None:
            yield finished([last], kinds)

    partials = inputs.mapInArrow(partial, types + "".join(f", {n} array<double>" for n in names))
    sorted_ = partials.repartition(*keys).sortWithinPartitions(*keys)
    return sorted_.mapInArrow(merge, types + "".join(f", `{out}` double" for _, _, out in specs))


def _grouped(df: DataFrame, keys: Sequence[str], agg: Spec) -> DataFrame:
    specs = _named(agg)
    plain = [make(F.col(c)).alias(f"_out_{out}") for c, _, make, out in specs if _is_plain(make)]
    users = [make(F.col(c)).alias(f"_out_{out}") for c, _, make, out in specs if make is not None and _is_pandas(make)]
    steps = [(c, make, f"_out_{out}") for c, _, make, out in specs if isinstance(make, Mergeable)]
    medians = [(c, out) for c, _, make, out in specs if make is None]
    result = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    if steps:
        result = same_keys(result, merged(df, keys, steps), list(keys))
    if users:  # Spark does not mix them with built-in aggregates
        result = same_keys(result, df.groupBy(*keys).agg(*users), list(keys))
    if medians:
        columns = list(dict.fromkeys(c for c, _ in medians))
        quantiles = exact_quantiles(df, columns, [0.5], keys).select(
            *keys, *[F.get(F.col(c), F.lit(0)).alias(f"_out_{out}") for c, out in medians]
        )
        result = same_keys(result, quantiles, list(keys), "left")
    return result.select(*keys, *[F.col(f"_out_{out}").alias(out) for _, _, _, out in specs])


def aggregate(df: DataFrame, group_by: Sequence[str], agg: Spec, time_freq: str | None = None, date_col: str = "order_date") -> DataFrame:
    """Group by ``group_by`` (rows with a NULL key are left out) and aggregate.

    A function is a name, a maker of a built-in aggregate column, or a user's own: in steps (``Mergeable``), for groups of any size, or
    a pandas function, which gets a whole group as one series and so is for groups that fit a task.

    With ``time_freq`` 'D', 'W' (labelled by its Sunday) or 'M' (labelled by the month's last day) every
    period between a group's first and last one appears, also empty ones.
    """
    keys = list(group_by)
    rows = df.dropna(subset=keys)
    if time_freq is None or date_col not in df.columns:
        return _grouped(rows, keys, agg)
    unit = TRUNC[time_freq]
    period = F.to_date(F.date_trunc(unit, F.col(date_col)))
    found = _grouped(rows.dropna(subset=[date_col]).withColumn("_period", period), [*keys, "_period"], agg)
    step = F.expr(f"interval 1 {unit}")
    periods = (
        found.groupBy(*keys)
        .agg(F.min("_period").alias("_lo"), F.max("_period").alias("_hi"))
        .select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias("_period"))
    )
    label = {"D": F.col("_period"), "W": F.date_add("_period", 6), "M": F.last_day("_period")}[time_freq]
    filled = [
        (F.coalesce(F.col(out), F.lit(EMPTY[name])) if name in EMPTY else F.col(out)).alias(out) for _, name, _, out in _named(agg)
    ]
    return periods.join(found, [*keys, "_period"], "left").select(*keys, label.alias(date_col), *filled)
