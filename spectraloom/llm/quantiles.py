"""Percentiles per group from mergeable rank-interval summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.session import materialize

#: Summaries that one merge takes at most.
FAN_IN = 64
#: Values of one key that a task holds before it summarises them.
CHUNK = 131_072

#: Steps in which the permitted error is used up; more of them keep more tuples.
LEVELS = 8

#: A summary: tuples (value, le, lt) in order of value, where at least ``le`` of
#: the ``n`` values are <= value and at most ``lt`` are < value. The rank error
#: of an answer follows from the tuples; it is 0 where le and lt are exact.
_FIELDS = "n bigint, value array<double>, le array<bigint>, lt array<bigint>"


def summarise(values: np.ndarray, epsilon: float) -> tuple:
    """The exact summary of ``values``, compressed for the first time."""
    distinct, counts = np.unique(values, return_counts=True)
    le = np.cumsum(counts)
    return compress((len(values), distinct, le, le - counts), epsilon)


def slack(summary: tuple) -> int:
    """Most ranks that lie open between two neighbouring tuples; no answer is off by more than half of it, rounded up."""
    _, value, le, lt = summary
    return int(max(0, (lt[1:] - le[:-1]).max())) if len(value) > 1 else 0


def compress(summary: tuple, epsilon: float) -> tuple:
    """Leaves out tuples as far as the permitted uncertainty allows.

    Between two kept tuples at most 2 epsilon n - 1 ranks may lie open, so
    that every rank has an answer that is off by epsilon n at most. Each
    compression takes one of LEVELS steps towards that bound and none beyond
    it: merging adds up the open ranks of the parts as it adds up their n.
    """
    n, value, le, lt = summary
    open_ranks = int(min(2 * epsilon * n - 1, slack(summary) + 2 * epsilon * n / LEVELS))
    if open_ranks < 1 or len(value) < 3:
        return summary
    # From each tuple the farthest one that may follow it.
    follow = np.maximum(np.searchsorted(lt, le + open_ranks, side="right") - 1, np.arange(1, len(le) + 1))
    kept = [0]
    while kept[-1] < len(value) - 1:
        kept.append(min(int(follow[kept[-1]]), len(value) - 1))
    return n, value[kept], le[kept], lt[kept]


def merge(summaries: Sequence[tuple], epsilon: float) -> tuple:
    """One summary of all the values: the bounds of a value add up over the parts, then ``compress``."""
    value = np.unique(np.concatenate([s[1] for s in summaries]))
    le, lt, total = np.zeros(len(value), "int64"), np.zeros(len(value), "int64"), 0
    for n, own, own_le, own_lt in summaries:
        below = np.searchsorted(own, value, side="right")
        le += np.where(below > 0, own_le[np.maximum(below - 1, 0)], 0)
        above = np.searchsorted(own, value, side="left")
        lt += np.where(above < len(own), own_lt[np.minimum(above, len(own) - 1)], n)
        total += n
    return compress((total, value, le, lt), epsilon)


def pile_up(pile: list[list[tuple]], summary: tuple, epsilon: float) -> None:
    """Adds a summary to the lowest level of ``pile``; FAN_IN of one level become one of the next, so that a value goes through few compressions."""
    for level in range(len(pile) + 1):
        if level == len(pile):
            pile.append([])
        pile[level].append(summary)
        if len(pile[level]) < FAN_IN:
            return
        summary, pile[level] = merge(pile[level], epsilon), []


def whole_pile(pile: list[list[tuple]], epsilon: float) -> tuple:
    rest = [s for level in pile for s in level]
    return rest[0] if len(rest) == 1 else merge(rest, epsilon)


def answer(summary: tuple, probs: Sequence[float]) -> list[tuple[float, float, int, int]]:
    """(prob, value, rank, error): the best known value for rank ceil(p n), and by how many ranks it may be off."""
    n, value, le, lt = summary
    out = []
    for p in probs:
        rank = max(1, int(np.ceil(p * n - 1e-9)))
        error = np.maximum(0, np.maximum(lt + 1 - rank, rank - le))
        at = int(error.argmin())
        out.append((p, float(value[at]), rank, int(error[at])))
    return out


def _row(key: tuple, summary: tuple) -> tuple:
    n, value, le, lt = summary
    return (*key, n, value, le, lt)


def _load(rows: pd.DataFrame) -> list[tuple]:
    return [(int(n), np.asarray(v), np.asarray(a), np.asarray(b)) for n, v, a, b in zip(rows["n"], rows["value"], rows["le"], rows["lt"])]


def day_summaries(df: DataFrame, group: str, columns: Sequence[str], day: str, epsilon: float) -> DataFrame:
    """(grp, day, measure, n, value, le, lt): one summary per group, day and column, whose answers are off by ``epsilon`` n ranks at most.

    Every task summarises its own rows; the parts are then merged FAN_IN at a
    time, by levels, so that no task ever holds more than FAN_IN summaries.
    Nulls and NaN are left aside; infinities count as values. A null group or
    day is a group or day of its own. Columns that are empty for a group and
    day have no row, and an empty table gives none.
    """
    kind = dict(df.dtypes)[group]
    rows = df.select(F.col(group).alias("grp"), F.to_date(F.col(day)).alias("day"), *[F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(columns)])
    schema = f"grp {kind}, day date, measure string, part int, {_FIELDS}"

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        waiting: dict[tuple, list[np.ndarray]] = {}
        held: dict[tuple, int] = {}
        done: dict[tuple, list[list[tuple]]] = {}

        def settle(key: tuple) -> None:
            pile_up(done.setdefault(key, []), summarise(np.concatenate(waiting.pop(key)), epsilon), epsilon)
            held[key] = 0

        for batch in batches:
            for (grp, date), own in batch.groupby(["grp", "day"], dropna=False, sort=False):
                for k, name in enumerate(columns):
                    values = own[f"m{k}"].to_numpy("float64")
                    values = values[~np.isnan(values)]
                    if len(values):
                        key = (None if pd.isna(grp) else grp, None if pd.isna(date) else date, name, part)
                        waiting.setdefault(key, []).append(values)
                        held[key] = held.get(key, 0) + len(values)
                        if held[key] >= CHUNK:
                            settle(key)
        for key in list(waiting):
            settle(key)
        names = ["grp", "day", "measure", "part", "n", "value", "le", "lt"]
        yield pd.DataFrame([_row(key, whole_pile(pile, epsilon)) for key, pile in done.items()], columns=names)

    parts = materialize(rows.mapInPandas(leaves, schema), "quantile-leaves")
    return _merged(parts, ["grp", "day", "measure"], parts.agg(F.max("part")).first()[0] or 0, epsilon)


def _merged(parts: DataFrame, keys: list[str], highest: int, epsilon: float) -> DataFrame:
    """Merges the summaries of each key over ``part`` (0..highest), FAN_IN at a time."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.select(*keys).schema) + f", part int, {_FIELDS}"

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        merged = merge(_load(rows), epsilon)
        return pd.DataFrame([_row((*(rows[k].iloc[0] for k in keys), int(rows["part"].iloc[0])), merged)], columns=[*keys, "part", "n", "value", "le", "lt"])

    while True:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy(*keys, "part").applyInPandas(combine, schema)
        highest //= FAN_IN
        if highest == 0:
            return parts.drop("part")


def percentiles(summaries: DataFrame, probs: Sequence[float], epsilon: float) -> DataFrame:
    """(grp, measure, prob, value, rank_no, rank_error, n) over whatever days ``summaries`` holds.

    ``value`` is a value of the data whose rank is off by ``rank_error`` at
    most, counted over ties in its favour. Select the days before the call:
    ``percentiles(days.filter("day >= '2025-03-10'"), ...)``.
    """
    whole = whole_summaries(summaries, epsilon)
    kind = dict(summaries.dtypes)["grp"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(grp, measure, *found, summary[0]) for grp, measure, summary in zip(batch["grp"], batch["measure"], _load(batch)) for found in answer(summary, probs)]
            yield pd.DataFrame(rows, columns=["grp", "measure", "prob", "value", "rank_no", "rank_error", "n"])

    return whole.mapInPandas(read, f"grp {kind}, measure string, prob double, value double, rank_no bigint, rank_error bigint, n bigint")


#: Tuples of all summaries together that go to every executor at most (about 7 MB); more of them meet their rows in bounded groups.
MAX_BROADCAST_TUPLES = 300_000
#: Rows of one group that a task ranks at once when the summaries are not broadcast.
RANK_ROWS = 200_000


def whole_summaries(summaries: DataFrame, epsilon: float) -> DataFrame:
    """(grp, measure, n, value, le, lt): the summaries of ``day_summaries`` merged over their days."""
    first = summaries.agg(F.min("day"), F.max("day")).first()
    span = (first[1] - first[0]).days if first[0] else 0
    # Part 0 is the null day; the others follow by date.
    part = F.when(F.col("day").isNull(), 0).otherwise(F.date_diff(F.col("day"), F.lit(first[0])) + 1)
    return _merged(summaries.withColumn("part", part.cast("int")).drop("day"), ["grp", "measure"], span + 1, epsilon)


def place(values: np.ndarray, summary: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each value: at least how many of the summarised values are below it, and at most how many are not above it."""
    n, value, le, lt = summary
    below = np.searchsorted(value, values, side="left")
    above = np.searchsorted(value, values, side="right")
    return np.where(below > 0, le[np.maximum(below - 1, 0)], 0), np.where(above < len(value), lt[np.minimum(above, len(value) - 1)], n)


def ranks(df: DataFrame, group: str, columns: Sequence[str], whole: DataFrame, keep: Sequence[str], max_tuples: int = MAX_BROADCAST_TUPLES, rank_rows: int = RANK_ROWS) -> DataFrame:
    """For every row and each of ``columns`` with a value: the ``keep`` columns, ``grp``, ``measure``, ``x``, ``rank_low``, ``rank_high``, ``n``.

    The value's ranks in its group lie in rank_low + 1 .. rank_high. Values
    that are null or NaN are left out, as are groups that ``whole`` lacks. A
    kept column of one of these names comes out with an underscore behind it.
    """
    needed = whole.filter(F.col("measure").isin(list(columns))).select("grp", "measure", "n", "value", "le", "lt")
    own = {"grp", "measure", "x", "rank_low", "rank_high", "n", "salt"}
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns]))
    kept = [c + "_" if c in own else c for c in keep]
    rows = df.select(*[F.col(c).alias(name) for c, name in zip(keep, kept)], F.col(group).alias("grp"), values.alias("__v")).select(*kept, "grp", "__v.measure", "__v.x").filter("x is not null and not isnan(x)")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", rank_low bigint, rank_high bigint, n bigint"
    name = lambda grp: None if pd.isna(grp) else grp

    def ranked(own: pd.DataFrame, summary: tuple) -> pd.DataFrame:
        low, high = place(own["x"].to_numpy(), summary)
        return own.assign(rank_low=low, rank_high=high, n=summary[0])

    if (needed.agg(F.sum(F.size("value"))).first()[0] or 0) <= max_tuples:
        met = needed.toArrow().to_pandas()
        known = {(name(grp), measure): summary for grp, measure, summary in zip(met["grp"], met["measure"], _load(met))}
        shipped = df.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for (grp, measure), own in batch.groupby(["grp", "measure"], dropna=False, sort=False):
                    if (name(grp), measure) in shipped.value:
                        yield ranked(own, shipped.value[name(grp), measure])

        return rows.mapInPandas(run, schema)

    # Groups of more than rank_rows values are split by a hash of the row, the same one if a task is run again.
    wide = needed.filter(F.col("n") > rank_rows).select(F.col("grp").alias("__grp"), F.col("measure").alias("__measure"), F.ceil(F.col("n") / rank_rows).cast("int").alias("__salts"))
    same = F.col("grp").eqNullSafe(F.col("__grp")) & (F.col("measure") == F.col("__measure"))
    # There are at most (values / rank_rows) of them; the shuffle of so few keys would be as skewed as they are.
    wide = F.broadcast(wide) if wide.limit(max_tuples + 1).count() <= max_tuples else wide
    salt = F.pmod(F.xxhash64(*kept, "x"), F.coalesce("__salts", F.lit(1))).cast("int")
    salted = rows.join(wide, same, "left").withColumn("salt", salt).drop("__grp", "__measure", "__salts")
    copies = needed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / rank_rows).cast("int") - 1)))

    def both(own: pd.DataFrame, summary: pd.DataFrame) -> pd.DataFrame:
        if own.empty or summary.empty:
            return own.drop(columns="salt").assign(rank_low=0, rank_high=0, n=0).iloc[:0]
        return ranked(own.drop(columns="salt"), _load(summary)[0])

    keys = ["grp", "measure", "salt"]
    return salted.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(both, schema)
