"""The N best rows of every group, by bisection on an order-preserving code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.session import materialize

#: Midpoints that one pass counts at once: 2**BITS digits per group.
BITS = 8
#: Groups with more than this share of all rows meet their cutoff by broadcast; there are fewer than 1/share of them.
HOT_SHARE = 0.001


def _ordered_bits(scores: pd.Series) -> pd.Series:
    bits = (scores.to_numpy("float64") + 0.0).view("int64")
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFF_FFFF_FFFF_FFFF), bits))


def _digit(code: Column, low: Column, high: Column) -> Column:
    """Which of at most 2**BITS equal slices of [low, high] holds ``code``; never decreasing in ``code``."""
    width = F.when(low == high, 0).otherwise(F.length(F.bin(low.bitwiseXOR(high))))
    shift = F.greatest(F.lit(0), width - BITS).cast("int")
    return F.call_function("shiftright", code, shift) - F.call_function("shiftright", low, shift)


def _resolve(counts: DataFrame, group: list[str]) -> DataFrame:
    """From (group, need, digit, rows, low, high) the next state of every group.

    ``cut`` is the code up to which all rows are taken. ``need`` is what still
    has to come out of the codes low..high behind it; 0 when the cut is final.
    """
    order = Window.partitionBy(*group).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = counts.withColumn("upto", F.sum("rows").over(order)).withColumn("before", F.col("upto") - F.col("rows"))
    split = (F.col("before") < F.col("need")) & (F.col("upto") > F.col("need"))
    whole = F.col("upto") <= F.col("need")
    state = seen.filter(F.col("before") < F.col("need")).groupBy(*group).agg(
        F.max(F.when(whole, F.col("high"))).alias("cut"),
        F.max(F.when(split, F.col("need") - F.col("before"))).alias("left"),
        F.max(F.when(split, F.col("low"))).alias("low"),
        F.max(F.when(split, F.col("high"))).alias("high"),
        F.max("need").alias("__n"),
    )
    stuck = F.col("low") == F.col("high")
    return state.select(
        *group,
        F.when(stuck, F.col("high")).otherwise(F.col("cut")).alias("cut"),
        F.when(stuck, 0).otherwise(F.coalesce("left", F.lit(0))).alias("need"),
        "low",
        "high",
    )


def _count(rows: DataFrame, group: list[str]) -> DataFrame:
    code = F.struct("c", "i")
    return rows.groupBy(*group, "need", "digit").agg(F.count(F.lit(1)).alias("rows"), F.min(code).alias("low"), F.max(code).alias("high"))


def _meet(rows: DataFrame, states: DataFrame, hot: DataFrame, group: list[str]) -> DataFrame:
    """Each row with its group's state; the few hot groups by broadcast, the others shuffled: there is a state per group."""
    marked = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), group, "left")
    hot_states = states.join(F.broadcast(hot), group, "left_semi")
    cold = marked.filter(F.col("__hot").isNull()).drop("__hot").join(states.join(F.broadcast(hot), group, "left_anti").hint("merge"), group)
    return marked.filter("__hot").drop("__hot").join(F.broadcast(hot_states), group).unionByName(cold)


def cutoffs(codes: DataFrame, group: list[str], n: int, hot: DataFrame) -> DataFrame:
    """For every group the code (struct c, i) of its n-th row, or of its last.

    All groups are bisected at the same time. The first pass counts rows by
    the top bits of the score code; every later pass cuts the undecided codes
    of each unfinished group into 2**BITS slices, counts the rows in each and
    keeps the slice in which the n-th row lies. Only the rows of that slice
    are read again, so the passes shrink quickly. A group is finished when a
    cut leaves exactly n rows.
    """
    first = codes.withColumn("need", F.lit(n).cast("bigint")).withColumn("digit", F.shiftright("c", 52).cast("bigint"))
    states = materialize(_resolve(_count(first, group), group), "topn-cuts")
    done, rows = [states.filter("need = 0").select(*group, "cut")], codes
    open_states = states.filter("need > 0")
    while not open_states.isEmpty():
        inside = F.struct("c", "i").between(F.col("low"), F.col("high"))
        rows = materialize(_meet(rows, open_states.drop("cut"), hot, group).filter(inside), "topn-rows")
        by_score = F.col("low.c") != F.col("high.c")
        digit = F.when(by_score, _digit(F.col("c"), F.col("low.c"), F.col("high.c"))).otherwise(_digit(F.col("i"), F.col("low.i"), F.col("high.i")))
        counted = _count(rows.withColumn("digit", digit), group)
        states = materialize(_resolve(counted, group), "topn-cuts")
        earlier = open_states.select(*group, F.col("cut").alias("__earlier"))
        states = states.join(earlier.hint("merge"), group).withColumn("cut", F.coalesce("cut", "__earlier")).drop("__earlier")
        done.append(states.filter("need = 0").select(*group, "cut"))
        open_states = states.filter("need > 0")
        rows = rows.select(*group, "c", "i")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def top_n(df: DataFrame, group: str, score: str, ident: str, n: int, ascending: bool = True, unique: bool = False) -> DataFrame:
    """(group, rank_no, ident): of every group the ``n`` rows best by ``score``, then by smallest ``ident``.

    Rows whose group, score or ident is null, or whose score is NaN, take no
    part; infinite scores are ordinary. Rows alike in group, score and ident
    count once; say ``unique`` if there are none, which saves a shuffle. Groups of at most ``n`` rows come out whole. An empty table
    gives no rows. Other columns are ignored. ``ident`` is of an integer type.
    """
    usable = df.select(F.col(group).alias("g"), F.col(score).cast("double").alias("s"), F.col(ident).cast("bigint").alias("i")).filter("g is not null and s is not null and not isnan(s) and i is not null")
    bits = F.pandas_udf(_ordered_bits, "bigint")("s")
    codes = usable.select("g", (bits if ascending else F.bitwise_not(bits)).alias("c"), "i")
    codes = materialize(codes if unique else codes.distinct(), "topn-codes")
    sizes = codes.groupBy("g").count()
    total = codes.count()
    hot = materialize(sizes.filter(F.col("count") > max(1000, total * HOT_SHARE)).select("g"), "topn-hot")
    cuts = cutoffs(codes, ["g"], n, hot)
    kept = _meet(codes, cuts, hot, ["g"]).filter(F.struct("c", "i") <= F.col("cut")).select("g", "c", "i")
    rank = F.row_number().over(Window.partitionBy("g").orderBy("c", "i"))
    return kept.withColumn("rank_no", rank).filter(F.col("rank_no") <= n).select(F.col("g").alias(group), "rank_no", F.col("i").alias(ident))
