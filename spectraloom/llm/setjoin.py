"""All pairs of similar sets, exactly, by metric pivot partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.session import fits, materialize

#: Values that all first pivots hold together at most: bounds the table that every task keeps of them.
PIVOT_VALUES = 20_000
#: Members of one side of a cell that one task compares at once.
BLOCK = 1000
#: Values that one product of incidence matrices takes at once.
SLICE = 4096
#: Values that so many right sets or fewer hold are met alone, more frequent ones with a second value.
RARE = 8
#: Sets of more values than this are met by single values only: their pairs of values would be too many.
PAIRWISE_SIZE = 128
#: Distinct values whose frequencies go to every executor at most (about 10 MB).
MAX_BROADCAST_VALUES = 100_000


def _near(pivots: list[list[str]], limits: dict[int, float] | None, home: float):
    """Per batch of sets: the nearest pivot within ``home`` (or -1), or, given each cell's limit, all cells to copy to."""
    ids = pd.Index(sorted({value for pivot in pivots for value in pivot}))
    places = [ids.get_indexer(pivot) for pivot in pivots]
    sizes = np.array([len(pivot) for pivot in pivots] or [0])

    def table() -> np.ndarray:
        incidence = np.zeros((len(ids) + 1, max(1, len(pivots))), dtype="int16")
        for k, at in enumerate(places):
            incidence[at, k] = 1
        return incidence

    def distances(sets: pd.Series, incidence: np.ndarray) -> np.ndarray:
        lengths = sets.map(len).to_numpy()
        flat = ids.get_indexer(np.concatenate([np.asarray(v, dtype=object) for v in sets])) if lengths.sum() else np.zeros(0, int)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        keep = flat >= 0
        overlap = np.zeros((len(lengths), incidence.shape[1]), dtype="int64")
        flat, owner = flat[keep], owner[keep]
        if len(flat):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            overlap[owner[starts]] = np.add.reduceat(incidence[flat], starts, axis=0, dtype="int64")
        return 1 - overlap / np.maximum(lengths[:, None] + sizes[None, :] - overlap, 1)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        incidence = table()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                yield part, distances(part["set"], incidence)

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, far in parts(batches):
            cell = far.argmin(axis=1)
            least = far[np.arange(len(cell)), cell]
            yield part.assign(cell=np.where((least <= home) & bool(pivots), cell, -1).astype("int32"), distance=least)

    def copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bound = np.array([limits.get(k, -1.0) for k in range(len(pivots))] or [-1.0])
        for part, far in parts(batches):
            row, cell = np.nonzero(far <= bound[None, :])
            yield part.iloc[row].assign(cell=cell.astype("int32"))

    return homes if limits is None else copies


def _exact(threshold: float):
    """Joins two blocks of one cell exactly: overlaps by products of incidence matrices over the values both blocks hold."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": np.zeros(0, "int64"), "b": np.zeros(0, "int64"), "jaccard": np.zeros(0)})
        common = pd.Index(np.intersect1d(np.concatenate(left["set"].to_list()), np.concatenate(right["set"].to_list())))

        def places(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            lengths = side["set"].map(len).to_numpy()
            columns = common.get_indexer(np.concatenate(side["set"].to_list()))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            return owner[columns >= 0], columns[columns >= 0], lengths

        def matrix(owner: np.ndarray, columns: np.ndarray, rows: int, first: int) -> np.ndarray:
            inside = (columns >= first) & (columns < first + SLICE)
            out = np.zeros((rows, min(SLICE, len(common) - first)), dtype="float32")
            out[owner[inside], columns[inside] - first] = 1
            return out

        (i, x, nx), (j, y, ny) = places(left), places(right)
        overlap = np.zeros((len(nx), len(ny)))
        for first in range(0, len(common), SLICE):
            overlap += np.rint(matrix(i, x, len(nx), first) @ matrix(j, y, len(ny), first).T)
        jaccard = overlap / np.maximum(nx[:, None] + ny[None, :] - overlap, 1)
        row, column = np.nonzero((jaccard >= threshold) & (overlap > 0))
        return pd.DataFrame({"a": left["id"].to_numpy()[row], "b": right["id"].to_numpy()[column], "jaccard": jaccard[row, column]})

    return run


def _in_cells(left: DataFrame, right: DataFrame, grid: DataFrame, threshold: float) -> DataFrame:
    """Exact joins within the cells; ``grid`` (cell, rows, columns) cuts a cell of many members into blocks of about BLOCK each."""
    mine = left.join(grid, "cell").withColumn("row", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int")).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    other = right.join(grid, "cell").withColumn("column", F.pmod(F.xxhash64("id"), F.col("columns")).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    keys, take = ["cell", "row", "column"], ["cell", "row", "column", "id", "set"]
    return mine.select(take).groupBy(keys).cogroup(other.select(take).groupBy(keys)).applyInPandas(_exact(threshold), "a bigint, b bigint, jaccard double")


def _ordered(side: DataFrame, frequency: DataFrame) -> DataFrame:
    """(id, set, n, unmet, rare): the values of each set from rare to frequent, how many of them no right set holds, and how many few hold."""
    exploded = side.select("id", F.explode("set").alias("value")).join(frequency, "value", "left")
    rank = F.struct(F.coalesce("f", F.lit(0)).alias("f"), F.xxhash64("value").alias("h"), "value")
    ranked = exploded.groupBy("id").agg(F.array_sort(F.collect_list(rank)).alias("ranked"))
    upto = lambda most: F.size(F.filter("ranked", lambda r: r["f"] <= most))
    return ranked.select("id", F.transform("ranked", lambda r: r["value"]).alias("set"), F.size("ranked").alias("n"), upto(0).alias("unmet"), upto(RARE).alias("rare"))


def _keys(side: DataFrame, threshold: float, least: Column) -> DataFrame:
    """(id, n, at, key): a set that shares ``least`` or more of these sets' values has a key of them.

    Both sets list their values from rare to frequent. The first value they
    share then stands among the first n - least + 1 of either, the second one
    among the first n - least + 2. A first value that few right sets hold is a
    key alone, else it is one together with each possible second value. Sets
    that may share one value only, and those too large for pairs (and what may
    resemble these), have every first value alone as a key too. ``at`` is the
    place of the first value. Keys are hashes: what they bring together by
    chance is compared like the rest.
    """
    known = side.withColumn("least", F.greatest(F.ceil(least - 1e-9), F.lit(1)).cast("int"))
    few, large, huge = F.col("n") * threshold <= 1, F.col("n") >= threshold * PAIRWISE_SIZE, F.col("n") > PAIRWISE_SIZE
    last = F.col("n") - F.col("least") + 1
    alone = F.when(few | large, last).otherwise(F.least(last, "rare"))
    first = F.filter(F.transform(F.slice("set", 1, alone), lambda v, i: F.struct(i.alias("at"), F.xxhash64(F.lit(1), v).alias("key"))), lambda k: k["at"] >= F.col("unmet"))
    places = F.when(~huge & (F.col("rare") < last), F.sequence(F.col("rare"), last - 1)).otherwise(F.array().cast("array<int>"))
    second = lambda i: F.slice("set", i + 2, F.greatest(last - i, F.lit(0)).cast("int"))
    pairs = F.flatten(F.transform(places, lambda i: F.transform(second(i), lambda v: F.struct(i.alias("at"), F.xxhash64(F.lit(2), F.get("set", i), v).alias("key")))))
    return known.select("id", "n", F.explode(F.concat(first, pairs)).alias("k")).select("id", "n", "k.at", "k.key")


def _own_cells(left: DataFrame, right: DataFrame, threshold: float, symmetric: bool) -> DataFrame:
    """(a, b, jaccard) with right sets that are pivots of cells of their own, of radius 0.

    A left set reaches such a cell if its distance to the pivot is at most
    1 - threshold, and that distance is the answer. The pivots within reach
    are looked up by rare values instead of being compared one by one.
    """
    frequency = materialize(right.select(F.explode("set").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("f")), "sets-frequency")
    frequency = F.broadcast(frequency) if fits(frequency, MAX_BROADCAST_VALUES) else frequency.hint("merge")
    left, right = (materialize(_ordered(side, frequency), "sets-ordered") for side in (left, right))
    share = threshold / (1 + threshold)
    # Two sets share at least ``share`` of their sizes' sum: the smaller one's own size bounds that best.
    smaller, larger = 2 * share * F.col("n"), threshold * F.col("n")
    cast = lambda side, names: side.toDF(*names)

    def met(mine: Column, others: Column, sizes: Column) -> DataFrame:
        a = cast(_keys(left, threshold, mine), ("a", "na", "at", "key"))
        b = cast(_keys(right, threshold, others), ("b", "nb", "bt", "key"))
        # Nothing before the first shared value is shared: what follows must be enough.
        enough = F.least(F.col("na") - F.col("at"), F.col("nb") - F.col("bt")) >= share * (F.col("na") + F.col("nb")) - 1e-9
        fitting = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
        return a.join(b.hint("merge"), "key").filter(sizes & enough & fitting).select("a", "b")

    upwards = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & ((F.col("a") <= F.col("b")) if symmetric else F.lit(True))
    found = met(smaller, larger, upwards)
    if not symmetric:
        found = found.unionByName(met(larger, smaller, F.col("na") > F.col("nb")))
    sets = lambda side, ident, name: side.select(F.col("id").alias(ident), F.col("set").alias(name)).hint("merge")
    reached = found.distinct().join(sets(left, "a", "x"), "a").join(sets(right, "b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return reached.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-9)


def first_pivots(right: DataFrame, pivots: int) -> list[list[str]]:
    """At most ``pivots`` sets of a hash sample, with PIVOT_VALUES values in all."""
    some = right.withColumn("n", F.size("set")).filter(F.col("n") <= PIVOT_VALUES)
    sizes = some.select("id", "n", F.xxhash64("id").alias("h")).orderBy("h").limit(pivots).collect()
    total = np.cumsum([r["n"] for r in sizes]) if sizes else np.zeros(0)
    chosen = [r["id"] for r, upto in zip(sizes, total) if upto <= PIVOT_VALUES]
    return [list(r["set"]) for r in some.filter(F.col("id").isin(chosen)).select("id", "set").orderBy("id").collect()] if chosen else []


def similar_sets(left: DataFrame, right: DataFrame, threshold: float, pivots: int = 128, home: float | None = None, symmetric: bool = False) -> DataFrame:
    """(a, b, jaccard): ids of ``left`` and ``right`` (id bigint unique, set array<string> of distinct values) with Jaccard >= ``threshold``.

    Every right set belongs to the cell of its nearest pivot, or is the pivot
    of a cell of its own. By the triangle inequality a left set can only match
    members of a cell whose pivot is nearer than the cell's radius +
    1 - threshold: it is copied to those cells and joined there exactly, in
    blocks. Each right set is in one cell, so each pair comes out once.

    The first ``pivots`` pivots are a hash sample of the right sets, so that a
    family with a share of the rows holds one the more surely the larger it
    is; they are compared with every set. A right set farther than ``home``
    from all of them is a pivot itself, with a cell of radius 0: a wider cell
    would reach left sets of nearly any distance (see README).

    ``symmetric`` tells that both sides have the same ids and sizes and that a
    resembles b exactly if b resembles a; then each pair comes out once, the
    set with fewer values (then the lesser id) as ``a``. Null and empty sets
    match nothing; extra columns are ignored; an empty side gives no rows.
    """
    home = 0.8 * threshold if home is None else home
    if not 0 < threshold <= 1 or home >= threshold:
        raise ValueError("0 < threshold <= 1 and home < threshold")
    left, right = (materialize(side.select(F.col("id").cast("bigint").alias("id"), "set").filter(F.size("set") > 0), "sets") for side in (left, right))
    chosen = first_pivots(right, pivots)
    placed = materialize(right.mapInPandas(_near(chosen, None, home), "id bigint, set array<string>, cell int, distance double"), "sets-placed")
    near = placed.filter("cell >= 0")
    # One row per pivot.
    cells = {r["cell"]: (r["n"], r["radius"]) for r in near.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()}
    limits = {cell: radius + 1 - threshold + 1e-9 for cell, (_, radius) in cells.items()}
    copied = materialize(left.mapInPandas(_near(chosen, limits, home), "id bigint, set array<string>, cell int"), "sets-copied")
    counts = {r["cell"]: r["count"] for r in copied.groupBy("cell").count().collect()}
    blocks = [(cell, max(1, -(-counts.get(cell, 0) // BLOCK)), max(1, -(-n // BLOCK))) for cell, (n, _) in cells.items()]
    grid = left.sparkSession.createDataFrame(blocks or [(-2, 1, 1)], "cell int, rows int, columns int")
    within = _in_cells(copied, near, F.broadcast(grid), threshold)
    if symmetric:
        size = lambda side, ident, name: side.select(F.col("id").alias(ident), F.size("set").alias(name)).hint("merge")
        sized = within.join(size(left, "a", "na"), "a").join(size(right, "b", "nb"), "b")
        within = sized.filter((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") <= F.col("b"))).drop("na", "nb")
    return within.unionByName(_own_cells(left, placed.filter("cell < 0").select("id", "set"), threshold, symmetric))
