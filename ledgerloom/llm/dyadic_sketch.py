"""Percentiles from dyadic Count-sketches: one signed sketch per binary resolution of the coded values.

A value of at least 0 is scaled to an integer and coded log-linearly in CODE_BITS bits (exact up
to 2**MANTISSA scaled units, then MANTISSA significant bits, so a decoded value is off by at most
2**-MANTISSA of itself plus one unit). A prefix of l bits of the code is a node of level l. Levels
up to EXACT keep a count for every node; each finer level keeps a Count-sketch of ROWS rows by
WIDTH signed counters. A group of at most SPARSE different codes needs none of this: it keeps the
counts of its codes (level LEAF), which is smaller and exact, and is turned into a sketch when more
codes come to it. All of it is a long table (group..., level, row, cell, n), which is

* mergeable: the sketch of two batches is the sum of theirs, so days add up to any span;
* open to deletion: a record taken out adds -1 where it added 1;
* bounded: at most 2**(EXACT + 1) + (CODE_BITS - EXACT) * ROWS * WIDTH rows a group.

Ranks are inverted by descending from the root, estimating the left child's count at each level as
the median over the rows. Down to level EXACT nothing is estimated, so a percentile's rank can't be
off by more than the records of the node reached there; the estimates below it are off by at most
3 * sqrt(F2 / WIDTH) a level with a probability of at least 8/9 a row, and 0.998 for the median of
five, with F2, without the greater child's part in it, read from the sketch itself (one node of
great weight, say a third of all records, meets another in the same counter too rarely to move a
median). Each percentile's rank error is the smaller of the two,
0 for groups of codes. Hashes are pairwise independent, (a*x + b) mod p.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.operators.current import current_rows, label

MANTISSA = 12
CODE_BITS = 18
WIDTH = 2048
ROWS = 5
EXACT = 12
#: The level of a group's plain counts by code, and how many codes a group may have of them.
LEAF = CODE_BITS + 1
SPARSE = 4096
PRIME = 2**31 - 1
PERCENTILES = (0.5, 0.9, 0.99)
#: Scaled units a value: words are whole, seconds are kept to the millisecond.
UNITS = {"words": 1, "duration_s": 1000}


def _hashes() -> np.ndarray:
    """[level, row] -> a, b of the cell's hash and of the sign's; fixed by a seed, as sketches must agree to be added."""
    draw = np.random.default_rng(20240229)
    return draw.integers(1, PRIME, size=(CODE_BITS + 1, ROWS, 4))


HASHES = _hashes()


def code(value: Column) -> Column:
    """The code of a scaled value of at least 0 (long); values beyond the codes' range take the greatest code."""
    exponent = F.length(F.bin(value)) - 1
    shift = F.greatest(exponent - MANTISSA, F.lit(0))
    high = shift * 2**MANTISSA + F.call_function("shiftright", value, shift)
    return F.least(high, F.lit(2**CODE_BITS - 1)).cast("long")


def decode(codes: np.ndarray) -> np.ndarray:
    """The middle of the scaled values of each code."""
    codes = np.asarray(codes, dtype=np.int64)
    shift = np.maximum(codes // 2**MANTISSA - 1, 0)
    low = (codes - shift * 2**MANTISSA) << shift
    return low + ((1 << shift) - 1) / 2


def sketch(values: DataFrame, group: list[str], value: str = "value", n: str | None = None) -> DataFrame:
    """The sketch (group..., level, row, cell, n) of integer ``value``; null and negative ones are left out.

    ``n`` names a column of counts; negative ones delete. Equal codes are added up before they are
    shuffled, so a hot group shuffles at most 2**CODE_BITS rows a partition.
    """
    valid = values.where(F.col(value) >= 0).withColumn("_code", code(F.col(value).cast("long")))
    codes = valid.groupBy(*group, F.col("_code").cast("int").alias("cell")).agg(F.sum(F.col(n) if n else F.lit(1)).cast("long").alias("n")).where("n <> 0")
    return settle(codes.select(*group, F.lit(LEAF).alias("level"), F.lit(0).alias("row"), "cell", "n"), group)


def settle(rows: DataFrame, group: list[str]) -> DataFrame:
    """Sketch rows with the codes of groups that have too many of them, or that hold counters already, turned into counters."""
    leaf = F.col("level") == LEAF
    of = Window.partitionBy(*group)
    told = rows.withColumn("_open", leaf & ((F.count_if(leaf).over(of) > SPARSE) | (F.count_if(~leaf).over(of) > 0)))
    counters = [F.struct(F.lit(level).alias("level"), F.lit(0).alias("row"), F.call_function("shiftright", F.col("cell"), F.lit(CODE_BITS - level)).cast("int").alias("cell"), F.col("n").alias("n")) for level in range(EXACT + 1)]
    for level in range(EXACT + 1, CODE_BITS + 1):
        node = F.call_function("shiftright", F.col("cell").cast("long"), F.lit(CODE_BITS - level))
        for row in range(ROWS):
            a, b, c, d = (int(x) for x in HASHES[level, row])
            cell = ((node * a + b) % PRIME) % WIDTH
            sign = F.lit(1) - 2 * (((node * c + d) % PRIME) % 2)
            counters.append(F.struct(F.lit(level).alias("level"), F.lit(row).alias("row"), cell.cast("int").alias("cell"), (F.col("n") * sign).alias("n")))
    same = F.array(F.struct("level", "row", "cell", "n"))
    cells = told.select(*group, F.explode(F.when(F.col("_open"), F.array(*counters)).otherwise(same)).alias("_c")).select(*group, "_c.*")
    return cells.groupBy(*group, "level", "row", "cell").agg(F.sum("n").alias("n")).where("n <> 0")


def merge(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Sketches added up to the coarser ``group``; counters that cancel out vanish."""
    return settle(sketches.groupBy(*group, "level", "row", "cell").agg(F.sum("n").alias("n")).where("n <> 0"), group)


def estimate(table: np.ndarray, hashes: np.ndarray, node: int) -> float:
    """A node's count by the median over the rows of its level's counters."""
    cells = ((node * hashes[:, 0] + hashes[:, 1]) % PRIME) % WIDTH
    signs = 1 - 2 * (((node * hashes[:, 2] + hashes[:, 3]) % PRIME) % 2)
    return float(np.median(signs * table[np.arange(ROWS), cells]))


def invert(cells: pd.DataFrame, percentiles: tuple = PERCENTILES) -> tuple[int, list[float], list[float]]:
    """Number of records, decoded nearest-rank percentiles of one group's sketch, and what each may be off in rank, as a share of the records."""
    level, row, cell, n = (cells[c].to_numpy() for c in ("level", "row", "cell", "n"))
    leaf = level == LEAF
    total = int(n[leaf].sum() + n[level == 0].sum())
    if total <= 0:
        return 0, [float("nan")] * len(percentiles), [0.0] * len(percentiles)
    needs = [max(1, int(np.ceil(round(p * total, 6)))) for p in percentiles]
    if leaf.all():
        order = np.argsort(cell)
        upto = np.cumsum(n[order])
        at = np.minimum(np.searchsorted(upto, needs), len(order) - 1)
        return total, decode(cell[order][at]).tolist(), [0.0] * len(percentiles)
    exact, tables, second = {}, {}, {}
    for at in range(CODE_BITS + 1):
        here = level == at
        if at <= EXACT:
            exact[at] = np.bincount(cell[here], weights=n[here], minlength=2**at)
        else:
            t = np.zeros((ROWS, WIDTH))
            np.add.at(t, (row[here], cell[here]), n[here])
            tables[at] = t
            second[at] = float(np.median((t**2).sum(axis=1)))  # estimates F2 of this level
    found, errors = [], []
    for need in needs:
        node, reached, off = 0, total, 0.0
        for at in range(1, CODE_BITS + 1):
            left = 2 * node
            if at <= EXACT:
                below = exact[at][left]
            else:
                below, other = (estimate(tables[at], HASHES[at], child) for child in (left, left + 1))
                off += 3 * np.sqrt(max(0.0, second[at] - max(below, other) ** 2) / WIDTH)
            if need <= below:
                node = left
            else:
                node, need = left + 1, need - below
            if at == EXACT:
                reached = exact[at][node]
        found.append(float(decode(np.array([node]))[0]))
        errors.append(float(min(reached, off) / total))
    return total, found, errors


def percentiles(sketches: DataFrame, group: list[str], metric: str = "metric") -> DataFrame:
    """group..., n, median, p90, p99, the rank error of each (as a share of n), value_error (as a share of the value).

    Groups of plain codes are walked in the JVM; of others the counters are bounded in number, so one
    group fits one Python task. Groups whose records were all deleted give no row.
    """
    of = Window.partitionBy(*group)
    told = sketches.withColumn("_dense", F.count_if(F.col("level") != LEAF).over(of) > 0)
    fields = [f for f in sketches.schema.fields if f.name in group]
    schema = T.StructType([*fields, *[T.StructField(c, k) for c, k in (("n", T.LongType()), ("median", T.DoubleType()), ("p90", T.DoubleType()), ("p99", T.DoubleType()), ("median_rank_error", T.DoubleType()), ("p90_rank_error", T.DoubleType()), ("p99_rank_error", T.DoubleType()), ("value_error", T.DoubleType()))]])

    def one(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        total, found, errors = invert(cells)
        if not total:
            return pd.DataFrame(columns=[f.name for f in schema])
        units = UNITS.get(key[group.index(metric)], 1) if metric in group else 1
        return pd.DataFrame([[*key, total, *[x / units for x in found], *errors, 2.0**-MANTISSA]], columns=[f.name for f in schema])

    walked = told.where("_dense").drop("_dense").groupBy(*group).applyInPandas(one, schema)
    return exact_percentiles(told.where("NOT _dense"), group, metric).unionByName(walked)


def exact_percentiles(codes: DataFrame, group: list[str], metric: str) -> DataFrame:
    """What percentiles() gives, of groups of plain codes: the codes at the ranks, by a running sum."""
    of = Window.partitionBy(*group)
    run = codes.select(*group, F.col("cell").cast("long").alias("cell"), F.sum("n").over(of.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("n").over(of).alias("_n"))
    need = lambda p: F.greatest(F.lit(1), F.ceil(F.round(F.lit(p) * F.col("_n"), 6)))
    at = [F.min(F.when(F.col("_upto") >= need(p), F.col("cell"))).alias(name) for p, name in zip(PERCENTILES, ("median", "p90", "p99"))]
    found = run.where("_n > 0").groupBy(*group).agg(F.max("_n").cast("long").alias("n"), *at)
    units = F.lit(1)
    if metric in group:
        for name, size in UNITS.items():
            units = F.when(F.col(metric) == name, F.lit(size)).otherwise(units)

    def decoded(name: str) -> Column:
        shift = F.greatest(F.floor(F.col(name) / 2**MANTISSA) - 1, F.lit(0)).cast("int")
        low = F.call_function("shiftleft", F.col(name) - shift.cast("long") * 2**MANTISSA, shift)
        return ((low + (F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1) / 2) / units).cast("double").alias(name)

    return found.select(*group, "n", *[decoded(name) for name in ("median", "p90", "p99")], *[F.lit(0.0).alias(f"{name}_rank_error") for name in ("median", "p90", "p99")], F.lit(2.0**-MANTISSA).alias("value_error"))


def session_values(sessions: DataFrame) -> DataFrame:
    """source, day, metric, value (scaled) of the current rows' words and duration_s; nulls and negatives left out.

    A value that is not a number or infinite is no duration and left out too.
    """
    rows = current_rows(sessions, ["source", "ingested_at", "words", "duration_s"])
    seconds = F.when(~F.isnan("duration_s") & (F.col("duration_s") < 1e15), F.round(F.col("duration_s") * UNITS["duration_s"]).cast("long"))
    seconds = F.when(F.col("duration_s") >= 0, seconds)
    both = F.explode(F.array(F.struct(F.lit("words").alias("metric"), F.col("words").cast("long").alias("value")), F.struct(F.lit("duration_s").alias("metric"), seconds.alias("value"))))
    flat = rows.select(label("source").alias("source"), F.to_date("ingested_at").alias("day"), both.alias("_v"))
    return flat.select("source", "day", "_v.metric", "_v.value").where(F.col("value") >= 0)


def session_sketches(sessions: DataFrame) -> DataFrame:
    """The daily sketches (source, day, metric, level, row, cell, n)."""
    return sketch(session_values(sessions), ["source", "day", "metric"])


def daily_percentiles(sessions: DataFrame) -> DataFrame:
    """Percentiles per source and day of ingested_at; a null source or day is a group of its own, a day without values gives no row."""
    return percentiles(session_sketches(sessions), ["source", "day", "metric"])


def span_percentiles(daily: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """Percentiles per source of the days from ``first`` to ``last``, put together from the daily sketches alone."""
    if first:
        daily = daily.where(F.col("day") >= F.lit(first).cast("date"))
    if last:
        daily = daily.where(F.col("day") <= F.lit(last).cast("date"))
    return percentiles(merge(daily, ["source", "metric"]), ["source", "metric"])
