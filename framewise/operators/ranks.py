"""Places in an order and order statistics, without a task that sees all rows."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewise.functions import text as X
from framewise.session import scratch_path

#: Values that are sorted in one task at most, and ranges that larger sets are counted in.
FEW, RANGES = 100_000, 1024


def read_often(df: DataFrame) -> DataFrame:
    """``df``, to be read more than once: written to the shared folder first, so that its joins and shuffles run once, unless it only scans, filters and projects."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if not re.search(r"^[\s:+-]*(Join|Aggregate|Window|Generate|Sort|Repartition|Distinct|MapInArrow|MapInPandas)", plan, re.M):
        return df
    return written(df)


def written(df: DataFrame) -> DataFrame:
    """``df`` by way of the shared folder; its files go when the driver ends."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[str], bucket: Column, order: list[Column | str], name: str = "place") -> DataFrame:
    """``df`` with each row's place (from 0) among those that agree in ``by``, in ``order``.

    ``bucket`` must not fall along the order: rows are counted by bucket, the
    buckets' starts summed up, and only the rows within a bucket are sorted.
    """
    rows = read_often(df).withColumn("__b", bucket)
    counts = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by, F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))  # a row a bucket
    starts = counts.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__b").alias("__at"), F.coalesce(before, F.lit(0)).alias("__start"))
    same = F.col("__b") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)) - 1
    return rows.withColumn("__w", within).join(starts, same).select(*df.columns, (F.col("__start") + F.col("__w")).cast("long").alias(name))


def hash_bits(n: int) -> int:
    """Bits of a hash that part ``n`` rows into buckets of ``FEW`` rows, in 256 buckets at least."""
    return min(32, max(8, math.ceil(math.log2(max(1, n) / FEW))))


def by_hash(df: DataFrame, by: list[str], key: str, name: str = "place") -> DataFrame:
    """``numbered`` in the order of a hash of ``key``, in as many buckets as the rows ask for."""
    h = X.hash32(F.col(key).cast("string"))
    return numbered(df, by, F.floor(h / 2 ** (32 - hash_bits(df.count()))), [h, key], name)


#: Places of an order that one block of a two-level scan covers.
BLOCK = 4096


def scanned(df: DataFrame, by: list[str], at: str, order: list[str], block: int = BLOCK, **scans: tuple[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``scans``: (kind, column), along ``order`` within ``by``, without a task that sees all rows of a group.

    kind: ``max`` or ``sum`` of all rows up to this one, itself included, or
    the value of the row before (``prev``), after (``next``) or of the group's
    first row (``first``). ``at`` is the
    whole number that ``order`` begins with. Ranges of it make blocks: a
    block's summary is one row, the summaries are scanned, and a row needs
    besides only the rows of its own block. Rows where it is null are the first.
    """
    rows = read_often(df).withColumn("__b", F.floor(F.col(at) / block))
    # A plain number as the place, and a value without a struct around it: numbers and flags are then hashed by Spark, not sorted.
    place = F.coalesce(F.col(at).cast("long"), F.lit(-(2**63))) if order == [at] else F.struct(*order)
    ends = {"max": F.max, "sum": F.sum, "prev": lambda c: F.max_by(c, place), "next": lambda c: F.min_by(c, place), "first": lambda c: F.min_by(c, place)}
    made = rows.groupBy(*by, "__b").agg(*(ends[kind](c).alias(name) for name, (kind, c) in scans.items()))
    made = made.withColumns({name: F.struct(F.col(name).alias("v")) for name, (kind, _) in scans.items() if kind not in ("max", "sum")})
    line = Window.partitionBy(*by).orderBy("__b")  # a row a block
    earlier, later = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    outside = {"max": lambda c: F.max(c).over(earlier), "sum": lambda c: F.sum(c).over(earlier), "prev": lambda c: F.last(c).over(earlier), "next": lambda c: F.first(c).over(later), "first": lambda c: F.first(c).over(earlier)}
    carry = made.select(*(F.col(c).alias(f"__{c}") for c in [*by, "__b"]), *(outside[kind](name).alias(f"__of_{name}") for name, (kind, _) in scans.items()))
    same = F.col("__b").eqNullSafe(F.col("____b"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = Window.partitionBy(*by, "__b").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    inside = {"max": lambda c: F.max(c).over(upto), "sum": lambda c: F.sum(c).over(upto), "prev": lambda c: F.lag(F.struct(c.alias("v"))).over(within), "next": lambda c: F.lead(F.struct(c.alias("v"))).over(within), "first": lambda c: F.first(F.struct(c.alias("v"))).over(upto)}
    rows = rows.withColumns({f"__in_{name}": inside[kind](c) for name, (kind, c) in scans.items()}).join(carry, same)

    def whole(name: str, kind: str) -> Column:
        a, b = F.col(f"__in_{name}"), F.col(f"__of_{name}")
        if kind in ("max", "sum"):
            return F.greatest(a, b) if kind == "max" else F.coalesce(a + b, a, b)
        return (F.coalesce(b, a) if kind == "first" else F.coalesce(a, b))["v"]

    return rows.select(*df.columns, *(whole(name, kind).alias(name) for name, (kind, _) in scans.items()))


def kth(df: DataFrame, column: str, k: int) -> float:
    """The value at place ``k`` (from 0) of a column without nulls: counted in ranges until few values are left to sort."""
    r = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = r["low"], r["high"]
    while low < high:
        rows = df.where(F.col(column).between(low, high))
        width = (high - low) / RANGES
        at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(RANGES - 1))
        parts = rows.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy("low").collect()  # a row a range
        for part in parts:
            if k < part["n"]:
                break
            k -= part["n"]
        low, high = part["low"], part["high"]
        if part["n"] <= FEW:
            return df.where(F.col(column).between(low, high)).orderBy(column).limit(k + 1).agg(F.max(column)).first()[0]
    return low


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median (mean of the two middle values) of what isn't null."""
    known = df.select(column).where(F.col(column).isNotNull())
    n = known.count()
    return (kth(known, column, (n - 1) // 2) + kth(known, column, n // 2)) / 2 if n else None
