"""Skew-safe building blocks used by every other operator.

A *heavy* key is one that holds at least 1/100,000 of all rows (and at least
``seqlab.heavy.rows`` rows, one million unless set). There can be no more than 100,000 of
them, so a table of heavy keys is always small enough to broadcast; every other key is
small enough for one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqlab.session import written

MAX_HEAVY = 100_000
SALTS = 4096


def heavy_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("seqlab.heavy.rows", "1000000"))


def heavy_keys(freq: DataFrame, n: str = "n") -> DataFrame:
    """Rows of a (key, count) table whose key is heavy; at most ``MAX_HEAVY`` of them."""
    floor = heavy_rows(freq.sparkSession)
    total = freq.agg(F.sum(n)).scalar()
    return freq.where((F.col(n) >= floor) & (F.col(n) * MAX_HEAVY >= total))


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    freq: DataFrame | None = None,
) -> DataFrame:
    """Left join to a table that is unique on ``keys``, safe when few keys hold most rows.

    Without ``freq`` this is a plain join: adaptive execution broadcasts the right side when
    its measured size allows, and otherwise splits skewed partitions of the left side.
    With ``freq`` (keys, n), the row counts of ``left`` per key, heavy keys are looked for
    first; if there are any, their rows find their partner in a broadcast table and are
    spread by a salt in the shuffle join, where they meet nothing.
    """
    rows = left.columns
    payload = [c for c in right.columns if c not in keys]
    marked = None if freq is None else heavy_keys(freq).select(*keys, F.lit(True).alias("_heavy"))
    if marked is None or marked.isEmpty():
        return left.join(right, keys, "left").select(*rows, *payload)
    heavy = marked.join(
        right.select(*keys, *[F.col(c).alias(f"_h_{c}") for c in payload]), keys, "left"
    )
    apart = F.col("_heavy") | F.col(keys[0]).isNull()
    salt = F.when(apart, F.pmod(F.xxhash64(*rows), F.lit(SALTS)) + 1).otherwise(0)
    salted = left.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt.cast("int"))
    # Always 0 but not a literal: a constant would be folded out of the join keys.
    light = right.withColumn("_salt", F.pmod(F.hash(keys[0]), F.lit(1)))
    joined = salted.join(light, [*keys, "_salt"], "left")
    return joined.select(*rows, *[F.coalesce(f"_h_{c}", c).alias(c) for c in payload])


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list,
    bucket: Column | None,
    value: Column,
    out: str,
) -> DataFrame:
    """Sum of ``value`` over the rows up to this one, per ``keys`` in ``order``.

    Without keys the table is cut into ranges of the order and written once; the sums of
    earlier ranges come from a table with one row per range. With keys, heavy groups are cut
    by ``bucket``, which must not decrease along the order; without heavy keys one window does.
    """
    marked = df.withColumn("_value", value)
    if keys:
        freq = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        heavy = heavy_keys(freq).select(*keys, F.lit(True).alias("_heavy"))
        if heavy.isEmpty():
            w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
            return marked.withColumn(out, F.sum("_value").over(w)).drop("_value")
        marked = marked.join(F.broadcast(heavy), keys, "left").withColumn(
            "_bucket", F.when(F.col("_heavy"), bucket)
        )
        sums = marked.where("_heavy").groupBy(*keys, "_bucket")
    else:
        ranges = marked.repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id())
        marked = written(ranges, "ranges")
        sums = marked.groupBy("_bucket")
    sums = sums.agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_bucket", F.sum("_sum").over(before).alias("_before"))
    here = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = marked.withColumn("_here", F.sum("_value").over(here))
    return local.join(offsets, [*keys, "_bucket"], "left").select(
        *df.columns, (F.col("_here") + F.coalesce("_before", F.lit(0))).alias(out)
    )


def number_rows(
    df: DataFrame, keys: list[str], order: list, bucket: Column | None, out: str
) -> DataFrame:
    """Dense 0-based numbers per ``keys`` in ``order``; see :func:`running_sum`."""
    counted = running_sum(df, keys, order, bucket, F.lit(1).cast("bigint"), out)
    return counted.withColumn(out, F.col(out) - 1)


#: Cells of one round of :func:`first_rows`, and rows among which it ranks.
CELLS = 1024
FEW = 100_000


def first_rows(df: DataFrame, order: list[str], n: int, key: Column) -> DataFrame:
    """The first ``n`` rows in ``order``, for any ``n``, without sorting the table or passing one task.

    ``key`` is a number that does not fall along the order. Counts of its values in ``CELLS`` equal
    cells tell in which cell the n-th row lies; that cell is cut again until few rows are left, or
    only such as share one value, and only these are ranked. Rows with a null key come first.
    """
    keyed = df.withColumn("_key", key.cast("double"))
    first = keyed.agg(F.count(F.lit(1)), F.count("_key"), F.min("_key"), F.max("_key")).first()
    total, known, low, high = first
    if total <= n:
        return df
    nulls = keyed.where("_key IS NULL")
    if n <= total - known:
        return number_rows(nulls, [], order, None, "_nth").where(F.col("_nth") < n).select(df.columns)
    before, inside = total - known, known
    while inside > FEW and low < high:
        width = (high - low) / CELLS
        cell = F.least(F.floor((F.col("_key") - low) / width), F.lit(CELLS - 1))
        rows = keyed.where(F.col("_key").between(low, high)).groupBy(cell.alias("cell"))
        counts = rows.agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high"))
        for r in sorted(counts.collect(), key=lambda r: r.cell):
            if before + r.n >= n:
                low, high, inside = r.low, r.high, r.n
                break
            before += r.n
    sure = keyed.where((F.col("_key") < low) | F.col("_key").isNull())
    edge = number_rows(keyed.where(F.col("_key").between(low, high)), [], order, None, "_nth")
    return sure.select(df.columns).union(edge.where(F.col("_nth") < n - before).select(df.columns))


def next_at_or_after(points: DataFrame, at: str, marks: DataFrame, mark: str, out: str) -> DataFrame:
    """Add to each point the smallest mark that is not below ``at`` (null: none).

    Points and marks are cut into ranges together and written once; what later ranges hold comes
    from a table with one row per range, so no task sees more than its range.
    """
    row = F.struct(*[F.col(c) for c in points.columns])
    asked = points.select(F.col(at).alias("_x"), F.lit(0).alias("_is_mark"), row.alias("_row"))
    given = marks.where(F.col(mark).isNotNull()).select(
        F.col(mark).alias("_x"), F.lit(1).alias("_is_mark"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")
    )
    order = [F.desc("_x"), F.desc("_is_mark")]
    ranges = asked.union(given).repartitionByRange(*order).withColumn("_bucket", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    here = F.when(F.col("_is_mark") == 1, F.col("_x"))
    least = ranges.groupBy("_bucket").agg(F.min(here).alias("_least"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    above = least.select("_bucket", F.min("_least").over(before).alias("_above"))
    down = W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = ranges.withColumn("_here", F.min(here).over(down)).where("_is_mark = 0")
    joined = found.join(above, "_bucket", "left")
    return joined.select("_row.*", F.coalesce("_here", "_above").alias(out))


def text_bucket(column: str) -> Column:
    """Order-keeping slices of a text column."""
    return F.substring(column, 1, 3)


def checked_small(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a small model table for the driver; refuses to fetch more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows, use the joined form instead")
    return rows


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
