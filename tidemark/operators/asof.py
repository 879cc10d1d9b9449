"""Backward as-of join of two tables of any age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_root, stored

#: Instants of one time bucket, one group of a window: at most so many units of time.
FAN = 256
#: Columns of the join's own tables.
AT, ROW = "_at", "_row"


def units(c: Column, kind: str) -> Column:
    """A date as days, a timestamp as microseconds, a whole number as it is."""
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":  # by the clock's reading, whatever the session's zone
        of_day = (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return F.unix_date(F.to_date(c)).cast("long") * 86_400_000_000 + of_day
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("long")
    raise ValueError(f"times must be dates, timestamps or whole numbers, not {kind}")


def last_before(rows: DataFrame, asked: DataFrame, keys: list[str], root: str, width: int, level: int = 0) -> DataFrame:
    """keys, AT and ROW of every asked (keys, AT): the row of the last instant at or before it, of rows (keys, AT, ROW; one an instant).

    Time is cut into buckets, each a group of its own. What is asked before a bucket's first row is asked again of the buckets'
    last rows, one a bucket, which are cut into wider buckets in turn, until a few are left: a value is so carried over
    any number of empty buckets, and no group holds a key's whole history.
    """
    span = rows.agg(F.max(AT) - F.min(AT)).first()[0] or 0
    cut = (F.floor(F.col(AT) / width) if span >= width else F.lit(0)).cast("long")
    seen = rows.select(*keys, AT, ROW, F.lit(False).alias("_asks")).unionByName(asked.select(*keys, AT, F.lit(True).alias("_asks")), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_bucket").orderBy(AT, "_asks")
    found = seen.withColumn("_bucket", cut).withColumn(ROW, F.last(ROW, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_asks")
    if span < width:
        return found.select(*keys, AT, ROW)
    found = stored(found.select(*keys, AT, "_bucket", ROW), root, f"met-{level}")
    # one row for each bucket with rows, and one question for each bucket whose first rows were asked too early
    lasts = stored(rows.groupBy(*keys, cut.alias("_bucket")).agg(F.max_by(ROW, AT).alias(ROW)).withColumnRenamed("_bucket", AT), root, f"lasts-{level}")
    open_ = found.where(F.col(ROW).isNull()).select(*keys, (F.col("_bucket") - 1).alias(AT)).distinct()
    carried = stored(last_before(lasts, open_, keys, root, FAN, level + 1), root, f"carried-{level}")
    carried = carried.select(*keys, (F.col(AT) + 1).alias("_bucket"), F.col(ROW).alias("_carried"))
    return found.join(carried, [*keys, "_bucket"], "left").select(*keys, AT, F.coalesce(ROW, "_carried").alias(ROW))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Every row of left with the columns of the last row of right of the same keys at or before its time, however old.

    Both times are dates (compared by day), timestamps or whole numbers of one kind. Of right rows of one key and instant the last by ``order``
    counts (all other columns, by default). Left rows stay as they are, with NULLs where nothing is earlier or a key or
    time is NULL; right rows with such a NULL take no part. ``width`` is a bucket's length in days, microseconds or units:
    256, or an hour of timestamps, by default.

    Instants are told apart before they are dealt, so a group holds no more than the distinct
    instants of a bucket; left rows get their answers by a join with a written table, whose hot keys Spark splits.
    """
    kinds = [dict(df.dtypes)[c] for df, c in ((left, left_time), (right, right_time))]
    if kinds[0] != kinds[1]:
        raise ValueError(f"times of two kinds: {kinds[0]} and {kinds[1]}")
    values = [c for c in right.columns if c not in keys]
    clash = {c.lower() for c in left.columns} & {c.lower() for c in values}
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    quoted = lambda c: F.col(f"`{c}`")
    own = [f"_key{i}" for i in range(len(keys))]
    keyed = lambda df, time: [quoted(k).alias(o) for k, o in zip(keys, own, strict=True)] + [units(quoted(time), kinds[0]).alias(AT)]
    whole = lambda df: df.where(" and ".join(f"{c} is not null" for c in [*own, AT]))
    root, width = shared_root(left.sparkSession), width or (3_600_000_000 if kinds[0].startswith("timestamp") else FAN)
    row, by = F.struct(*[quoted(c) for c in values]), F.struct(*[quoted(c) for c in (order or values)])
    rows = whole(right.select(*keyed(right, right_time), row.alias(ROW), by.alias("_by"))).groupBy(*own, AT).agg(F.max_by(ROW, "_by").alias(ROW))
    rows = stored(rows, root, "rows")
    asked = whole(left.select(*keyed(left, left_time))).distinct()
    found = stored(last_before(rows, asked, own, root, width), root, "found").withColumnsRenamed({c: f"{c}f" for c in (*own, AT)})
    placed = left.withColumns({o: quoted(k) for k, o in zip(keys, own, strict=True)} | {AT: units(quoted(left_time), kinds[0])})
    met = placed.join(found, [placed[c] == found[f"{c}f"] for c in (*own, AT)], "left")
    return met.select(*[quoted(c) for c in left.columns], *[F.col(f"{ROW}.`{c}`").alias(c) for c in values])
