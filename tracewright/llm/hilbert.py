"""Sharding along a Hilbert curve.

Several metadata columns are quantised to the same number of steps of about equal frequency, rows are
ordered by the place of their cell on the Hilbert curve, and the order is cut into runs. A run covers a
compact part of the space, so the minima and maxima of each column in a shard prune files for filters
on any of the columns. Everything here is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Windows of the ranking: at least so many, and one more for each WINDOW rows of the table.
PIECES, WINDOW = 1024, 1 << 20
_LOTS = 1 << 30


def numeric(df: DataFrame, column: str) -> Column:
    """A number that orders the column's values: strings and binaries by their first seven bytes, all
    else as doubles; null stays null."""
    kind = df.schema[column].dataType.simpleString()
    if kind in ("string", "binary"):
        first = F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 7)), 14, "0")
        return F.conv(first, 16, 10).cast("double")
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def steps(df: DataFrame, columns: list[str], bits: int) -> dict[str, list[float]]:
    """Bounds of the quantiles of each column, 2**bits - 1 at most; equal ones count once."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    row = df.agg(*[F.percentile_approx(numeric(df, c), shares, 2000).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return {c: sorted({x for x in row[f"q{i}"] or [] if x == x}) for i, c in enumerate(columns)}


def quantised(value: Column, bounds: list[float]) -> Column:
    """How many bounds lie below the value; 0 for null and NaN."""
    if not bounds:
        return F.lit(0)
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value))
    return F.when(value.isNull() | F.isnan(value), F.lit(0)).otherwise(below)


def curve(spark: SparkSession, dims: int, bits: int) -> DataFrame:
    """``cell, place``: the place on the Hilbert curve of each of the 2**(dims * bits) cells; a cell's
    number holds the coordinates one after another, the first in the highest bits."""
    cells = spark.range(1 << (dims * bits)).withColumnRenamed("id", "cell")
    x = cells.withColumn("x", F.expr(f"transform(sequence(0, {dims - 1}), i -> shiftright(cell, {bits} * ({dims - 1} - i)) & {(1 << bits) - 1}L)"))
    # For each bit from the highest, and each coordinate: where it has the bit, the first coordinate's
    # lower bits are inverted; else they are exchanged with its own.
    k, i = f"CAST({bits - 1} - s DIV {dims} AS INT)", f"v[s % {dims}]"
    turned = f"""
        aggregate(sequence(0, {(bits - 1) * dims - 1}), x, (v, s) -> transform(v, (w, j) -> CASE
            WHEN shiftright({i}, {k}) & 1 = 1 THEN CASE WHEN j = 0 THEN w ^ (shiftleft(1L, {k}) - 1) ELSE w END
            WHEN j = 0 OR j = s % {dims} THEN w ^ ((v[0] ^ {i}) & (shiftleft(1L, {k}) - 1))
            ELSE w END))"""
    x = x.withColumn("x", F.expr(turned)) if bits > 1 else x
    x = x.withColumn("x", F.expr("transform(x, (w, j) -> aggregate(slice(x, 1, j + 1), 0L, (a, b) -> a ^ b))"))
    x = x.withColumn("flip", F.expr(f"aggregate(sequence(0, {bits - 1}), 0L, (f, k) -> CASE WHEN k > 0 AND shiftright(x[{dims - 1}], k) & 1 = 1 THEN f ^ (shiftleft(1L, k) - 1) ELSE f END)"))
    place = f"aggregate(sequence(0, {bits * dims - 1}), 0L, (p, s) -> p * 2 + (shiftright(x[s % {dims}] ^ flip, CAST({bits - 1} - s DIV {dims} AS INT)) & 1))"
    return x.select("cell", F.expr(place).alias("place"))


def assign(df: DataFrame, folder: str, columns: list[str], shards: int, id_column: str, text_column: str, bits: int = 4) -> DataFrame:
    """``id, size, crc, place, shard, slot`` of every row: the text's UTF-8 bytes plus 1, its CRC-32,
    the cell's place on the curve over ``columns``, the shard and the place in it.

    Shards are runs of the order by (place, hash of id and crc, id, crc) whose counts are at most one
    apart; slots count from 0 without gaps. Null texts count as empty, null metadata as the lowest
    step; rows that repeat an id are rows of their own; an empty table gives no rows. Other columns
    don't matter, whatever their names.

    The ranking never brings a cell's rows together: a cell with more than 1 / PIECES of all rows, or
    more than WINDOW, is cut by the hash into that many windows more, so that no window grows with the
    table. The running totals are over one row per window, 2**(dims * bits) + PIECES + rows / WINDOW at
    most, which also bounds what is broadcast: 100,000 small rows for 10**11 documents.
    """
    spark = df.sparkSession
    bounds = steps(df, columns, bits)
    cell = F.lit(0).cast("long")
    for c in columns:
        cell = cell * (1 << bits) + quantised(numeric(df, c), bounds[c])
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = df.select(F.col(id_column).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), cell.alias("cell"))
    places = curve(spark, len(columns), bits)
    rows = rows.join(F.broadcast(places), "cell").withColumn("lot", F.pmod(F.xxhash64("id", "crc"), F.lit(_LOTS)))
    # Written once, so that the texts are read once and the steps below take a few numbers a row.
    rows = written(rows.select("id", "size", "crc", "place", "lot"), folder, "rows")
    counts = rows.groupBy("place").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    windows = counts.select("place", total.alias("total"), F.ceil(F.col("n") * F.greatest(F.lit(PIECES), F.ceil(total / WINDOW)) / total).cast("long").alias("windows"))
    rows = rows.join(F.broadcast(windows), "place").withColumn("window", F.floor(F.col("lot") * F.col("windows") / _LOTS))
    before = F.sum("n").over(Window.orderBy("place", "window").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("place", "window").agg(F.count("*").alias("n")).select("place", "window", F.coalesce(before, F.lit(0)).alias("start"))
    rows = rows.join(F.broadcast(starts), ["place", "window"])
    order = Window.partitionBy("place", "window").orderBy("lot", "id", "crc", "size")
    rank = F.col("start") + F.row_number().over(order) - 1
    ranked = rows.select("id", "size", "crc", "place", "total", rank.alias("rank"))
    ranked = ranked.withColumn("shard", F.expr(f"CAST(rank * {shards} DIV total AS INT)"))
    first = F.expr(f"(shard * total + {shards} - 1) DIV {shards}")
    return ranked.select("id", "size", "crc", "place", "shard", (F.col("rank") - first).alias("slot"))


def file_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum of each column in each shard of ``df(shard, ...)``: what prunes files."""
    return df.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "min"), (F.max, "max"))])
