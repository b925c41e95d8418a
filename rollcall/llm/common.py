"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.operators.common import number_within_groups
from rollcall.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Removes a query's shuffle files as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder of ``spark.checkpoint.dir`` and read
    it back: cuts the lineage, so that a lost executor repeats no step before
    this one, and lets several readers share one computation. The shuffle files
    of the write are of no further use and go with it."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def with_file_key(rows: DataFrame) -> DataFrame:
    """``rows``, read from files, with ``_file`` and ``_at``: the hash of a row's
    file and its place in it, the same at every reading. (Hashes of a million
    files meet with a probability of 3e-8.)"""
    return rows.select(*rows.columns, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hashes(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds; together they identify a text."""
    return F.xxhash64(c), F.xxhash64(F.lit(7), c)


#: Rows that one numbering window holds, about.
ROWS_PER_WINDOW = 20_000
#: A part of so many windows' rows is cut anew.
CROWDED = 8


def slice_of(c: Column, low: int, high: int, parts: int) -> Column:
    """Which of ``parts`` equal parts of [low, high] holds ``c``."""
    def whole(x: int) -> Column:    # the range of a long has more than 63 bits
        return F.lit(str(x)).cast("decimal(20,0)")
    return F.floor((c.cast("decimal(20,0)") - whole(low)) / whole((high - low) // parts + 1)).cast("long")


def numbered(rows: DataFrame, group: str, place: str, out: str) -> DataFrame:
    """``out``: 0, 1, 2, ... by ``place`` in each ``group``; neither is null. A
    group of any size is numbered in parts of ``place``, each of which adds the
    rows of the group's earlier parts. Places that spread evenly over their
    range, as hashes do, give even parts. Where they do not (many rows of one
    place, far outliers), so that a part would hold CROWDED windows' rows, the
    rows are cut by measured bounds instead, ties by a number of their own."""
    span = rows.agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n")).first()
    if not span.n:
        return rows.withColumn(out, F.lit(None).cast("long"))
    some = rows.withColumn("_part", slice_of(F.col(place), span.low, span.high, span.n // ROWS_PER_WINDOW + 1))
    counts = some.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_in_part"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(counts.withColumn("_before", F.coalesce(F.sum("_in_part").over(before), F.lit(0))), "offsets")
    if offsets.agg(F.max("_in_part")).first()[0] > CROWDED * ROWS_PER_WINDOW:
        each = settle(rows.withColumn("_nth", F.monotonically_increasing_id()), "rows")
        ranked = number_within_groups(each, [group], [place, "_nth"], out=out)
        return ranked.withColumn(out, F.col(out) - 1).drop("_nth")
    inside = Window.partitionBy(group, "_part").orderBy(place, *[c for c in rows.columns if c not in (group, place)])
    return (some.withColumn("_in_order", F.row_number().over(inside)).join(offsets.drop("_in_part"), [group, "_part"])
            .withColumn(out, (F.col("_in_order") - 1 + F.col("_before")).cast("long")).drop("_part", "_in_order", "_before"))


#: bitmap_construct_agg makes bitmaps of so many bits.
_PAGE = 32768


def bitmap_of(hashes: DataFrame, col: str, n: int, most_bits: int) -> tuple[bytes, int]:
    """A bitmap with bit (hash mod bits) set for each hash, and its bits: about
    64 for each of ``n`` hashes, a power of two, ``most_bits`` at most."""
    bits = most_bits
    while bits > _PAGE and bits > 64 * n:
        bits //= 2
    place = F.pmod(F.col(col), F.lit(bits)) + 1   # bits divides 2**64: signed and unsigned agree
    pages = (hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect())
    out = bytearray(bits // 8)
    for p in pages:
        out[(p.page - 1) * _PAGE // 8: p.page * _PAGE // 8] = p.bits
    return bytes(out), bits


def in_bitmap(page: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) have their bit set in the bitmap's bytes."""
    pos = hashes & np.uint64(bits - 1)
    return (page[pos >> np.uint64(3)] >> (pos & np.uint64(7)).astype(np.uint8) & 1) == 1
