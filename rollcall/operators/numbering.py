"""Registration codes given as visitors arrive (O28), as an insert trigger gives
them: a visitor without a code takes one number more than the largest in use
with the prefix (category code and year of registration) in the tenant; one that
brings a code keeps it, and its number counts for those that come later.

Row by row the largest number is ``last = max(last, number brought)`` or ``last + 1``.
After ``k`` rows that took a number it is ``k + max(last before, number brought -
k at that row)``, a running sum and a running maximum. Both are carried over
range pieces, so a tenant with most of the arrivals is many tasks.

``CodeLog`` keeps what has been given under one folder, a sub-folder per step:

- ``codes``: the rows of a batch with their codes;
- ``last``: the largest number of each (tenant, prefix) that it touched, of all
  of them every COMPACT steps; readers start from there;
- ``steps``: a pointer (step, base, stream, batch), appended last.

A batch that failed leaves no pointer and its folders are written over; a batch
that is repeated after its pointer does nothing. So numbers have no gaps and no
doubles over restarts and over streams that follow each other. Streams of one
log run one after another. A visitor arrives once, as the table's key has it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.scalars import lpad_keep
from ..sources.io import scratch_path
from .common import _join_null_safe, as_list

COMPACT = 32
WIDTH = 4
NUMBER = "decimal(37,0)"
CODES = ("visitor_id long, tenant_id int, category_id int, registered_at timestamp_ntz, registration_code string, "
         f"prefix string, number {NUMBER}, arrived boolean")
LAST = f"tenant_id int, prefix string, last {NUMBER}"
STEPS = "step long, base long, stream string, batch long"


def number_as_inserted(rows: DataFrame, group: Sequence[str], order: Sequence[str], takes: str, brought: str,
                       out: str = "number", partitions: int | None = None) -> DataFrame:
    """Add ``out``: for a row that ``takes`` a number (boolean) one more than the
    largest taken or brought before it in its group, in ``order`` (which ends in
    a unique column); NULL for the others. NULL is a group of its own.

    The rows are range-partitioned by (group, order) and written with their
    piece's number; sums and maxima inside a piece come from a window, those of
    earlier pieces from a table of one row for each piece that begins inside a
    group."""
    group, order = as_list(group), as_list(order)
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "arrivals")
    rows.repartitionByRange(n, *group, *order).withColumn("_piece", F.spark_partition_id()).write.parquet(path)
    rows_at = T.StructType([*rows.schema.fields, T.StructField("_piece", T.IntegerType())])
    placed = spark.read.schema(rows_at).parquet(path)

    so_far = Window.partitionBy("_piece", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    took = F.coalesce(F.col(takes), F.lit(False)).cast("long")
    counted = placed.withColumn("_k", F.sum(took).over(so_far))
    ahead = (F.col(brought).cast(NUMBER) - F.col("_k")).cast(NUMBER)
    local = counted.withColumn("_ahead", F.max(ahead).over(so_far))

    pieces = local.groupBy("_piece", *group).agg(F.max("_k").alias("_pk"), F.max("_ahead").alias("_pa"))
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = pieces.withColumn("_k0", F.coalesce(F.sum("_pk").over(earlier), F.lit(0).cast("long")))
    carry = carry.withColumn("_a0", F.max((F.col("_pa") - F.col("_k0")).cast(NUMBER)).over(earlier))
    carry = carry.where("_k0 > 0 OR _a0 IS NOT NULL").select("_piece", *group, "_k0", "_a0")
    joined = _join_null_safe(local, F.broadcast(carry), ["_piece", *group], "left")
    before = F.coalesce(F.col("_k0"), F.lit(0).cast("long"))
    most = F.greatest(F.lit(0).cast(NUMBER), F.col("_a0"), (F.col("_ahead") - before).cast(NUMBER))
    number = (F.col("_k") + before + most).cast(NUMBER)
    return joined.withColumn(out, F.when(F.col(takes), number)).drop("_piece", "_k", "_ahead", "_k0", "_a0")


@dataclass
class CodeLog:
    spark: SparkSession
    root: str
    categories: DataFrame

    def _steps(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema(STEPS).parquet(f"{self.root}/steps")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _published(self, spark: SparkSession) -> tuple[int, int]:
        """The last step and the one that readers of ``last`` start from; (0, 1) before the first."""
        steps = self._steps(spark)
        top = steps.agg(F.max(F.struct("step", "base"))).first()[0] if steps is not None else None
        return (top.step, top.base) if top else (0, 1)

    def _read(self, spark: SparkSession, name: str, schema: str, from_: int, to: int) -> DataFrame:
        if to < from_:
            return spark.createDataFrame([], schema)
        full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("step", T.LongType())])
        rows = spark.read.schema(full).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        return rows.where(F.col("step").between(from_, to)).drop("step")

    def last_numbers(self, spark: SparkSession | None = None) -> DataFrame:
        """(tenant_id, prefix, last): the largest number in use."""
        spark = spark or self.spark
        step, base = self._published(spark)
        return self._read(spark, "last", LAST, base, step).groupBy("tenant_id", "prefix").agg(F.max("last").alias("last"))

    def codes(self) -> DataFrame:
        """All visitors that arrived, with their codes."""
        step, _ = self._published(self.spark)
        return self._read(self.spark, "codes", CODES, 1, step).where("arrived").drop("prefix", "number", "arrived")

    def allocate(self, batch: DataFrame, stream: str, batch_id: int) -> None:
        """Give codes to a batch of visitors, in order of registration time and id.

        A code brought counts where it begins with its visitor's own prefix and
        ends in digits alone. A visitor without a code whose category is unknown
        has none. An empty batch publishes an empty step."""
        spark = batch.sparkSession
        steps = self._steps(spark)
        if steps is not None and not steps.where((F.col("stream") == stream) & (F.col("batch") == batch_id)).isEmpty():
            return
        done, base = self._published(spark)
        step = done + 1
        prefix = F.concat("_code", F.date_format("registered_at", "yy"))
        named = self.categories.select(F.col("category_id").alias("_c"), F.col("code").alias("_code"))
        code = F.nullif(F.col("registration_code"), F.lit(""))
        end = F.substring(code, F.length("prefix") + 1, 1 << 30)
        rows = (batch.join(named, F.col("category_id") == F.col("_c"), "left").withColumn("prefix", prefix)
                .select(F.col("visitor_id").cast("long").alias("visitor_id"), F.col("tenant_id").cast("int").alias("tenant_id"),
                        F.col("category_id").cast("int").alias("category_id"), "registered_at", code.alias("registration_code"), "prefix",
                        F.when(code.startswith(F.col("prefix")) & end.rlike("^[0-9]+$"), end.try_cast(NUMBER)).alias("brought"),
                        (code.isNull() & F.col("prefix").isNotNull()).alias("takes"), F.lit(True).alias("arrived")))
        # The largest numbers so far go first, as rows that bring them: no join meets the arrivals.
        touched = rows.select(F.col("tenant_id").alias("_t"), F.col("prefix").alias("_p")).where("_p IS NOT NULL").distinct()
        last = self.last_numbers(spark)
        known = last.join(touched, F.col("tenant_id").eqNullSafe(F.col("_t")) & (F.col("prefix") == F.col("_p")), "left_semi")
        blank = {"visitor_id": "long", "category_id": "int", "registered_at": "timestamp_ntz", "registration_code": "string"}
        before = known.select("tenant_id", "prefix", F.col("last").alias("brought"), F.lit(False).alias("takes"), F.lit(False).alias("arrived"),
                              *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
        numbered = number_as_inserted(rows.unionByName(before), ["tenant_id", "prefix"], ["arrived", "registered_at", "visitor_id"], "takes", "brought")
        given = F.when(F.col("takes"), F.concat("prefix", lpad_keep("number", WIDTH))).otherwise(F.col("registration_code"))
        written = numbered.withColumn("registration_code", given).withColumn("number", F.coalesce("number", "brought"))
        fields = T.StructType.fromDDL(CODES).names
        written.select(*fields).write.mode("overwrite").parquet(f"{self.root}/codes/step={step}")

        own = spark.read.schema(CODES).parquet(f"{self.root}/codes/step={step}").where("number IS NOT NULL")
        now = own.select("tenant_id", "prefix", F.col("number").alias("last"))
        whole = step - base >= COMPACT
        if whole:
            now = now.unionByName(last)
        (now.groupBy("tenant_id", "prefix").agg(F.max("last").alias("last"))
            .write.mode("overwrite").parquet(f"{self.root}/last/step={step}"))
        pointer = spark.createDataFrame([(step, step if whole else base, stream, batch_id)], STEPS)
        pointer.coalesce(1).write.mode("append").parquet(f"{self.root}/steps")

    def handler(self, stream: str):
        """For ``foreachBatch`` of the stream of that name."""
        return lambda batch, batch_id: self.allocate(batch, stream, batch_id)
