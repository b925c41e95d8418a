"""Corpus pipeline: toxicity filter, SimHash near-dedup, benchmark
decontamination, mixing to target weights, sharding.

Each stage works on all rows that the one before kept and returns the columns
of ``documents`` (the last adds position, shard and slot). ``run`` writes each
stage's rows into the shared folder and reads them again.

Mixing changes no rows but their order. Its result is laid out by position, and
its plan (which block of which source stands where) is written into the shared
folder under a digest of the rows. Sharding schedules nothing of its own: it
finds the plan by the same digest of its rows and places them by it, however
their files have been split, joined or renamed since, and cuts that order, so
each shard is a slice of the mixture that the mixing stage decided. Rows that no
mixture was made of are cut as they stand in their files.

Every stage decides on slim rows and moves whole rows at most twice. Null and
empty texts, null ids and sources stay in (they are not toxic and hold no
benchmark passage; near copies of each other count as one group); whole texts
count, however long; of rows that are alike in all columns near-dedup keeps one
and the other stages all. Further columns pass through untouched, whatever their
names; where the last stage's names are taken, its columns get ``_in_mixture``
appended. An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollcall.llm import toxicity as tox
from rollcall.llm.common import numbered, settle, table, text_hashes, with_file_key
from rollcall.llm.decontaminate import without_contaminated
from rollcall.llm.mixing import PLAN, mix, placed, schedule
from rollcall.llm.sharding import shard_rows
from rollcall.llm.simhash import one_of_each_group
from rollcall.operators.common import number_within_groups, running_within_groups
from rollcall.session import ensure_checkpoint_dir

SHARDS = 16
#: Documents with this score or more are rejected.
TOXIC = 0.5
#: Weights of the mixture by source; None: by the sources' sizes.
WEIGHTS: dict | None = None
#: Rows of one file of the mixture at most, about.
ROWS_PER_FILE = 100_000


def _rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct, beside the columns that stages read: whatever
    further columns there are, their names meet no other."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["doc_id"], docs["text"], docs["source"])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar rejects go."""
    model = tox.fit(docs, table(spark, sf_dir, "labels"))
    return tox.score(_rows(docs), model, carry=["_row"]).where(F.col("score") < TOXIC).select("_row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row as ``_row`` with its key (file, place in it)."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    try:
        return docs.select(row, F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:   # not read from files: written once as it stands
        return with_file_key(settle(docs.select(row), "rows"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id stays."""
    rows = _keyed(docs)
    slim = rows.select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"), "_file", "_at")
    return one_of_each_group(slim, key=[F.col("_file"), F.col("_at")]).select("_row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _slim(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with their keys, and the written slim rows: key, id, source, the
    hash of the whole row, the text's hashes and its size."""
    rows = _keyed(docs)
    h1, h2 = text_hashes(F.col("_row.text"))
    slim = rows.select("_file", "_at", "_row.doc_id", "_row.source", F.xxhash64("_row.doc_id", "_row.source", "_row").alias("place"), h1.alias("h1"), h2.alias("h2"),
                       (F.coalesce(F.octet_length("_row.text"), F.lit(0)) + 1).cast("long").alias("size"))
    return rows, settle(slim, "slim")


def _plan_path(spark: SparkSession, slim: DataFrame) -> str:
    """Where the plan of a mixture of these rows is: their number and sums of
    their hashes name them, in whatever order or files they stand."""
    whole = "decimal(20,0)"
    d = slim.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("place").cast(whole)).alias("a"), F.sum(F.xxhash64("place", "h1", "h2").cast(whole)).alias("b")).first()
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-mixture-of-{d.n}-{d.a or 0}-{d.b or 0}"


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mixture; the plan is written
    for the sharding stage. A repeated run with other weights replaces it."""
    rows, slim = _slim(docs)
    plan = schedule(slim, weights=WEIGHTS, path=_plan_path(spark, slim))
    at = settle(placed(slim, plan, carry=["_file", "_at"], place="place").select(
        F.col("_file").alias("_f"), F.col("_at").alias("_a"), "position"), "positions")
    n = at.agg(F.max("position")).first()[0]
    whole = rows.join(at, (F.col("_file") == F.col("_f")) & (F.col("_at") == F.col("_a"))).select("_row", "position")
    # Positions are gapless, so equal slices of them are files of equal numbers of rows.
    files = min(max(1, n or 0), max(int(spark.conf.get("spark.sql.shuffle.partitions")), (n or 0) // ROWS_PER_FILE + 1))
    share = -(-((n or 0) + 1) // files)
    return (whole.repartitionById(files, F.expr(f"cast(position div {share} as int)"))
            .sortWithinPartitions("position").select("_row.*"))


def _as_laid_out(rows: DataFrame, docs: DataFrame, slim: DataFrame) -> DataFrame:
    """(_file, _at, position): a row's place from 0 in the order in which the
    rows stand in their files: by the number that Spark's writer gave the file,
    then the file's path, then the row in it."""
    files = settle(docs.select(F.col("_metadata.file_path").alias("path"), F.xxhash64("_metadata.file_path").alias("_f")).distinct(), "files")
    number = [F.coalesce(F.regexp_extract("path", p, 1).try_cast("long"), F.lit(-1)) for p in (r"/part-(\d+)[^/]*$", r"\.c(\d+)[^/]*$")]
    ordered = number_within_groups(files.select("_f", *[c.alias(f"n{i}") for i, c in enumerate(number)], "path").withColumn("_all", F.lit(0)),
                                   ["_all"], ["n0", "n1", "path"], out="_file_no").select("_f", "_file_no")
    last = slim.groupBy("_file").agg((F.max("_at") + 1).alias("rows")).join(ordered, F.col("_file") == F.col("_f")).drop("_f")
    starts = running_within_groups(last.withColumn("_all", F.lit(0)), ["_all"], ["_file_no"], out="_end", weight="rows").select(
        F.col("_file").alias("_f"), (F.col("_end") - F.col("rows")).alias("_start"))
    at = settle(slim.join(starts, F.col("_file") == F.col("_f")).select("_file", "_at", (F.col("_start") + F.col("_at")).alias("position")), "laid")
    whole = at.agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last")).first()
    if not whole.n or whole.last + 1 == whole.n:
        return at
    # Only some rows of the files: the gaps between them are closed.
    return numbered(at.withColumnRenamed("position", "_place").withColumn("_all", F.lit(0)), "_all", "_place", "position").drop("_all", "_place")


def _order(spark: SparkSession, docs: DataFrame, rows: DataFrame, slim: DataFrame) -> DataFrame:
    """(_file, _at, position) by the plan that the mixing stage wrote for these
    rows, else as they are laid out."""
    try:
        plan = spark.read.schema(PLAN).parquet(_plan_path(spark, slim))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        try:
            docs.select("_metadata.file_path")
        except AnalysisException:   # not read from files: as they were written
            docs = rows
        return _as_laid_out(rows, docs, slim)
    return placed(slim, plan, carry=["_file", "_at"], place="place").select("_file", "_at", "position")


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with position, shard and slot: contiguous runs of the
    order of the mixture, with near-equal bytes; equal texts share a shard."""
    rows, slim = _slim(docs)
    at = _order(spark, docs, rows, slim).select(F.col("_file").alias("_f"), F.col("_at").alias("_a"), "position")
    one = (F.col("_file") == F.col("_f")) & (F.col("_at") == F.col("_a"))
    sized = slim.join(at, one).select("_file", "_at", "position", "h1", "h2", "size")
    sharded = settle(shard_rows(sized, ["h1", "h2"], "size", "position", "position", SHARDS).select(
        F.col("_file").alias("_f"), F.col("_at").alias("_a"), "position", "shard", "slot"), "shards")
    taken = docs.columns
    added = [F.col(c).alias(c if c not in taken else f"{c}_in_mixture") for c in ("position", "shard", "slot")]
    return rows.join(sharded, one).select("_row.*", *added)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("sharding", sharding)]

#: The toxicity model and XXH64 fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
