"""Visitor search through a trigram index.

``build`` writes three tables under one folder:

- ``rows``: the visitors, one folder for each of at most BLOCKS blocks (a hash
  of the id);
- ``postings``: for each trigram of a searched field, in lower case, the sorted
  ids that hold it, cut by block and page, so a trigram that every row holds is
  many rows of at most about PAGE ids; one folder for each of BUCKETS buckets of
  trigrams, sorted inside, so a lookup reads one folder and few row groups;
- ``counts``: how many ids hold each trigram.

``search`` looks up the counts of the term's trigrams, takes the rarest first
and further ones while they are at most WORTH times as common, intersects their
postings block by block, reads the rows of the blocks that are left and checks
the real condition there, so the result is that of a scan. A term without three
letters in a row has no trigram, and one whose rarest trigram is in more than
SCAN_SHARE of the rows saves nothing: those are scans of ``rows``, as a trigram
index does it in a database.

``add`` appends visitors that the index does not hold: their rows, postings and
counts stand beside the earlier ones and are read with them.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.io import scratch_path

FIELDS = ("first_name", "last_name", "email", "registration_code")
BLOCKS, BUCKETS, PAGE = 1024, 256, 32_768
#: Rows of a block at least, before there is a second one.
BLOCK_ROWS = 4096
WORTH, SCAN_SHARE = 8, 0.25


def trigrams(*fields: Column) -> Column:
    """The distinct runs of three characters of the fields, in lower case."""
    def of(c: Column) -> Column:
        low = F.lower(F.coalesce(c, F.lit("")))
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(low) - 2, F.lit(1)))
        return F.filter(F.transform(starts, lambda i: low.substr(i, F.lit(3))), lambda g: F.char_length(g) == 3)
    return F.array_distinct(F.flatten(F.array(*[of(c) for c in fields])))


def literal_runs(term: str) -> list[str]:
    """The stretches of a LIKE term between its wildcards, unescaped."""
    runs, some, chars = [], [], iter(term)
    for c in chars:
        if c in "%_":
            runs.append("".join(some))
            some = []
        else:
            some.append(next(chars, c) if c == "\\" else c)
    return [r for r in [*runs, "".join(some)] if len(r) >= 3]


@dataclass
class TrigramIndex:
    spark: SparkSession
    path: str
    id_col: str
    fields: tuple[str, ...]
    blocks: int
    pages: int
    schema: T.StructType

    def _read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    @property
    def rows(self) -> DataFrame:
        return self._read("rows", T.StructType([*self.schema.fields, T.StructField("_block", T.IntegerType())]))

    @property
    def postings(self) -> DataFrame:
        kind = self.schema[self.id_col].dataType.simpleString()
        return self._read("postings", f"trigram string, _block int, _page int, ids array<{kind}>, _bucket int")

    @property
    def counts(self) -> DataFrame:
        return self._read("counts", "trigram string, n long").groupBy("trigram").agg(F.sum("n").alias("n"))

    def _placed(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64(F.col(self.id_col))
        return rows.withColumns({"_block": F.pmod(h, F.lit(self.blocks)).cast("int"),
                                 "_page": F.pmod(F.expr(f"xxhash64(11, `{self.id_col}`)"), F.lit(self.pages)).cast("int")})

    def add(self, rows: DataFrame) -> None:
        """Appends rows whose ids the index does not hold yet; rows without an
        id cannot be found by one and are left out."""
        rows = self._placed(rows.select(*self.schema.names).where(F.col(self.id_col).isNotNull()))
        rows.drop("_page").repartition("_block").write.mode("append").partitionBy("_block").parquet(f"{self.path}/rows")
        held = rows.select(F.col(self.id_col).alias("id"), "_block", "_page", F.explode(trigrams(*[F.col(c) for c in self.fields])).alias("trigram"))
        bucket = F.pmod(F.xxhash64("trigram"), F.lit(BUCKETS)).cast("int")
        lists = held.groupBy("trigram", "_block", "_page").agg(F.sort_array(F.collect_set("id")).alias("ids"))
        lists = lists.withColumn("_bucket", bucket)
        # Sorted by bucket first, so a writer holds one file open; by trigram, so row groups are narrow.
        (lists.repartition("_bucket", "_block").sortWithinPartitions("_bucket", "trigram")
              .write.mode("append").partitionBy("_bucket").parquet(f"{self.path}/postings"))
        held.groupBy("trigram").agg(F.count(F.lit(1)).alias("n")).sort("trigram").write.mode("append").parquet(f"{self.path}/counts")

    def lookup(self, grams: Sequence[str]) -> DataFrame:
        """The posting rows of some trigrams."""
        spots = self.spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(BUCKETS)).cast("int")).collect()
        return self.postings.where(F.col("_bucket").isin(sorted({r[0] for r in spots})) & F.col("trigram").isin(list(grams)))

    def chosen(self, term: str) -> list[str] | None:
        """The term's trigrams that are looked up, the rarest first; none if a
        row cannot match; None where a scan is as good."""
        runs = literal_runs(term)
        if not runs:
            return None
        asked = self.spark.createDataFrame([(r,) for r in runs], "r string").select(F.explode(trigrams(F.col("r"))).alias("g")).distinct()
        grams = [r.g for r in asked.collect()]          # no more than the term has letters
        found = {r.trigram: r.n for r in self.counts.where(F.col("trigram").isin(grams)).collect()}
        if len(found) < len(grams):
            return []
        order = sorted(grams, key=lambda g: (found[g], g))
        if found[order[0]] > SCAN_SHARE * self.rows.count():
            return None
        return [g for g in order if found[g] <= WORTH * found[order[0]]]

    def candidates(self, term: str) -> DataFrame | None:
        """(_block, id) of the rows that hold the chosen trigrams; None: all."""
        grams = self.chosen(term)
        if grams is None:
            return None
        if not grams:
            return self.rows.select("_block", F.col(self.id_col).alias("id")).limit(0)
        lists = self.lookup(grams).groupBy("_block", "_page", "trigram").agg(F.flatten(F.collect_list("ids")).alias("ids"))
        both = lists.groupBy("_block", "_page").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(grams))
        # One list for each trigram, each with at most a page's ids.
        common = F.aggregate(F.slice("lists", 2, len(grams)), F.element_at("lists", 1), lambda acc, x: F.array_intersect(acc, x))
        return both.select("_block", F.explode(common).alias("id"))

    def matching(self, term: str) -> DataFrame:
        """The rows with the term in a field, as ILIKE '%term%' finds them."""
        hit = F.lit(False)
        for c in self.fields:
            hit = hit | F.col(c).ilike(f"%{term}%")
        some = self.candidates(term)
        if some is None:
            return self.rows.where(hit).drop("_block")
        path = scratch_path(self.spark, "candidates")
        some.write.parquet(path)
        some = self.spark.read.schema(some.schema).parquet(path)
        blocks = [r[0] for r in some.select("_block").distinct().collect()]      # at most BLOCKS numbers
        rows = self.rows.where(F.col("_block").isin(blocks))
        on = (rows["_block"] == some["_block"]) & (rows[self.id_col] == some["id"])
        return rows.join(some, on, "left_semi").where(hit).drop("_block")


def build(visitors: DataFrame, path: str | None = None, id_col: str = "visitor_id", fields: Sequence[str] = FIELDS) -> TrigramIndex:
    """Writes the index of ``visitors`` (unique ids) under ``path``."""
    spark = visitors.sparkSession
    n = visitors.count()
    blocks = max(1, min(BLOCKS, n // BLOCK_ROWS))
    index = TrigramIndex(spark, path or scratch_path(spark, "trigrams"), id_col, tuple(fields), blocks, max(1, -(-n // (blocks * PAGE))), visitors.schema)
    meta = [(id_col, list(fields), index.blocks, index.pages, visitors.schema.json())]
    spark.createDataFrame(meta, "id_col string, fields array<string>, blocks int, pages int, schema string") \
        .coalesce(1).write.parquet(f"{index.path}/meta")
    index.add(visitors)
    return index


def open_index(spark: SparkSession, path: str) -> TrigramIndex:
    m = spark.read.parquet(f"{path}/meta").first()
    return TrigramIndex(spark, path, m.id_col, tuple(m.fields), m.blocks, m.pages, T.StructType.fromJson(json.loads(m.schema)))


def search(index: TrigramIndex, categories: DataFrame, term: str, event_id=None, tenant_id=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """``reports.search_visitors`` through the index: same rows, same order."""
    from .reports import search_visitors
    return search_visitors(index.matching(term), categories, term, event_id=event_id, tenant_id=tenant_id, limit=limit, offset=offset)
