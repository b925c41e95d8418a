"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's shingles are its runs of ``shingle`` words (words stand between
``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a shorter text is one shingle of all its
words). Each is hashed to 64 bits; the sketch is the sorted array of the ``k``
smallest distinct hashes. Sketches of parts merge into the sketch of the whole,
and estimate

- resemblance: of the k smallest hashes of the union, the share in both;
- containment of A in B: resemblance * |A or B| / |A|;
- the number of distinct shingles: exact below k, else (k - 1) / u, where u is
  the k-th smallest hash as a part of the hash range.

All of it is built-in column functions. Null and empty text have the empty
sketch. Two empty sketches resemble each other fully, an empty one and another
not at all. A text of any length is sketched whole, in one row. Rows that repeat
an id, and null ids, are rows of their own, in the order of the text's hash. An
empty table gives no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import settle, slice_of, with_file_key
from rollcall.operators.common import number_within_groups

SHINGLE, K = 5, 128
#: Documents of one part of the order, about.
ROWS_PER_PART = 2000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text: Column, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the sketch of ``text`` as array<long>."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BLANK), lambda w: w != "")
    some = df.withColumn("_words", words)
    starts = F.slice("_words", 1, F.greatest(F.size("_words") - shingle + 1, F.lit(1)))
    hashes = F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get("_words", i + j) for j in range(1, shingle)]))
    return some.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop("_words")


def merged(sketches: list[Column], k: int = K) -> Column:
    """The sketch of the union."""
    return F.slice(F.sort_array(reduce(F.array_union, sketches)), 1, k)


def merge_parts(parts: DataFrame, by: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each ``by`` from the sketches of its parts. Hashes are
    counted apart before they meet, so a group holds distinct hashes only."""
    hashes = parts.select(*by, F.explode(sketch).alias("_h")).distinct()
    ranked = hashes.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_n") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merged([a, b], k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(sketch, k).cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of A's shingles that are in B."""
    whole = distinct_shingles(merged([a, b], k), k)
    own = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * whole / own))


def as_hex(sketch: Column) -> Column:
    return F.lower(F.concat_ws("", F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0"))))


#: A slice of so many parts' documents is cut anew.
CROWDED = 8


def _in_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (id, h, text) with ``part``: parts stand in the order of ids, each
    of about ROWS_PER_PART rows; and the parts that have rows.

    Even slices of the range of ids are taken if no slice is crowded. Where ids
    are uneven (a far one, many null or repeated ones) the rows are written and
    numbered by (id, h) in measured pieces, and a part is so many numbers."""
    span = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).first()
    if span.low is not None:
        part = F.coalesce(slice_of(F.col("id"), span.low, span.high, span.n // ROWS_PER_PART + 1), F.lit(-1))
        parts = settle(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), "parts")
        if parts.agg(F.max("n")).first()[0] <= CROWDED * ROWS_PER_PART:
            return rows.withColumn("part", part), parts
    rows = with_file_key(settle(rows, "rows"))
    slim = settle(rows.select("_file", "_at", "id", "h", F.lit(0).alias("g")), "slim")
    ranked = number_within_groups(slim, ["g"], ["id", "h", "_file", "_at"], out="r")
    at = settle(ranked.select(F.col("_file").alias("_f"), F.col("_at").alias("_a"), F.expr(f"(r - 1) div {ROWS_PER_PART}").alias("part")), "placed")
    placed = rows.join(at, (F.col("_file") == F.col("_f")) & (F.col("_at") == F.col("_a"))).select("id", "h", "text", "part")
    return placed, at.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def with_next(docs: DataFrame, id_col: str, text_col: str, sketch: str) -> DataFrame:
    """(id, text, sketch, next_text, next_sketch): the next row by descending
    id, after the last the first. Ties stand by the text's hash, descending,
    then by the text; null ids last.

    Each part of the order is ordered by itself and gets, as an extra last row,
    the first row of the next part that has rows.
    """
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))
    rows, parts = _in_parts(rows)
    # The first row of a part is a maximum, found with map-side aggregation: no text of other rows moves.
    heads = rows.groupBy("part").agg(F.max(F.struct("id", "h", "text")).alias("first"))
    heads = settle(heads.select("part", F.col("first.text").alias("text")), "heads")
    ranked = settle(number_within_groups(parts.select("part", F.lit(0).alias("g")), ["g"], ["part"], out="r").select("part", "r"), "ranks")
    last = ranked.count()
    links = ranked.select(F.col("part").alias("_from"), F.when(F.col("r") == 1, F.lit(last)).otherwise(F.col("r") - 1).alias("_r")) \
        .join(ranked.select(F.col("part").alias("_to"), "r"), F.col("_r") == F.col("r")).select("_from", "_to")
    extra = links.join(heads, F.col("_to") == F.col("part")).select(
        F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), F.lit(None).cast("long").alias("h"), "text", F.col("_from").alias("part"), F.lit(True).alias("extra"))
    both = with_sketch(rows.withColumn("extra", F.lit(False)).unionByName(extra), F.col("text"), sketch)
    order = Window.partitionBy("part").orderBy("extra", F.desc("id"), F.desc("h"), F.desc("text"))
    return (both.withColumn("next_text", F.lead("text").over(order)).withColumn(f"next_{sketch}", F.lead(sketch).over(order))
            .where("NOT extra").drop("extra", "part", "h"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Each document's sketch beside that of its edited text (the last half of
    its code points replaced by as many of the next document's first, or all)."""
    rows = with_next(docs, id_col, text_col, "sketch")
    text, other = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.char_length(text).cast("long")
    half = F.expr("n_chars div 2").cast("int")
    edited = F.concat(text.substr(F.lit(1), (F.col("n_chars") - half).cast("int")), other.substr(F.lit(1), half))
    rows = rows.withColumn("n_chars", n).withColumn("edited", edited)
    rows = with_sketch(rows, F.col("edited"), "edited_sketch", k)
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited", "sketch", "edited_sketch",
                       resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
