"""Benchmark decontamination as a prefix-filtered set join.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased. A window is ``window`` consecutive words of an item; an item of
fewer words, but not none, is one window. A document contains a window if the
window's words stand in it in a row.

1. A window is the set of its ``shingle``-word shingles (all its words where it
   is shorter). One Arrow pass over the documents keeps the positions whose
   shingle may be one of a window's: a bitmap of at most 2**26 bits tells. It
   only spares work; with a large benchmark it lets more positions through.
   Of each run of such positions it keeps what is long enough for a window
   (the length bound) with the run's words.
2. Shingles are ordered by rarity over all documents. A contained window has
   all its shingles in the document, so its necessary prefix is the single
   rarest one: documents and windows join on that token alone.
3. The token's offset in the window fixes where the window must begin; it must
   begin and end inside the run (the positional bound).
4. What is left is verified word by word against the run's words.

Null or empty text has no words and no hits; an item without words has no
windows. Repeated rows of one document each get a result. Null ids are kept
(a null item_id is left out of the list of items but counts as one).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollcall.llm.common import bitmap_of, in_bitmap, settle, text_hashes

WINDOW, SHINGLE = 10, 5
MAX_BITS = 1 << 26
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SEED = 42


def words_of(text: bytes | None) -> list[bytes]:
    return _WORD.findall((text or b"").lower())


def _item_windows(window: int):
    def run(batches):
        for batch in batches:
            ids, found, sizes = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = words_of(text)
                n = min(window, len(words))
                wins = {b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)} if n else ()
                found.extend(wins)
                ids.extend([item] * len(wins))
                sizes.extend([n] * len(wins))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(found, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32())],
                ["item_id", "window", "size"])
    return run


def _tokens(flat: bytes, starts: list[int], ends: list[int], k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of the space-joined words."""
    digest = xxhash.xxh64_intdigest
    n = len(starts) - k + 1
    return np.fromiter((digest(flat[s:e], _SEED) for s, e in zip(starts[:n], ends[k - 1:])), np.uint64, max(n, 0))


def _runs(bitmap, bits: int, kinds: dict[int, int]):
    """For each document a row with its number of words, and a row for each
    run of positions that may be shingles of windows. ``kinds``: shingle
    length -> shortest run that can hold a window."""
    def run(batches):
        page = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            row, kind, at, words_col, token_col = [], [], [], [], []
            for r, text in enumerate(texts):
                words = words_of(text)
                row.append(r), kind.append(0), at.append(len(words)), words_col.append(None), token_col.append(None)
                if not words:
                    continue
                flat, starts, ends, p = b" ".join(words), [], [], 0
                for w in words:
                    starts.append(p)
                    ends.append(p + len(w))
                    p += len(w) + 1
                for k, least in kinds.items():
                    if len(words) < k:
                        continue
                    tokens = _tokens(flat, starts, ends, k)
                    hit = np.flatnonzero(in_bitmap(page, bits, tokens))
                    for some in np.split(hit, np.flatnonzero(np.diff(hit) != 1) + 1) if len(hit) else ():
                        if len(some) >= least:
                            a, b = int(some[0]), int(some[-1]) + 1
                            row.append(r), kind.append(k), at.append(a)
                            words_col.append(words[a:b + k - 1])
                            token_col.append(tokens[a:b].view(np.int64))
            take = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(take) for c in ("id", "h1", "h2")], pa.array(kind, pa.int32()), pa.array(at, pa.int64()),
                 pa.array(words_col, pa.list_(pa.binary())), pa.array(token_col, pa.list_(pa.int64()))],
                ["id", "h1", "h2", "kind", "at", "words", "tokens"])
    return run


def _window_tokens(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, size, kind, token, offset), one row per shingle position."""
    w = windows.withColumn("ws", F.split("window", " ")).withColumn("kind", F.least(F.lit(shingle), F.col("size")))
    w = w.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("kind"))))
    return w.select("window", "size", "kind", "offset", F.xxhash64(
        F.concat_ws(" ", F.slice("ws", F.col("offset") + 1, F.col("kind")))).alias("token"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, its text's hashes ``h1`` and
    ``h2``, n_words, n_hit (words inside any occurrence of a window), n_items,
    item_ids (sorted as strings) and contaminated."""
    spark = docs.sparkSession
    owned = settle(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
                   .mapInArrow(_item_windows(window), f"item_id {items.schema[item_id].dataType.simpleString()}, window string, size int")
                   .distinct(), "windows")
    windows = owned.select("window", "size").distinct()
    parts = settle(_window_tokens(windows, shingle), "shingles")
    marks, bits = bitmap_of(parts, "token", parts.count(), MAX_BITS)
    bitmap = spark.sparkContext.broadcast(marks)
    # At most ``window`` sizes: the shortest run of shingles that can hold a window.
    kinds = {r.kind: r.least for r in parts.groupBy("kind").agg(F.min(F.col("size") - F.col("kind") + 1).alias("least")).collect()}
    h1, h2 = text_hashes(F.col(text_col))
    scan = settle(docs.select(F.col(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), F.col(text_col).alias("text"))
                  .mapInArrow(_runs(bitmap, bits, kinds), f"id {docs.schema[id_col].dataType.simpleString()}, h1 long, h2 long, "
                              "kind int, at long, words array<binary>, tokens array<long>"), "runs")
    runs = scan.where("kind > 0")
    key = ["id", "h1", "h2"]

    found = runs.select(*key, "kind", "at", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "token"))
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    prefix = settle(parts.join(counts, "token").groupBy("window", "size", "kind")
                    .agg(F.min(F.struct("seen", "token", "offset")).alias("first"))
                    .select("window", "size", "kind", "first.token", "first.offset"), "prefix")
    begins = (found.join(prefix, ["kind", "token"])
              .withColumn("begin", F.col("i") - F.col("offset"))
              .where("begin >= 0 AND begin + size <= n + kind - 1"))
    by_run = begins.groupBy(*key, "kind", "at").agg(F.collect_set(F.struct("begin", "size", "window")).alias("cands"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*key, "kind", "at")]
    once = runs.groupBy(*key, "kind", "at").agg(F.first("words").alias("words"))
    both = by_run.alias("c").join(once.alias("r"), same[0] & same[1] & same[2] & same[3] & same[4])
    words = F.transform("words", lambda w: w.cast("string"))
    checked = F.filter("cands", lambda c: F.concat_ws(" ", F.slice("text_words", c["begin"] + 1, c["size"])) == c["window"])
    hits = settle(both.select(*[F.col(f"c.{k}") for k in (*key, "at")], "cands", words.alias("text_words"))
                  .select(*key, "at", F.explode(checked).alias("hit"))
                  .select(*key, (F.col("at") + F.col("hit.begin")).alias("a"), (F.col("at") + F.col("hit.begin") + F.col("hit.size")).alias("b"),
                          "hit.window"), "hits")

    seen = F.max("b").over(Window.partitionBy(*key).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    covered = (hits.select(*key, "a", "b").distinct().withColumn("seen", F.coalesce(seen, F.lit(0)))
               .groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "seen"))).alias("n_hit")))
    listed = (hits.select(*key, "window").distinct().join(owned, "window").select(*key, "item_id").distinct()
              .groupBy(*key).agg(F.count(F.lit(1)).alias("n_items"),
                                 F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids")))
    found = settle(_on_key(covered, listed, key, "inner"), "marks")
    out = _on_key(scan.where("kind = 0").select(*key, F.col("at").alias("n_words")), found, key, "left")
    return out.select(F.col("id").alias(id_col), "h1", "h2", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                      F.col("n_hit").isNotNull().alias("contaminated"))


def _on_key(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """Join on ``key`` where null meets null."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in key], *[c for c in right.columns if c not in key])
    on = [left[k].eqNullSafe(other[f"_{k}"]) for k in key]
    return left.join(other, on[0] & on[1] & on[2], how).drop(*[f"_{k}" for k in key])


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    marks = contamination(docs, items, id_col, text_col).where("contaminated").select(
        F.col(id_col).alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    h1, h2 = text_hashes(docs[text_col])
    return docs.join(marks, docs[id_col].eqNullSafe(marks["_id"]) & (h1 == marks["_h1"]) & (h2 == marks["_h2"]), "left_anti")
