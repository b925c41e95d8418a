"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also
starts earlier (smaller doc_id, or the same document and an earlier start).

1. Every window of ``length`` bytes belongs to one *anchor*: of the ``gram``-byte
   strings inside it the one with the least hash (the leftmost of equals). That
   depends on the window's bytes alone, so equal windows have equal anchors at
   equal offsets. An occurrence of an anchor owns a run of window starts; the
   bytes of these windows are its context. One anchor stands for 30 bytes or so.
2. Anchors are counted with map-side aggregation. Only those that occur twice go
   on (a bitmap of bounded size spares the others the second shuffle, an exact
   join decides). Equal contexts are collapsed to their earliest occurrence: all
   later ones are covered wholly.
3. Anchors with different contexts need to know which windows these share. Each
   batch of anchors is a collection of context strings: it is cut into shards,
   each shard gets its suffix order and Burrows-Wheeler transform, and the
   transforms are merged by interleave refinement: starting from any interleave,
   walking the merged transform and placing each row by its preceding symbol,
   stably, sorts the rows by one more symbol a round (Holt and McMillan). Symbols
   are blocks of STEP bytes, so length / STEP rounds part the rows into blocks
   with a common prefix of ``length`` bytes: the repeated intervals. No suffixes
   are sorted across shards. The earliest window of a block stays.
4. An anchor with more than HOT different contexts would be one large task; its
   windows are pre-aggregated by two 64-bit hashes instead, each on its own.
5. Spans that touch are joined, then those of each document meet its text
   again; covered bytes go.

Null text is empty; texts shorter than ``length`` stay whole. Null ids come
first. Different texts that share a doc_id are separate documents ordered by
their hashes; repeated rows of one document do not cover each other and get
the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcall.llm.common import bitmap_of, in_bitmap, numbered, settle, shuffle_width, text_hashes

LENGTH, GRAM, STEP = 100, 32, 10
#: Symbols of a batch of anchors, and of one shard of it, about.
BATCH, SHARD = 120_000, 16_000
HOT = 20_000
MAX_BITS = 1 << 26
#: A longer text is anchored in overlapping pieces of so many windows.
PIECE = 1 << 22
#: Spans that start in one stretch of so many bytes are joined in one task.
STRETCH = 1 << 16
_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []
_LOW = np.uint64(0xFFFFFF)


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (_ODD, pow(_ODD, -1, 2**64))]
    return _POWERS


def anchors(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, number of windows) of each
    anchor of at most PIECE + length bytes."""
    n = len(b)
    windows, reach = n - length + 1, length - gram + 1
    with np.errstate(over="ignore"):
        up, down = _powers(n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n])])
        h = _stir((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
        # Hash above, position below: the minimum over a window is its leftmost least.
        low, size = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64), 1
        while size * 2 <= reach:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < reach:
            low = np.minimum(low[:-(reach - size)], low[reach - size:])
        at = (low & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        own = np.diff(np.append(first, windows))
        end = first + own + length - 1
        context = _stir((sums[end] - sums[first]) * down[first] + _stir((own * 4096 + at[first] - first).astype(np.uint64)))
        return h[at[first]], context, first, own


def text_anchors(b: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The same of a whole text; pieces overlap so that every window is whole in one."""
    if len(b) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    found = []
    for i in range(0, len(b) - length + 1, PIECE):
        a, c, first, own = anchors(b[i:i + PIECE + length - 1], length, gram)
        found.append((a, c, first + i, own))
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_rows(length: int, gram: int, bitmap=None, bits: int = 0):
    def run(batches):
        page = np.frombuffer(bitmap.value, np.uint8) if bitmap else None
        for batch in batches:
            out, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = text_anchors(np.frombuffer(text.as_buffer() if text.is_valid else b"", np.uint8), length, gram)
                if page is not None:
                    keep = in_bitmap(page, bits, found[0])
                    found = tuple(x[keep] for x in found)
                out.append(found)
                docs.append(np.full(len(found[0]), doc, np.int64))
            a, c, first, own = (np.concatenate(x) for x in zip(*out)) if out else text_anchors(np.zeros(0, np.uint8), length, gram)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(np.concatenate(docs) if docs else np.zeros(0, np.int64)),
                 pa.array(first), pa.array(own.astype(np.int32))], ["a", "c", "doc", "at", "own"])
    return run


# --- shard transforms and their merge ------------------------------------------

def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


class Collection:
    """Strings laid end to end, each followed by STEP empty positions."""

    def __init__(self, strings: list[bytes], step: int = STEP):
        self.step = step
        sizes = np.array([len(s) for s in strings], np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes + step)])[:-1]
        self.last = self.start + sizes + step - 1
        text = np.zeros(int((sizes + step).sum()) + step, np.uint64)
        raw = np.frombuffer(b"".join(strings), np.uint8)
        real = np.arange(len(raw)) + np.repeat(np.arange(len(strings)) * step, sizes)
        text[real] = raw.astype(np.uint64) + np.uint64(1)
        self.n = len(text) - step
        self.owner = np.repeat(np.arange(len(strings)), sizes + step)
        # Symbol of a position: rank of its block of ``step`` bytes; 0 where nothing is left.
        block = np.zeros(self.n, np.int64)
        for i in range(0, step, 5):
            part = np.zeros(self.n, np.uint64)
            for k in range(i, min(i + 5, step)):
                part = part << np.uint64(9) | text[k:k + self.n]
            rank = _ranks(part)
            block = _ranks(block * (int(rank.max()) + 1) + rank) if i else rank
        self.symbol = block + 1
        self.symbol[text[:self.n] == 0] = 0

    def shards(self, size: int) -> list[tuple[int, int]]:
        """Ranges of whole strings, of about ``size`` positions."""
        cuts = [0]
        for end in (self.last + 1).tolist():
            if end - cuts[-1] >= size:
                cuts.append(end)
        if cuts[-1] != self.n:
            cuts.append(self.n)
        return list(zip(cuts, cuts[1:]))

    def suffix_order(self, low: int, high: int) -> np.ndarray:
        """The shard's positions in suffix order (equal suffixes by string), by prefix doubling."""
        last, here = self.last[self.owner[low:high]] - low, np.arange(high - low)
        rank, depth = _ranks(self.symbol[low:high]), self.step
        longest = int((self.last - self.start).max()) + 1
        while depth < longest:
            rank = _ranks(rank * (high - low + 1) + rank[np.minimum(here + depth, last)])
            depth *= 2
        return low + np.argsort(rank, kind="stable")

    def transform(self, order: np.ndarray) -> np.ndarray:
        """The symbol before each suffix; 0 where the string begins."""
        inside = order - self.start[self.owner[order]] >= self.step
        return np.where(inside, self.symbol[order - self.step], 0)


def repeated_blocks(c: Collection, length: int, shard: int = SHARD) -> np.ndarray:
    """For each position the number of its block: positions of one block have
    their first ``length`` bytes in common."""
    step = c.step
    ranges = c.shards(shard)
    orders = [c.suffix_order(*r) for r in ranges]
    before = np.concatenate([c.transform(o) for o in orders])
    before = before.astype(np.uint16 if before.max() < 1 << 16 else np.int64)
    which = np.uint8 if len(ranges) < 1 << 8 else np.uint16 if len(ranges) < 1 << 16 else np.int64
    z = np.repeat(np.arange(len(ranges)), [b - a for a, b in ranges]).astype(which)
    strings = np.bincount(np.searchsorted([b for _, b in ranges], c.start, side="right"), minlength=len(ranges))
    empty = np.repeat(np.arange(len(ranges)), strings * step).astype(which)
    block = np.zeros(c.n, np.int64)
    for _ in range(length // step):
        merged = np.empty_like(before)
        merged[np.argsort(z, kind="stable")] = before       # the merged transform under this interleave
        moved = np.argsort(merged, kind="stable")[len(empty):]
        symbol, old = merged[moved], block[moved]
        z = np.concatenate([empty, z[moved]])
        parted = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (old[1:] != old[:-1])]) if len(moved) else np.zeros(0, bool)
        block = np.concatenate([np.zeros(len(empty), np.int64), np.cumsum(parted)])
    out = np.empty(c.n, np.int64)
    position = np.empty(c.n, np.int64)
    position[np.argsort(z, kind="stable")] = np.concatenate(orders)
    out[position] = block
    return out


def later_windows(strings: list[bytes], own: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int,
                  step: int = STEP, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first, end): runs of its first ``own`` windows that also start earlier in another string."""
    c = Collection(strings, step)
    block = repeated_blocks(c, length, shard)
    string = np.repeat(np.arange(len(strings)), own)
    nth = np.arange(len(string)) - np.repeat(np.cumsum(own) - own, own)
    kind, who, where = block[c.start[string] + nth], doc[string], at[string] + nth
    order = np.lexsort((where, who, kind))
    later = np.ones(len(order), bool)
    sorted_kind = kind[order]
    later[order[np.flatnonzero(np.concatenate([[True], sorted_kind[1:] != sorted_kind[:-1]]))]] = False
    return _runs(string, nth, later)


def _runs(string: np.ndarray, nth: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hit = np.flatnonzero(flag)
    if not len(hit):
        return (np.zeros(0, np.int64),) * 3
    first = np.concatenate([[True], (np.diff(hit) != 1) | (string[hit[1:]] != string[hit[:-1]])])
    last = np.append(first[1:], True)
    return string[hit[first]], nth[hit[first]], nth[hit[last]] + 1


_SPANS = pa.schema([("doc", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _merged_spans(length: int):
    """From partitions sorted by anchor: spans that also stand earlier in
    another context of the anchor. A batch holds whole anchors."""
    def solve(rows: pa.Table) -> pa.RecordBatch:
        own, doc, at = (rows.column(x).to_numpy().astype(np.int64) for x in ("own", "doc", "at"))
        string, first, end = later_windows(rows.column("context").to_pylist(), own, doc, at, length)
        return pa.RecordBatch.from_arrays([pa.array(doc[string]), pa.array(at[string] + first), pa.array(at[string] + end - 1 + length)], schema=_SPANS)

    def run(batches):
        waiting, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            a = batch.column("anchor").to_numpy()
            grown = np.cumsum(batch.column("own").to_numpy().astype(np.int64) + length + STEP)
            starts = np.flatnonzero(np.concatenate([[a[0] != last], a[1:] != a[:-1]]))
            from_, done = 0, 0
            for i in starts.tolist():
                so_far = size + int(grown[i - 1] if i else 0) - done
                if so_far >= BATCH:
                    waiting.append(t.slice(from_, i - from_))
                    yield solve(pa.concat_tables(waiting))
                    waiting, from_, done, size = [], i, int(grown[i - 1] if i else 0), 0
            waiting.append(t.slice(from_))
            size += int(grown[-1]) - done
            last = a[-1]
        if waiting:
            yield solve(pa.concat_tables(waiting))
    return run


def _contexts(length: int):
    """The contexts of each document's anchors; windows alone where it is hot."""
    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text, reps in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("reps").to_pylist()):
                for r in reps:
                    pieces = [(r["at"], r["own"])] if not r["hot"] else [(r["at"] + i, 1) for i in range(r["own"])]
                    for at, own in pieces:
                        for col, v in zip(cols, (r["a"], doc, at, own if not r["hot"] else 0, text[at:at + own + length - 1])):
                            col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                ["anchor", "doc", "at", "own", "context"])
    return run


def _cut(keep_text: bool):
    def run(batches):
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("_text", "_spans")]
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()):
                text, kept, at, runs = text or b"", [], 0, []
                for s in sorted((s["a"], s["b"]) for s in spans or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                for col, v in zip(out, (len(text), len(text) - len(left), len(runs), left if keep_text else hashlib.sha256(left).hexdigest())):
                    col.append(v)
            last = pa.array(out[3], pa.binary() if keep_text else pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(x, pa.int64()) for x in out[:3]], last],
                                             [*names, "n_bytes", "n_removed", "n_spans", "kept"])
    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(doc, text as bytes, carry): ``doc`` orders the documents and names each."""
    id_ = F.col(id_col).cast("long")
    rows = docs.select(*[F.col(c) for c in carry], id_.alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    ids = docs.select(id_.alias("i"))
    span = ids.agg(F.min("i").alias("low")).first()
    none = F.lit(-(2**63) if span.low is None or span.low == -(2**63) else span.low - 1).cast("long")
    doc = F.coalesce(F.col("_id"), none)
    if ids.groupBy(F.coalesce("i", none)).count().where("count > 1").isEmpty():
        return rows.withColumn("_doc", doc).drop("_id")
    # doc_ids repeat: number the different documents.
    h1, h2 = text_hashes(F.col("_text"))
    rows = rows.withColumns({"_id": doc, "_h1": h1, "_h2": h2})
    known = rows.select(F.lit(0).alias("g"), F.col("_id").alias("i"), F.col("_h1").alias("x1"), F.col("_h2").alias("x2")).distinct()
    known = settle(numbered(known, "g", "i", "_doc"), "documents")
    return (rows.join(known, (F.col("_id") == F.col("i")) & (F.col("_h1") == F.col("x1")) & (F.col("_h2") == F.col("x2")))
            .drop("g", "i", "x1", "x2", "_id", "_h1", "_h2"))


def joined(spans: DataFrame) -> DataFrame:
    """(doc, a, b) with the spans of a stretch of a document that touch made one,
    so that a document has no more of them than its bytes allow for: a text
    that repeats itself gives a span for every byte."""
    spans = spans.select("doc", "a", "b", F.expr(f"a div {STRETCH}").alias("stretch"))
    by = Window.partitionBy("doc", "stretch").orderBy("a", "b")
    reached = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("begins", F.when(reached >= F.col("a"), 0).otherwise(1))
    runs = begins.withColumn("run", F.sum("begins").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("doc", "stretch", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("doc", "a", "b")


def later_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, spans): byte spans of each document of (doc, text) that also start
    earlier; spans may overlap. Each doc is one row."""
    spark = texts.sparkSession
    schema = "a long, c long, doc long, at long, own int"
    every = texts.mapInArrow(_anchor_rows(length, gram), schema)
    twice = settle(every.groupBy("a").agg(F.count(F.lit(1)).alias("n"), (F.min("c") != F.max("c")).alias("differ"))
                   .where("n > 1").select("a", "differ"), "anchors")
    marks, bits = bitmap_of(twice, "a", twice.count(), MAX_BITS)
    likely = texts.mapInArrow(_anchor_rows(length, gram, spark.sparkContext.broadcast(marks), bits), schema)
    found = settle(likely.join(twice, "a"), "occurrences")
    first = settle(found.groupBy("a", "c", "differ").agg(F.min(F.struct("doc", "at", "own")).alias("f"), F.count(F.lit(1)).alias("n"))
                   .select("a", "c", "differ", "n", F.col("f.doc").alias("doc"), F.col("f.at").alias("at"), F.col("f.own").alias("own")), "contexts")
    # Later occurrences of a context are covered wholly.
    f = first.where("n > 1").select("a", "c", F.col("doc").alias("first_doc"), F.col("at").alias("first_at"))
    copies = (found.join(f, ["a", "c"]).where("doc <> first_doc OR at <> first_at")
              .select("doc", F.col("at").alias("a"), (F.col("at") + F.col("own") + F.lit(length - 1)).alias("b")))
    copies = settle(joined(copies), "copies")

    apart = first.where("differ")
    crowds = apart.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select(F.col("a").alias("_a"), (F.col("m") > HOT).alias("hot"))
    reps = (apart.join(crowds, F.col("a") == F.col("_a")).groupBy("doc").agg(F.collect_list(F.struct("a", "at", "own", "hot")).alias("reps")))
    reps = settle(reps, "representatives")
    strings = settle(texts.join(reps, "doc").select("doc", "text", "reps")
                     .mapInArrow(_contexts(length), "anchor long, doc long, at long, own int, context binary"), "strings")
    merged = (strings.where("own > 0").repartition(shuffle_width(spark), "anchor").sortWithinPartitions("anchor")
              .mapInArrow(_merged_spans(length), "doc long, a long, b long"))
    w1, w2 = text_hashes(F.col("context"))
    alone = strings.where("own = 0").select(w1.alias("w1"), w2.alias("w2"), "doc", "at")
    least = alone.groupBy("w1", "w2").agg(F.min(F.struct("doc", "at")).alias("f"))
    crowd = (alone.join(least, ["w1", "w2"]).where("doc <> f.doc OR at <> f.at")
             .select("doc", F.col("at").alias("a"), (F.col("at") + length).alias("b")))
    shared = settle(joined(merged.unionByName(crowd)), "shared")
    return copies.unionByName(shared).groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (),
                 length: int = LENGTH, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """``id_col``, the ``carry`` columns, n_bytes, n_removed, n_spans (maximal
    removed runs) and ``kept``: the remaining bytes, or with ``digest`` their SHA-256."""
    if length % STEP or not 8 <= gram < length:
        raise ValueError(f"length must be a multiple of {STEP} and longer than gram")
    cols = list(dict.fromkeys([id_col, *carry]))
    rows = _keyed(docs, id_col, text_col, cols)
    texts = rows.select(F.col("_doc").alias("doc"), F.col("_text").alias("text"))
    spans = later_spans(texts.dropDuplicates(["doc"]) if not _each_once(texts) else texts, length, gram)
    spans = settle(spans.select(F.col("doc").alias("_of"), F.col("spans").alias("_spans")), "spans")
    whole = rows.join(spans, F.col("_doc") == F.col("_of"), "left").select(*cols, "_text", "_spans")
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols]
                       + ["n_bytes long, n_removed long, n_spans long", "kept string" if digest else "kept binary"])
    return whole.mapInArrow(_cut(not digest), schema)


def _each_once(texts: DataFrame) -> bool:
    return texts.groupBy("doc").count().where("count > 1").isEmpty()
