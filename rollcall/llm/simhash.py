"""SimHash near-dedup by anchor-point covering.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased,
``shingle``-word shingles with repeats, space-joined (fewer words: the whole
sequence), each hashed with XXH64 (seed 42); a bit is 1 if more than half of
the hashes set it. No words: fingerprint zero, linked like any other.

Links (at most 4 differing bits) are found between *distinct* fingerprints:

1. The 64 bits are cut into three parts of 22, 21 and 21 bits. Two
   fingerprints within 4 bits agree in some part up to 1 bit.
2. Anchors of a part are the code words of the binary Golay code, whose
   covering radius is 3: every part value has exactly one anchor within 3 bits
   (its home), and a value one bit away is within 3 + 1 bits of that anchor.
   So a fingerprint is replicated to every anchor within 4 bits, and each
   anchor compares those that have their home there with all replicas.
3. An anchor gives a link from each fingerprint to the smallest one that it
   reaches there, never all pairs: that keeps every connection. Crowded
   anchors are split: their homes are dealt to several tasks, the replicas
   are repeated. Counts per anchor are at most 3 * 4096 rows.
4. Components are the closure of the links by alternating large-star and
   small-star steps over the linked fingerprints.

Null or empty text has fingerprint zero, a text of any length is hashed whole.
Rows that repeat a ``doc_id`` keep their rows; a null ``doc_id`` takes part, and
a component of null ids alone has a null ``component_id``. An empty table gives
no rows. Columns that are not named in ``carry`` play no part; a carried column
named as one of the results comes back with ``_of_row`` appended.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import settle, text_hashes, with_file_key

SHINGLE, MAX_BITS = 4, 4
#: (lowest bit, width) of the parts.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
#: Homes times replicas that one task of an anchor compares.
PAIRS_PER_TASK = 50_000_000
_SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    n = max(1, len(words) - shingle + 1)
    starts = [0] + [e + 1 for e in ends[:n - 1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[s:e], _SEED) for s, e in zip(starts, ends[-n:])], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)],
                                             [*batch.schema.names[:-1], "_fp"])
    return run


def with_fingerprint(docs: DataFrame, text_col: str, carry: list[str], shingle: int = SHINGLE) -> DataFrame:
    """The ``carry`` columns and ``_fp``, the fingerprint as a signed long."""
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField("_fp", T.LongType())])
    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(_fingerprints(shingle), schema)




def _syndromes() -> tuple[list[np.ndarray], np.ndarray]:
    """By syndrome (remainder by the generator): the error patterns of up to 4
    bits, and the pattern of at most 3 bits, the home's."""
    def rest(v: np.ndarray) -> np.ndarray:
        for bit in range(22, 10, -1):
            v = np.where(v >> bit & 1, v ^ (GOLAY << (bit - 11)), v)
        return v
    one = [1 << i for i in range(23)]
    by: list[list[int]] = [[] for _ in range(2048)]
    home = np.zeros(2048, np.int64)
    level = [(0, -1)]
    for weight in range(5):
        found = np.array([e for e, _ in level], np.int64)
        for e, s in zip(found.tolist(), rest(found).tolist()):
            by[s].append(e)
            if weight <= 3:
                home[s] = e
        level = [(e | one[i], i) for e, last in level for i in range(last + 1, 23)]
    return [np.array(x, np.int64) for x in by], home


def syndrome(v: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        v = np.where(v >> bit & 1, v ^ (GOLAY << (bit - 11)), v)
    return v


def _to_anchors(batches):
    """One row for each anchor within 4 bits of each part, with whether it is
    the part's home."""
    patterns, home = _syndromes()
    sizes = np.array([len(x) for x in patterns])
    flat, first = np.concatenate(patterns), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        for part, (low, width) in enumerate(PARTS):
            v = (fp >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64)
            s = syndrome(v)
            n = sizes[s]
            row = np.repeat(np.arange(len(v)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            e = flat[first[s][row] + nth]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp.view(np.int64)[row]), pa.array(np.full(len(row), part, np.int32)),
                 pa.array((v[row] ^ e).astype(np.int32)), pa.array(e == home[s][row])], ["fp", "part", "anchor", "home"])




def _links(max_bits: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        """A link from each fingerprint to the smallest that it reaches here."""
        fp = t.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(fp, kind="stable")
        fp, home = fp[order], t.column("home").to_numpy()[order]
        at_home = np.flatnonzero(home)
        parent = np.arange(len(fp))
        step = max(1, 4_000_000 // max(1, len(fp)))
        for i in range(0, len(at_home), step):
            some = at_home[i:i + step]
            a, b = np.nonzero(np.bitwise_count(fp[some][:, None] ^ fp[None, :]) <= max_bits)
            a = some[a]
            apart = a != b
            _unite(parent, a[apart], b[apart])
        root = _roots(parent)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[linked].view(np.int64), "b": fp[root[linked]].view(np.int64)})
    return run


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent[:] = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook the larger root of each link under the smaller until all agree."""
    while len(a):
        root = _roots(parent)
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within
    ``max_bits`` (at most 4, what the anchors cover) of each other."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the anchors cover up to 4 differing bits")
    placed = settle(prints.mapInArrow(_to_anchors, "fp long, part int, anchor int, home boolean"), "anchors")
    load = placed.groupBy("part", "anchor").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("home"), 1)).alias("homes"))
    # At most 3 * 4096 anchors, whatever the number of fingerprints. An anchor without two members has no link.
    splits = load.where("n > 1 AND homes > 0").select(
        "part", "anchor", F.least(F.col("homes"), F.ceil(F.col("n") * F.col("homes") / PAIRS_PER_TASK)).cast("int").alias("splits"))
    dealt = placed.join(F.broadcast(splits), ["part", "anchor"]).withColumn(
        "own", F.pmod(F.xxhash64("fp"), "splits").cast("int"))
    sent = dealt.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    return (sent.select("fp", "part", "anchor", "split", (F.col("home") & (F.col("own") == F.col("split"))).alias("home"))
            .groupBy("part", "anchor", "split").applyInArrow(_links(max_bits), "a long, b long").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by
    large-star and small-star steps; each round is written before the next."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        # Large star: each node's larger neighbours go to its smallest neighbour or itself.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # It is written, so that the join deals both sides by ``u`` itself and Spark splits a centre's rows.
        low = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")), "low")
        large = settle(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                       .where("u <> v").distinct(), "large")
        # Small star: each node and its smaller neighbours go to the smallest of them.
        low = settle(large.groupBy("u").agg(F.min("v").alias("low")), "low")
        small = settle(large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
                       .where("u <> v").distinct(), "small")
        done = small.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(small, ["u", "v"], "left_anti").isEmpty()
        edges = small
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (),
                          shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col``, the ``carry`` columns, ``fingerprint`` (16 hex digits),
    ``component_id``, the smallest id that links reach, and ``component_fp``,
    the component's smallest fingerprint as a signed long (never null)."""
    kept = list(dict.fromkeys([id_col, *carry]))
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("_row"), docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    marked = settle(with_fingerprint(rows, "_text", ["_row", "_id"], shingle), "prints")
    prints = settle(marked.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct")
    roots = components(near_links(prints.select(F.col("_fp").alias("fp")), max_bits))
    rooted = prints.join(roots, prints["_fp"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "_fp"))
    rooted = settle(rooted.select("_fp", "_least", "_root"), "rooted")
    least = rooted.groupBy("_root").agg(F.min("_least").alias("component_id")).select(F.col("_root").alias("component_fp"), "component_id")
    own = settle(rooted.join(least, F.col("_root") == F.col("component_fp"))
                 .select(F.col("_fp").alias("_print"), "component_fp", "component_id"), "classes")
    added = ("fingerprint", "component_id", "component_fp")
    return (marked.join(own, marked["_fp"] == own["_print"], "left")
            .select(*[F.col(f"_row.`{c}`").alias(c if c not in added else f"{c}_of_row") for c in kept],
                    F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id", "component_fp"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                      max_bits: int = MAX_BITS, key: list[Column] | None = None) -> DataFrame:
    """The rows of ``docs`` but for near copies: of each component the row with
    the smallest id stays (null ids last, ties by the text's hashes, then by the
    row's place). ``key``: two columns that name each row and read the same
    every time, as file and place in it; without them the rows are written
    first. Only keys are grouped and compared, whole rows move once at most."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    if key is None:
        rows = with_file_key(settle(docs.select(row), "rows"))
    else:
        rows = docs.select(row, key[0].alias("_file"), key[1].alias("_at"))
    own = ["_file", "_at"]
    h1, h2 = text_hashes(F.col("_text"))
    slim = rows.select(*own, F.col(f"_row.`{id_col}`").alias("_id"), F.col(f"_row.`{text_col}`").alias("_text")).withColumns({"_h1": h1, "_h2": h2})
    groups = settle(near_duplicate_groups(slim, "_id", "_text", ["_h1", "_h2", *own], shingle, max_bits)
                    .select("component_fp", F.struct(F.col("_id").isNull().alias("n"), "_id", "_h1", "_h2", *own).alias("k")), "members")
    first = settle(groups.groupBy("component_fp").agg(F.min("k").alias("first")), "first")
    gone = settle(groups.join(first, "component_fp").where("k <> first").select(*[F.col(f"k.{c}").alias(f"_gone{c}") for c in own]), "gone")
    on = (F.col("_file") == F.col("_gone_file")) & (F.col("_at") == F.col("_gone_at"))
    return rows.join(gone, on, "left_anti").select("_row.*")
