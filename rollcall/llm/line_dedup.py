"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with
A-Z lower-cased. A key of at least ``min_chars`` code points that stands in at
least ``min_docs`` documents is *heavy*: it loses all its lines except in the
largest ``doc_id`` that holds it.

1. One Arrow pass hashes every line key of every document to 128 bits; a
   document gives each of its keys once.
2. Distinct line hashes are counted with map-side aggregation, so a line that
   stands in a third of all documents reaches its reducer as one row per task.
3. The heavy hashes are dealt to shards by hash, and each shard becomes one
   index row: the level bitmaps of a minimal perfect hash, and, at the slot
   that it gives, a fingerprint, a document count and the kept document.
4. Line hashes travel to their shard (split further by document, with the
   small index row repeated, so one frequent line is spread) and probe the
   arrays there. Only (document, dropped key) pairs go on to the documents.

Null or empty text is one empty line. A null ``doc_id`` counts as a document
below every other. Repeated rows of one ``doc_id`` are one document to the
counts and each lose the same lines. A text of any length is one row. An empty
table gives no rows. A carried column named as one of the results comes back
with ``_of_row`` appended; other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import settle, shuffle_width

MIN_CHARS, MIN_DOCS = 20, 3
KEYS_PER_SHARD = 50_000
#: What a null doc_id counts as.
NO_ID = -(2**63)
_BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line's 16-byte key hash, or None for a key that is too short."""
    key = line.strip(_BLANK)
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _line_hashes(min_chars: int):
    def run(batches):
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                keys = {line_key(x, min_chars) for x in (text or b"").split(b"\n")}
                keys.discard(None)
                found.extend(keys)
                ids.extend([doc] * len(keys))
            both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "doc"])
    return run


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """A fresh hash of ``h`` for each level (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = h.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes: level by level, each
    hash that has a cell of its own takes it, the others go to the next level;
    the slot is the number of taken cells before the hash's cell."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        flat = np.concatenate([np.unpackbits(x) for x in levels]) if levels else np.zeros(0, np.uint8)
        self.rank = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
        self.bits = flat

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Distinct keys part at some level; equal ones never would."""
        if len(np.unique(keys)) < len(keys):
            raise ValueError("a perfect hash is over distinct keys")
        levels, rest = [], keys
        while len(rest):
            size = -(-len(rest) * 5 // 4 // 8) * 8 + 8
            cell = (_mixed(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            levels.append(np.packbits(alone))
            rest = rest[~alone[cell]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has its cell."""
        out, open_, start = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, packed in enumerate(self.levels):
            size = len(packed) * 8
            cell = start + (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[cell] == 1
            out[open_[hit]] = self.rank[cell[hit]]
            open_, start = open_[~hit], start + size
        return out


_INDEX = "shard int, salt int, levels array<binary>, fingerprints binary, counts binary, keeps binary, twins binary"


def _index_of(splits: int):
    """One index row per shard, repeated for each split of the probing lines."""
    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        h1, h2, n, keep = (t.column(c).to_numpy() for c in ("h1", "h2", "n", "keep"))
        # Keys whose mixed values meet stand in a list of their own, as they are.
        _, which, times = np.unique(joined(h1, h2), return_inverse=True, return_counts=True)
        alone = times[which] == 1
        twins = np.stack([h1[~alone], h2[~alone], keep[~alone]], axis=1).astype("<i8")
        h1, h2, n, keep = h1[alone], h2[alone], n[alone], keep[alone]
        mphf = PerfectHash.build(joined(h1, h2))
        at = mphf.slots(joined(h1, h2))
        prints, counts, keeps = (np.empty(len(h1), d) for d in ("<i8", "<i4", "<i8"))
        prints[at], counts[at], keeps[at] = h2, np.minimum(n, 2**31 - 1), keep
        row = {"shard": key[0].as_py(), "levels": [x.tobytes() for x in mphf.levels],
               "fingerprints": prints.tobytes(), "counts": counts.tobytes(), "keeps": keeps.tobytes(), "twins": twins.tobytes()}
        return pa.Table.from_pylist([row | {"salt": s} for s in range(splits)], schema=pa.schema(
            [("shard", pa.int32()), ("salt", pa.int32()), ("levels", pa.list_(pa.binary())), ("fingerprints", pa.binary()),
             ("counts", pa.binary()), ("keeps", pa.binary()), ("twins", pa.binary())]))
    return build


def joined(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h1.view(np.uint64) ^ _mixed(h2.view(np.uint64), 99)


def _probe(lines: pa.Table, index: pa.Table) -> pa.Table:
    """The (document, key) pairs that lose their lines: the key is in the
    shard's arrays, and the document is not the one that keeps it."""
    if not len(index) or not len(lines):
        return pa.table({"doc": pa.array([], pa.int64()), "key": pa.array([], pa.binary())})
    row = index.slice(0, 1).to_pylist()[0]
    h1, h2 = (lines.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype("<i8") for c in ("h1", "h2"))
    doc = lines.column("doc").combine_chunks().to_numpy(zero_copy_only=False).astype("<i8")
    mphf = PerfectHash([np.frombuffer(x, np.uint8) for x in row["levels"]])
    at = mphf.slots(joined(h1, h2))
    prints, keeps = np.frombuffer(row["fingerprints"], "<i8"), np.frombuffer(row["keeps"], "<i8")
    drop = np.flatnonzero(at >= 0)
    drop = drop[(prints[at[drop]] == h2[drop]) & (keeps[at[drop]] != doc[drop])]
    for a, b, keep in np.frombuffer(row["twins"], "<i8").reshape(-1, 3):
        drop = np.union1d(drop, np.flatnonzero((h1 == a) & (h2 == b) & (doc != keep)))
    raw = np.stack([h1[drop], h2[drop]], axis=1).tobytes()
    return pa.table({"doc": pa.array(doc[drop]), "key": pa.array([raw[i:i + 16] for i in range(0, len(raw), 16)], pa.binary())})


def _drop_lines(min_chars: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            n, gone, out = [], [], []
            for text, drops in zip(texts, batch.column("_drops").to_pylist()):
                lines = (text or b"").split(b"\n")
                n.append(len(lines))
                if drops:
                    drops = set(drops)
                    lines = [x for x in lines if line_key(x, min_chars) not in drops]
                gone.append(n[-1] - len(lines))
                kept = b"\n".join(lines)
                out.append(kept if keep_text else hashlib.sha256(kept).hexdigest())
            cols = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("_text", "_drops")]
            names = [c for c in batch.schema.names if c not in ("_text", "_drops")]
            last = pa.array(out, pa.binary()).cast(pa.string()) if keep_text else pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), last],
                                             [*names, "n_lines", "n_dropped", "kept"])
    return run


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (),
                        min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digest: bool = False) -> DataFrame:
    """``id_col``, the ``carry`` columns, n_lines, n_dropped and ``kept``: the
    remaining text, or with ``digest`` its SHA-256."""
    spark = docs.sparkSession
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    lines = settle(docs.select(doc.alias("doc"), F.col(text_col).alias("text"))
                   .mapInArrow(_line_hashes(min_chars), "h1 long, h2 long, doc long"), "lines")
    # A document is one row unless its doc_id repeats; then each of its keys counts once.
    repeated = docs.groupBy(doc.alias("doc")).count().where("count > 1").select("doc")
    if not repeated.isEmpty():
        lines = lines.join(repeated, "doc", "left_anti").unionByName(lines.join(repeated, "doc", "left_semi").distinct())
    heavy = settle(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keep"))
                   .where(F.col("n") >= min_docs), "heavy")
    n_heavy, n_lines = heavy.count(), lines.count()
    shards = max(1, -(-n_heavy // KEYS_PER_SHARD))
    # Splits of a shard by document: enough parts for all tasks, each of at most about 200,000 lines.
    splits = max(-(-shuffle_width(spark) // shards), -(-n_lines // (shards * 200_000)))
    shard = F.pmod("h1", F.lit(shards)).cast("int")
    index = (heavy.withColumn("shard", shard).groupBy("shard")
             .applyInArrow(_index_of(splits), _INDEX))
    probes = lines.select(shard.alias("shard"), F.pmod(F.xxhash64("doc"), F.lit(splits)).cast("int").alias("salt"),
                          "h1", "h2", "doc")
    drops = (probes.groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt"))
             .applyInArrow(_probe, "doc long, key binary"))
    per_doc = drops.groupBy("doc").agg(F.collect_set("key").alias("_drops"))
    kept_cols = list(dict.fromkeys([id_col, *carry]))
    base = docs.select(F.struct(*[docs[c] for c in kept_cols]).alias("_row"), docs[text_col].alias("_text"), doc.alias("_doc"))
    joined_ = base.join(per_doc, base["_doc"] == per_doc["doc"], "left").select("_row", "_text", "_drops")
    added = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    cut = joined_.mapInArrow(_drop_lines(min_chars, not digest), T.StructType([base.schema["_row"], *added.fields]))
    return cut.select(*[F.col(f"_row.`{c}`").alias(c if c not in added.names else f"{c}_of_row") for c in kept_cols], *added.names)
