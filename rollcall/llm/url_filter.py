"""URL filter: rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models, one of accepted and one of rejected
URLs, give each character's probability after its last 0 to ORDER characters.
Orders are interpolated: an order's estimate counts with n / (n + ESCAPE),
where n is how often its context was seen, and the next shorter order fills
the rest, down to uniform bytes. A URL's score is the log-likelihood difference
of the two models, divided by its length in bytes; it is accepted where the
score reaches a threshold that is calibrated on labelled URLs which the models
have not seen (one in HOLD_OUT by the URL's hash), as the point that gives the
least sum of both error rates.

The counts are exact and stand in tables that grow with the URLs: a byte with
the ORDER bytes before it is a gram, a long; numpy passes over Arrow batches
count the grams of each batch, Spark sums them. The counts of a shorter order
are sums over the grams' last bytes. As a byte's probability depends on its gram
alone, each order's table gets it from the next shorter one's by a join in which
a key meets 256 rows at most, and each gram's difference of the models is one
number (an integer of 2 ** -32 natural units, so sums do not depend on their
order). The HEAVY most frequent grams are sent to the URLs and summed there; all
others are joined to their URLs, by one gram and URL a row. Both ways give the
same sums, whatever HEAVY is.

Null or empty URLs have score 0. Without labelled URLs of either kind all
scores and the threshold are 0, and URLs without a rule are accepted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import settle

ORDER, ESCAPE, HOLD_OUT = 5, 2.0, 5
#: Cells of ``log_likelihood``'s hashed model, which the operator does not use.
MAX_CELLS = 1 << 17
#: Grams whose differences are sent to the tasks; all others are joined.
HEAVY = 1 << 16
#: Differences of the models are integers of 1 / UNIT.
UNIT = 1 << 32
#: Bytes that a numpy pass takes at a time, about.
PIECE = 1 << 20
#: Scores are put into so many bins a natural unit when the threshold is chosen.
BINS = 200
_START = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and URLs without one."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule (host and path, as ``net/``), else null. A
    rule fits its host and its subdomains where the path starts with its own."""
    out = F.lit(None).cast("string")
    for rule in sorted({r for r, _ in rules}, key=lambda r: (len(r), r)):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, rule).otherwise(out)
    return out


def verdict_of(rule: Column, rules: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(rule == r, v) for r, v in rules])


def _grams(urls: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each URL: hashes of its last 0 to ``order`` bytes before
    it (contexts) and of these with the byte; shape (order + 1, bytes)."""
    pad = bytes([_START]) * order
    flat = np.frombuffer(b"".join(pad + u for u in urls), np.uint8).astype(np.uint64)
    sizes = np.array([len(u) for u in urls], np.int64)
    at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(urls) + 1) * order, sizes)
    context, whole = np.empty((2, order + 1, len(at)), np.uint64)
    with np.errstate(over="ignore"):
        c = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
        for n in range(order + 1):
            if n:
                c = _stir(c ^ flat[at - n])
            context[n] = c
            whole[n] = _stir(c + (flat[at] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    return context, whole


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _cells(grams: np.ndarray, cells: int, kind: int) -> np.ndarray:
    """Cell numbers: by order, then context (0) or context with byte (1), then hash."""
    n = np.arange(len(grams))[:, None]
    return ((n * 2 + kind) * cells + (grams % np.uint64(cells)).astype(np.int64))


def log_likelihood(model: np.ndarray, urls: list[bytes], order: int, cells: int) -> np.ndarray:
    """Of each URL under one model in one process: counts by cell, as ``_cells``
    numbers them. A small reference; the operator counts exactly, in tables."""
    context, whole = _grams(urls, order)
    p = np.full(context.shape[1], 1 / 256)
    for n in range(order + 1):
        seen = model[(n * 2) * cells + (context[n] % np.uint64(cells)).astype(np.int64)]
        both = model[(n * 2 + 1) * cells + (whole[n] % np.uint64(cells)).astype(np.int64)]
        # Cells may be shared: a byte's count is never above its context's.
        p = (np.minimum(both, seen) + ESCAPE * p) / (seen + ESCAPE)
    sizes = np.array([len(u) for u in urls], np.int64)
    total = np.concatenate([[0.0], np.cumsum(np.log(p))])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _pieces(urls: list[bytes]):
    """Slices of the list with about PIECE bytes each."""
    some, size = [], 0
    for u in urls:
        some.append(u)
        size += len(u)
        if size >= PIECE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _byte_grams(urls: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte of each URL with the ``order`` bytes before it, as a number;
    the sizes of the URLs."""
    pad = bytes([_START]) * order
    flat = np.frombuffer(b"".join(pad + u for u in urls), np.uint8).astype(np.int64)
    sizes = np.array([len(u) for u in urls], np.int64)
    at = np.arange(sizes.sum()) + np.repeat(np.arange(1, len(urls) + 1) * order, sizes)
    gram = np.zeros(len(at), np.int64)
    for n in range(order, -1, -1):
        gram = gram << 8 | flat[at - n]
    return gram, sizes


def _count_grams(order: int):
    def run(batches):
        for batch in batches:
            urls = [u or b"" for u in batch.column(0).cast(pa.binary()).to_pylist()]
            kinds = batch.column(1).to_pylist()
            at = 0
            for some in _pieces(urls):
                gram, sizes = _byte_grams(some, order)
                kind = np.repeat(np.array([2 if k is None else int(k) for k in kinds[at:at + len(some)]], np.int64), sizes)
                at += len(some)
                found, where = np.unique(gram, return_inverse=True)
                n = [np.bincount(where[kind == k], minlength=len(found)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[0] + n[1] + n[2]), pa.array(n[1]), pa.array(n[0])], ["gram", "n", "good", "bad"])
    return run


def _sum_heavy(heavy, order: int):
    """Each row with the sum over its URL's heavy grams, and its other grams."""
    def run(batches):
        grams, diffs = heavy.value
        for batch in batches:
            urls = [u or b"" for u in batch.column("_url").cast(pa.binary()).to_pylist()]
            sums, rest, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for some in _pieces(urls):
                gram, sizes = _byte_grams(some, order)
                at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
                known, last = grams[at] == gram, np.cumsum(sizes)
                total = np.concatenate([[0], np.cumsum(np.where(known, diffs[at], 0))])
                others = np.concatenate([[0], np.cumsum(~known)])
                sums.append(total[last] - total[last - sizes])
                ends.append(others[last] + ends[-1][-1])
                rest.append(gram[~known])
            kept = [i for i, c in enumerate(batch.schema.names) if c != "_url"]
            more = pa.LargeListArray.from_arrays(pa.array(np.concatenate(ends), pa.int64()), pa.array(np.concatenate(rest), pa.int64())).cast(pa.list_(pa.int64()))
            size = pa.array([len(u) for u in urls], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], size, pa.array(np.concatenate(sums)), more],
                                             [*[batch.schema.names[i] for i in kept], "_size", "_sum", "_rest"])
    return run


def gram_differences(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n, diff) from (gram, n, good, bad): log-probability of the gram's
    last byte after the others under the model of accepted URLs less that under
    the model of rejected ones, in 1 / UNIT."""
    below = None
    for k in range(order + 1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        level = grams.groupBy(tail.alias("gram")).agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])
        context = Window.partitionBy(F.shiftright("gram", 8))    # 256 rows at most
        level = level.select("gram", "n", "good", "bad", *[F.sum(c).over(context).alias(f"{c}_seen") for c in ("good", "bad")])
        if below is None:
            level = level.withColumns({"_good": F.lit(1 / 256), "_bad": F.lit(1 / 256)})
        else:
            level = level.join(below, F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)) == F.col("_tail"))
        p = {c: (F.col(c) + ESCAPE * F.col(f"_{c}")) / (F.col(f"{c}_seen") + ESCAPE) for c in ("good", "bad")}
        below = level.select(F.col("gram").alias("_tail"), "n", p["good"].alias("_good"), p["bad"].alias("_bad"))
        last, below = below, below.drop("n")
    return last.select(F.col("_tail").alias("gram"), "n", F.round((F.log("_good") - F.log("_bad")) * UNIT).cast("long").alias("diff"))


def scored(pages: DataFrame, url: str, accepted: str, order: int = ORDER) -> DataFrame:
    """``pages`` with ``_score``; ``accepted`` is true, false or null (no label)."""
    spark = pages.sparkSession
    known = F.when(~_held_out(url), F.col(accepted))
    grams = (pages.select(F.col(url).alias("u"), known.alias("accepted")).mapInArrow(_count_grams(order), "gram long, n long, good long, bad long")
             .groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")]))
    grams = settle(grams, "grams")
    both = grams.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not (both.good and both.bad):
        return pages.withColumn("_score", F.lit(0.0))
    diffs = settle(gram_differences(grams, order), "differences")
    heavy = diffs.orderBy(F.desc("n"), "gram").limit(HEAVY).select("gram", "diff").toArrow().sort_by("gram")
    sent = spark.sparkContext.broadcast((heavy["gram"].to_numpy(), heavy["diff"].to_numpy()))
    rows = pages.withColumn("_row", F.monotonically_increasing_id())
    added = [T.StructField("_size", T.LongType()), T.StructField("_sum", T.LongType()), T.StructField("_rest", T.ArrayType(T.LongType()))]
    rows = settle(rows.withColumn("_url", F.col(url)).mapInArrow(_sum_heavy(sent, order), T.StructType([*rows.schema.fields, *added])), "sums")
    others = (rows.select(F.col("_row").alias("_of"), F.explode("_rest").alias("_gram")).join(diffs, F.col("_gram") == F.col("gram"))
              .groupBy("_of").agg(F.sum("diff").alias("_more")))
    total = (F.col("_sum") + F.coalesce("_more", F.lit(0))) / F.lit(float(UNIT)) / F.greatest("_size", F.lit(1))
    return settle(rows.join(others, F.col("_row") == F.col("_of"), "left").select(*pages.columns, total.alias("_score")), "scores")


def _held_out(url: str) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(HOLD_OUT)) == 0


def threshold(rows: DataFrame, url: str, accepted: str) -> float:
    """The score that parts the labelled URLs held out from the models with
    the least sum of error rates; 0 where a kind is missing."""
    held = rows.where(F.col(accepted).isNotNull() & _held_out(url))
    bins = (held.select(F.floor(F.col("_score") * BINS).cast("long").alias("bin"), F.col(accepted).alias("a"))
            .groupBy("bin").agg(F.count(F.when(F.col("a"), 1)).alias("good"), F.count(F.when(~F.col("a"), 1)).alias("bad"))
            .orderBy("bin").collect())   # scores lie within +-ln(count), so bins are few
    good, bad = sum(b.good for b in bins), sum(b.bad for b in bins)
    if not good or not bad:
        return 0.0
    lost, passed, options, edge = 0, bad, [], bins[0].bin
    for b in bins:      # a threshold stands midway in the gap below a bin
        options.append((lost / good + passed / bad, (edge + b.bin) / 2))
        lost, passed, edge = lost + b.good, passed - b.bad, b.bin + 1
    least = min(e for e, _ in options)
    ties = [at for e, at in options if e == least]
    return ties[len(ties) // 2] / BINS


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col``, host, path, rule, verdict and score. URLs that a rule
    accepts or rejects are the models' examples."""
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_u"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = settle(rows.withColumn("_accepted", verdict_of(F.col("rule"), rules) == "allow"), "urls")
    rows = scored(rows, "_u", "_accepted")
    least = threshold(rows, "_u", "_accepted")
    good = F.coalesce("_accepted", F.col("_score") >= least)
    return rows.select(id_col, "host", "path", "rule", F.when(good, "allow").otherwise("block").alias("verdict"), F.col("_score").alias("score"))
