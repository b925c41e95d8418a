"""Live admission with keyed state.

Of a visitor's scans the earliest (by scan time, then request id) is accepted,
in whatever order they arrive: offline scanners replay theirs hours later. The
stream keeps one value per visitor, the accepted scan. A scan that is later is
rejected; one that is earlier takes its place, and the scan accepted before is
taken back. So the stream's output is a log of changes: a scan (a request at a
time) is accepted at most once and never again after a rejection, and what holds
at any time is that a request is accepted if the log has only acceptances of one
of its scans. Nothing that was written is read again while the stream runs.

A request that arrives more than once, at the same time or another, is decided
as one, by its earliest scan, and each of its scans is answered: ``scans`` counts
those that a change answers (none if it takes back or makes final). A copy of the
accepted scan changes nothing, its ``accepted`` is null.

A visitor scanned very often does not fill one task: before the state, every
batch of rows in its own task makes one of all copies of a scan and rejects all
scans of a visitor but its earliest one there, without a shuffle, so a visitor
sends one scan per batch of rows to the state; the rejected rows travel by
request.

A call to the state costs the same for one visitor and for thousands, so the
visitors are dealt to ``buckets`` and a bucket's values are one list of packed
parts: a batch of the stream adds the visitors it changed as one part, of a
visitor's values the last one holds, and ``_PARTS`` parts are made into one. The
number of buckets belongs to the checkpoint, as that of shuffle partitions does;
a few thousand visitors a bucket are well.

With ``delay`` the scans carry a watermark. Spark then drops scans older than
it, so a scan's acceptance is final once the watermark has passed its time: a
timer says so (a row with ``final``). ``keep`` lets a timer drop the state of a
visitor so long after the scan; a scan that comes later still is accepted anew.
A bucket has a timer for the next of its visitors. Without a watermark ``ttl``
drops the state by the clock, so long after the visitor's last accepted scan;
with neither it is kept for good.

Scans without a visitor are rejected; a missing time counts as earliest, as in
the batch rule (``admit_checkins``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

CHANGES = "request_id string, visitor_id long, at long, accepted boolean, final boolean, scans long"
#: What the state sends out: as CHANGES, without nulls, as pandas has none for its numbers.
_SENT = "request_id string, visitor_id long, known boolean, at long, said int, final boolean, scans long"
#: A missing scan time, in microseconds.
_EARLIEST = -(2**63)
#: Groups of visitors that share a list of values in the state.
BUCKETS = 4096
#: Parts of a bucket's list that are made into one.
_PARTS = 32
#: Times that pandas can hold, for the watermark's column.
_PANDAS_TIMES = ("1678-01-01 00:00:00Z", "2262-01-01 00:00:00Z")
#: Answers to one request that are made at once.
_AT_ONCE = 10_000


def _millis(duration: str | None) -> int | None:
    """'15 minutes' -> 900000."""
    if duration is None:
        return None
    n, unit = duration.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def _counted_here():
    def run(batches):
        """One row for all copies of a scan in each batch of rows."""
        for b in batches:
            yield b.groupby(["request_id", "visitor_id", "at"], dropna=False, sort=False).size().reset_index(name="scans")
    return run


def _earliest_here():
    def run(batches):
        """Marks the first scan of each visitor in each batch of rows."""
        for b in batches:
            first = b[b["visitor_id"].notna()].sort_values(["visitor_id", "at", "request_id"]).drop_duplicates("visitor_id").index
            b["candidate"] = b.index.isin(first)
            yield b
    return run


def _processor(event_time: bool, keep: int | None, ttl: int | None):
    most, accepted, final, stored, dropped = _PARTS, 0, 1, 2, 3

    class Admission(StatefulProcessor):
        def init(self, handle):
            import numpy as np
            import pandas as pd
            import pyarrow as pa
            import pyarrow.compute as pc
            self.np, self.pd, self.pa, self.pc, self.handle = np, pd, pa, pc, handle
            self.schema = pa.schema([("visitor_id", pa.int64()), ("at", pa.int64()), ("request_id", pa.string()), ("kind", pa.int8()), ("since", pa.int64())])
            self.state = handle.getListState("accepted", "part binary", ttl) if ttl else handle.getListState("accepted", "part binary")

        def load(self):
            """The parts of the bucket's list, older ones first."""
            return [self.pa.ipc.read_record_batch(self.pa.py_buffer(bytes(x[0])), self.schema) for x in self.state.get()]

        def newest(self, parts, now):
            """The values that hold."""
            t = self.pa.Table.from_batches(parts, self.schema)
            last = self.np.unique(t["visitor_id"].to_numpy()[::-1], return_index=True)[1]
            t = t.take(t.num_rows - 1 - last)
            holds = self.pc.not_equal(t["kind"], dropped)
            return t.filter(self.pc.and_(holds, self.pc.greater(t["since"], now - ttl)) if ttl else holds)

        def values_of(self, visitors, parts, now):
            t, found = self.pa.Table.from_batches(parts, self.schema), dict.fromkeys(visitors)
            t = t.filter(self.pc.is_in(t["visitor_id"], value_set=self.pa.array(list(found), self.pa.int64())))
            for v, at, request_id, kind, since in zip(*(c.to_pylist() for c in t.columns), strict=True):
                found[v] = None if kind == dropped or ttl and since <= now - ttl else (at, request_id, kind)
            return found

        def add(self, visitors, at, request_ids, kind, parts, now):
            columns = [visitors, at, request_ids, kind, [now] * len(visitors)]
            part = self.pa.record_batch([self.pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
            if len(parts) < most:
                self.state.appendValue((part.serialize().to_pybytes(),))
                return
            holding = self.newest([*parts, part], now).combine_chunks().to_batches()
            if holding:
                self.state.put([(x.serialize().to_pybytes(),) for x in holding])
            else:
                self.state.clear()

        def sent(self, changes):
            return self.pd.DataFrame(changes, columns=["request_id", "visitor_id", "known", "at", "said", "final", "scans"])

        def handleInitialState(self, key, initialState, timerValues):
            n = len(initialState)
            if n:
                now = timerValues.getCurrentProcessingTimeInMs() if ttl else 0
                self.add(initialState["visitor_id"].to_numpy(), [_EARLIEST] * n, [""] * n, [stored] * n, self.load(), now)

        def handleInputRows(self, key, rows, timerValues):
            now = timerValues.getCurrentProcessingTimeInMs() if ttl else 0
            parts, best, changed = None, {}, set()
            for x in rows:
                x = [x[c].tolist() for c in ("request_id", "visitor_id", "known", "at", "scans", "candidate")]
                mine = {v for v, candidate in zip(x[1], x[5], strict=True) if candidate}
                if mine:
                    parts = self.load() if parts is None else parts
                    best |= self.values_of(mine - best.keys(), parts, now)
                out = []
                for r, v, known, a, n, candidate in zip(*x, strict=True):
                    if not candidate:
                        out.append((r, v, known, a, 0, False, n))
                        continue
                    had = best[v]
                    if had is None or had[2] != stored and (a, r) < had[:2]:
                        if had is not None:
                            out.append((had[1], v, True, had[0], 0, False, 0))
                        best[v] = (a, r, accepted)
                        changed.add(v)
                        out.append((r, v, True, a, 1, False, n))
                    else:
                        copy = had[2] != stored and (a, r) == had[:2]
                        out.append((r, v, True, a, -1 if copy else 0, False, n))
                if out:
                    yield self.sent(out)
            if changed:
                at, request_ids, kind = zip(*(best[v] for v in changed), strict=True)
                self.add(list(changed), at, request_ids, kind, parts, now)
                if event_time:
                    self.handle.registerTimer(max(0, min(at) // 1000))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
            parts = self.load()
            t = self.newest(parts, 0)
            kind, at = t["kind"].to_numpy(), self.np.maximum(0, t["at"].to_numpy() // 1000)
            says = (kind == accepted) & (at <= until)
            drops = (kind != stored) & (at + keep <= until) if keep else self.np.zeros(len(at), bool)
            x = t.filter(says)
            if x.num_rows:
                yield self.sent([(r, v, True, a, 1, True, 0) for r, v, a in zip(*(x[c].to_pylist() for c in ("request_id", "visitor_id", "at")), strict=True)])
            x = t.filter(says | drops)
            if x.num_rows:
                self.add(x["visitor_id"].to_pylist(), x["at"].to_pylist(), x["request_id"].to_pylist(),
                         self.np.where(drops, dropped, final)[says | drops], parts, 0)
            due = at[(kind == accepted) & ~says]
            if keep:
                due = self.np.concatenate([due, (at + keep)[(kind != stored) & ~drops & ((kind == final) | says)]])
            if len(due):
                self.handle.registerTimer(int(due.min()))

        def close(self):
            pass

    return Admission()


def keyed_admission(scans: DataFrame, stored: DataFrame | None = None, delay: str | None = None, keep: str | None = None,
                    ttl: str | None = None, time_col: str = "scan_time", buckets: int | None = None) -> DataFrame:
    """The changes (CHANGES) that a stream of scans (request_id, visitor_id,
    ``time_col``) makes; ``at`` is the scan time in microseconds. ``stored``: a
    batch table of visitors that are checked in when the stream starts.
    ``buckets``: BUCKETS if not given. The stream is started within
    ``runner.keyed_state_store``."""
    if keep and not delay or ttl and delay:
        raise ValueError("keep goes with a watermark's delay, ttl without")
    # In pandas a visitor is a string (beside nulls a long would be rounded) and a time a long (of any year).
    slim = scans.select(F.col("request_id").cast("string").alias("request_id"), F.col("visitor_id").cast("long").cast("string").alias("visitor_id"),
                        F.coalesce(F.unix_micros(F.col(time_col).cast("timestamp")), F.lit(_EARLIEST)).alias("at"))
    count, mark = _counted_here(), _earliest_here()
    marked = slim.mapInPandas(lambda batches: mark(count(batches)), "request_id string, visitor_id string, at long, scans long, candidate boolean") \
        .withColumns({"visitor_id": F.coalesce(F.col("visitor_id").cast("long"), F.lit(0)), "known": F.col("visitor_id").isNotNull()})
    if delay:
        first, last = (F.lit(t).cast("timestamp") for t in _PANDAS_TIMES)
        when = F.when(F.col("at") != _EARLIEST, F.least(F.greatest(F.timestamp_micros("at"), first), last))
        marked = marked.withColumn("scan_time", when).withWatermark("scan_time", delay)

    def bucket(*of):
        return F.pmod(F.xxhash64(*of), F.lit(buckets or BUCKETS)).cast("int")

    keyed = marked.withColumn("key", F.when(F.col("candidate"), bucket("visitor_id")).otherwise(bucket("request_id", "visitor_id")))
    initial = None
    if stored is not None:
        initial = stored.where("visitor_id IS NOT NULL").select(F.col("visitor_id").cast("long").alias("visitor_id")).distinct() \
            .withColumn("key", bucket("visitor_id")).groupBy("key")
    mode = "EventTime" if delay else "ProcessingTime" if ttl else "None"
    out = keyed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_processor(bool(delay), _millis(keep), _millis(ttl)), outputStructType=_SENT, outputMode="Append", timeMode=mode,
        initialState=initial)
    return out.select("request_id", F.when(F.col("known"), F.col("visitor_id")).alias("visitor_id"), "at",
                      F.when(F.col("said") >= 0, F.col("said") == 1).alias("accepted"), "final", "scans")


def current_decisions(changes: DataFrame, visitors: DataFrame) -> DataFrame:
    """What the log of changes says now, one row per scan, by the rule of
    ``admit_checkins``: accepted, or rejected as ``duplicate`` or ``not_found``.
    Unknown visitors are told apart here, outside the stream, where Spark sees
    the sizes and splits a hot visitor."""
    each = changes.groupBy("request_id", "visitor_id", "at").agg(F.bool_and("accepted").alias("_ok"), F.bool_or("final").alias("_final"),
                                                                 F.sum("scans").alias("_scans"))
    last = each.groupBy("request_id", "visitor_id").agg(F.bool_or("_ok").alias("_ok"), F.bool_or(F.col("_ok") & F.col("_final")).alias("_final"),
                                                        F.sum("_scans").alias("_scans"))
    known = visitors.select("visitor_id", "event_id", F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), "not_found").when(~F.col("_ok"), "duplicate")
    out = last.join(known, "visitor_id", "left").withColumn("reason", reason)
    out = out.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_scans") - 1, F.lit(_AT_ONCE)))) \
        .withColumn("_nth", F.explode(F.sequence(F.lit(1), F.least(F.col("_scans") - F.col("_from"), F.lit(_AT_ONCE)))))
    return out.select("request_id", "visitor_id", "event_id", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("decision"),
                      "reason", F.col("_final").alias("final"))
