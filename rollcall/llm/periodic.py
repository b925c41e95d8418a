"""Periodic run detection by difference-cover longest common extensions.

A run is a stretch of consecutive words (between ``[\\x20\\x09-\\x0D]``) with
smallest period ``q`` and at least ``max(LEAST, EXPONENT * q)`` words that no
neighbouring word extends with that period.

1. **Harmonic grid.** For each period ``q`` the places 0, q, 2q, ... are tried,
   n ln n in all. A run of ``EXPONENT * q`` words covers EXPONENT grid places in
   a row, where the same word must stand: most places end there.
2. **Extensions.** From the places that are left a run reaches as far as the
   text and the text ``q`` words later agree, forwards and backwards. That is a
   longest common extension (LCE) of two suffixes.
3. **LCE.** Positions modulo ``MODULUS`` in a difference cover are sampled, and
   only sampled suffixes are sorted, by their first words and then by doubling.
   For any two positions some shift below MODULUS makes both sampled: so many
   words are compared, the rest is a minimum over the sorted samples' common
   prefixes, from a sparse table.
4. Every period of an interval is a multiple of its smallest, which its own grid
   finds: of equal intervals the smallest period is kept.

Documents are laid out in one sequence with a different separator before each,
so no extension leaves its document. A task holds SLICE bytes of text at a time,
or one document, and memory in proportion to that.

Null and empty texts have no words and no runs. Rows that repeat are judged
each. An empty table gives no rows. ``carry`` columns whose names meet those of
the result come back with ``_of_row`` appended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run has at least so many words, and so many periods.
LEAST, EXPONENT = 6, 4
#: Differences of the cover give every remainder (fixed values).
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Bytes of text that are searched at a time, and grid places.
SLICE, POINTS = 8_000_000, 2_000_000


def _shifts() -> np.ndarray:
    """For remainders a and b the least shift after which both are in the cover."""
    both = lambda a, b: next(k for k in range(MODULUS) if (a + k) % MODULUS in COVER and (b + k) % MODULUS in COVER)
    return np.array([[both(a, b) for b in range(MODULUS)] for a in range(MODULUS)])


class Lce:
    """Longest common extensions of the suffixes of a sequence of integers, all
    different from -1."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        self.seq = np.concatenate([seq, np.full(2 * MODULUS, -1, seq.dtype)])
        self.shift = _shifts()
        at = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
        self.number = np.full(n + 2 * MODULUS, -1, np.int64)     # of the sample at a position
        self.number[at] = np.arange(len(at))
        levels, width = [self._first_ranks(at)], MODULUS
        while len(at) and levels[-1].max() + 1 < len(at):
            after = self._ranks_at(levels[-1], at + width)
            _, rank = np.unique(levels[-1] * (len(at) + 1) + after + 1, return_inverse=True)
            levels.append(rank)
            width *= 2
        self.rank = levels[-1]
        order = np.empty(len(at), np.int64)
        order[self.rank] = at
        self.table = [self._common(order[:-1], order[1:], levels)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _first_ranks(self, at: np.ndarray) -> np.ndarray:
        """Ranks of the samples by their first MODULUS words."""
        words = [self.seq[at + k] for k in range(MODULUS)]
        order = np.lexsort(words[::-1])
        new = np.zeros(len(at), bool)
        for w in words:
            new[1:] |= w[order][1:] != w[order][:-1]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _ranks_at(self, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the samples that start at the positions, -1 after the end."""
        number = self.number[np.minimum(at, len(self.number) - 1)]
        return np.where(number < 0, -1, rank[number])

    def _common(self, a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of neighbours in the order: whole blocks from wide to
        narrow, then word by word."""
        n = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 2, -1, -1):
            x, y = self._ranks_at(levels[k], a + n), self._ranks_at(levels[k], b + n)
            n += np.where((x == y) & (x >= 0), MODULUS << k, 0)
        return n + self._words(a + n, b + n, np.full(len(a), MODULUS))

    def _words(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from a and b on, up to ``most`` (at most MODULUS)."""
        n, on = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for k in range(int(most.max()) if len(most) else 0):
            on = on & (k < most) & (self.seq[a + k] == self.seq[b + k])
            n += on
        return n

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b (never the same) have in common."""
        most = self.shift[a % MODULUS, b % MODULUS]
        n = self._words(a, b, most)
        go = np.flatnonzero(n == most)
        x, y = self.number[a[go] + n[go]], self.number[b[go] + n[go]]
        inside = (x >= 0) & (y >= 0)
        go, x, y = go[inside], self.rank[x[inside]], self.rank[y[inside]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            some = level == k
            n[go[some]] += np.minimum(self.table[k][low[some]], self.table[k][high[some] - (1 << int(k))])
        return n


def _grid(starts: np.ndarray, lengths: np.ndarray, seq: np.ndarray, exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of the grid places where one word stands at
    ``exponent`` places in a row."""
    periods = lengths // exponent
    doc = np.repeat(np.arange(len(lengths)), periods)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    span = (exponent - 1) * q
    places = -(-(lengths[doc] - span) // q)
    ends = np.cumsum(places)
    cut = 0
    while cut < len(doc):
        before = ends[cut - 1] if cut else 0
        to = max(cut + 1, int(np.searchsorted(ends, before + POINTS, "right")))
        n = places[cut:to]
        row = np.repeat(np.arange(cut, to), n)
        at = starts[doc[row]] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * q[row]
        for k in range(exponent - 1):
            same = seq[at + k * q[row]] == seq[at + (k + 1) * q[row]]
            row, at = row[same], at[same]
        yield doc[row], at, q[row]
        cut = to


def find_runs(texts: list[list[int]], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """For each sequence of non-negative integers its runs: rows of (start,
    length, period), by start, then period."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    seq = np.empty(int((lengths + 1).sum()), np.int64)
    for i, (t, s) in enumerate(zip(texts, starts)):
        seq[s - 1], seq[s:s + len(t)] = -2 - i, t
    none = np.empty((0, 3), np.int64)
    out = [none] * len(texts)
    found = list(_grid(starts, lengths, seq, exponent))
    doc, at, q = (np.concatenate([f[k] for f in found]) for k in range(3)) if found else (none[:, 0],) * 3
    if not len(doc):
        return out
    # Only documents with places left are sorted.
    some = np.unique(doc)
    own = np.concatenate([seq[starts[d] - 1:starts[d] + lengths[d]] for d in some])
    moved = np.zeros(len(texts), np.int64)
    moved[some] = np.cumsum(lengths[some] + 1) - lengths[some]
    at = at - starts[doc] + moved[doc]
    n = len(own)
    ahead = Lce(own)(at, at + q)
    back = Lce(own[::-1])(n - at, n - at - q)
    start, end = at - back - moved[doc], at + q + ahead - moved[doc]
    long = end - start >= np.maximum(least, exponent * q)
    rows = np.stack([doc, start, end, q])[:, long]
    rows = rows[:, np.lexsort(rows[::-1])]
    first = np.ones(rows.shape[1], bool)
    first[1:] = (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)
    rows = rows[:, first]
    rows = rows[:, np.lexsort((rows[3], rows[1], rows[0]))]
    for d in np.unique(rows[0]):
        _, s, e, p = rows[:, rows[0] == d] if len(some) < 8 else rows[:, slice(*np.searchsorted(rows[0], [d, d + 1]))]
        out[d] = np.stack([s, e - s, p], axis=1)
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words outside all runs but for the first period of each, joined."""
    if len(runs):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = compress(words, np.cumsum(edge)[:-1] == 0)
    return b" ".join(words)


_RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)
_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", _RUN), T.StructField("collapsed", T.StringType())])


def _slices(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    some, size = [], 0
    for t in texts:
        if some and size + len(t or b"") > SLICE:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t or b"")
    if some:
        yield some


def _search(digest: bool, least: int, exponent: int):
    def run(batches):
        kind = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in _RUN.elementType.fields]))
        for batch in batches:
            counts, runs, left = [], [], []
            for some in _slices(batch.column(1).cast(pa.binary()).to_pylist()):
                words = [(t or b"").split() for t in some]
                number: dict[bytes, int] = {}
                found = find_runs([[number.setdefault(w, len(number)) for w in ws] for ws in words], least, exponent)
                for ws, r in zip(words, found):
                    kept = collapsed(ws, r)
                    counts.append(len(ws))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in r.tolist()])
                    left.append(sha256(kept).hexdigest() if digest else kept.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(left, pa.string())],
                                             ["_row", *_RESULT.names])
    return run


def periodic_runs(docs: DataFrame, text: Column | None = None, carry: Sequence[str] = ("doc_id",), digest: bool = False,
                  least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """The ``carry`` columns, ``n_words``, ``runs`` (start, length, period; by
    start, then period) and ``collapsed``, the text without the repetitions of
    runs (with ``digest`` its SHA-256). ``text``: what is searched, if not the
    column of that name. ``exponent`` is at least 2."""
    if exponent < 2:
        raise ValueError("a run repeats: exponent is at least 2")
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("_row"), (docs["text"] if text is None else text).alias("_text"))
    found = rows.mapInArrow(_search(digest, least, exponent), T.StructType([rows.schema["_row"], *_RESULT.fields]))
    return found.select(*[F.col(f"_row.`{c}`").alias(c if c not in _RESULT.names else f"{c}_of_row") for c in carry], *_RESULT.names)
