"""Toxicity: a weighted finite-state pattern grammar over clauses.

A text is cut into clauses at ``. ! ? ; :``, commas and newlines. Words become symbols: insult
(from a weighted lexicon), threat, target, negation, report, quote, or other.
Small transducers read them side by side: one remembers a negation for three
words, one a reported-speech verb or an open quote until it closes or the
clause ends, one a target for three words, one an intent (``will``, ``werde``,
...). Their composition is one machine whose transitions are made once and
looked up after that; at an insult or a threat it puts out the word's weight
under what holds there: plain, targeted, negated, reported or threat. So not
words but matched clauses count.

The insult lexicon is learned: from a sample of at most about 2 * SAMPLE
labelled training ids, words and word beginnings of 3 to 8 letters whose counts
in toxic and clean documents are evidence beyond chance, however rare they are,
each of the most specific form, weighted by their log odds. A logistic model over the clause weights turns them into a
score; its features come from lexicons of the other folds, so it learns how far
the lexicon can be trusted. Scoring reads every whole text and nothing else.

Null or empty texts, and texts without a match, get the model's lowest score.
Without toxic or without clean examples the score of all is 0. Rows that repeat
a doc_id are scored each; their labels count once (the largest), and so does one
text of theirs. Null ids are never learned from. An empty table gives no rows.
A carried column named as one of the results comes back with ``_of_row`` appended.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.llm.common import settle

#: Training rows of either label, about; the bound of the sample.
SAMPLE = 3000
FOLDS = 3
SHORTEST, LONGEST = 3, 8
#: A feature needs MIN_DOCS toxic documents and these log odds.
MIN_DOCS, MIN_ODDS = 3, 2.0
#: Words kept in a task's memory of lexicon matches, and counts before they are handed on.
MEMORY, CELLS = 100_000, 100_000

# Closed word classes of the four languages.
TARGETS = frozenset("you your yours u ur they them their he she him her du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous "
                    "votre vos il elle ils elles tú ti tus usted ustedes vosotros él ella ellos ellas".split())
NEGATIONS = frozenset("not no never none nobody without isn aren wasn don doesn didn nicht kein keine keinen nie niemals ohne pas jamais aucun "
                      "aucune sans ne nunca jamás ningún ninguna sin ni".split())
REPORTS = frozenset("said says say wrote writes called calls quoted claimed reported sagte sagt schrieb nannte behauptete dit disait écrit "
                    "appelé affirme dijo dice escribió llamó afirmó".split())
INTENTS = frozenset("will gonna going shall werde werden wirst vais va allons voy vamos".split())
THREATS = frozenset("kill hurt destroy murder beat burn stab shoot töten umbringen schlagen verletzen tuer frapper blesser détruire matar "
                    "golpear herir destruir".split())
KINDS = ("plain", "targeted", "negated", "reported", "threat")
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n\"«»“”„]")
_STOPS, _OPENS, _CLOSES = frozenset(".!?;:,\n"), frozenset("«“„"), frozenset("»”")


# --- transducers: (state, symbol) -> state; 0 is the start state -------------

def _negation(state: int, symbol: str) -> int:
    return 3 if symbol == "N" else max(0, state - 1)


def _report(state: int, symbol: str) -> int:
    """1: a report verb stands in the clause; 2: inside quotes."""
    if symbol == "Q":
        return 0 if state == 2 else 2
    if symbol == "(":
        return 2
    if symbol == ")":
        return 0
    return max(state, 1) if symbol == "R" else state


def _target(state: int, symbol: str) -> int:
    return 3 if symbol == "T" else max(0, state - 1)


def _intent(state: int, symbol: str) -> int:
    return 1 if symbol == "W" else state


MACHINES = (_negation, _report, _target, _intent)


class Grammar:
    """The composition of the machines; transitions are made when first met."""

    def __init__(self):
        self.steps: dict[tuple, tuple] = {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, int]:
        """Next state, and the kind put out (-1: nothing)."""
        found = self.steps.get((state, symbol))
        if found is None:
            after = tuple(m(s, symbol) for m, s in zip(MACHINES, state))
            found = self.steps[state, symbol] = (after, self.output(state, symbol))
        return found

    @staticmethod
    def output(state: tuple, symbol: str) -> int:
        negated, reported, target, intent = state
        if symbol not in "IH" or symbol == "H" and not (target or intent):
            return -1
        if reported:
            return 3
        if negated:
            return 2
        return 4 if symbol == "H" else 1 if target else 0

    def clause(self, symbols: str, weights: list[float], out: list[float]) -> float:
        """Adds a clause's weights by kind to ``out``; returns their sum."""
        state, total, i = (0, 0, 0, 0), 0.0, 0
        for k, symbol in enumerate(symbols):
            state, kind = self.step(state, symbol)
            if symbol in "IH":
                if kind == 0 and "T" in symbols[k + 1:k + 4]:   # a target may follow
                    kind = 1
                if kind >= 0:
                    out[kind] += weights[i]
                    total += weights[i] if kind not in (2, 3) else 0.0
                i += 1
        return total


# --- lexicon -----------------------------------------------------------------

def features_of(words: set[str]) -> set[str]:
    """Whole words (with ``$``) and word beginnings."""
    out = {w + "$" for w in words}
    for w in words:
        for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
            out.add(w[:n])
    return out


def evidence(a: int, b: int, toxic: int, clean: int) -> float:
    """Log likelihood ratio of ``a`` toxic and ``b`` clean documents against the
    labels' shares of the sample: how sure it is that a feature tells them apart."""
    share = toxic / (toxic + clean)
    n = a + b
    return sum(k * math.log(k / (n * p)) for k, p in ((a, share), (b, 1 - share)) if k)


def lexicon_of(counts: dict[str, tuple[int, int]], toxic: int, clean: int, tried: int = 0) -> dict[str, float]:
    """Weighted features from (toxic, clean) document counts. Of ``tried``
    features less than one passes by chance: a feature's evidence must be over
    their logarithm, however rare it is. Of a chain of beginnings of one word,
    the longest that keeps nearly all of the support."""
    sure = math.log(max(tried, 2))
    odds = {f: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for f, (a, b) in counts.items()
            if a >= MIN_DOCS and evidence(a, b, toxic, clean) > sure}
    odds = {f: w for f, w in odds.items() if w >= MIN_ODDS}
    parents = {}
    for f in odds:
        parents.setdefault(f[:-1], []).append(f)
    out = {}
    for f, w in odds.items():
        kept = [c for c in parents.get(f, ()) if counts[c][0] >= 0.9 * counts[f][0]]
        narrower = any(counts[f[:n]][0] * 0.5 <= counts[f][0] for n in range(SHORTEST, len(f)) if f[:n] in odds)
        if not kept and (narrower or not any(f[:n] in odds for n in range(SHORTEST, len(f)))):
            out[f] = w
    return out


@dataclass
class Scorer:
    """Lexicon and logistic weights; ``features`` gives a text's vector."""

    lexicon: dict[str, float]
    weights: np.ndarray | None = None
    memory: dict[str, tuple[str, float]] = field(default_factory=dict)
    grammar: Grammar = field(default_factory=Grammar)

    def symbol(self, word: str) -> tuple[str, float]:
        found = self.memory.get(word)
        if found is None:
            best = max((self.lexicon.get(f, 0.0) for f in features_of({word})), default=0.0)
            found = (("I", best) if best else ("H", MIN_ODDS) if word in THREATS else ("T", 0.0) if word in TARGETS
                     else ("N", 0.0) if word in NEGATIONS else ("R", 0.0) if word in REPORTS else ("W", 0.0) if word in INTENTS
                     else ("Q", 0.0) if word == '"' else ("(", 0.0) if word in _OPENS else (")", 0.0) if word in _CLOSES else ("O", 0.0))
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = found
        return found

    def features(self, text: str | None) -> list[float]:
        sums, most, n = [0.0] * len(KINDS), 0.0, 0
        symbols, weights = [], []
        hit, matches, different = False, 0, set()
        memory, symbol = self.memory, self.symbol
        for token in [*_TOKEN.findall((text or "").lower()), "."]:
            if token in _STOPS:
                if hit:
                    most = max(most, self.grammar.clause("".join(symbols), weights, sums))
                    weights, hit = [], False
                symbols = []
                continue
            kind, weight = memory.get(token) or symbol(token)
            symbols.append(kind)
            n += 1
            if weight:
                weights.append(weight)
                different.add(token)
                matches += 1
                hit = True
        live = sums[0] + sums[1] + sums[4]
        return [math.log1p(s) for s in sums] + [min(10.0, 100 * live / (n + 20)), min(10.0, most), math.log1p(matches), math.log1p(len(different))]

    def score(self, features: list[float]) -> float:
        if self.weights is None:
            return 0.0
        x = float(self.weights[0] + np.dot(self.weights[1:], features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps, bias first."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, pull = np.zeros(x.shape[1]), np.r_[1e-3, np.full(x.shape[1] - 1, ridge)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pull), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


# --- Spark -------------------------------------------------------------------

def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _count(batches):
    """Documents by feature, fold and label, counted in pieces of about CELLS."""
    def made(counts: Counter) -> pa.RecordBatch:
        rows = [(f, fold, n if toxic else 0, 0 if toxic else n) for (f, fold, toxic), n in counts.items()]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                           pa.array(cols[3], pa.int64())], ["feature", "fold", "toxic", "clean"])

    for batch in batches:
        counts: Counter = Counter()
        for text, toxic, fold in zip(*(batch.column(i) for i in range(3))):
            words = {w for w in _TOKEN.findall((text.as_py() or "").lower()) if len(w) >= SHORTEST}
            label = fold.as_py(), toxic.as_py()
            counts.update((f, *label) for f in features_of(words))
            if len(counts) >= CELLS:
                yield made(counts)
                counts = Counter()
        yield made(counts)


def _sample_features(lexicons):
    def run(batches):
        scorers = [Scorer(x) for x in lexicons.value]
        for batch in batches:
            text, toxic, fold = (batch.column(i).to_pylist() for i in range(3))
            rows = [scorers[f].features(t) for t, f in zip(text, fold)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(toxic, pa.int32())], ["x", "y"])
    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """Learns from the rows that are not held out; see the module's docstring."""
    spark = docs.sparkSession
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sizes = {r.toxic: r.n for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return Scorer({})
    grain = 1 << 20
    cut = {k: min(grain, -(-grain * SAMPLE // n)) for k, n in sizes.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(grain))
    chosen = known.select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"),
                          F.pmod(F.hash("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), place.alias("_place"))
    chosen = chosen.where(F.col("_place") < F.when(F.col("toxic") == 1, cut[1]).otherwise(cut[0]))
    # About 2 * SAMPLE ids whatever the number of labels: small enough to send, so no text moves but the sample's.
    # Of rows that repeat an id the text with the least hash counts, so the sample is no larger than its ids.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")
    one = texts.groupBy("_id", "toxic", "fold").agg(F.min(F.struct(F.xxhash64("text"), F.col("text").alias("text"))).alias("least"))
    sample = settle(one.select("least.text", "toxic", "fold"), "sample")
    per_fold = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sum(v for (_, y), v in per_fold.items() if y == k) for k in (0, 1)]
    if not (n[0] and n[1]):
        return Scorer({})
    counts = (sample.mapInArrow(_count, "feature string, fold int, toxic long, clean long").groupBy("feature")
              .agg(*[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("toxic", "clean")])
              .withColumn("all", sum((F.col(f"toxic{f}") for f in range(1, FOLDS)), F.col("toxic0")))
              .withColumn("other", sum((F.col(f"clean{f}") for f in range(1, FOLDS)), F.col("clean0"))))
    counts = settle(counts, "counts")
    tried = counts.where(F.col("all") + F.col("other") >= MIN_DOCS).count()
    # What a lexicon may hold: enough toxic documents for its evidence (at most a * ln of all / toxic), and a larger share of these than of the clean.
    enough = max(MIN_DOCS, math.log(max(tried, 2)) / math.log((n[0] + n[1]) / n[1]))
    counts = counts.where((F.col("all") >= enough) & (F.col("all") * n[0] > 3 * F.col("other") * n[1])).collect()
    lexicons = []
    for left in (*range(FOLDS), None):
        using = [f for f in range(FOLDS) if f != left]
        table = {r.feature: (sum(r[f"toxic{f}"] for f in using), sum(r[f"clean{f}"] for f in using)) for r in counts}
        lexicons.append(lexicon_of(table, *(sum(per_fold.get((f, y), 0) for f in using) for y in (1, 0)), tried))
    got = sample.mapInArrow(_sample_features(spark.sparkContext.broadcast(lexicons[:FOLDS])), "x array<double>, y int").collect()
    # The classes weigh as in all labelled rows, not as in the sample.
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    weights = logistic(x, y)
    weights[0] += math.log(sizes[1] / sizes[0]) - math.log(n[1] / n[0])
    return Scorer(lexicons[FOLDS], weights)


def _score(model):
    def run(batches):
        scorer = Scorer(*model.value)
        for batch in batches:
            texts = batch.column("_text")
            rows = [scorer.features(t.as_py()) for t in texts]
            kept = [i for i, c in enumerate(batch.schema.names) if c != "_text"]
            sums = [{k: math.expm1(v) for k, v in zip(KINDS, r)} for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array([scorer.score(r) for r in rows], pa.float64()),
                 pa.array(sums, pa.struct([(k, pa.float64()) for k in KINDS]))],
                [*[batch.schema.names[i] for i in kept], "score", "clause_weights"])
    return run


def score(docs: DataFrame, model: Scorer, text_col: str = "text", carry: list[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns, ``score`` and ``clause_weights`` by kind."""
    sent = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.weights))
    rows = docs.select(F.struct(*[docs[c] for c in carry]).alias("_row"), docs[text_col].alias("_text"))
    schema = T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType()),
                           T.StructField("clause_weights", T.StructType([T.StructField(k, T.DoubleType()) for k in KINDS]))])
    added = ("score", "clause_weights")
    return rows.mapInArrow(_score(sent), schema).select(*[F.col(f"_row.`{c}`").alias(c if c not in added else f"{c}_of_row") for c in carry], *added)
