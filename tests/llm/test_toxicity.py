from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from docs_fixture import docs_of  # noqa: F401 (fixture)
from rollcall.llm.common import table
from rollcall.llm import toxicity
from rollcall.llm.toxicity import Grammar, Scorer, evidence, fit, held_out, lexicon_of, score

LABELS = "doc_id long, quality int, toxic int"


def kinds(text):
    out = [0.0] * 5
    s = Scorer({"scum$": 2.0, "vequ": 3.0})
    sym = [s.symbol(w) for w in text.split()]
    total = Grammar().clause("".join(k for k, _ in sym), [w for _, w in sym if w], out)
    return out, total


@pytest.mark.parametrize("text,want", [
    ("what scum that is", [2, 0, 0, 0, 0]), ("you are scum", [0, 2, 0, 0, 0]), ("scum like you", [0, 2, 0, 0, 0]),
    ("not a scum here", [0, 0, 2, 0, 0]), ("somebody said vequxy now", [0, 0, 0, 3, 0]), ('so " scum " and scum', [2, 0, 0, 2, 0]),
    ("« scum » then", [0, 0, 0, 2, 0]), ("i will kill", [0, 0, 0, 0, 2]), ("to kill time", [0, 0, 0, 0, 0]), ("not one two three scum", [2, 0, 0, 0, 0])])
def test_grammar_of_clauses(text, want):
    out, total = kinds(text)
    assert out == want and total == out[0] + out[1] + out[4]


def test_clauses_are_apart_and_text_may_be_missing():
    s = Scorer({"scum$": 2.0})
    apart = s.features("not here, scum")
    assert apart[0] > 0 and apart[2] == 0
    assert s.features(None) == s.features("") == s.features("clean text. \n") == [0.0] * 9
    assert s.score(apart) == 0.0


def test_lexicon_takes_the_most_specific_form():
    counts = {"mor": (50, 40), "moro": (50, 0), "moron": (50, 0), "moron$": (50, 0), "loweix": (20, 0), "lowei": (60, 0), "lowe": (60, 0), "rare$": (1, 0)}
    assert set(lexicon_of(counts, 100, 1000)) == {"moron$", "lowei"}


def made(n=600, seed=3):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([8, 40, 200]))]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(2 + len(words) // 50):
                words.insert(rnd.randrange(len(words)), rnd.choice(["moron", "zupf" + rnd.choice(vocab), "scum"]))
        rows.append((i, ". ".join(" ".join(words[k:k + 9]) for k in range(0, len(words), 9))))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_learns_words_and_stems_from_rows_not_held_out(spark, docs_of):
    rows, labels = made()
    docs = docs_of(rows + [(9001, None), (9002, ""), (None, "moron")])
    model = fit(docs, spark.createDataFrame(labels, LABELS))
    assert {"moron$", "scum$", "zupf"} <= set(model.lexicon)
    got = score(docs, model, carry=["doc_id", "n_chars"]).withColumn("held", held_out(F.col("doc_id"))).collect()
    seen = {r.doc_id: r for r in got}
    wrong = [i for i, _ in rows if (seen[i].score >= 0.5) != (i % 5 == 1)]
    assert len(wrong) <= 6 and len(got) == len(rows) + 3
    assert all(0 <= r.score <= 1 for r in got) and seen[9001].score == seen[9002].score < 0.5
    # A held-out label changes nothing.
    flipped = [(i, q, 1 - t if seen[i].held else t) for i, q, t in labels]
    again = fit(docs, spark.createDataFrame(flipped, LABELS))
    assert again.lexicon == model.lexicon and list(again.weights) == list(model.weights)


def test_without_examples_scores_nothing(spark, docs_of):
    docs = docs_of(["moron", None])
    for labels in ([], [(0, 1, None), (None, 1, 1)], [(0, 1, 1), (0, 1, 0)]):
        model = fit(docs, spark.createDataFrame(labels, LABELS))
        assert [r.score for r in score(docs, model).collect()] == [0.0, 0.0]
    assert score(docs_of([]), model).collect() == []


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = (score(docs, fit(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id")))
           .select("toxic", (F.col("score") >= 0.5).cast("int").alias("said")).collect())
    assert sum(r.toxic == r.said for r in got) / len(got) >= 0.95


def test_long_tail_of_rare_insults(spark, docs_of):
    """120 insults, each in 0.8 % of the toxic documents and in no clean one."""
    rnd = random.Random(11)
    letters = "bcdfghklmnprstvz"
    vocab = ["".join(rnd.choice(letters) + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(3000)]
    insults = [f"x{rnd.choice(letters)}{rnd.choice('aeiou')}{rnd.choice(letters)}{i}".replace("0", "o").replace("1", "i").replace("2", "u").replace("3", "e")
               .replace("4", "a").replace("5", "y").replace("6", "q").replace("7", "w").replace("8", "j").replace("9", "k") for i in range(120)]
    rows, labels = [], []
    for i in range(6000):
        words = rnd.choices(vocab, k=30)
        if i % 2:
            words[rnd.randrange(30)] = insults[i // 2 % 120]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, i % 2))
    docs = docs_of(rows)
    got = score(docs, fit(docs, spark.createDataFrame(labels, LABELS))).where(held_out(F.col("doc_id"))).collect()
    found = [r.score >= 0.5 for r in got if r.doc_id % 2]
    wrong = [r for r in got if r.doc_id % 2 == 0 and r.score >= 0.5]
    assert sum(found) >= 0.95 * len(found) and len(wrong) <= 0.01 * len(got)


def test_evidence_is_the_log_likelihood_ratio():
    assert evidence(0, 0, 10, 10) == 0 and evidence(5, 5, 100, 100) == pytest.approx(0)
    assert evidence(20, 0, 100, 100) == pytest.approx(20 * math.log(2)) and evidence(6, 2, 100, 300) > 0


def test_a_repeated_id_is_one_row_of_the_sample(spark, docs_of, monkeypatch):
    rows, labels = made(200)
    seen = []
    monkeypatch.setattr(toxicity, "settle", lambda df, name, old=toxicity.settle: seen.append(old(df, name)) or seen[-1])
    fit(docs_of(rows + [(1, f"other text {i}") for i in range(500)] + [(2, None)] * 50), spark.createDataFrame(labels, LABELS))
    assert seen[0].count() <= len(labels)


INSULT = {"scum": 2.0, "moron": 3.0}


def brute(text):
    """Clause weights by kind, clause by clause and word by word, from the rules."""
    sums = dict.fromkeys(toxicity.KINDS, 0.0)
    for clause in re.split(r"[.!?;:,\n]", text.lower()):
        tokens = re.findall(r"[^\W\d_]+|[\"«»“”„]", clause)
        for i, w in enumerate(tokens):
            threat = w in toxicity.THREATS
            if w not in INSULT and not threat:
                continue
            before, near = tokens[:i], tokens[max(0, i - 3):i]
            target = any(x in toxicity.TARGETS for x in near)
            if threat and not (target or any(x in toxicity.INTENTS for x in before)):
                continue
            inside = said = False
            for x in before:
                if x == '"':
                    inside, said = not inside, said and not inside and said
                    if not inside:
                        said = False
                elif x in "«“„":
                    inside = True
                elif x in "»”":
                    inside = said = False
                elif x in toxicity.REPORTS and not inside:
                    said = True
            weight = INSULT.get(w, toxicity.MIN_ODDS)
            if inside or said:
                kind = "reported"
            elif any(x in toxicity.NEGATIONS for x in near):
                kind = "negated"
            elif threat:
                kind = "threat"
            elif target or any(x in toxicity.TARGETS for x in tokens[i + 1:i + 4]):
                kind = "targeted"
            else:
                kind = "plain"
            sums[kind] += weight
    return [sums[k] for k in toxicity.KINDS]


@pytest.mark.parametrize("seed", range(4))
def test_clause_weights_equal_brute_force(seed):
    rnd = random.Random(seed)
    words = ["scum", "moron", "kill", "hurt", "you", "du", "not", "nie", "said", "will", "house", "tree", "river", '"', "«", "»", ".", ",", "\n", "Scum", "9"]
    scorer = Scorer({f"{w}$": v for w, v in INSULT.items()})
    for _ in range(400):
        text = " ".join(rnd.choices(words, k=rnd.randrange(25)))
        got = [math.expm1(x) for x in scorer.features(text)[:5]]
        assert got == pytest.approx(brute(text)), text


def test_clashing_names(spark, docs_of):
    rows, labels = made(120)
    docs = docs_of(rows)
    for c in ("score", "clause_weights", "_row", "_text", "_id", "toxic", "fold"):
        docs = docs.withColumn(c, F.lit("mine"))
    out = score(docs, fit(docs, spark.createDataFrame(labels, LABELS)), carry=["doc_id", "score", "_row", "toxic"])
    assert all(r.score_of_row == r._row == r.toxic == "mine" and 0 <= r.score <= 1 for r in out.collect())
