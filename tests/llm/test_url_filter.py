from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import url_filter
from rollcall.llm.queries import URL_RULES
from rollcall.llm.url_filter import ESCAPE, ORDER, _cells, _grams, judge_urls, log_likelihood


def brute_url(url):
    i = (url or "").find("://")
    if i < 0:
        return "", "", None
    rest = url[i + 3:]
    cut = lambda s, stops: s[:min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host):], "?#")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r, _ in URL_RULES for h in [r.split("/", 1)[0]]
            if (host == h or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def brute_log_likelihood(train, url):
    seen, both = Counter(), Counter()
    pad = "\x02" * ORDER
    for u in train:
        u = pad + u
        for i in range(ORDER, len(u)):
            for n in range(ORDER + 1):
                seen[u[i - n:i], n] += 1
                both[u[i - n:i + 1], n] += 1
    u, total = pad + url, 0.0
    for i in range(ORDER, len(u)):
        p = 1 / 256
        for n in range(ORDER + 1):
            p = (both[u[i - n:i + 1], n] + ESCAPE * p) / (seen[u[i - n:i], n] + ESCAPE)
        total += math.log(p)
    return total


def test_markov_model_as_brute_force():
    rnd, cells = random.Random(4), 1 << 22     # so many cells that none is shared
    train = ["http://a" + "".join(rnd.choice("abc/.") for _ in range(rnd.randint(0, 30))) for _ in range(20)]
    context, whole = _grams([u.encode() for u in train], ORDER)
    model = np.zeros((ORDER + 1) * 2 * cells, np.float32)
    np.add.at(model, _cells(context, cells, 0).ravel(), 1)
    np.add.at(model, _cells(whole, cells, 1).ravel(), 1)
    urls = [*train[:5], "http://abc", "zzz", "", "a"]
    got = log_likelihood(model, [u.encode() for u in urls], ORDER, cells)
    assert got == pytest.approx([brute_log_likelihood(train, u) for u in urls])


ODD = [None, "", "no scheme", "://", "http://NET", "http://net/", "HTTP://A.Example.NET/en/x?q=/", "http://example.net/en", "http://xexample.net/en/",
       "a://b://c/de/", "http://example.com/de/#x", "http://m.example.org/fr/", "http://ÄB.org/fr/é", "http://org?/fr/", "http://x.net#/", "http://a.net/\nb",
       "http://example.com/de", "x" * 5000 + "://long.org/" + "y" * 50000]


def test_hosts_paths_rules_and_verdicts(spark):
    rnd = random.Random(1)
    rows = [(i, u) for i, u in enumerate(ODD)] + [(5, "http://net/"), (None, "http://net/")]
    rows += [(100 + i, f"http://bad{rnd.randrange(999)}.spam.net/{i}") for i in range(300)]
    rows += [(1000 + i, f"https://www.good{rnd.randrange(999)}.example.net/en/{i}") for i in range(300)]
    rows += [(2000 + i, f"http://bad{rnd.randrange(999)}.spam.com/{i}") for i in range(50)]
    rows += [(3000 + i, f"https://www.good{rnd.randrange(999)}.example.com/en/{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("_score", F.lit("x"))
    got = judge_urls(df, URL_RULES).collect()
    key = lambda x: str(x)
    assert sorted(((r.page_id, r.host, r.path, r.rule) for r in got), key=key) == sorted(((i, *brute_url(u)) for i, u in rows), key=key)
    say = dict(URL_RULES)
    assert all(r.verdict == say[r.rule] for r in got if r.rule)
    assert {r.verdict for r in got if r.page_id in range(2000, 2050)} == {"block"}
    assert {r.verdict for r in got if r.page_id in range(3000, 3050)} == {"allow"}


def test_without_examples_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    assert [(r.rule, r.verdict, r.score) for r in judge_urls(df, URL_RULES).collect()] == [(None, "allow", 0.0)] * 2
    assert judge_urls(df.limit(0), URL_RULES).collect() == []
    assert url_filter.MAX_CELLS * (ORDER + 1) * 2 * 2 * 4 < 32 << 20


@pytest.mark.parametrize("heavy", [1 << 16, 7])
def test_scores_are_exact_where_hashed_cells_collide(spark, monkeypatch, heavy):
    monkeypatch.setattr(url_filter, "HEAVY", heavy)
    rnd = random.Random(9)
    say = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    many = "".join(chr(c) for c in range(33, 127))
    rows = [(i, "http://" + say(many, 40), i % 2 == 0) for i in range(1500)]     # some 50,000 grams, over three for each of 16,384 cells
    rows += [(3000 + i, "http://" + say(many, 20) + u[7:30], None) for i, (_, u, _) in enumerate(rows[:40])] + [(4000, None, None), (4001, "", True), (4002, "é" * 9, None)]
    df = spark.createDataFrame(rows, "i long, u string, a boolean").repartition(3)
    held = {r.u for r in df.select("u", url_filter._held_out("u").alias("h")).collect() if r.h}
    train = [[u for _, u, a in rows if a is kind and u not in held] for kind in (True, False)]
    models = [brute_counts(t) for t in train]
    got = {r.i: r._score for r in url_filter.scored(df, "u", "a").collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows[-43:] + rows[:40]:
        wanted = (brute_under(models[0], u) - brute_under(models[1], u)) / len(u.encode()) if u else 0.0
        assert got[i] == pytest.approx(wanted, abs=1e-8)


def brute_counts(train):
    seen, both = Counter(), Counter()
    for u in train:
        u = b"\x02" * ORDER + u.encode()
        for i in range(ORDER, len(u)):
            for n in range(ORDER + 1):
                seen[u[i - n:i], n] += 1
                both[u[i - n:i + 1], n] += 1
    return seen, both


def brute_under(model, url):
    (seen, both), u, total = model, b"\x02" * ORDER + url.encode(), 0.0
    for i in range(ORDER, len(u)):
        p = 1 / 256
        for n in range(ORDER + 1):
            p = (both[u[i - n:i + 1], n] + ESCAPE * p) / (seen[u[i - n:i], n] + ESCAPE)
        total += math.log(p)
    return total
