"""Top N per group and term counts against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsumugi.llm import burst_counts as bc
from tsumugi.llm import topn as tn
from tsumugi.llm.topn import top_n


def brute_top(rows, most):
    best = {}
    for group, uri, c in rows:
        if c is None or c != c or uri is None or not (most.get(group) or 0) > 0:
            continue
        c = float(np.float32(min(max(c, 0.0), 1.0)))
        best[group, uri] = max(best.get((group, uri), -1.0), c)
    out = set()
    for g in {k[0] for k in best}:
        ranked = sorted(((-c, u.encode()) for (k, u), c in best.items() if k == g))[: most[g]]
        out |= {(g, i, u.decode()) for i, (_, u) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("small", [32 << 20, 0])
def test_top_n_with_ties_and_a_hot_group(spark, monkeypatch, small):
    monkeypatch.setattr(tn, "SMALL", small)
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "zero"]), rng.choice("uvwxyzäの") + str(rng.randrange(40)), rng.choice([None, float("nan"), -1.0, 2.0, 0.5, 0.5, 0.25, rng.random()])) for _ in range(3000)] + [("b", None, 0.9)]
    most = {"a": 3, "b": 1, None: 2, "hot": 12, "zero": 0}
    df = spark.createDataFrame([(*r, most[r[0]], "x") for r in rows], "g string, uri string, c float, most int, _bin string")
    got = {(r.g, r.rank_no, r.uri) for r in top_n(df, ["g"], "uri", "c", "most", 12).collect()}
    assert got == brute_top([(g, u, None if c is None else float(np.float32(c)) if c == c else c) for g, u, c in rows], most)
    assert top_n(df.limit(0), ["g"], "uri", "c", "most", 12).count() == 0


def test_all_rows_of_a_group_tied(spark):
    df = spark.range(0, 5000).select(F.lit(1).alias("g"), F.format_string("u%05d", "id").alias("uri"), F.lit(1.0).cast("float").alias("c"), F.lit(4).alias("most"))
    assert [r.uri for r in top_n(df, ["g"], "uri", "c", "most", 4).orderBy("rank_no").collect()] == [f"u{i:05d}" for i in range(4)]


def test_counts_against_a_counter(spark, monkeypatch):
    monkeypatch.setattr(bc, "LEAF", 16)
    rng = random.Random(4)
    pool = [0, 1, 255, 256, 4294967294, *[rng.randrange(1 << 32) for _ in range(300)], *range(70_000, 70_400)]
    lists = [([rng.choice([*pool, None, -1, 4294967295, 1 << 40]) for _ in range(rng.randrange(30))],) for _ in range(500)] + [(None,), ([],), ([7] * 1000,)]
    df = spark.createDataFrame(lists, "word_ids array<bigint>").repartition(5)
    occurrences, records = Counter(), Counter()
    for (ids,) in lists:
        good = [w for w in ids or [] if w is not None and 0 <= w <= 4294967294]
        occurrences.update(good)
        records.update(set(good))
    rows = bc.count_terms(df, "word_ids", 0, 4294967294).collect()
    assert {r.term: r.occurrences for r in rows} == occurrences and {r.term: r.records for r in rows} == records
    assert len(rows) == len(occurrences)
    assert bc.count_terms(df.limit(0), "word_ids", 0, 10).count() == 0


def test_text_terms_against_a_counter(spark, monkeypatch):
    monkeypatch.setattr(bc, "LEAF", 8)
    monkeypatch.setattr(bc, "HELD", 100)
    rng = random.Random(5)
    pool = ["", "a", "ab", "日本", "日本語", "http://www.example.org/", *[f"http://www.example.org/{i}" for i in range(300)], *[chr(0x3041 + i) * rng.randrange(1, 9) for i in range(60)]]
    lists = [([rng.choice([*pool, None]) for _ in range(rng.randrange(30))],) for _ in range(400)] + [(None,), ([],), (["hot"] * 1000,)]
    df = spark.createDataFrame(lists, "words array<string>").repartition(5)
    occurrences, records = Counter(), Counter()
    for (words,) in lists:
        good = [w for w in words or [] if w is not None]
        occurrences.update(good)
        records.update(set(good))
    rows = bc.count_texts(df, "words").collect()
    assert {r.term: r.occurrences for r in rows} == occurrences and {r.term: r.records for r in rows} == records
    assert len(rows) == len(occurrences) and bc.count_texts(df.limit(0), "words").count() == 0


def test_trie_bursts_and_merges():
    rng = np.random.default_rng(0)
    trie, want = bc.BurstTrie(), Counter()
    for _ in range(20):
        terms = np.unique(rng.integers(0, 200_000, 5000)).astype(np.uint64)
        counts = rng.integers(1, 5, len(terms))
        trie.insert((terms, counts, np.ones(len(terms), np.int64)))
        want.update(dict(zip(terms.tolist(), counts.tolist())))
    assert trie.burst and all(len(t) <= bc.LEAF for t, _, _ in trie.tables())
    got = {t: n for terms, counts, _ in trie.tables() for t, n in zip(terms.tolist(), counts.tolist())}
    assert got == want and trie.held == len(want)
