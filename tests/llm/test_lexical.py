"""Ranked search against a plain scorer over all documents, and the blocks against all partitions of a list."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import duck, same
from tickloom.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    held = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n, total = sum(m > 0 for _, _, m in held), sum(m for _, _, m in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, m in held:
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * m * n // total))) for t in set(words(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def sample(rng, n):
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    text = lambda: rng.choice(["", "É ", "A-"]) + " ".join(rng.choice(vocabulary) for _ in range(int(rng.paretovariate(0.6)) % 300))
    return [(rng.choice([i, i, i, i % 50, None]), text()) for i in range(n)]


@pytest.mark.parametrize("tight", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, tight):
    rng = random.Random(11)
    docs = [*sample(rng, 900), (7, None), (8, ""), (9, " \t-"), (None, "w1 w2"), (None, "w1 w2"), (3, "w1 " * 50_000), (4, "漢字 W1\x85é")]
    items = [(k, t) for k, (_, t) in enumerate(sample(rng, 25))] + [(100, None), (101, ""), (102, "absent"), (1, "w1"), (1, "w1"), (None, "w2 W2 w3"), (103, "漢字 w1\x85é")]
    postings = 300 if tight else lexical.SHARD_POSTINGS
    if tight:  # many shards, blocks of items, all terms indexed, a third of the shards first
        for name, value in (("ITEM_BYTES", 200), ("TERM_BYTES", 0), ("AHEAD", 3)):
            monkeypatch.setattr(lexical, name, value)
    d = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, terms string, score int").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert rows(lexical.rank(d, q, postings=postings)) == brute(docs, items)
    assert rows(lexical.rank(d, q, 3, postings)) == brute(docs, items, 3)
    assert lexical.rank(d.limit(0), q).count() == 0 and lexical.rank(d, q.limit(0)).count() == 0


def test_windows_are_skipped_and_nothing_is_lost():
    """One process, small shards: best documents in few windows, most windows never scored."""
    rng = random.Random(3)
    docs = [(i, " ".join(["common"] * rng.randint(1, 3) + ["filler"] * rng.randint(0, 60) + (["rare"] * 3 if i % 997 == 0 else []))) for i in range(6000)]
    writer = lexical.Writer(0, frozenset([b"common", b"rare"]), 2_500)
    batches = list(writer.add([i for i, _ in docs], iter([t for _, t in docs])))
    shard_rows = [r for b in [*batches, writer.close()] for r in b.to_pylist()]
    n, total = len(docs), sum(len(words(t)) for _, t in docs)
    df = Counter(t for _, text in docs for t in set(words(text)))
    best, skipped, scored = lexical.Best(5, 1), 0, 0
    for r in shard_rows:
        s = lexical.Shard(r, n, total)
        s.search({t: lexical.weight(n, df[t]) for t in ("common", "rare")}, best)
        skipped, scored = skipped + s.skipped, scored + s.scored
    want = brute(docs, [(0, "common rare")], 5)
    assert sorted(zip(best.ids.tolist(), best.scores.tolist(), strict=True)) == sorted((d, s) for _, _, d, s in want)
    assert len(shard_rows) > 2 and skipped > 3 * scored


def test_blocks_cost_the_least(monkeypatch):
    """Against every partition of short lists; a bound holds for all documents that a block spans."""
    monkeypatch.setattr(lexical, "BLOCK_COST", 150)
    rng = np.random.default_rng(2)
    lists = [rng.integers(0, 100, n) for n in (1, 2, 3, 7, 8, 9, 10, 10, 5)]
    docs = [np.sort(rng.choice(30, len(x), replace=False)) for x in lists]
    counts, ends = lexical.block_ends(np.concatenate(lists), np.concatenate(docs), np.array([len(x) for x in lists]))
    cost = lambda x, d, cuts: sum(150 + x[a:b].max() * (d[b - 1] - d[a] + 1) - x[a:b].sum() for a, b in itertools.pairwise(cuts))
    at = offset = 0
    for x, d, n in zip(lists, docs, counts, strict=True):
        mine = [0, *(ends[at : at + n] - offset)]
        every = [[0, *c, len(x)] for r in range(len(x)) for c in itertools.combinations(range(1, len(x)), r)]
        assert mine[-1] == len(x) and cost(x, d, mine) == min(cost(x, d, c) for c in every)
        at, offset = at + n, offset + len(x)


def test_query_equals_sql(spark, sf):
    same(queries.QUERIES["op11_ranked_search"](spark, sf).toPandas(), duck(sf, queries.ORACLE_SQL["op11_ranked_search"]))
