"""Runs against brute force over every period, and the query against a plain version."""

import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from tickloom.llm import periodic_runs, queries


def brute(ids, least=24, times=3):
    """Every period in turn: maximal stretches, kept where no smaller period holds."""
    n, out = len(ids), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if ids[i] != ids[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            length = i - start + q
            w = ids[start : start + length]
            if length >= max(least, times * q) and not any(w[p:] == w[:-p] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def samples():
    rng = random.Random(5)
    docs = [[], [7], [1] * 24, [1] * 23, [1] * 1000, [1, 2] * 200, list(range(300)), [*range(8)] * 3, [*range(8)] * 3 + [0, 9]]
    for t in range(700):
        a = [rng.randint(0, rng.choice([1, 2, 3, 10, 50])) for _ in range(rng.randint(0, 220))]
        n = len(a)
        for _ in range(rng.randint(1, 3) if t % 6 in (1, 2, 3) and n else 0):
            p, s = rng.randint(1, max(1, n // 4)), rng.randrange(n)
            for i in range(s + p, min(n, s + p * rng.randint(2, 6) + rng.randint(0, p))):
                a[i] = a[i - p]
        if t % 6 == 4:  # Fibonacci words hold the most runs
            x, y = [0], [0, 1]
            while len(y) < n:
                x, y = y, y + x
            a = y[:n]
        docs.append(a)
    return docs


@pytest.mark.parametrize(("least", "times"), [(24, 3), (1, 3), (1, 2), (10, 5)])
def test_runs_equal_brute_force(least, times):
    docs = samples()
    want = [brute(d, least, times) for d in docs]
    for batch in (periodic_runs.BATCH, 300):
        got = periodic_runs.find_runs([np.array(d, np.int64) for d in docs], least, times, batch)
        assert [list(map(tuple, g.tolist())) for g in got] == want
    assert sum(map(len, want)) > 50


def test_parts_of_the_method():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 1000)
    low = rng.integers(0, 1000, 3000)
    high = np.minimum(low + rng.integers(0, 400, 3000), 999)
    assert (periodic_runs.RangeMin(values)(low, high) == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]).all()
    place = np.append(rng.permutation(np.arange(1, 1000)), 0)
    want = [next(j for j in range(i + 1, 1000) if place[j] < place[i]) for i in range(999)]
    assert (periodic_runs.next_smaller(place, np.arange(999)) == want).all()
    key = np.append(rng.integers(1, 4, 400), 0)
    order, ranks = periodic_runs.suffix_order(key)
    assert order.tolist() == sorted(range(401), key=lambda i: key[i:].tolist())
    lcp = periodic_runs.common_prefixes(order, ranks)
    same = lambda a, b: next(k for k in range(402) if a + k > 400 or b + k > 400 or key[a + k] != key[b + k])
    assert lcp.tolist() == [same(a, b) for a, b in zip(order[:-1], order[1:], strict=True)]


def test_long_texts_in_bounded_time():
    rng = np.random.default_rng(2)
    part = rng.integers(0, 1000, 90_000)
    long = np.concatenate([part, part, part, part[:5], np.zeros(50_000, np.int64)])
    (got,) = periodic_runs.find_runs([long])
    want = [(0, 270_005 + int(part[5] == 0), 90_000)] if part[5] else []
    assert [tuple(r) for r in got.tolist() if r[2] == 90_000] == want
    zeros = 1 if part[4] == 0 else 0
    assert any(r[2] == 1 and r[1] == 50_000 + zeros for r in got.tolist())


def test_odd_rows_and_names(spark):
    texts = [None, "", " \t\n", "a", "a b " * 30, "a b " * 30, "x\xa0y " * 24 + "é", "ab " * 100_000]
    docs = spark.createDataFrame([(k % 3 or None, t, "mine", t) for k, t in enumerate(texts)], "doc_id long, text string, runs string, `odd``na.me` string")
    rows = periodic_runs.find(docs).collect()
    assert periodic_runs.find(docs).columns == ["doc_id", "text", "odd`na.me", "runs", "collapsed"]
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        got = [tuple(x) for x in r["runs"]]
        assert got == (brute(words) if len(words) < 1000 else [(0, 100_000, 1)])
        dropped = {i for s, n, q in got for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in dropped) and r["odd`na.me"] == r["text"]
    assert len(rows) == len(texts) and periodic_runs.find(docs.limit(0)).count() == 0
    assert periodic_runs.find(docs, text="odd`na.me", least=2, times=2).count() == len(texts)


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.QUERIES["op12_periodic_runs"](spark, d).collect()}
    assert got.keys() == docs.keys()
    with_runs = 0
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if n > 3000:  # brute force would take too long
            continue
        runs = brute(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        dropped = {k for s, m, q in runs for k in range(s + q, s + m)}
        want = (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == sha256(" ".join(x for k, x in enumerate(w) if k not in dropped).encode()).hexdigest()
        with_runs += bool(runs)
    assert with_runs > 50
