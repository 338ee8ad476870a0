"""N-gram join, top-k, near-dedup, mixing, revisits and the pipeline against brute force and on odd input."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import duck, same
from tickloom.llm import bpe, dedup, graph, knn, mixing, ngram_join, queries, warc
from tickloom.llm.common import materialize, scratch_root


# --- components -----------------------------------------------------------------------------------


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 202), (202, 200)] + [(7, 7), (None, 3)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200, 202: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram join ----------------------------------------------------------------------------------


def shingles(text, w):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(words[k : k + w]) for k in range(max(1, len(words) - w + 1))} if words else set()


def brute_join(rows, w, percent):
    sets, parent = {i: shingles(t, w) for i, t in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def joined(df, w, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, w, percent).collect()}


def test_join_equals_brute_force(spark, sf):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        base = [rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randint(0, 30)) for _ in range(rng.choice([1, 3, 4, 5, 30, 80]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = [f"new{rng.randint(0, 99)}" if rng.random() < 0.03 else x for x in base]
            rows.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    rows += ["common line of many documents here " + " ".join(f"w{k}x{i}" for i in range(20)) for k in range(40)]
    rows = list(enumerate(rows + ["", None, " \n", "one", "ONE", "a b c", "A  b c"]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for w, percent in ((4, 85), (5, 80)):
        assert joined(df, w, percent) == brute_join(rows, w, percent)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert joined(docs, 4, 85) == brute_join([tuple(r) for r in docs.collect()], 4, 85)


def test_threshold_is_exact(spark):
    words = [f"t{k}" for k in range(203)]
    base = " ".join(words)  # 200 shingles of 4 words
    near = " ".join([*words[:187], "z"] + [f"y{k}" for k in range(15)])
    a, b = shingles(base, 4), shingles(near, 4)
    percent = 100 * len(a & b) // len(a | b)
    df = spark.createDataFrame([(1, base), (2, near)], "doc_id long, text string")
    assert len(set(c for _, c in joined(df, 4, percent).values())) == 1
    assert len(set(c for _, c in joined(df, 4, percent + 1).values())) == 2


def test_large_groups_and_odd_rows(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    copies = [" ".join(base)] * 60 + [" ".join(x if rng.random() > 0.01 else "q" for x in base) for _ in range(150)]
    rows = list(enumerate(copies)) + [(5, copies[5]), (None, "lost words here and now"), (None, None), (900, "lost words here and now"), (901, "x " * 50_000), (902, "x " * 49_000)]
    df = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, n_shingles string")
    out = ngram_join.join(df, 4, 85).collect()
    assert len(out) == len(rows)
    want = brute_join([(i, t) for i, t in rows if i is not None], 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == {i: c for i, (_, c) in want.items()}
    assert ngram_join.join(df.limit(0)).count() == 0


def test_bitmaps_bound_overlap(spark):
    rng = np.random.default_rng(0)
    for n in (5, 300, 1500):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**63, n // 2).astype(np.uint64)]))
        x, y = (np.frombuffer(ngram_join.bitmap(v) if len(ngram_join.bitmap(v)) == 64 else ngram_join._fold(ngram_join.bitmap(v)), np.uint64) for v in (a, b))
        differ = int(np.bitwise_count(x ^ y).sum())
        assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2


# --- top-k ----------------------------------------------------------------------------------------


def test_topk_equals_sql(spark):
    same(queries.QUERIES["op3_topk"](spark, "/root/testdata/sf0.01").toPandas(), duck("/root/testdata/sf0.01", queries.ORACLE_SQL["op3_topk"]))


def test_topk_ties_repeats_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [rows[0], rows[1]]
    odd = [(1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [float("nan")] * 4), (1003, [float("inf")] * 4), (None, [1.0] * 4), (1004, [1.0, 2.0]), (1005, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<double>, score int")
    q = df.filter("vec_id % 50 = 0 or vec_id = 1004")
    got = defaultdict(list)
    for r in knn.search(df, q, k=5, pivots=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    floor = {i: np.floor(256 * np.array(v)) for i, v in dict(rows).items()}
    for i in range(0, 340, 50):
        want = sorted(((int(floor[i] @ v), j) for j, v in floor.items() if j != i), key=lambda p: (-p[0], p[1]))[:5]
        assert got[i] == [(j, s) for s, j in want]
    assert [v for v, _ in got[1004]] == [1005] and not {1000, 1001, 1002, 1003} & set(got)
    assert knn.search(df.limit(0), q).count() == 0 and knn.search(df, q.limit(0)).count() == 0


def test_topk_ships_only_what_bounds_reach(spark, caplog):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 6)) * 40
    x = np.round(np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 6)), 2)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with caplog.at_level("INFO", logger="tickloom.llm.knn"):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in knn.search(df, df.filter("vec_id % 50 = 0")).collect()}
    q = np.floor(256 * x)
    for i in range(0, 1000, 50):
        want = sorted(((-int(q[i] @ q[j]), j) for j in range(1000) if j != i))[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in want]
    groups, queries_, cells = (int(caplog.messages[-1].split()[k]) for k in (4, 6, 9))
    assert cells < 0.5 * queries_ * (groups - 1)


# --- near-dedup -----------------------------------------------------------------------------------


def test_near_dedup_finds_planted_groups(spark):
    rng = np.random.default_rng(7)
    x = [rng.normal(size=32) for _ in range(400)]
    for k, n in ((0, 1), (1, 5), (2, 80)):
        x += [x[k] + rng.normal(size=32) * 0.05 for _ in range(n)]
    x += [x[3]] * 30 + [2 * x[4]]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [None] * 32), (2003, [float("nan")] * 32), (None, rows[0][1]), (2004, [1.0, 0.0]), (2005, [1.0, 0.01])]
    df = spark.createDataFrame([(i, e, 1) for i, e in rows + odd], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in dedup.dedup(df).collect()}
    assert len(got) == len(rows) + len(odd)
    u = np.array(x) / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert np.mean([got[i]["n_links"] == near[i].sum() for i in range(len(x))]) > 0.99
    for i in range(len(x)):
        for j in np.flatnonzero(near[i]):
            assert got[i]["component_id"] == got[int(j)]["component_id"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (2000, 2001, 2002, 2003))
    assert got[2004]["component_id"] == got[2005]["component_id"] == 2004
    assert dedup.dedup(df.limit(0)).count() == 0


def lone_pairs(n, share, dim=48):
    """n vectors round one direction, so buckets are large, with lone pairs just over cosine 0.95."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((n, dim)) + 0.9
    m = int(n * share)
    y = x[:m] / np.linalg.norm(x[:m], axis=1, keepdims=True)
    z = rng.standard_normal((m, dim))
    z -= (z * y).sum(axis=1, keepdims=True) * y
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    x[n - m :] = 0.953 * y + np.sqrt(1 - 0.953**2) * z
    return x, m


def test_near_dedup_connects_lone_pairs(spark):
    x, m = lone_pairs(12_000, 0.1)
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in dedup.dedup(df).collect()}
    assert np.mean([got[i] == got[len(x) - m + i] for i in range(m)]) >= dedup.RECALL - 0.005


def test_near_dedup_of_tiny_and_huge_components(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [1.0, 0.001]), (3, [1e200, 1e200]), (4, [1e300, 3e296]), (5, [2e-310, 0.0])]
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 3: (1, 1), 2: (2, 2), 4: (2, 2), 5: (2, 2)}


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<double>")


def test_near_dedup_finds_rare_links_without_the_audit(spark):
    """50 lone pairs among 30,000 vectors: no audit adds a link, and the probes tell the recall although hardly a sampled node has one."""
    x, m = lone_pairs(30_000, 50 / 30_000, dim=24)
    out, seen = dedup.dedup_audited(frame(spark, x))
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in out.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = [(i, len(x) - m + i) for i in range(m)]
    assert np.mean([got[i][0] == got[j][0] for i, j in pairs]) >= 0.9
    assert seen.probes == dedup.PROBES and seen.probes_found >= dedup.PROBED * seen.probes and not seen.exact
    assert seen.links < 40 and len(got) == len(x)
    for i, j in pairs[:10]:
        assert got[i][1] in (0, int((u @ u[i] >= 0.95).sum()) - 1)


def test_near_dedup_compares_everything_at_last(spark, monkeypatch):
    """One table of one set of planes and short lists find too little; the exact pass adds the rest, block by block."""
    assert [dedup._tables(b, 0.95) for b in (7, 12, 16)] == [9, 17, 27]
    for name, value in (("PLANES", 1), ("ROUNDS", 1), ("SAMPLE_BYTES", 40_000)):
        monkeypatch.setattr(dedup, name, value)
    monkeypatch.setattr(dedup, "_tables", lambda bits, threshold: 1)
    x, _ = lone_pairs(1_500, 0.2, dim=24)
    x = np.concatenate([x, x[:40] * 1.5, x[5:6] + np.random.default_rng(0).normal(size=(30, 24)) * 0.02])
    out, seen = dedup.dedup_audited(frame(spark, x), neighbours=2)
    assert seen.exact and not seen.holds and seen.planes == 1
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in out.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(label, np.where(near, label, len(x)).min(axis=1))
        if (low == label).all():
            break
        label = low
    assert [got[i] for i in range(len(x))] == list(zip(label.tolist(), near.sum(axis=1).tolist(), strict=True))


def test_near_dedup_without_links_or_dimensions(spark):
    rng = np.random.default_rng(4)
    out, seen = dedup.dedup_audited(frame(spark, rng.normal(size=(300, 40))))
    assert out.filter("n_links > 0 or not kept").count() == 0 and (seen.links, seen.exact) == (0, False) and seen.probes_found >= 198
    out, seen = dedup.dedup_audited(frame(spark, [[1.0], [2.0], [-1.0]]))
    assert [tuple(r) for r in out.orderBy("vec_id").collect()] == [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True)] and seen.probes == 0


# --- mixing ---------------------------------------------------------------------------------------


def test_mix_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES["op8_mix_sources"](spark, d).toPandas()
    same(got, duck(d, queries.ORACLE_SQL["op8_mix_sources"]))
    source = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source").toPandas().set_index("doc_id")["source"]
    per = got.assign(source=got["doc_id"].map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), longest=("size", "max"))
    # whole documents: less than one too many or too few
    assert (abs(per["taken"] - per["target"]) <= per["longest"]).all() and (abs(per["taken"] / per["target"] - 1) < 0.015).mean() > 0.9
    assert (got["taken"] <= 3 * got["size"]).all()


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes, (1, 2, 3), 3).collect()}
    # weights a 1, b 2, c 3, null 1: c stops at 30, null at 0, a at 300
    assert got["c"] == 30 and got[None] == 0 and got["a"] == 300 and got["b"] == 1110 - 330


def test_mix_fills_until_nothing_fits(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([1, 3, 8, 20, 60, 400]), rng.choice("abc")) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for s, g in got.toPandas().groupby("source"):
        gap = g["target"].iloc[0] - g["taken"].sum()
        whole = int(g["target"].iloc[0] // g["source_size"].iloc[0])
        left = g[g["copies"] == whole]["size"]
        assert gap >= 0 and (left.empty or left.min() > gap), s
    # Longer texts are likelier: the share of words taken beyond the whole copies grows with the size.
    pdf = got.toPandas()
    extra = pdf[pdf["source"] == "a"].assign(more=lambda x: x["copies"] - x["copies"].min()).groupby("size")["more"].mean()
    assert extra.loc[1] < extra.loc[60] <= extra.loc[400]


def test_mix_draws_repeats_one_by_one(spark):
    rows = [(7, "a b c", "s")] * 9_000 + [(i, "x y z u", "s") for i in range(100, 200)] + [(i, "a " * 50, "t") for i in range(1000, 1900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(df).toPandas()
    per = got.groupby(got["doc_id"] < 1000).agg(taken=("taken", "sum"), words=("size", "sum"))
    target = got[got["doc_id"] == 7]["target"].iloc[0]
    assert len(got) == len(rows) and abs(per.loc[True, "taken"] - target) <= 4 and got[got["doc_id"] == 7]["copies"].nunique() == 2


def test_mix_keeps_columns_of_any_name(spark):
    names = ["p", "u", "k", "at", "row", "bits", "whole", "rest", "plan_source", "cut", "gap", "rounds", "factor", "longest", "range", "part", "n", "key"]
    df = spark.createDataFrame([(*[f"{n}{i}" for n in names], i, "a b c d"[: 2 * i + 1], "s") for i in range(4)], ", ".join(f"{n} string" for n in names) + ", doc_id long, text string, source string")
    for out in (mixing.mix(df), mixing.mix(df.unionAll(df))):
        for r in out.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names)


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", None), (2, None, "s"), (3, "", "t"), (4, "w " * 50_000, "u")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, taken int")
    out = mixing.mix(df)
    got = out.collect()
    assert len(got) == 6 and all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


# --- revisits -------------------------------------------------------------------------------------


def test_revisits_equal_sql(spark):
    d = "/root/testdata/sf0.1"
    same(queries.QUERIES["op10_revisits"](spark, d).toPandas(), duck(d, queries.ORACLE_SQL["op10_revisits"]))


def test_revisit_verdicts(spark):
    h = lambda **k: {x.replace("_", "-"): v for x, v in k.items()}
    rows = [
        (1, "http://WWW.a.com:80/p/?utm_source=x&b=2&a=1#f", 10, 200, h(ETag='"1"', Content_Type="t", Date="d1"), 1),
        (2, "https://a.com/p?a=1&b=2", 5000, 304, h(etag='W/"1"', date="d2", server="s"), None),
        (3, "a.com/p?a=1&b=2", 9000, 304, h(etag='"2"'), None),
        (4, "a.com/p?a=1&b=2", 9001, 304, None, None),
        (5, "a.com/p?a=1&b=2", 9, 304, {}, None),
        (6, "a.com/q", 10, 304, {}, None),
        (7, None, 10, 304, {}, None),
        (8, "a.com/p?a=1&b=2", 9500, 404, {}, None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, url string, ts long, status int, headers map<string,string>, payload_id long, verdict string")
    got = {r["record_id"]: r for r in warc.resolve(df).collect()}
    assert {k: v["verdict"] for k, v in got.items()} == {2: "resolved", 3: "mismatch", 4: "unverified", 5: "orphan", 6: "orphan", 7: "orphan"}
    assert got[2]["refers_to"] == 1 and got[2]["headers"] == {"content-type": "t", "etag": 'W/"1"', "date": "d2"}
    assert got[3]["refers_to"] is None and got[3]["payload_id"] is None
    assert warc.resolve(df.limit(0)).count() == 0


def test_revisits_with_ties(spark):
    rows = [(1, "a.com", 10, 200, {"etag": x, "vary": "v"}, p) for x, p in (("b", 2), ("a", 2), ("c", 3), ("z", None), ("y", None))] + [(2, "a.com", 20, 304, {"etag": x}, None) for x in ("y", "q")]
    schema = "record_id long, url string, ts long, status int, headers map<string,string>, payload_id long"
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        (r,) = warc.resolve(spark.createDataFrame(rows, schema).repartition(3)).collect()
        assert r["payload_id"] is None and r["verdict"] == "mismatch" and r["headers"] == {"etag": "q"}


# --- scratch and pipeline -------------------------------------------------------------------------


def test_scratch_tables_live_in_the_checkpoint_folder(spark):
    df = materialize(spark.range(5), "t")
    assert all(scratch_root(spark).removeprefix("file://") in f for f in df.inputFiles()) and df.count() == 5


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "ngram_join", "sanitise", "mix", "bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stage = dict(cp.STAGES)
    clean = materialize(stage["toxicity"](spark, docs, sf), "s1")
    assert clean.columns == docs.columns and 0.8 * docs.count() < clean.count() <= docs.count()
    single = materialize(stage["ngram_join"](spark, clean, sf), "s2")
    want = brute_join([(r["doc_id"], r["text"]) for r in clean.collect()], 5, 80)
    assert {r[0] for r in single.select("doc_id").collect()} == {i for i, (n, c) in want.items() if i == c or n == 0}
    safe = materialize(stage["sanitise"](spark, single, sf), "s3")
    assert safe.columns == docs.columns and safe.count() == single.count()
    assert safe.filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]")).count() == 0
    mixed = materialize(stage["mix"](spark, safe, sf), "s4")
    assert mixed.columns == docs.columns and {r[0] for r in mixed.select("doc_id").collect()} <= {r[0] for r in safe.select("doc_id").collect()}
    final = stage["bpe"](spark, mixed, sf)
    assert final.count() == mixed.count() and final.filter("n_tokens <> size(ids) or not intact").count() == 0
    # Against the operators' definitions: each source's words come near its target, texts are those that stage 3 left.
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed.collect())
    ids = {r["doc_id"]: r["ids"] for r in final.collect()}
    c = bpe.codec(bpe.read_ranks(spark, cp.public_tokenizers.path(cp.VOCABULARY)), cp.public_tokenizers.PATTERN)
    assert all(c.decode([np.array(x, np.int32)])[0].decode() == (texts[i] or "") for i, x in list(ids.items())[:50])


def test_pipeline_stages_of_odd_rows(spark, sf):
    import corpus_pipeline as cp

    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (None, text), (None, text + " z"), (3, text), (3, text + " y"), (4, "b@c.de"), (4, "b@c.de"), (5, None), (5, None), (6, ""), (None, "lone words of no one else at all")]
    names = ["row", "key", "own", "whole", "again", "leader", "kept", "copy", "copies", "size", "spans", "base", "redacted", "taken"]
    df = spark.createDataFrame([(i, t, "en", "s", 3, *[n] * len(names)) for i, t in rows for n in ["x"]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    single = cp.near_copies(spark, df, sf)
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in single.collect())
    long = [t for _, t in got if t.startswith(text[:20])]
    assert single.columns == df.columns and len(long) == 1 and got.count(("4", "b@c.de")) == 1 and ("6", "") in got and ("None", "lone words of no one else at all") in got
    assert {r["key"] for r in single.collect()} == {"x"}
    safe = materialize(cp.personal_data(spark, single, sf), "odd")
    assert safe.columns == df.columns and {r["text"] for r in safe.filter("doc_id = 4").collect()} == {"[EMAIL]"} and safe.filter("doc_id = 4").first()["n_chars"] == 7
    mixed = cp.mixed(spark, safe, sf)
    assert mixed.columns == df.columns and {r["copies"] for r in mixed.collect()} <= {"x"}
    assert cp.tokens(spark, mixed, sf).filter("not intact").count() == 0
    for stage in (cp.near_copies, cp.personal_data, cp.mixed, cp.tokens):
        assert stage(spark, df.limit(0), sf).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered(name):
    assert name in queries.QUERIES
