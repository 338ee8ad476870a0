"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. A document first gets as many certain whole
copies as the target holds whole source sizes. The rest R of the target is drawn with
unequal probabilities: a document of s words is included with p = min(1, c s), where c
makes the expected words those of the rest. Documents with p = 1 are certain copies as
well. The others have the ranking variable

    Q = (u / (1 - u)) / (p / (1 - p))

with a random number u, and those with the smallest Q are selected. The size of the
sample is fixed in words: documents are taken in the order of Q, each that still fits,
until none fits.

Taking what fits goes in rounds: of the documents behind the last cut that are no longer
than the gap, as many are taken in the order of Q as fit together. The first rounds are
distributed; when all gaps are below ``FILL`` words, a group for each source ends it, with
no more documents of each size than the gap could hold, and the one that ends them.

Scale: a row for each document (source, bits, size, rank) is written aside, never a text.
Running sums are taken within (source, range of Q), so a source that holds a third of all
rows is spread over many groups; its ranges are then summed. A document is decided by
comparing its Q with the cuts of its source, so texts are not shuffled unless rows repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of Q that a source's running sums are split into, for each power of 2.
RANGES = 64
#: Words of a gap from which on a group for each source ends the filling.
FILL = 1 << 16
#: Rows that one row of repeats expands to at once, and parts that repeated rows are numbered in.
CHUNK, PARTS = 4096, 1024
#: Sources of which every so-many-th is a bound of the ranges in which sources are numbered.
SAMPLE, EVERY = 4096, 16
ADDED = ("size", "source_size", "target", "pareto_rank", "copies", "taken")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_bits(*columns: Column) -> Column:
    """52 bits from the md5 of the columns; reruns agree. Nulls count as a value of their own."""
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long")


def uniform(bits: Column) -> Column:
    """The number in (0, 1) that 52 bits stand for."""
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def ordered(rows: DataFrame, key: Column, sums: dict[str, Column]) -> DataFrame:
    """Add number (from 1) and the sums of all earlier rows, in the order of key.

    Rows fall into ranges between bounds of a sample of bounded size; each range is a
    window of its own, and the totals of the ranges before are added.
    """
    rows = rows.withColumn("key", key)
    taken = sorted(r[0] for r in rows.groupBy("key").count().select("key").orderBy(F.xxhash64("key")).limit(SAMPLE).select(F.to_json(F.struct("key"))).collect())
    kind = rows.schema["key"].dataType
    bounds = F.transform(F.array(*map(F.lit, taken[EVERY - 1 :: EVERY])).cast("array<string>"), lambda b: F.from_json(b, StructType().add("key", kind))["key"])
    rows = rows.withColumn("span", F.size(F.filter(bounds, lambda b: b <= F.col("key"))))
    local = Window.partitionBy("span").orderBy("key")
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("span").agg(F.count("*").alias("count_"), *[F.sum(c).alias(f"{n}_all") for n, c in sums.items()])
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select("span", zero(F.sum("count_").over(before)).alias("count_"), *[zero(F.sum(f"{n}_all").over(before)).alias(f"{n}_all") for n in sums])
    own = [zero(F.sum(c).over(local.rowsBetween(Window.unboundedPreceding, -1))).alias(f"{n}_own") for n, c in sums.items()]
    rows = rows.select("*", F.row_number().over(local).alias("row_"), *own).join(totals, "span")
    rows = rows.withColumn("number", F.col("count_") + F.col("row_")).withColumns({n: F.col(f"{n}_all") + F.col(f"{n}_own") for n in sums})
    return rows.drop("key", "span", "count_", "row_", *[f"{n}{x}" for n in sums for x in ("_all", "_own")])


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """(source, source_size) -> + target: shares of all words by weight, at most ``most`` times the source.

    Sources take the weights in turn by code point, null last. The excess above
    a limit is shared again by weight; the fixed point is found in one pass over
    the sources in the order of limit by weight. Integers decide who is limited.
    """
    last = lambda c: F.struct(c.isNull(), c)
    w = ordered(sizes, last(F.col("source")), {})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    w = w.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("limit"))
    w = ordered(w, F.struct(F.col("limit") / F.col("weight"), last(F.col("source"))), {"before": F.col("limit"), "weight_before": F.col("weight")})
    w = materialize(w, "mix-sources")
    total, all_weights = w.agg(F.sum("source_size"), F.sum("weight")).first()
    w = w.withColumn("limited", F.col("limit") * (F.lit(all_weights) - F.col("weight_before")) <= (F.lit(total) - F.col("before")) * F.col("weight"))
    spent, free = w.agg(F.coalesce(F.sum(F.when(F.col("limited"), F.col("limit"))), F.lit(0)), F.sum(F.when(~F.col("limited"), F.col("weight")))).first()
    share = (F.col("weight") * F.lit((total or 0) - (spent or 0))).cast("double") / F.lit(float(free or 1))
    return w.select("source", "source_size", F.when(F.col("limited"), F.col("limit").cast("double")).otherwise(share).alias("target"))


def inclusion(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """plan (source, rest, ...) -> + factor, longest, gap: p = factor * size up to longest words, 1 above; words to draw below.

    sizes: source, size, n. Certain documents are the longest ones: with those above size
    s certain, c = (rest - their words) / (sum of squares of the others), and c s < 1.
    """
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    big = lambda c: c.cast("decimal(38,0)")
    s = sizes.filter("size > 0").join(plan.select(F.col("source").alias("plan_source"), "rest"), F.col("source").eqNullSafe(F.col("plan_source")))
    above = F.coalesce(F.sum(big(F.col("size") * F.col("n"))).over(down), big(F.lit(0)))
    squares = F.sum(big(F.col("n")) * F.col("size") * F.col("size")).over(up)
    s = s.withColumn("above", above.cast("double")).withColumn("squares", squares.cast("double"))
    s = s.filter((F.col("rest") - F.col("above")) * F.col("size") < F.col("squares"))
    s = s.groupBy("source").agg(F.max_by(F.struct("size", "above", "squares"), "size").alias("cut")).select(F.col("source").alias("cut_source"), "cut")
    plan = plan.join(s, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    certain = F.coalesce("cut.above", F.lit(0.0))
    return plan.withColumns(
        {"factor": F.coalesce((F.col("rest") - certain) / F.col("cut.squares"), F.lit(0.0)), "longest": F.coalesce("cut.size", F.lit(0)), "gap": F.floor(F.greatest(F.col("rest") - certain, F.lit(0.0))).cast("long")}
    ).drop("cut")


ROUND = "struct<low:struct<rank:double,bits:bigint,k:bigint>,cut:struct<rank:double,bits:bigint,k:bigint>,gap:bigint>"


def _distributed(tickets: DataFrame, plan: DataFrame) -> DataFrame:
    """One round over all sources: rounds gains an entry, gap loses what was taken."""
    key = plan.select(F.col("source").alias("plan_source"), "gap", F.try_element_at("rounds", F.lit(-1))["cut"].alias("low"))
    rows = tickets.join(key, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    rows = rows.filter((F.col("size") <= F.col("gap")) & (F.col("low").isNull() | (F.col("at") > F.col("low"))))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("earlier"))
    # Ranges that begin beyond the gap can't be reached.
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).filter(F.col("earlier") < F.col("gap"))
    within = Window.partitionBy("source", "range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.col("earlier") + F.sum("size").over(within)).filter(F.col("cum") <= F.col("gap"))
    got = rows.groupBy("source").agg(F.max("at").alias("cut"), F.max("cum").alias("filled"), F.first("low").alias("low")).withColumnRenamed("source", "got_source")
    plan = plan.join(got, F.col("source").eqNullSafe(F.col("got_source")), "left")
    entry = F.struct("low", "cut", "gap").cast(ROUND)
    plan = plan.withColumn("rounds", F.when(F.col("cut").isNull(), F.col("rounds")).otherwise(F.concat("rounds", F.array(entry))))
    return plan.withColumn("open", F.col("cut").isNotNull()).withColumn("gap", F.col("gap") - F.coalesce("filled", F.lit(0))).drop("got_source", "cut", "filled", "low")


def _fill(tickets: DataFrame, plan: DataFrame) -> DataFrame:
    """The remaining rounds of each source as an array: source, last."""
    key = plan.select(F.col("source").alias("plan_source"), "gap", F.try_element_at("rounds", F.lit(-1))["cut"].alias("low"))
    rows = tickets.join(key, F.col("source").eqNullSafe(F.col("plan_source"))).filter((F.col("size") <= F.col("gap")) & (F.col("low").isNull() | (F.col("at") > F.col("low"))))
    first = Window.partitionBy("source", "size").orderBy("at")
    rows = rows.withColumn("i", F.row_number().over(first)).filter(F.col("i") <= FILL + 1).filter((F.col("i") - 1) * F.col("size") <= F.col("gap"))
    rows = rows.select("source", "size", "gap", "at.rank", "at.bits", "at.k")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("rank", "ascending"), ("bits", "ascending"), ("k", "ascending")])
        size, gap = t.column("size").to_numpy(), t.column("gap")[0].as_py()
        places = [dict(zip(("rank", "bits", "k"), x, strict=True)) for x in zip(*(t.column(c).to_pylist() for c in ("rank", "bits", "k")), strict=True)]
        rounds, last = [], -1
        while True:
            at = last + 1 + np.flatnonzero(size[last + 1 :] <= gap)
            fits = int((np.cumsum(size[at]) <= gap).sum())
            if not fits:
                break
            rounds.append({"low": places[last] if last >= 0 else None, "cut": places[at[fits - 1]], "gap": gap})
            gap, last = gap - int(size[at[:fits]].sum()), int(at[fits - 1])
        kind = pa.struct([(c, pa.struct([("rank", pa.float64()), ("bits", pa.int64()), ("k", pa.int64())])) for c in ("low", "cut")] + [("gap", pa.int64())])
        return pa.table({"source": t.column("source").slice(0, 1), "last": pa.array([rounds], pa.list_(kind))})

    return rows.groupBy("source").applyInArrow(run, f"source string, last array<{ROUND}>")


def _numbered(docs: DataFrame, key: list[str]) -> DataFrame:
    """Rows of repeats with k = 1, 2, ... within a key; a key's rows are numbered in parts."""
    docs = materialize(docs.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "mix-repeats")
    earlier = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = docs.groupBy(*key, "part").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"{c}_") for c in (*key, "part")], "earlier")
    same = F.lit(True)
    for c in (*key, "part"):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    docs = docs.withColumn("i", F.row_number().over(Window.partitionBy(*key, "part").orderBy("part"))).join(counts, same)
    return docs.select("row", *key, (F.col("earlier") + F.col("i")).alias("k"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """docs (doc_id, text, source, ...) -> the same rows with size, source_size, target, pareto_rank, copies, taken.

    A null or empty text has size 0 and is taken zero words. A null source is a
    source of its own. Rows alike in doc_id, text and source are drawn one by one, each by
    a random number of its own; which of them has which is free. pareto_rank is null where
    nothing is drawn: in texts of size 0 and where the target holds whole sources only. An
    empty table gives no rows. Other columns pass through whatever their names; columns
    named like the added ones are replaced.
    """
    docs = docs.drop(*ADDED)
    bits = random_bits(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    size = word_count(F.col("text"))
    key = ["source", "bits", "size"]
    sized = materialize(docs.select(F.col("source").cast("string").alias("source"), bits.alias("bits"), size.alias("size")).groupBy(*key).agg(F.count("*").alias("n")), "mix-sizes")
    plan = source_targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(inclusion(sized.groupBy("source", "size").agg(F.sum("n").alias("n")), plan), "mix-plan")

    def ranked(rows: DataFrame) -> DataFrame:
        """rows (source, bits, size, k) -> + p, at: the place in the order of Q."""
        p = F.when(F.col("size") > F.col("longest"), 1.0).otherwise(F.col("factor") * F.col("size"))
        own = F.when(F.col("k") == 1, F.col("bits")).otherwise(random_bits(F.lit(seed), F.col("bits"), F.col("k")))
        rows = rows.withColumn("p", p).withColumn("u", uniform(own))
        q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
        at = F.struct(q.alias("rank"), "bits", F.col("k").cast("long").alias("k"))
        return rows.withColumn("at", F.when((F.col("p") > 0) & (F.col("p") < 1), at))

    def with_plan(rows: DataFrame, *columns: str) -> DataFrame:
        own = plan.select(F.col("source").alias("plan_source"), *columns)
        return rows.join(own, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")

    repeats = sized.filter("n > 1")
    repeated = not repeats.isEmpty()
    tickets = sized.select(*key, F.lit(1).cast("long").alias("k"))
    if repeated:
        chunks = repeats.select(*key, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk")).repartition("bits", "chunk")
        more = chunks.select(*key, F.explode(F.sequence(F.col("chunk") * CHUNK + 1, F.least("n", (F.col("chunk") + 1) * CHUNK))).alias("k"))
        tickets = tickets.unionByName(more.filter("k > 1"))
    tickets = ranked(with_plan(tickets, "factor", "longest")).filter("at is not null")
    tickets = materialize(tickets.select("source", "size", "at", F.floor(F.log2("at.rank") * RANGES).cast("int").alias("range")), "mix-ranks")
    plan = plan.withColumn("rounds", F.array().cast(f"array<{ROUND}>")).withColumn("open", F.col("gap") > 0)
    while True:
        plan = materialize(_distributed(tickets, plan), "mix-cuts")
        if (plan.filter("open").agg(F.max("gap")).first()[0] or 0) <= FILL:
            break
    last = _fill(tickets, plan).withColumnRenamed("source", "last_source")
    plan = plan.join(last, F.col("source").eqNullSafe(F.col("last_source")), "left").drop("last_source")
    plan = materialize(plan.withColumn("rounds", F.concat("rounds", F.coalesce("last", F.array().cast(f"array<{ROUND}>")))), "mix-cuts")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("source"), bits.alias("bits"), size.alias("size"))
    if repeated:
        repeats = repeats.select(*[F.col(c).alias(f"{c}_") for c in key])
        same = F.lit(True)
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
        several = _numbered(rows.join(repeats, same, "left_semi"), key)
        rows = rows.join(repeats, same, "left_anti").withColumn("k", F.lit(1).cast("long")).unionByName(several)
    else:
        rows = rows.withColumn("k", F.lit(1).cast("long"))
    rows = ranked(with_plan(rows, "source_size", "target", "whole", "factor", "longest", "rounds"))
    drawn = F.exists("rounds", lambda r: (r["low"].isNull() | (F.col("at") > r["low"])) & (F.col("at") <= r["cut"]) & (F.col("size") <= r["gap"]))
    copies = F.least(F.col("whole") + (F.coalesce(drawn, F.lit(False)) | (F.col("p") == 1)).cast("long"), F.lit(most))
    rank = F.when(F.col("p") == 1, 0.0).otherwise(F.col("at.rank"))
    rows = rows.select("row", "size", "source_size", "target", rank.alias("pareto_rank"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns], *ADDED)
