"""Personal data: patterns, and terms that reveal who they belong to.

Spans of four kinds (email, ip, card, phone) are found by patterns; they are the
protected entities. Then corpus co-occurrence tells how much a term reveals an
entity: with documents that hold entity e, term t, or t beside e,

    PMI(e, t) = log(N df(e, t) / (df(e) df(t))),   IC(e) = log(N / df(e))

PMI reaches IC when every document with t has it beside e. A term is a disclosure in the
documents with e from PMI >= DISCLOSURE * IC on; wherever it stands there it is generalised
to [TERM], as the entity is to its kind.

A term stands beside an entity within NEAR characters of an occurrence, or in a text with an
address that spells it: a part of the mailbox name or domain (without its last label) is the
term, or begins or ends with it. It takes SUPPORT pieces of evidence: each different text
with the term beside the entity is one, each different window is one, and the spelling is
two. So a name beside an address needs two texts or two windows, and one that the address
spells needs one text. Terms are words of two letters or digits or more, outside the spans;
a run of letters without spaces, as in CJK, is one word.

DataFrame functions only. Where a pattern of the contract would backtrack or
recurse on long input, an equal one in linear time stands in: possessive loops
over character classes, and a start that is no continuation of an earlier try. Folds over
matches go in blocks, and texts are cut into pieces of ``PIECE`` characters before spans are
taken out of them, as arrays that grow entry by entry and places in long strings would both
cost the square of a text's matches.

Scale: pairs come from windows and addresses, so their number is in proportion to the
occurrences of entities, whatever a text holds. All counts combine before the shuffle. Copies
of a text are paired once, weighted. Only documents with entities are stored aside and
joined; clean ones stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize

#: Kinds in the order of the contract; terms come last.
KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information from which a term reveals it.
DISCLOSURE = 0.9
#: Pieces of evidence that an entity and a term need together.
SUPPORT = 3
#: Characters on either side of an occurrence that make its window.
NEAR = 60
#: Lengths of the beginnings and ends of an address part that may be terms; a whole part may have any.
SPELT = (3, 40)
#: Matches of a block of a fold, and characters of a piece of a text.
BLOCK, PIECE = 256, 4096

#: Stands for a dot that no domain label follows; in a text it counts as U+FFFD.
STOP = "￾"
EMAIL = rf"(?:(?<![A-Za-z0-9._%+{STOP}-])|\G)[A-Za-z0-9._%+{STOP}-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*+"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_VALID = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\.){3}0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: A run of digits and separators that may hold a card; two separators in a row part it.
DIGITS = r"[0-9][0-9\x20-]{11,}+"
PARTS = r"[\x20-]{2,}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"\p{L}\p{M}\p{N}"
TERM = rf"[{WORD}]{{2,}}+"

SPANS = "array<struct<start:int,rank:int,end:int,value:string>>"


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.transform(F.array(value), f)[0]


def _span(start: Column, rank: int, end: Column, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), value.alias("value"))


def _none() -> Column:
    return F.array().cast(SPANS)


def _fold(pairs: Column, first: str, rank: int) -> Column:
    """Spans of the hits in pairs (hit, gap) that alternate in a text; first: which of the two comes first."""

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + (F.length(x["gap"]) if first == "gap" else F.lit(0))
        end = start + F.length(x["hit"])
        after = end if first == "gap" else end + F.coalesce(F.length(x["gap"]), F.lit(0))
        moved = F.struct(after.cast("int").alias("at"), F.concat(s["found"], F.array(_span(start, rank, end, x["hit"]))).alias("found"))
        return F.when(x["hit"].isNull(), s).otherwise(moved)

    def block(s: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(s["at"].alias("at"), _none().alias("found")), step)
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(s["found"], F.array(d["found"])).alias("found")))

    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(p), F.lit(1)) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("found"))
    return _let(pairs, lambda p: F.aggregate(blocks(p), zero, block, lambda s: F.flatten(s["found"])))


def places(text: Column, pattern: Column | str, rank: int) -> Column:
    """Spans of the pattern's leftmost matches that do not overlap, in code points."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return _fold(F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.split(text, p, -1).alias("gap")), "gap", rank)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when((n - i) % 2 == 0, d).otherwise(doubled)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _cards(text: Column) -> Column:
    """Runs of digits with single separators, 12 to 19 digits that pass the checksum."""

    def parts(run: Column) -> Column:
        value = F.regexp_replace(run["value"], r"[\x20-]$", "")
        own = F.arrays_zip(F.split(value, PARTS, -1).alias("hit"), F.regexp_extract_all(value, F.lit(PARTS), F.lit(0)).alias("gap"))
        return F.transform(_fold(own, "hit", 2), lambda x: _span(run["start"] + x["start"], 2, run["start"] + x["end"], x["value"]))

    def valid(x: Column) -> Column:
        return _let(_digits(x["value"]), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))

    return F.filter(F.flatten(F.transform(places(text, DIGITS, 2), parts)), valid)


def base_spans(text: Column) -> Column:
    """Spans (start, rank, end, value) of the four kinds by start, then kind. A null text has none."""
    t = F.coalesce(text, F.lit(""))
    # A dot that no label follows ends a domain, but may stand before an @.
    marked = F.regexp_replace(F.translate(t, STOP, "�"), r"\.(?![A-Za-z0-9-])", STOP)
    mails = _let(marked, lambda m: places(m, EMAIL, 0))
    mails = F.transform(mails, lambda x: _span(x["start"], 0, x["end"], F.translate(x["value"], STOP, ".")))
    phones = F.filter(places(t, PHONE, 3), lambda x: F.length(_digits(x["value"])).between(9, 15))
    found = [
        F.when(F.instr(t, "@") > 0, mails).otherwise(_none()),
        F.when(t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(places(t, IP, 1), lambda x: x["value"].rlike(IP_VALID))).otherwise(_none()),
        F.when(t.rlike(r"[0-9][0-9\x20-]{11}"), _cards(t)).otherwise(_none()),
        F.when(F.instr(t, "+") > 0, phones).otherwise(_none()),
    ]
    return F.array_sort(F.concat(*found))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, (*KINDS, "term")))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _entity(x: Column) -> Column:
    """Kind and normal form of a span."""
    normal = F.when(x["rank"] < 2, F.lower(x["value"])).otherwise(_digits(x["value"]))
    return F.concat(x["rank"].cast("string"), F.lit(":"), normal)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def rewritten(text: Column, spans: Column, shown) -> Column:
    """The text with shown(span, from) in place of each span; what an earlier span covers up to ``from`` is not shown again.

    spans are sorted by start. Each piece of the text is put together from the spans that begin in it.
    """

    def piece(s: Column, p: Column, ids: Column) -> Column:
        begin = p["i"] * PIECE
        own = F.slice(spans, F.greatest(F.array_position(ids, p["i"]).cast("int"), F.lit(1)), F.size(F.filter(ids, lambda i: i == p["i"])))

        def step(x: Column, span: Column) -> Column:
            between = F.substring(p["t"], x["at"] - begin + 1, F.greatest(span["start"] - x["at"], F.lit(0)))
            moved = F.struct(span["end"].alias("at"), F.concat(x["out"], between, shown(span, F.greatest(span["start"], x["at"]))).alias("out"))
            return F.when(span["end"] <= x["at"], x).otherwise(moved)

        done = F.aggregate(own, F.struct(F.greatest(s["at"], begin).alias("at"), F.lit("").alias("out")), step)
        rest = lambda d: F.substring(p["t"], d["at"] - begin + 1, F.lit(PIECE))
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(s["out"], F.array(F.concat(d["out"], rest(d)))).alias("out")))

    numbered = F.transform(_pieces(text), lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = lambda ids: F.aggregate(numbered, zero, lambda s, p: piece(s, p, ids), lambda s: F.array_join(s["out"], ""))
    return F.when(F.size(spans) == 0, text).otherwise(_let(F.transform(spans, lambda x: F.floor(x["start"] / PIECE).cast("int")), whole))


def outside(text: Column, spans: Column) -> Column:
    """The text with spaces in place of its spans, of the same length."""
    return rewritten(text, spans, lambda x, at: F.repeat(F.lit(" "), x["end"] - at))


def _window(pieces: Column, x: Column) -> Column:
    """Terms of the window round a span, sorted; words that its ends cut are left out. pieces: those of the text with a space on each side."""
    start = F.greatest(x["start"] - NEAR, F.lit(0))
    length = x["end"] + NEAR + 2 - start
    first = F.floor(start / PIECE).cast("int")
    cut = F.array_join(F.slice(pieces, first + 1, F.floor(length / PIECE).cast("int") + 2), "")
    cut = F.substring(cut, start - first * PIECE + 1, length)
    return F.array_sort(_terms(F.regexp_replace(cut, rf"^[{WORD}]++|(?<![{WORD}])[{WORD}]++$", "")))


def _spellings(e: Column) -> Column:
    """What an address may spell: its parts, and their beginnings and ends."""
    least, most = SPELT
    parts = F.filter(F.split(F.regexp_replace(F.substring(e, 3, 1 << 30), r"\.[^.@]*$", ""), rf"[^{WORD}]+"), lambda p: F.length(p) >= least)
    ends = lambda p: F.sequence(F.lit(least), F.least(F.length(p), F.lit(most)))
    cut = F.transform(parts, lambda p: F.concat(F.array(p), F.transform(ends(p), lambda n: F.left(p, n)), F.transform(ends(p), lambda n: F.right(p, n))))
    return F.array_distinct(F.flatten(cut))


def disclosures(texts: DataFrame, docs: DataFrame, disclosure: float, support: int) -> DataFrame:
    """(text_key, t): the terms of each text that reveal one of its entities.

    texts: text_key, m (copies), base and outside of the different texts with entities;
    docs: outside of all documents.
    """
    padded = _pieces(F.concat(F.lit(" "), F.col("outside"), F.lit(" ")))
    seen = _let(padded, lambda p: F.transform("base", lambda x: F.struct(_entity(x).alias("e"), _window(p, x).alias("window"))))
    windows = materialize(texts.select("text_key", "m", F.explode(seen).alias("x")).select("text_key", "m", "x.e", "x.window").distinct(), "pii-windows")
    term = materialize(texts.select("text_key", F.explode(_terms(F.col("outside"))).alias("t")), "pii-terms")
    entity = materialize(windows.select("text_key", "m", "e").distinct(), "pii-entities")
    known = entity.groupBy("e").agg(F.sum("m").alias("df_e"))
    beside = windows.select("text_key", "m", "e", F.explode("window").alias("t"), F.lit(0).alias("spelt"))
    spelt = entity.filter("e like '0:%'").select("text_key", "m", "e", F.explode(_spellings(F.col("e"))).alias("t"), F.lit(2).alias("spelt"))
    spelt = spelt.join(term, ["text_key", "t"], "left_semi").select("text_key", "m", "e", "t", "spelt")
    pairs = beside.unionByName(spelt).groupBy("e", "t", "text_key").agg(F.first("m").alias("m"), F.max("spelt").alias("spelt"))
    pairs = pairs.groupBy("e", "t").agg(F.count("*").alias("texts"), F.sum("m").alias("df_et"), F.max("spelt").alias("spelt"))
    # A window that several texts share is one piece of evidence.
    near = windows.select("e", "window").distinct().select("e", F.explode("window").alias("t")).groupBy("e", "t").agg(F.count("*").alias("near"))
    pairs = pairs.join(near, ["e", "t"], "left").filter(F.col("texts") + F.coalesce("near", F.lit(0)) + F.col("spelt") >= support)
    pairs = materialize(pairs.select("e", "t", "df_et").join(known, "e"), "pii-pairs")
    df_t = docs.select(F.explode(_terms(F.coalesce(F.col("outside"), F.lit("")))).alias("t"))
    # An inner join below, as a semi join would be pushed under the counts and shuffle every word.
    df_t = df_t.groupBy("t").agg(F.count("*").alias("df_t"))
    n = F.lit(float(docs.count()))
    pmi = F.log(n * F.col("df_et") / (F.col("df_e") * F.col("df_t")))
    ic = F.log(n / F.col("df_e"))
    revealing = pairs.join(df_t, "t").filter((ic > 0) & (pmi >= disclosure * ic)).select("e", "t")
    return revealing.join(term, "t").join(entity.select("e", "text_key"), ["e", "text_key"], "left_semi").select("text_key", "t").distinct()


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """docs (text, ...) -> the same rows with base and spans (start, rank, end, value) and redacted.

    Every row stays, with its other columns, whatever their names; columns named base,
    spans or redacted are replaced. In redacted each span is generalised to its kind; a
    span within another counts as one with it. A null text stays null and has no spans;
    so does an empty one. Repeated rows get alike results. No rows give no rows.
    """
    docs = docs.drop("base", "spans", "redacted")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("whole"), base_spans(F.col("text")).alias("base"))
    held = rows.filter(F.size("base") > 0).withColumn("outside", outside(F.col("whole"), F.col("base"))).withColumn("text_key", F.sha2("whole", 256))
    held = materialize(held, "pii-held")
    clean = rows.filter(F.size("base") == 0)
    texts = held.groupBy("text_key").agg(F.count("*").alias("m"), F.first("base").alias("base"), F.first("outside").alias("outside"))
    texts = materialize(texts, "pii-texts")
    every = clean.select(F.col("whole").alias("outside")).unionByName(held.select("outside"))
    found = materialize(disclosures(texts, every, disclosure, support), "pii-found")
    word = texts.join(found.select("text_key").distinct(), "text_key", "left_semi").select("text_key", F.explode(places(F.col("outside"), TERM, len(KINDS))).alias("x"))
    terms = word.withColumn("t", F.lower("x.value")).join(found, ["text_key", "t"], "left_semi").groupBy("text_key").agg(F.collect_list("x").alias("terms"))
    held = held.join(terms, "text_key", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("terms", _none()))))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    held = held.withColumn("redacted", rewritten(F.col("whole"), F.col("spans"), lambda x, at: F.element_at(kinds, x["rank"] + 1)))
    own = [F.col("row")[c].alias(c) for c in docs.columns]
    return clean.select(*own, "base", F.col("base").alias("spans"), F.col("whole").alias("redacted")).unionByName(held.select(*own, "base", "spans", "redacted"))
