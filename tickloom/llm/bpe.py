"""Byte-level BPE by recursive queries of DuckDB, one database in each Python worker.

Encoding. A text is cut into pre-tokens by the vocabulary's pattern. A pre-token that
is a token is done; the others become rows (word, position, token), one for each byte.
A recursive query joins each row and its successor with the merge table and contracts
the leftmost pair of the smallest rank of every word, until no word has a pair left.
Pairs of that rank further right are contracted in the same round where none can make a
pair of a smaller rank, which the merge table tells beforehand. Words already seen come
from a bounded cache, so the query runs over what is new in a slice of texts.

Long pre-tokens. A recursion keeps the rows of all its rounds, so words of more than
``CHUNK`` bytes are contracted in chunks by the same query. A sequence of tokens is a
word's encoding if and only if each two neighbours are the encoding of their bytes: up to
a first merge across a boundary, the tokens on its sides grow as if they were alone. So
boundaries between chunks are checked, and where one fails a window round it is
contracted anew, twice as wide each time, until all hold.

Memory. A query has a bounded number of rows times rounds; a block that is not finished
after its rounds goes on in the next query. The cache is bounded in bytes, and long texts
are handled in segments.

Decoding. The rows (text, position, id) join the vocabulary; an ordered aggregation
concatenates their bytes.

Each text is encoded by itself, so a partition needs nothing but its rows and the
vocabulary, which has a fixed size. The path of the rank file is a parameter; each
worker reads it once, and gets its bytes from the driver.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import sliced

#: Bytes of a chunk of a long pre-token, and of the first window round a boundary, to each side.
CHUNK, WINDOW = 32, 8
#: Rows of one recursive query, and rows times rounds.
ROWS, STEPS = 60_000, 4_000_000
#: Ids of one decoding query.
DECODED = 250_000
#: Bytes in a generation of what a worker remembers, and what an entry costs besides its key and value.
CACHE, ENTRY = 128 << 20, 180
#: Characters of a segment of a long text.
SEGMENT = 1 << 20

#: A place is word * 2^32 + the position of a token's first byte; the successor's place is that plus the token's size.
MERGE = """
WITH RECURSIVE step(id, size, tok, round, open) AS (
    SELECT id, size, tok, 0, true FROM start_rows
  UNION ALL (
    WITH ranked AS (
      SELECT s.id, s.id >> 32 AS word, s.size, s.tok, s.round, n.size AS more, m.merged, m.safe
      FROM step s
      LEFT JOIN (SELECT id, size, tok FROM step WHERE open) n ON n.id = s.id + s.size
      LEFT JOIN merges m ON m.pair = s.tok::BIGINT * 4294967296 + n.tok
      WHERE s.open AND s.round < {rounds}),
    best AS (SELECT word, min(merged::BIGINT * 4294967296 + (id & 4294967295)) AS place FROM ranked GROUP BY word),
    wanted AS (
      SELECT r.id, r.size, r.more, r.merged FROM ranked r JOIN best b ON b.word = r.word
      WHERE r.merged = b.place >> 32 AND (r.safe OR r.id & 4294967295 = b.place & 4294967295)),
    taken AS (SELECT * FROM wanted w ANTI JOIN (SELECT id + size AS after FROM wanted) p ON p.after = w.id)
    SELECT r.id, r.size + coalesce(t.more, 0), coalesce(t.merged, r.tok), r.round + 1, b.place IS NOT NULL
    FROM ranked r JOIN best b ON b.word = r.word
    LEFT JOIN taken t ON t.id = r.id
    ANTI JOIN (SELECT id + size AS gone FROM taken) g ON g.gone = r.id))
SELECT id, size, tok, open FROM step WHERE NOT open OR round = {rounds} ORDER BY id
"""

DECODE = """
SELECT r.text, string_agg(v.bytes, '' ORDER BY r.pos) AS bytes FROM id_rows r JOIN vocabulary v ON v.id = r.id GROUP BY r.text
"""


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and their ranks from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Memory:
    """A cache of two generations of so many bytes: what the older one holds and nobody asked for is forgotten."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held = limit, 0
        self.young: dict = {}
        self.old: dict = {}

    def put(self, found: dict) -> None:
        self.young.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)

    def lacking(self, keys: Iterable) -> list:
        """Those of different keys that neither holds; all others are in young afterwards. Takes time by keys, not by what is held."""
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        young, old = self.young, self.old
        missing = [k for k in keys if k not in young]
        known = {k: v for k in missing if (v := old.get(k)) is not None}
        self.put(known)
        return [k for k in missing if k not in known]


class Codec:
    """Encoder and decoder over one rank file and pattern."""

    def __init__(self, data: bytes, pattern: str, cache: int = CACHE) -> None:
        import duckdb
        import regex

        self.ranks = parse_ranks(data)
        self.text_of = {r: t for t, r in self.ranks.items()}
        self.pattern, self.spaced = regex.compile(pattern), pattern == SPACED
        self.words, self.decoded, self.pairs = Memory(cache), Memory(cache), Memory(cache // 8)
        self.tokens = {t: np.array([r], np.int32).tobytes() for t, r in self.ranks.items()}
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.full = duckdb.OutOfMemoryException
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "384MB", "temp_directory": ""})
        names = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]})
        merges = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        a, b, m = (np.array(x, np.int64) for x in zip(*merges, strict=True)) if merges else (np.zeros(0, np.int64),) * 3
        # The smallest rank of a pair that holds a token: above the token's own rank, its pairs may be contracted together.
        least = np.full(max(self.text_of) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, a, m)
        np.minimum.at(least, b, m)
        rows = pa.table({"pair": a * (1 << 32) + b, "merged": m.astype(np.int32), "safe": least[m] > m})
        for name, rel in (("vocabulary", names), ("merges", rows)):
            self.db.register("given", rel)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")

    def _run(self, query: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def _rounds(self, start: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        """(place, token) of the finished rows, by as many queries as the rounds need. A block that does not fit is parted."""
        done = []
        while start.num_rows:
            try:
                got = self._run(MERGE.format(rounds=max(4, STEPS // start.num_rows)), "start_rows", start)
            except self.full:
                word = start.column("id").to_numpy() >> 32
                cut = int(np.searchsorted(word, (word[0] + word[-1] + 1) // 2))
                if not 0 < cut < len(word):
                    raise
                return done + self._rounds(start.slice(0, cut)) + self._rounds(start.slice(cut))
            open_ = got.column("open").to_numpy()
            done.append(tuple(got.column(c).to_numpy()[~open_] for c in ("id", "tok")))
            start = got.select(["id", "size", "tok"]).filter(pa.array(open_))
        return done

    def _contract(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """Packed ids of each word."""
        words = list(dict.fromkeys(words))
        out: dict[bytes, bytes] = {}
        ends = np.cumsum([len(w) for w in words])
        lo = 0
        while lo < len(words):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + ROWS)))
            block = words[lo:hi]
            sizes = np.array([len(w) for w in block])
            last = np.cumsum(sizes)
            place = (np.repeat(np.arange(len(block)), sizes) << 32) + np.arange(last[-1]) - np.repeat(last - sizes, sizes)
            start = pa.table({"id": place, "size": np.ones(len(place), np.int32), "tok": self.bytes[np.frombuffer(b"".join(block), np.uint8)]})
            parts = self._rounds(start)
            places, tokens = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(places, kind="stable")
            word, raw = places[order] >> 32, tokens[order].astype(np.int32).tobytes()
            cuts = (np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1, [len(word)]]) * 4).tolist()
            out.update({w: raw[a:b] for w, a, b in zip(block, cuts[:-1], cuts[1:], strict=True)})
            lo = hi
        return out

    def _valid(self, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], bytes]:
        """b"y" for the pairs of tokens that are the encoding of their bytes."""
        lacking = self.pairs.lacking(wanted)
        if lacking:
            text = {p: self.text_of[p[0]] + self.text_of[p[1]] for p in lacking}
            got = self._contract(text.values())
            self.pairs.put({p: b"y" if got[t] == np.array(p, np.int32).tobytes() else b"" for p, t in text.items()})
        return self.pairs.young

    def _long(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of words by chunks, and by windows round the boundaries that fail."""
        chunks = {w: [w[k : k + CHUNK] for k in range(0, len(w), CHUNK)] for w in words}
        got = self._contract(c for own in chunks.values() for c in own)
        ids, doubt = {}, {}
        for w, own in chunks.items():
            parts = [np.frombuffer(got[c], np.int32) for c in own]
            ids[w] = np.concatenate(parts)
            doubt[w] = np.cumsum([len(p) for p in parts])[:-1]
        reach = WINDOW
        while doubt:
            valid = self._valid({(int(ids[w][b - 1]), int(ids[w][b])) for w, at in doubt.items() for b in at})
            windows: dict[bytes, list[tuple[int, int, bytes]]] = {}
            for w, at in doubt.items():
                x = ids[w]
                ends = np.cumsum([len(self.text_of[t]) for t in x.tolist()])
                starts = ends - [len(self.text_of[t]) for t in x.tolist()]
                own: list[list[int]] = []
                for b in at:
                    if not valid[int(x[b - 1]), int(x[b])]:
                        lo = int(np.searchsorted(starts, starts[b] - reach, "right")) - 1
                        hi = int(np.searchsorted(ends, starts[b] + reach)) + 1
                        lo, hi = max(lo, 0), min(hi, len(x))
                        if own and lo <= own[-1][1]:
                            own[-1][1] = hi
                        else:
                            own.append([lo, hi])
                if own:
                    windows[w] = [(lo, hi, w[int(starts[lo]) : int(ends[hi - 1])]) for lo, hi in own]
            got = self._contract(t for own in windows.values() for _, _, t in own)
            doubt = {}
            for w, own in windows.items():
                parts, at, last, held = [], [], 0, 0
                for lo, hi, t in own:
                    new = np.frombuffer(got[t], np.int32)
                    parts += [ids[w][last:lo], new]
                    at.append(held + lo - last)
                    held += lo - last + len(new)
                    at.append(held)
                    last = hi
                parts.append(ids[w][last:])
                ids[w] = np.concatenate(parts)
                inner = [b for b in dict.fromkeys(at) if 0 < b < len(ids[w])]
                if inner:
                    doubt[w] = np.array(inner)
            reach *= 2
        return {w: x.tobytes() for w, x in ids.items()}

    def _merge(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of words that are no tokens themselves."""
        long = [w for w in dict.fromkeys(words) if len(w) > CHUNK]
        return self._contract(w for w in words if len(w) <= CHUNK) | (self._long(long) if long else {})

    def _learn(self, pieces: Iterable[str]) -> None:
        """Packed ids of pieces that the cache lacks. A piece is cut by the pattern on its own."""
        cut = {p: self.pattern.findall(p) if self.spaced else [p] for p in pieces}
        known: dict[str, bytes] = {}
        todo: dict[str, bytes] = {}
        young, old = self.words.young, self.words.old
        for tokens in cut.values():
            for t in tokens:
                if t not in known and t not in todo:
                    own = young.get(t) or old.get(t)
                    if own is None:
                        raw = t.encode("utf-8", "replace")
                        own = self.tokens.get(raw)
                        if own is None:
                            todo[t] = raw
                            continue
                    known[t] = own
        merged = self._merge(list(todo.values()))
        merged = {t: merged[raw] for t, raw in todo.items()}
        known.update(merged)
        # A word with another mark behind it is then known.
        self.words.put(merged)
        self.words.put({p: known[own[0]] if len(own) == 1 else b"".join([known[t] for t in own]) for p, own in cut.items() if p not in merged})

    def _cut(self, texts: list[str | None]) -> pa.ListArray:
        """Pieces of each text that concatenate to it."""
        if self.spaced:
            return split_at_spaces(texts)
        pieces = [[m.group() for m in self.pattern.finditer(t or "")] for t in texts]
        if any(sum(map(len, own)) != len(t or "") for own, t in zip(pieces, texts, strict=True)):
            raise ValueError("the pattern leaves out parts of a text")
        return strings(pieces, pa.list_(pa.large_string()))

    def _pieces(self, texts: list[str | None]) -> tuple[list[bytes], pa.Array, pa.Array]:
        """Packed ids of the different pieces, the number of each piece in order, and where each text's pieces begin."""
        cut = self._cut(texts)
        pieces = cut.values.dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        lacking = self.words.lacking(different)
        if lacking:
            self._learn(lacking)
        words = self.words.young
        return [words[p] for p in different], pieces.indices, cut.offsets

    def _segmented(self, texts: list[str | None], work) -> list[tuple[bytes, ...]]:
        """work(texts) -> tuples of bytes for each; a long text is handled in segments, whose results are joined."""
        if not self.spaced or all(t is None or len(t) <= SEGMENT for t in texts):
            return work(texts)
        out = []
        for t in texts:
            parts = [work([s])[0] for s in segments(t)] if t and len(t) > SEGMENT else work([t])
            out.append(tuple(b"".join(c) for c in zip(*parts, strict=True)))
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for a null or empty one."""
        def work(own: list[str | None]) -> list[tuple[bytes, ...]]:
            packed, numbers, starts = self._pieces(own)
            return list(zip(joined(packed, numbers, starts), strict=True))

        got = self._segmented(texts, work)
        return [np.frombuffer(x, np.int32) for (x,) in got]

    def _round_trip(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        packed, numbers, starts = self._pieces(texts)
        lacking = self.decoded.lacking(dict.fromkeys(packed))
        if lacking:
            self.decoded.put(dict(zip(lacking, self._decoded(lacking), strict=True)))
        decoded = self.decoded.young
        return list(zip(joined(packed, numbers, starts), joined([decoded[x] for x in packed], numbers, starts), strict=True))

    def round_trip(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids of each text and what they decode to; like pieces of ids are decoded once."""
        got = self._segmented(texts, self._round_trip)
        return [np.frombuffer(x, np.int32) for x, _ in got], [d for _, d in got]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of each list of ids."""
        return self._decoded([np.asarray(x, np.int32).tobytes() for x in ids])

    def _decoded(self, packed: list[bytes]) -> list[bytes]:
        """Bytes of packed ids. A query takes so many ids; a longer list is several rows whose bytes are joined."""
        out = [b""] * len(packed)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(packed):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + DECODED, "right")))
            if sizes[lo] > DECODED:
                own = packed[lo]
                out[lo] = b"".join([self._decode([own[k : k + 4 * DECODED]])[0] for k in range(0, len(own), 4 * DECODED)])
            else:
                out[lo:hi] = self._decode(packed[lo:hi])
            lo = hi
        return out

    def _decode(self, packed: list[bytes]) -> list[bytes]:
        out = [b""] * len(packed)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        ends = np.cumsum(sizes)
        rows = {
            "text": np.repeat(np.arange(len(packed), dtype=np.int32), sizes),
            "pos": (np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32),
            "id": np.frombuffer(b"".join(packed), np.int32),
        }
        got = self._run(DECODE, "id_rows", pa.table(rows))
        for k, s in zip(got.column("text").to_numpy().tolist(), got.column("bytes").to_numpy().tolist(), strict=True):
            out[k] = s.encode("latin-1")
        return out


def joined(values: list[bytes], numbers: pa.Array, starts: pa.Array) -> list[bytes]:
    """For each text the values with its numbers, one after the other."""
    each = pa.array(values, pa.large_binary()).take(numbers)
    return pc.binary_join(pa.ListArray.from_arrays(starts, each), pa.scalar(b"", each.type)).to_pylist()


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0] + [len(x) for x in arrays])
    return pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))


#: Fixed value: the pattern for which a text may be cut at single spaces first; texts of others are cut by the pattern alone.
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space between two characters that are no white space always begins a pre-token.
BREAK = re.compile(r"(?<=\S) (?=\S)")
#: A text with white space at an end, beside a space, or other than a space or a line feed, in RE2's words: not every space of it is such a one.
UNEVEN = r"\A[ \n]|[ \n]\z|  | \n|\n |[\t\v\f\r\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space, so no text that is even holds it.
MARK = "\x1f"


def strings(values: list, kind: pa.DataType) -> pa.Array:
    """An array of texts or of lists of texts; halves of surrogate pairs become question marks."""
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:
        plain = lambda t: t and t.encode("utf-8", "replace").decode()
        return pa.array([[plain(t) for t in v] if isinstance(v, list) else plain(v) for v in values], kind)


def split_at_spaces(texts: list[str | None]) -> pa.ListArray:
    """Pieces that concatenate to each text, cut where every pre-token of the pattern ends; a null text is an empty one."""
    column = pc.fill_null(strings(texts, pa.large_string()), "")
    uneven = pc.match_substring_regex(column, UNEVEN)
    cut = pc.split_pattern(pc.replace_substring(column.filter(pc.invert(uneven)), " ", MARK + " "), MARK)
    if len(cut) == len(texts):
        return cut
    rest = [BREAK.split(t) for t in column.filter(uneven).to_pylist()]
    rest = pa.array([[own[0], *[" " + p for p in own[1:]]] for own in rest], pa.list_(pa.large_string()))
    # The two parts in the order of the texts.
    return pa.concat_arrays([cut, rest]).take(np.argsort(np.argsort(uneven.to_numpy(zero_copy_only=False), kind="stable")))


def segments(text: str) -> Iterator[str]:
    """Parts of about SEGMENT characters, cut before a space that begins a pre-token; a part without one is longer."""
    lo = 0
    while len(text) - lo > SEGMENT:
        m = BREAK.search(text, lo + SEGMENT)
        if m is None:
            break
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


_codecs: dict[tuple[int, str, int], Codec] = {}


def codec(data: bytes, pattern: str, cache: int = CACHE) -> Codec:
    """This worker's codec for a rank file. cache: bytes in a generation of what it remembers."""
    key = (hash(data), pattern, cache)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, pattern, cache)
    return _codecs[key]


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes by Spark's reader, or from a local path."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def encode(docs: DataFrame, path: str, pattern: str, cache: int = CACHE, slice_bytes: int = 4 << 20) -> DataFrame:
    """docs (text, ...) -> the same columns and ids array<int>; a column ids is replaced.

    A null text has the ids of an empty one: none. A text of any length is encoded whole,
    repeated rows get equal ids, and no rows give none. cache and slice_bytes bound a
    worker's memory; they change its speed only.
    """
    docs = docs.drop("ids")
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data.value, pattern, cache)
        for batch in sliced(batches, "text", slice_bytes):
            yield batch.append_column("ids", lists_of(c.encode(batch.column("text").to_pylist())))

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())))


def round_trip(docs: DataFrame, path: str, pattern: str, cache: int = CACHE, slice_bytes: int = 4 << 20) -> DataFrame:
    """docs (text, ...) -> the same columns, ids array<int> and intact: whether the ids decode to the text's bytes.

    A null text counts as an empty one, a text of any length is encoded whole, repeated rows
    get equal ids, and no rows give none. Columns ids and intact are replaced.
    """
    docs = docs.drop("ids", "intact")
    data = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data.value, pattern, cache)
        for batch in sliced(batches, "text", slice_bytes):
            texts = batch.column("text").to_pylist()
            ids, decoded = c.round_trip(texts)
            same = [d == (t or "").encode() for t, d in zip(texts, decoded, strict=True)]
            yield batch.append_column("ids", lists_of(ids)).append_column("intact", pa.array(same, pa.bool_()))

    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType())).add("intact", BooleanType()))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows (ids, ...) -> the same columns and decoded binary; null ids are none, repeated rows decode alike, no rows give none."""
    rows = rows.drop("decoded")
    data = rows.sparkSession.sparkContext.broadcast(read_ranks(rows.sparkSession, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(data.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = c.decode([np.array(x or [], np.int32) for x in part.column("ids").to_pylist()])
                yield part.append_column("decoded", pa.array(got, pa.binary()))

    from pyspark.sql.types import BinaryType, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields]).add("decoded", BinaryType()))
