"""Secret scans: keywords first, anchored patterns near hits, then embedded checksums.

An Aho-Corasick automaton runs once over each text and reports where a keyword
begins. Only there the patterns of its kind are tried, anchored, left to right and
without overlap. Runs of hexadecimal digits have no keyword; they are found by one
linear pattern. Kinds with an embedded checksum count only if it holds:

    github  gh[pousr]_ and 36 letters or digits, the last 6 the base-62 CRC-32 of the 30 before
    npm     npm_ and 36 letters or digits, likewise
    jwt     three base64url parts whose first is a JSON object that names an alg

Every text is scanned by itself, whole; the automaton has a fixed size.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tickloom.llm.common import sliced

#: Kinds in the order of the contract, then those with a checksum.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PART = re.compile(r"[A-Za-z0-9_-]*")

#: Keywords in lower case and the kind whose pattern is tried at a hit.
KEYWORDS = {
    "password": 0,
    "passwd": 0,
    "secret": 0,
    "token": 0,
    "apikey": 0,
    "api_key": 0,
    "akia": 1,
    "ghp_": 3,
    "gho_": 3,
    "ghu_": 3,
    "ghs_": 3,
    "ghr_": 3,
    "npm_": 4,
    "eyj": 5,
}
PATTERNS = (ASSIGN, ACCESS, HEX, GITHUB, NPM, JWT)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_holds(token: str) -> bool:
    """Whether the last 6 characters are the base-62 CRC-32 of the 30 after the prefix."""
    body, check = token[4:-6], token[-6:]
    n = zlib.crc32(body.encode())
    digits = ""
    for _ in range(6):
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits == check


def jwt_holds(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        got = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(got, dict) and "alg" in got


def _valid(kind: int, m: re.Match) -> bool:
    if kind == 0:
        return len(m.group(2)) >= 6
    if kind == 1:
        return len(m.group()) >= 20
    if kind in (3, 4):
        return crc_holds(m.group())
    return kind == 2 or jwt_holds(m.group())


def _lower(text: str) -> str:
    """ASCII letters in lower case, every character at its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)


class Scanner:
    def __init__(self) -> None:
        import ahocorasick

        self.hits = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            self.hits.add_word(word, (len(word), kind))
        self.hits.make_automaton()

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind, end) by start, then kind; code points, end exclusive."""
        if not text:
            return []
        found = []
        begin = sorted({(end - n + 1, kind) for end, (n, kind) in self.hits.iter(_lower(text))})
        free = [0] * len(KINDS)
        for start, kind in begin:
            if start < free[kind]:
                continue
            if m := PATTERNS[kind].match(text, start):
                free[kind] = m.end()
                if _valid(kind, m):
                    found.append((start, kind, m.end()))
            elif kind == 5 and text.startswith("eyJ", start):
                # What is missing stands behind the first part, so no later start within it can match.
                free[kind] = PART.match(text, start).end()
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(found)


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("kind", StringType()), StructField("end", IntegerType())]))


def scan(docs: DataFrame) -> DataFrame:
    """docs (text, ...) -> the same columns and spans array<struct<start, kind, end>>; a column spans is replaced.

    A null or empty text has no spans, no rows give none. Repeated rows get alike spans.
    Time is in proportion to a text's length, whatever it repeats.
    """
    docs = docs.drop("spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Scanner()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for batch in sliced(batches, "text"):
            spans = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in f(t)] for t in batch.column("text").to_pylist()]
            yield batch.append_column("spans", pa.array(spans, kind))

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("spans", SPANS))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
