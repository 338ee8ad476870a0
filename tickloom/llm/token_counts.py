"""Token counts: batches encoded by a public tokenizer's own library, only lengths returned.

A text's count needs nothing but the text and the vocabulary, so there is no shuffle: an
Arrow function maps the column of texts to the column of lengths. Texts are cut where no
token crosses, so counts of the parts add up to the text's:

* under a word-splitting vocabulary (.json) before white space that follows other
  characters, and in long words between a letter and a digit and before a full-width
  punctuation mark that follows a letter; the string of an added token is never cut;
* under a .model at one space between other characters, which is consumed, as the library
  puts the same mark in front of the part that follows. A vocabulary with a piece that goes
  on after such a mark, or without that prefix, is not cut.

Parts come again and again, so a worker keeps the lengths of short ones (bounded), and the
library gets what is new, in batches of about ``BATCH`` bytes: as large for ten long parts
as for thousands of words. A run of one kind without such a place stays whole, so counts
are always the library's.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tickloom.llm.bpe import read_ranks
from tickloom.llm.common import trim

#: Bytes of a batch of the library, and characters of a text that are cut into parts at once.
BATCH, PIECE = 1 << 19, 1 << 20
#: Characters of a part that outlives its generation, and parts remembered in two generations.
SHORT, REMEMBERED = 48, 1_500_000
#: The white space of the vocabularies' patterns: Python's, but for four separators.
_SPACE, _OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
#: A part of a text under a word-splitting vocabulary.
WORD_PART = rf"{_SPACE}*{_OTHER}+|{_SPACE}+"
#: The same parts where every space follows another character or a space, as it mostly does, and what tells otherwise.
PLAIN_PART, NOT_PLAIN = " *[^ ]+| +", r"[^\S\x1c-\x1f ] "
ASCII_ODD = ("\n ", "\t ", "\r ", "\x0b ", "\x0c ")
#: Further places in a long part, and in all texts where white space comes first.
WORD_EDGE = rf"(?<={_OTHER})(?={_SPACE})|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=\p{{L}})(?=[、。，？；])"
#: One space between other characters: a cut of a .model takes it away.
SPACE_EDGE = r"(?<=[^\s▁]) (?=[^\s▁])"
MARK = "▁"


class Counter:
    """The lengths of texts under one vocabulary; cutting, remembering and packing by bytes."""

    def __init__(self, data: bytes, kind: str, batch: int = BATCH, piece: int = PIECE, remembered: int = REMEMBERED) -> None:
        import regex

        self.batch, self.piece, self.remembered = batch, piece, remembered
        self.kind, self.specials = kind, []
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        if kind == "json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(data.decode())
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.edge, plain, any_ = regex.compile(WORD_EDGE), re.compile(PLAIN_PART).findall, re.compile(WORD_PART).findall
            odd = re.compile(NOT_PLAIN).search
            self.parts = lambda text: any_(text) if (any(x in text for x in ASCII_ODD) if text.isascii() else odd(text)) else plain(text)
            self.spaced = [s for s in self.specials if re.search(r"\s", s)]
        elif kind == "model":
            from sentencepiece import SentencePieceProcessor

            self.tokenizer = SentencePieceProcessor(model_proto=data)
            pieces = [self.tokenizer.id_to_piece(i) for i in range(self.tokenizer.get_piece_size())]
            crossing = any(MARK in p.lstrip(MARK) for p in pieces)
            fronted = self.tokenizer.encode("a", out_type=str)[0].startswith(MARK)
            self.edge = regex.compile(SPACE_EDGE) if fronted and not crossing else None
            self.parts = re.compile(SPACE_EDGE).split if self.edge else lambda text: [text]
            self.spaced = []
        else:
            raise ValueError(f"no library for a vocabulary of kind {kind!r}: json or model")

    def lengths(self, texts: list[str]) -> list[int]:
        """The library's count of each text, in one call."""
        if self.kind == "json":
            return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return [len(e) for e in self.tokenizer.encode(texts, num_threads=1)]

    def segments(self, text: str) -> Iterator[str]:
        """Parts of a long text, each to the first edge behind ``piece`` characters."""
        start = 0
        while self.edge is not None and len(text) - start > self.piece:
            found = self.edge.search(text, start + self.piece)
            while found and self._inside(text, found.start()):
                found = self.edge.search(text, found.start() + 1)
            if not found:
                break
            yield text[start : found.start()]
            start = found.end()
        yield text[start:] if start else text

    def _inside(self, text: str, at: int) -> bool:
        """Whether an added token's string stands across this place."""
        return any(text.find(s, max(at - len(s) + 1, 0), at + len(s) - 1) >= 0 for s in self.specials)

    def _learn(self, parts: set[str]) -> dict[str, int]:
        """The lengths of these parts: the library's, in batches of about as many bytes."""
        found, packed, held = {}, [], 0
        for part in parts:
            size = len(part) if part.isascii() else len(part.encode())
            if packed and held + size > self.batch:
                found.update(zip(packed, self.lengths(packed), strict=True))
                packed, held = [], 0
            packed.append(part)
            held += size
        if packed:
            found.update(zip(packed, self.lengths(packed), strict=True))
        return found

    def _know(self, parts: set[str]) -> None:
        """Bring the lengths of these parts into the younger of two generations of what is remembered."""
        if 2 * len(self.young) > self.remembered:
            self.old, self.young = {p: n for p, n in self.young.items() if len(p) <= SHORT}, {}
        new = parts.difference(self.young)
        again = new.intersection(self.old)
        self.young.update((p, self.old[p]) for p in again)
        self.young.update(self._learn(new - again))

    def count(self, texts: Iterable[str | None]) -> list[int]:
        """Token counts of texts; None counts as empty."""
        counts, waiting, held = [], [], 0

        def settle() -> None:
            self._know(set(chain.from_iterable(parts for _, parts in waiting)))
            length = self.young.__getitem__
            for owner, parts in waiting:
                counts[owner] += sum(map(length, parts))
            waiting.clear()

        for k, text in enumerate(texts):
            counts.append(0)
            if not text:
                continue
            whole = any(s in text for s in self.spaced)
            for segment in (text,) if whole else self.segments(text):
                waiting.append((k, [segment] if whole else self.parts(segment)))
                held += len(segment)
                if held > self.piece:
                    settle()
                    held = 0
        settle()
        return counts


_OPEN: dict[tuple, Counter] = {}


def opened(data: bytes, kind: str) -> Counter:
    """The counter of this worker: a vocabulary is read once in each Python worker."""
    key = (kind, len(data), hash(data))
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Counter(data, kind)
    return _OPEN[key]


def token_count(spark: SparkSession, path: str) -> Callable[[Column | str], Column]:
    """A function from a column of texts to their token counts under the vocabulary at path (.json or .model).

    Without begin, end or added special tokens, truncation or padding; the strings of
    special tokens inside a text count as the library's default has it. Null and empty
    texts have 0 tokens; the length of a text is unbounded; rows do not depend on each
    other, so repeated rows get equal counts and no rows give none.
    """
    kind = path.rsplit(".", 1)[-1]
    data = spark.sparkContext.broadcast(read_ranks(spark, path))

    @arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = opened(data.value, kind)
        for texts in batches:
            yield pa.array(counter.count(t.as_py() for t in texts), pa.int64())
        trim()

    return count


def count_tokens(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens, and over_limit (more than ``limit`` tokens).

    Columns of these names are replaced; all others stay as they are, whatever their
    names. A null text has no bytes and no tokens.
    """
    ours = ("n_bytes", "n_tokens", "over_limit")
    count = token_count(docs.sparkSession, path)
    column = F.col("`" + text.replace("`", "``") + "`")
    others = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c.lower() not in ours]
    counted = docs.select(*others, F.coalesce(F.octet_length(column), F.lit(0)).cast("long").alias("n_bytes"), count(column).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


