"""Token counts equal each library's own, whatever is cut, packed or remembered."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tickloom.llm import queries, token_counts

ALPHABET = "ab's \n\t  é1!漢。、,字😀\x1c\x85\xa0▁ Σσ̀x9 "
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    return lambda x: len(p.encode(x or ""))


def texts():
    rng = random.Random(13)
    some = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 200))) for _ in range(1500)]
    return [*some, None, "", " ", "x" * 20_000, "ab12" * 3_000, "漢字。" * 2_000, "<|endoftext|>".join(["ab cd" * 10] * 5), "x<|endoftext|> y " * 30, "<|startoftext|>1a" * 40, "a\n b  c\t d \x1c e"]


@pytest.mark.parametrize("name", FILES)
def test_as_the_library(spark, sf, name):
    rows = texts() + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    data, want = open(public_tokenizers.path(name), "rb").read(), list(map(library(name), rows))
    kind = name.rsplit(".", 1)[-1]
    assert token_counts.Counter(data, kind).count(rows) == want
    # Texts in many segments, batches of few parts, and a memory that forgets at once.
    tight = token_counts.Counter(data, kind, batch=500, piece=30, remembered=50)
    assert tight.count(rows) == want
    assert tight.edge is not None and len(list(tight.segments("some words " * 40))) > 10


def test_an_added_token_is_never_cut():
    c = token_counts.Counter(open(public_tokenizers.path(FILES[0]), "rb").read(), "json", piece=10)
    c.specials = ["ab 12cd"]
    cut = list(c.segments("xxxxxxxxxab 12cd yyyyy zz ab 12cd"))
    assert "".join(cut) == "xxxxxxxxxab 12cd yyyyy zz ab 12cd" and all("ab 12cd" in p for p in cut if "ab" in p)
    with pytest.raises(ValueError):
        token_counts.Counter(b"", "txt")


def test_odd_rows_and_names(spark):
    rows = [(k, t, t, "mine") for k, t in enumerate([None, "", "a b", "a b", "x" * 100_000, "é😀 " * 500])] + [(None, None, "z", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd``na.me` string, n_tokens string")
    out = token_counts.count_tokens(docs, public_tokenizers.path(FILES[0]), limit=2)
    assert out.columns == ["doc_id", "text", "odd`na.me", "n_bytes", "n_tokens", "over_limit"]
    want = library(FILES[0])
    for r in out.collect():
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((r["text"] or "").encode()), want(r["text"]), want(r["text"]) > 2)
    other = token_counts.count_tokens(docs, public_tokenizers.path(FILES[0]), limit=2, text="odd`na.me")
    assert other.filter("doc_id is null").first()["n_tokens"] == want("z")
    assert token_counts.count_tokens(docs.limit(0), public_tokenizers.path(FILES[0]), limit=2).count() == 0
    count = token_counts.token_count(spark, public_tokenizers.path("piece_bpe_32k.model"))
    assert docs.select(count("text").alias("n")).agg(F.sum("n")).first()[0] == sum(map(library("piece_bpe_32k.model"), [r[1] for r in rows]))


def test_query_over_the_whole_table(spark):
    d = "/root/testdata/sf0.01"
    want, docs = library(FILES[0]), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.QUERIES["op13_token_counts"](spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        n = want(docs[r["doc_id"]])
        assert r.asDict() == {"doc_id": r["doc_id"], "n_bytes": len((docs[r["doc_id"]] or "").encode()), "n_tokens": n, "over_limit": n > 1024}
