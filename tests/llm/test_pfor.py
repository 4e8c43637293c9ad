import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import pfor, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 40), max_size=700), st.sampled_from([8, 128]), st.sampled_from([0.5, 0.9, 1.0]))
def test_round_trip(values, block, percentile):
    v = np.array(values, "<u4")
    s = pfor.Shard(pfor.encode_shard([None, 7], [len(v), 0], v, block, percentile))
    assert (s.ids() == v).all() and s.doc_ids == [None, 7] and s.lengths.tolist() == [len(v), 0]
    assert (s.ids(100, 333) == v[100:333]).all()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab .,\n\t\x01é'1_-\xa0　")), max_size=40))
def test_cuts_give_the_tokenizers_ids(text):
    e = pfor.encoder(PATH)
    assert e.encode([text]) == e._whole([text])


_ODD = "a a b . , \n \t \x01 \x02 \x1c é ' 1 _ - \x85 \xa0 \u180e \u200b \u2028 \u3000 \ufeff “ ½ ① \u0301 中 😀 \r <|endoftext|>".split(" ") + [" ", " the"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_ODD), max_size=30).map("".join), max_size=6), st.sampled_from([7, 1 << 20]), st.sampled_from([300, 1 << 20]))
def test_texts_together_give_the_tokenizers_ids(texts, slice_size, cache):
    e = pfor.encoder(PATH)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(pfor, "SLICE", slice_size)
        m.setattr(pfor, "CACHE_BYTES", cache)
        assert e.encode(texts) == e._whole(texts)


class Counting:
    """A tokenizer that counts the characters that it is given."""

    def __init__(self, tok):
        self.tok, self.chars = tok, 0

    def encode_batch_fast(self, texts, **how):
        self.chars += sum(map(len, texts))
        return self.tok.encode_batch_fast(texts, **how)


def test_words_are_encoded_once(monkeypatch):
    """Also in texts with runs of white space, and the words that repeat also after the store was full."""
    e = pfor.WordEncoder(PATH)
    e.tok = Counting(e.tok)
    often = [f"one two  \n\n“three”. \tfour ({i % 7})  \n" * 100 for i in range(50)]
    whole = e._whole(often)
    e.tok.chars = 0
    assert e.encode(often) == whole and e.tok.chars < 500
    monkeypatch.setattr(pfor, "CACHE_BYTES", 20_000)
    for k in range(20):
        e.encode([*often, " ".join(f"w{k}x{i}" for i in range(100))])
    e.tok.chars = 0
    assert e.encode(often) == whole and e.tok.chars == 0 and e.held <= 40_000


def ordered(docs):
    text = F.coalesce("text", F.lit(""))
    return [(r[0], r[1]) for r in docs.select("doc_id", text.alias("t")).orderBy("doc_id", F.xxhash64("t"), "t").collect()]


def held(found, docs):
    """The result against the tokenizers library, document by document."""
    t, start = Tokenizer.from_file(PATH), 0
    for r, (d, x) in zip(found.orderBy("start").collect(), ordered(docs), strict=True):
        ids = [*t.encode(x, add_special_tokens=False).ids, 0]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (d, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_documents(docs_of, odd_rows):
    docs = docs_of([*odd_rows, (7, "a <|endoftext|> b"), (8, "<|endoftext|>"), (None, None)])
    extra = docs.withColumn("part", F.lit(1)).withColumn("payload", F.lit("x")).withColumn("n_tokens", F.lit(0))
    held(pfor.token_documents(extra, PATH, shard_tokens=16), docs)
    assert pfor.token_documents(docs.limit(0), PATH).isEmpty()


def test_stretches_of_a_long_text(monkeypatch):
    e = pfor.WordEncoder(PATH)
    text = "é " + "ab cd. ef, g\n" * 5_000 + "  two" + "x" * 3_000
    whole = e._whole([text, text[:60_000]])
    monkeypatch.setattr(pfor, "SLICE", 1_000)
    monkeypatch.setattr(pfor, "CACHE_BYTES", 200)
    assert e.encode([text, text[:60_000]]) == whole


def test_query_on_documents(spark, small):
    held(queries.op1_pfor_tokens(spark, small), queries.table(spark, small, "documents"))
