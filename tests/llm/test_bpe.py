from __future__ import annotations

import hashlib
import random

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from casdelta.llm import bpe
from casdelta.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    enc = bpe.encoder(PATH)
    assert enc.encode(text) == ids
    assert enc.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["ΑΣΣΑΣ Σ", "İstanbul ÅÅ \x1ca\x1d b", "hi <|endoftext|>the <|startoftext|>X<|endoftext|", "don't I'll 've12345", "日本語 👩‍👩‍👧", "", " ", "a" * 3000, "1" * 300, "ＡＢＣ ½ ﬁ ß", "é x́"])
def test_like_the_library(library, text):
    same(library, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    library = Tokenizer.from_file(PATH)
    same(library, text)


def test_full_memory_is_emptied(library):
    enc = bpe.Encoder(PATH, max_pieces=3)
    enc.trie.most = 2
    for text in ("alpha beta gamma delta", "beta gamma epsilon zeta", "beta <|endoftext|> eta", "theta", "beta iota"):
        assert enc.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert len(enc.pieces) < 10 and len(enc.trie.fits) < 40


def test_seam_like_plain_merging():
    v = bpe.encoder(PATH).vocab
    trie = bpe.PrefixTrie(v)
    draw = random.Random(5)
    inner, every, merged = list(v.inner.values()), list(v.ids.values()), list(v.parts)
    for n in range(6000):
        left = draw.choice(inner)
        right = draw.choice(every) if n % 2 else v.parts[draw.choice(merged)][1]
        assert trie.compatible(left, right) == (v.merge(v.symbols(left) + v.symbols(right)) == [v.text[left], v.text[right]])


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op7_bpe"](spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_odd_rows(odd, none):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    want = sorted((str(r["doc_id"]), ids := library.encode(r["text"] or "", add_special_tokens=False).ids, library.decode(ids, skip_special_tokens=False)) for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in bpe.encode_decode(odd, PATH).collect()) == want
    assert bpe.encode_decode(none, PATH).count() == 0
