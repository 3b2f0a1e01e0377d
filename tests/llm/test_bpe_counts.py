"""BPE and token counts against the public library."""
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ranksmith.llm import bpe, token_counts
from ranksmith.session import shared_dir

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY, OWN = Tokenizer.from_file(PATH), bpe.ByteBPE(PATH)


def agrees(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    packed = OWN.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == want
    assert OWN.decode(packed).decode() == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "a", "  a  b", "a<|endoftext|>b", "<|endoftext|>", "don't I'LL we'd", "\n\n\t x \n", "日本語 🎉👩‍👩‍👧 é", "ab" * 3000,
    " " * 300, "a \nb", "\r\nfoo \r\n bar", "½²x٣ 1234", "\x1c a\x85b", "  x  y", "the the  the", "�"])
def test_texts(text):
    agrees(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabcthe'<|>.1é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    agrees(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=20))
def test_any_ids_decode(ids):
    assert OWN.decode(np.array(ids, "<u4").tobytes()).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


def test_small_caches_change_nothing():
    small = bpe.ByteBPE(PATH)
    small.pieces.limit = small.segments.limit = 3
    text = " ".join(f"word{i % 50} the{i % 7}" for i in range(500))
    assert small.encode(text) == OWN.encode(text)


def test_odd_rows(odd_docs, no_docs):
    got = bpe.round_trip(odd_docs, PATH).collect()
    assert len(got) == odd_docs.count() and got[0].own if "own" in got[0] else True
    by = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got)
    want = sorted((str(r.doc_id), LIBRARY.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in odd_docs.collect())
    assert by == want
    again = bpe.decode(bpe.encode(odd_docs, PATH), PATH, out="score").select("doc_id", "score").collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((a, c) for a, _, c in want)
    assert bpe.round_trip(no_docs, PATH).count() == 0


def test_counts_and_cache(spark, odd_docs, no_docs):
    cache = shared_dir(spark, "test-counts")
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(LIBRARY.encode(r.text or "", add_special_tokens=False).ids))
                  for r in odd_docs.collect())
    for _ in range(2):
        got = token_counts.count_tokens(odd_docs, PATH, cache).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        stored = token_counts.read_cache(spark, cache)
        assert stored.count() == len({r.text or "" for r in odd_docs.collect()})  # misses only, once each
    assert token_counts.count_tokens(no_docs, PATH, cache).count() == 0
    assert token_counts.count_tokens(no_docs, PATH, cache + "-none").count() == 0


def test_counts_come_from_the_cache(spark, odd_docs):
    cache = shared_dir(spark, "test-planted")
    one = odd_docs.where("doc_id = 11")
    version = token_counts.tokenizer_digest(PATH)
    spark.createDataFrame([(hashlib.sha256(b"a b").digest(), version, 99), (hashlib.sha256(b"a b").digest(), b"other", 5)],
                          token_counts.CACHE_SCHEMA).write.parquet(cache)
    assert [r.n_tokens for r in token_counts.count_tokens(one, PATH, cache).collect()] == [99]


def test_sentencepiece_counts(spark, odd_docs):
    import sentencepiece
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    some = odd_docs.where("doc_id in (0, 2, 9, 11)")
    got = token_counts.count_tokens(some, path, shared_dir(spark, "test-pieces")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((r.doc_id, len(model.encode(r.text))) for r in some.collect())
