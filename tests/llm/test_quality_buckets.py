"""Quality buckets follow the corpus."""
import numpy as np

from ranksmith.llm import quality

SF = "/root/testdata"


def test_bits_follow_the_number_of_ngrams():
    assert [quality.bits_for(n) for n in (0, 80_000, 1 << 20, 10 << 20, 1 << 40)] == [12, 12, 16, 19, 22]


def test_pairs_lie_apart_and_buckets_nest():
    words = b"some words of a text and of a text".split()
    fine, coarse = (quality.buckets(words, quality._cache(), bits) for bits in (22, 12))
    assert (fine >> 10 == coarse).all()
    assert (fine[:9] < 1 << 21).all() and (fine[9:] >= 1 << 21).all()


def test_more_ngrams_more_buckets_and_labels_kept_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    ratios = quality.fit(docs, quality.trusted_ids(labels))
    assert len(ratios) == 1 << 15
    got = quality.score(docs, ratios).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.99
    assert np.mean([r.kept for r in got if r.quality == 0]) < 0.1


def test_slices_are_texts_one_by_one():
    texts = [b"", b"one", b"a b a b a b", "naïve x_1 don't stop-gap 12,5 日本語。".encode(), b"\n\n", b"same line\nsame line\nother"] * 3
    some = quality.Slice(texts)
    at, text = some.buckets(22)
    cache = quality._cache()
    for i, t in enumerate(texts):
        assert sorted(at[text == i]) == sorted(quality.buckets(t.split(), cache, 22))
    assert some.repeated() == [quality.base_counts(t)[4] for t in texts]
    assert quality.Slice([]).repeated() == []


def brute_ratios(docs: dict, good: set, bits: int) -> tuple[dict, float]:
    """Ratios by hashing anew and dictionaries."""
    import math
    import regex
    import xxhash

    def grams(t):
        h = [int.from_bytes(xxhash.xxh64_digest(x.encode()), "little") for w in t.encode().split() for x in regex.findall(r"\w+|[^\w\s]+", w.decode())]
        mix, word = 0x9E3779B97F4A7C15, (1 << 64) - 1
        pairs = [(((a * mix & word) + b & word) * mix & word) for a, b in zip(h, h[1:])]
        return [x >> 65 - bits for x in h] + [(x >> 65 - bits) + (1 << bits - 1) for x in pairs]

    raw, own = {}, {}
    for i, t in docs.items():
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            if i in good:
                own[g] = own.get(g, 0) + 1
    share = lambda n, of: math.log((n + 1) / (of + (1 << bits)))
    n_raw, n_own = sum(raw.values()), sum(own.values())
    score = {}
    for i, t in docs.items():
        gs = [share(own.get(g, 0), n_own) - share(raw[g], n_raw) for g in grams(t)]
        score[i] = sum(gs) / len(gs) if gs else 0.0
    return score


def test_scores_of_a_table_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    trusted = quality.trusted_ids(labels)
    ratios = quality.fit(docs, trusted)
    want = brute_ratios({r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id for r in trusted.collect()}, len(ratios).bit_length() - 1)
    for r in quality.score(docs, ratios).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-5
