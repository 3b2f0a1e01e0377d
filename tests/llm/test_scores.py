"""Toxicity, quality rules and language identification."""
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from ranksmith.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


def held(i, mod, rest):
    return i is not None and zlib.crc32(str(i).encode()) % mod == rest


# --- toxicity ---------------------------------------------------------------

def test_noisy_or_by_definition():
    m = toxicity.Model({"bad": 3.0, "bad*": 1.0, "worse": 5.0}, -4.0)
    text = b"A bad day. Worse still!\nbadly done ### fine\nnothing"
    p = lambda z: 1 / (1 + np.exp(-z))
    m2 = toxicity.Model({"bad": 3.0, "worse": 5.0}, -4.0)
    assert m2.score(text) == pytest.approx(1 - (1 - p(-1)) * (1 - p(1)) * (1 - p(-4)) ** 2)
    assert [text[a:b] for a, b, _ in m2.offending(text, 0.5)] == [b"Worse still!"]
    assert m.score(b"") == m.score(b" \n") == pytest.approx(p(-4))
    assert [text[a:b] for a, b in toxicity.sentences(text)] == [b"A bad day.", b"Worse still!", b"badly done ### fine", b"nothing"]


def test_gradient_learns_from_document_labels_alone():
    rng = random.Random(0)
    y, plain, words, sents = [], [], [], []
    for _ in range(300):
        toxic = rng.random() < 0.3
        bags = [rng.sample(range(2, 8), 2) for _ in range(5)]
        if toxic:
            bags[rng.randrange(5)].append(0)
        y.append(int(toxic)), plain.append(3), words.append(sum(bags, []))
        sents.append([k for k, bag in enumerate(bags) for _ in bag])
    w, b = toxicity.noisy_or_fit(y, plain, words, sents, 8)
    assert w[0] > 3 and np.abs(w[2:]).max() < 1 and b < -2


def docs_and_labels(spark, n=240):
    rng = random.Random(4)
    words = [f"w{a}{b}" for a, b in itertools.product("abcdefgh", repeat=2)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(6)) + "." for _ in range(8)]
        toxic = i % 4 == 0
        if toxic:
            sentences[rng.randrange(8)] = "you vile" + rng.choice(["st", "r", "ness"]) + " creature."
        rows.append((i, " ".join(sentences), "x"))
        labels.append((i, int(toxic), 1))
    return (spark.createDataFrame(rows, "doc_id long, text string, score string"),
            spark.createDataFrame(labels, "doc_id long, toxic int, text int"))


def test_toxic_held_out(spark):
    docs, labels = docs_and_labels(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    test = [i for i in got if held(i, 5, 0)]
    assert len(test) > 30 and all((got[i] >= 0.5) == (i % 4 == 0) for i in test)
    found = toxicity.offending_sentences(docs, model).collect()
    assert {r.doc_id for r in found} == set(range(0, 240, 4)) and all("vile" in r.sentence for r in found)
    assert toxicity.not_toxic(docs, model).count() == 180
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    other = toxicity.fit(docs, flipped)  # held-out labels change nothing
    assert other.weights == model.weights and other.bias == model.bias


def test_toxic_odd_rows(spark, odd_docs, no_docs):
    docs, labels = docs_and_labels(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.not_toxic(odd_docs, model).schema == odd_docs.schema
    assert toxicity.not_toxic(odd_docs, model).count() == odd_docs.count()
    assert toxicity.score(no_docs, model).count() == 0 and toxicity.offending_sentences(no_docs, model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("cast(null as long) doc_id", "toxic")):
        nothing = toxicity.fit(docs, few)
        assert {r.score for r in toxicity.score(docs.limit(5), nothing).collect()} == {0.0}


def test_toxic_accuracy_on_given_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(toxicity.held_out()).collect()
    wrong = Counter((r.toxic, r.score >= 0.5) for r in got)
    assert wrong[0, True] <= 1 and wrong[1, True] >= wrong[1, False]


# --- quality ----------------------------------------------------------------

def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))


@pytest.mark.parametrize("text", ["", "a", "a b a b a b", "a a a a", "x y z\nx y z\n\n \nx y z", "é# <b> 日本|語\n#", "a b c a b d a b c",
                                  "\x0ba\x0cb\x1cc", "q\r\nq\r\nq"])
def test_base_counts(text):
    assert quality.base_counts(text.encode()) == brute_counts(text)


def test_base_counts_random():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "#", "  ", "日"]) for _ in range(rng.randint(0, 80)))
        assert quality.base_counts(text.encode()) == brute_counts(text)


def test_ratio_by_brute_force(spark, odd_docs):
    trusted = spark.createDataFrame([(0,), (5,), (7,), (None,)], "doc_id long")
    got = quality.fit(odd_docs, trusted)
    cache, raw, good = quality._cache(), *np.full((2, 1 << quality.BUCKET_BITS), quality.PRIOR)
    for r in odd_docs.collect():
        for b in quality.buckets((r.text or "").encode().split(), cache):
            raw[b] += 1
            good[b] += r.doc_id in (0, 5, 7)
    assert got == pytest.approx(np.log(good / good.sum()) - np.log(raw / raw.sum()))
    rows = quality.score(odd_docs, got).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)


def test_quality_empty_and_untrusted(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    assert [r.doc_id for r in quality.trusted_ids(labels).collect()] == [5]
    flat = quality.fit(no_docs, quality.trusted_ids(labels))
    assert not flat.any() and quality.score(no_docs, flat).count() == 0
    assert {r.score for r in quality.score(odd_docs, flat).collect()} == {0.0}


def test_quality_tells_labels_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.fit(docs, quality.trusted_ids(labels))).join(labels, "doc_id").where("n_words >= 50").collect()
    assert np.mean([r.kept for r in got if r.quality == 1 and not r.base_failed]) > 0.99
    assert np.mean([r.kept for r in got if r.quality == 0]) < 0.1


# --- language identification ------------------------------------------------

SMALL = ["a", "b", "ab", "ba", "▁", "▁a", "abc"]


def segmentations(word):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in SMALL:
            for rest in segmentations(word[n:]):
                yield [SMALL.index(word[:n]), *rest]
        elif n == 1:
            for rest in segmentations(word[1:]):
                yield [len(SMALL), *rest]


def small_probs():
    return np.vstack([np.random.default_rng(0).random((len(SMALL), 2)) * 0.2, [[1e-7, 1e-7]], [[0, 0]]])


@pytest.mark.parametrize("word", ["▁", "▁a", "▁abcab", "▁zab", "▁abababa", "▁zzz"])
def test_forward_sums_all_segmentations(word):
    probs, trie = small_probs(), langid.Trie(SMALL)
    want = np.log([sum(np.prod(probs[s, k]) for s in segmentations(word)) for k in range(2)])
    assert langid.forward_logs(*trie.lattice([word]), probs)[0] == pytest.approx(want)
    weights = [(s, np.prod(probs[s, 0])) for s in segmentations(word)]
    uses = np.zeros(len(probs))
    for s, p in weights:
        for i in s:
            uses[i] += p / sum(p for _, p in weights)
    got = langid.expected_uses(*trie.lattice([word, "▁a"]), probs[:, 0], np.array([2.0, 0.0]))
    assert got == pytest.approx(2 * uses)


def test_forward_stays_in_range():
    probs, trie = small_probs(), langid.Trie(SMALL)
    long = "▁" + "ab" * 4000
    got = langid.forward_logs(*trie.lattice(["▁a", long, "▁" + "z" * 500]), probs)
    assert np.isfinite(got).all() and got[1][0] < -1000
    one = langid.forward_logs(*trie.lattice([long]), probs)
    assert got[1] == pytest.approx(one[0])


def test_languages_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs, PIECES)
    assert set(model.languages) <= {"en", "de", "fr"}
    got = langid.predict(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    text = {r.doc_id: r.text for r in odd_docs.collect()}
    for r in got:
        no_letter = not re.search(r"[^\W\d_]", text[r.doc_id] or "") if r.doc_id is not None else None
        if no_letter is not None:
            assert (r.lang_pred == "und") == no_letter and 0 <= r.score <= 1
    none = langid.fit(no_docs, PIECES)
    assert {r.lang_pred for r in langid.predict(odd_docs, none).collect()} == {"und"}
    assert langid.predict(no_docs, model).count() == 0


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = (langid.predict(docs, langid.fit(docs, PIECES)).withColumnRenamed("lang_pred", "said")
           .join(docs, "doc_id").where(langid.held_out()).collect())
    assert np.mean([r.said == r.lang for r in got]) > 0.98
