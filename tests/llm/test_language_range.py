"""Language identification of long letter runs, with the production vocabulary."""
import numpy as np
import public_tokenizers
import pytest

from ranksmith.llm import langid

PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))
RUNS = [*range(44, 81, 4), 200, 1000, 5000]
ENGLISH = "the cat sat on the mat and looked at the other house with its garden"
GERMAN = "die katze sitzt auf der matte und sieht das andere haus mit dem garten an"


def unknown_letter():
    pieces = langid.pieces_of(PIECES)
    known = {c for p in pieces for c in p}
    return next(chr(c) for c in range(0x13A0, 0x1400) if chr(c).lower() == chr(c) and chr(c).isalpha() and chr(c) not in known)


@pytest.mark.parametrize("n", RUNS)
def test_sums_of_unknown_letters(n):
    pieces = sorted(langid.pieces_of(PIECES))
    trie, probs = langid.Trie(pieces), np.full((len(pieces) + 2, 2), 1.0 / len(pieces))
    probs[-2], probs[-1] = langid.UNKNOWN, 0.0
    at = trie.lattice([langid.MARK + unknown_letter() * n, langid.MARK + "the"])
    mark = np.log(1.0 / len(pieces) if langid.MARK in pieces else langid.UNKNOWN)
    assert langid.forward_logs(*at, probs)[0] == pytest.approx(mark + n * np.log(langid.UNKNOWN))
    uses = langid.expected_uses(*at, probs[:, 0], np.array([3.0, 0.0]))
    assert uses[-2] == pytest.approx(3 * (n + (langid.MARK not in pieces)))
    assert uses[:-2].sum() == pytest.approx(3 * (langid.MARK in pieces))


def test_long_known_words_are_learnt_from():
    pieces = sorted(langid.pieces_of(PIECES))
    trie, probs = langid.Trie(pieces), np.full(len(pieces) + 2, 1.0 / len(pieces))
    probs[-2], probs[-1] = langid.UNKNOWN, 0.0
    lengths, grid = trie.lattice([langid.MARK + "qxz" * 400])
    uses = langid.expected_uses(lengths, grid, probs, np.array([1.0]))
    # Each character is covered once.
    assert sum(u * len(p) for u, p in zip(uses, [*pieces, "?"])) == pytest.approx(1201)


@pytest.mark.parametrize("n", [44, 70, 5000])
def test_odd_run_leaves_languages_alone(spark, n):
    run = unknown_letter() * n
    rows = [(i, f"{t} {run if i % 2 else ''}", g) for i in range(30) for t, g in ((ENGLISH, "en"), (GERMAN, "de"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = langid.fit(docs, PIECES)
    assert np.isfinite(model.probs).all()
    got = model.ready().predict([f"{ENGLISH} {run}".encode(), f"{GERMAN} {run}".encode()])
    assert [g for g, _ in got] == ["en", "de"] and all(0.99 < s <= 1 for _, s in got)


def test_lattice_by_substrings():
    rng = np.random.default_rng(1)
    pieces = sorted({"".join(rng.choice(list("abcé"), rng.integers(1, 5))) for _ in range(60)})
    trie = langid.Trie(pieces)
    words = ["".join(rng.choice(list("abcéz"), rng.integers(1, 40))) for _ in range(100)]
    lengths, grid = trie.lattice(words)
    assert lengths.tolist() == [len(w) for w in words]
    for w, word in enumerate(words):
        for stop in range(1, len(word) + 1):
            for k in range(1, trie.longest + 1):
                known = k <= stop and word[stop - k:stop] in pieces
                want = pieces.index(word[stop - k:stop]) if known else len(pieces) + (k > 1)
                assert grid[w, stop, k] == want


def test_long_runs_piecemeal():
    rng = np.random.default_rng(2)
    pieces = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 6))) for _ in range(80)})
    trie, probs = langid.Trie(pieces), rng.random((len(pieces) + 2, 3))
    probs[-2], probs[-1] = 1e-7, 0.0
    for word in ["abc" * 50 + "zz" + "ca" * 40, "a", "z" * 300]:
        whole = langid.forward_logs(*trie.lattice([word]), probs)[0]
        assert langid.long_logs(trie, word, probs, chunk=7) == pytest.approx(whole)
