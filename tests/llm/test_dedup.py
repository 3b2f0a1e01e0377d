"""Exact and near deduplication against brute force."""
import random
import re
from collections import defaultdict

import xxhash
from pyspark.sql import functions as F

from ranksmith.llm import exact_dedup, simhash
from ranksmith.llm.common import row_digest

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r.text or "")].append(r)
    out = []
    for rs in groups.values():
        best = min(rs, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        out += [(str(r.doc_id), str(best.doc_id), len(rs)) for r in rs]
    return sorted(out)


def groups_of(df, **how):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in exact_dedup.exact_groups(df, **how).collect())


def test_exact_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    assert groups_of(odd_docs) == brute_groups(rows)
    kept = exact_dedup.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.schema == odd_docs.schema
    assert kept.count() == len({SPACE.sub("", r.text or "") for r in rows})
    assert groups_of(no_docs) == [] and exact_dedup.deduplicated(no_docs).count() == 0


def test_digest_collisions_are_told_apart(spark):
    texts = ["abc", "a b c", "abd", "xyz", "xy z", "", None, "q" * 10_000, "q" * 9_999 + "r", "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weak = lambda c: F.unhex(F.substring(F.md5(c.cast("binary")), 1, 1))  # noqa: E731  16 digests
    none = lambda c: F.lit("00").cast("binary")  # noqa: E731  one digest
    for digest in (weak, none):
        assert groups_of(df, digest=digest) == brute_groups(df.collect())


def test_chunks_join_to_the_text_and_follow_content(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnop0123é日") for _ in range(60_000))
    df = spark.createDataFrame([(text,), ("zz" + text,), ("日" * 9000,), ("",)], "t string")
    cut = [r[0] for r in df.select(exact_dedup.chunks(F.col("t"))).collect()]
    assert ["".join(c) for c in cut] == [text, "zz" + text, "日" * 9000, ""]
    assert all(len(x) <= exact_dedup.MAX_CHUNK for c in cut for x in c)
    assert len(set(cut[0]) & set(cut[1])) > len(cut[0]) // 2 > 20  # an insertion moves few cuts


def test_fingerprint_by_definition():
    for text, n in (("A b c D e", 3), ("a b", 3), ("", 3), (" \n", 3), ("x Y z x y z", 2), ("É é", 1)):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
        assert simhash.fingerprint(text.encode(), n) == want


def test_hash_is_sparks(spark):
    got = spark.createDataFrame([("the cat é",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("the cat é".encode(), 42)


def brute_components(fps, radius):
    label = {f: f for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) % (1 << 64)).bit_count() <= radius:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_balls_lose_no_link(spark):
    rng = random.Random(5)
    for radius in (1, 2, 3):
        fps = set()
        for _ in range(12):  # centres with neighbours at distances up to 5, and chains
            f = rng.getrandbits(64)
            for _ in range(8):
                g = f
                for b in rng.sample(range(64), rng.randint(0, 5)):
                    g ^= 1 << b
                fps.add(g)
                f = g if rng.random() < 0.5 else f
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        want = brute_components(signed, radius)
        nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
        got = {r.node: r.label for r in simhash.components(simhash.links(nodes, radius)).collect()}
        assert {f: got.get(f, f) for f in signed} == want


def test_links_are_near_and_few(spark):
    base = 0x0123456789ABCDEF
    fps = [base ^ (1 << i) for i in range(40)]  # pairwise distance 2
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in got)
    assert len(got) == len({frozenset((r.a, r.b)) for r in got}) <= 40 * 39 / 2  # once each


def test_long_chain(spark):
    chain, f = [], 0
    for i in range(60):
        f ^= 1 << i
        chain.append(f)
    edges = spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:])], "a long, b long")
    assert {r.label for r in simhash.components(edges).collect()} == {min(chain)}


def test_near_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    fp = [simhash.fingerprint((r.text or "").encode()) for r in rows]
    label = brute_components(set(fp), 3)
    first = defaultdict(list)
    for r, f in zip(rows, fp):
        if r.doc_id is not None:
            first[label[f]].append(r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", str(min(first[label[f]], default=None))) for r, f in zip(rows, fp))
    got = simhash.near_groups(odd_docs).collect()
    assert sorted((str(r.doc_id), f"{r.fp % (1 << 64):016x}", str(r.component_id)) for r in got) == want
    kept = simhash.deduplicated(odd_docs)
    assert kept.schema == odd_docs.schema and kept.count() == len(set(label.values()))
    assert simhash.near_groups(no_docs).count() == 0 and simhash.deduplicated(no_docs).count() == 0


def test_row_digest_tells_nulls(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", "a"), ("a", "a"), (None, None), ("", None)], "x string, y string")
    assert df.select(*row_digest(df)).distinct().count() == 5
