"""Mixing, sharding and chat formatting against brute force."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ranksmith.llm import chat, mixing, sharding
from ranksmith.session import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else level * w[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def brute_mix(rows):
    docs = [(r.doc_id, r.source, len(WORD.findall(r.text or "")),
             int(hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{r.text or ''}".encode()).hexdigest()[:15], 16)) for r in rows]
    sizes = Counter()
    for _, s, n, _ in docs:
        sizes[s] += n
    target, out = brute_targets(sizes), []
    for s, t in target.items():
        whole = math.floor(t / sizes[s]) if sizes[s] else 0
        rest, held, upto = t - whole * sizes[s], 0, -1
        by_hash = Counter()
        for _, s2, n, h in docs:
            if s2 == s and n:
                by_hash[h] += n
        for h, n in sorted(by_hash.items()):
            if held + n > rest:
                upto = h if held + n - rest < rest - held else upto
                break
            held, upto = held + n, h
        out += [(str(d), n, str(s), round(t, 6), n * (whole + (h <= upto and rest > 0))) for d, s2, n, h in docs if s2 == s]
    return sorted(out)


def mixed(df):
    return sorted((str(r.doc_id), r.size, str(r.source), r.target, r.size * r.copies) for r in mixing.mix(df).collect())


def test_mix_odd_rows(odd_docs, no_docs):
    got = mixed(odd_docs)
    want = brute_mix(odd_docs.collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    assert mixing.mix(no_docs).count() == 0
    rows = mixing.mixed_rows(odd_docs)
    assert rows.schema == odd_docs.schema
    copies = {(str(r.doc_id), r.hash): r.copies for r in mixing.mix(odd_docs).collect()}
    repeats = Counter((str(r.doc_id), r.hash) for r in mixing.mix(odd_docs).collect())
    assert rows.count() == sum(copies[k] * n for k, n in repeats.items())
    assert mixing.mixed_rows(no_docs).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_random(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 300]))),
             rng.choice(["a"] * 12 + ["b", "c", "d", None, "e" if i < 8 else "f"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, want = mixed(df), brute_mix(df.collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    per = defaultdict(lambda: [0, 0, 0])
    for _, n, s, t, taken in got:
        per[s][0] += taken
        per[s][1], per[s][2] = t, max(per[s][2], n)
        assert taken <= 3 * n
    assert all(abs(taken - t) <= largest for taken, t, largest in per.values())
    assert mixed(df.repartition(7)) == got


def check_shards(rows, shards, docs):
    assert len(rows) == docs and {r.shard for r in rows} <= set(range(shards))
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_balance_and_keep_texts_together(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["en"] * 6 + ["de", None]), rng.choice(["s1"] * 5 + ["s2", "s3"]), "t" * rng.randint(0, 400) + str(i % 900))
            for i in range(3000)]
    rows += [(10_000 + i, "en", "s1", "same text " * 30) for i in range(1500)]  # a third of all bytes
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got = sharding.assign(df, shards=16).collect()
    check_shards(got, 16, len(rows))
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean
    text, where = {r[0]: r[3] for r in rows}, defaultdict(set)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert sum(len(w) > 1 for w in where.values()) <= 1  # only the hot text is cut
    by_bytes = sharding.assign(df, target_bytes=int(mean * 4)).collect()
    check_shards(by_bytes, 5, len(rows))


def test_shards_odd_rows(spark, odd_docs, no_docs):
    got = sharding.assign(odd_docs, shards=4).collect()
    check_shards(got, 4, odd_docs.count())
    want = sorted(len((r.text or "").encode()) + 1 for r in odd_docs.collect())
    assert sorted(r.size for r in got) == want
    assert sharding.assign(no_docs, shards=4).count() == 0
    one = sharding.assign(odd_docs, shards=1).collect()
    check_shards(one, 1, odd_docs.count())
    path = shared_dir(spark, "test-shards")
    sharding.write_shards(odd_docs, path, shards=4)
    assert spark.read.parquet(path).count() == odd_docs.count()


def brute_chats(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r.conv_id].append((r.turn is not None, r.turn or 0, r.role, r.text))
    key = lambda t: (t[0], t[1])
    logs = {c: [(x[2], x[3]) for x in sorted(ts, key=key)] for c, ts in convs.items()}
    out = []
    for c, log in logs.items():
        if any(len(o) > len(log) and o[:len(log)] == log for o in logs.values()):
            continue
        same = [d for d, o in logs.items() if o == log]
        if c == min(same, key=lambda d: (d is None, d or 0)):
            out.append((str(c), len(log), len(same), "".join(f"<|im_start|>{a or ''}\n{b or ''}<|im_end|>\n" for a, b in log)))
    return sorted(out)


def chats(df):
    parts = defaultdict(list)
    for r in chat.render(df).collect():
        parts[str(r.conv_id), r.n_turns, r.copies].append((r.part, r.chat))
    assert all([p for p, _ in sorted(v)] == list(range(len(v))) for v in parts.values())
    return sorted((*k, "".join(t for _, t in sorted(v))) for k, v in parts.items())


def test_chat_snapshots(spark, monkeypatch):
    rng = random.Random(9)
    base = [[(rng.choice(["user", "assistant", None]), rng.choice(["hi", "yes", "no", "", None]) or "") for _ in range(rng.randint(1, 9))] for _ in range(15)]
    logs = [b[:rng.randint(1, len(b))] for b in base for _ in range(3)] + base
    rows = [(i, t, role, text, "x") for i, log in enumerate(logs) for t, (role, text) in enumerate(log)]
    rows += [(None, 0, "user", None, "x"), (None, 5, "user", "null id", "x"), (900, None, "system", "lost turn", "x"), (900, 3, "user", "u", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    want = brute_chats(df.collect())
    assert chats(df) == want
    monkeypatch.setattr(chat, "BLOCK_TURNS", 2)  # conversations over several blocks
    assert chats(df) == want
    assert chats(df.limit(0)) == []


def test_metadata_values_keep_order(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("ab",), ("b",), ("é",)], "s string")
    got = [r[0] for r in df.select(sharding.metadata_value(df, "s")).collect()]
    assert got == sorted(got) and got[0] < got[1] < got[2]
    n = spark.createDataFrame([(None,), (2,)], "s int")
    assert [r[0] for r in n.select(sharding.metadata_value(n, "s")).collect()] == [float("-inf"), 2.0]


def test_word_count(odd_docs):
    got = odd_docs.select("text", mixing.word_count("text").alias("n")).collect()
    assert all(r.n == len(WORD.findall(r.text or "")) for r in got)
    assert odd_docs.select(F.max(mixing.position_hash("doc_id", "text"))).first()[0] < 1 << 60


def test_splits_follow_the_widest_axis(spark):
    """Every node of the tree that the shards make: the units left and right
    of its middle are apart on its relatively widest axis, near half its bytes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    body = F.coalesce("text", F.lit(""))
    shard = {r.doc_id: r.shard for r in sharding.assign(docs, shards=8).collect()}
    axes = [sharding.metadata_value(docs, "lang"), sharding.metadata_value(docs, "source"),
            F.log2(F.octet_length(body) + 1), F.xxhash64(body).cast("double")]
    rows = [([-1.0 if v == float("-inf") else v for v in r[2:]], len(r.t.encode()) + 1, shard[r.doc_id])
            for r in docs.select("doc_id", body.alias("t"), *[a.alias(f"a{i}") for i, a in enumerate(axes)]).collect()]
    span = [max(u[0][i] for u in rows) - min(u[0][i] for u in rows) or 1 for i in range(4)]

    def node(first, n):
        if n == 1:
            return
        own = [u for u in rows if first <= u[2] < first + n]
        wide = [max(u[0][i] for u in own) - min(u[0][i] for u in own) for i in range(4)]
        axis = max(range(4), key=lambda i: (wide[i] / span[i], -i))
        left, right = ([u for u in own if (u[2] < first + n // 2) == side] for side in (True, False))
        step = wide[axis] / 65535
        assert max(u[0][axis] for u in left) <= min(u[0][axis] for u in right) + step
        assert abs(sum(u[1] for u in left) - sum(u[1] for u in own) / 2) <= max(u[1] for u in own)
        node(first, n // 2)
        node(first + n // 2, n - n // 2)

    node(0, 8)
