"""The pipeline's stages against brute force, and the entry's guard."""
import hashlib
import os
import re
import subprocess
import sys
from collections import Counter

import duckdb
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from ranksmith.llm import exact_dedup, queries, toxicity

from .test_located import brute_score

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fingerprint(text):
    """SimHash of three-word shingles, bit by bit."""
    ws = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows):
    """Components of all pairs within three bits, as lists of row numbers."""
    fps, label = [fingerprint(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(i)
    return list(groups.values())


def mixed(docs):
    """How often each row is taken, by the SQL of the mixing query."""
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toArrow())
    return Counter({(i, size): taken // size if size else 0 for i, size, _, _, taken in con.sql(queries.ORACLE["op5_mixing"]).fetchall()})


def check(name, old, new, before, after, model):
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    if name == "toxicity":
        want = [r for r in old if brute_score(r.text, model.weights, model.bias) < 0.5]
        assert Counter(new) == Counter(want)
    elif name == "exact dedup":
        best = {}
        for r in old:
            norm = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
            if norm not in best or (-len(r.text or ""), key(r)) < (-len(best[norm].text or ""), key(best[norm])):
                best[norm] = r
        assert sorted(map(key, new)) == sorted(map(key, best.values())) and len(new) == len(best)
    elif name == "SimHash near-dedup":
        want = [min((old[i] for i in g), key=key) for g in near_groups(old)]
        assert sorted(map(key, new)) == sorted(map(key, want))
    elif name.startswith("mixing"):
        times, got = mixed(before), Counter(r.doc_id for r in new)
        want = Counter()
        for r in old:
            want[r.doc_id] += times[r.doc_id, len(words(r.text))]
        assert +want == got
    else:
        ids = {r.doc_id: r for r in new}
        lib = Tokenizer.from_file(queries.vocabulary())
        for r in old:
            enc = lib.encode(r.text or "", add_special_tokens=False).ids
            packed = b"".join(i.to_bytes(4, "little") for i in enc)
            text = lib.decode(enc, skip_special_tokens=False)
            mine = ids[r.doc_id]
            assert (mine.n_tokens, mine.ids_sha256, mine.decoded_sha256) == (
                len(enc), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert len(new) == len(old)


@pytest.mark.parametrize("odd", [False, True])
def test_stages(spark, odd_docs, odd):
    """Each stage on its own input, by brute force; once on rows with nulls,
    empty and long texts, ties, repeated rows and clashing columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(odd_docs if odd else docs, spark.read.parquet(f"{SF}/labels.parquet"))
    if odd:  # nulls of the id are one document only, as the lists below are by id
        docs = odd_docs.where("doc_id is not null").unionByName(odd_docs.where("doc_id is null").limit(1))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        old, new = before.collect(), docs.collect()
        if k < 4:
            assert docs.columns == columns and set(new) <= set(old)
        check(name, old, new, before, docs, model)


def test_stages_on_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
        docs = spark.createDataFrame([], docs.schema)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("gone", ["corpus_pipeline", "ranksmith.llm"])
def test_entry_without_the_subpackage(gone):
    code = (f"import sys; sys.modules[{gone!r}] = None\n"
            "import __spark_entry__ as e\nassert 'pipeline' not in e.queries() and 'bm25_topk' in e.queries()")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_chunks_are_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
