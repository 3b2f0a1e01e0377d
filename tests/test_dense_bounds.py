"""What dense search holds in a task follows the queries, not queries x passages."""

import numpy as np
from pyspark.sql import functions as F

from ranksmith.operators import dense, dense_index
from ranksmith.session import staged


def _vectors(spark, n, ids="id"):
    v = F.array(*[F.sin(F.col("id") * (i + 1)) for i in range(8)])
    return spark.range(n).select(F.expr(ids).alias("id"), v.alias("v"))


def test_a_block_gives_k_rows_a_query(spark):
    p = _vectors(spark, 5000, "lpad(string(id), 5, '0')")
    q = spark.createDataFrame([(1, [1.0] * 8), (2, [0.0] * 8), (3, [-1.0] + [0.5] * 7)], "qid int, v array<double>")
    fields = [dense.T.StructField("qid", dense.T.IntegerType()), dense.T.StructField("pid", dense.T.StringType()),
              dense.T.StructField("score", dense.T.DoubleType())]
    found = dense._scan(q, p, [], "qid", "v", "id", "v", dense.BLOCK_BYTES, dense._topk_kernel(5), fields).collect()
    assert len(found) <= 3 * 6
    assert sorted(r.pid for r in found if r.qid == 2) == [f"{i:05d}" for i in range(5)]  # all tie at 0
    P = np.array([r.v for r in p.orderBy("id").collect()])
    top = {(r.qid, r["rank"]): r.id for r in dense.dense_topk(q, p, 5, qvec="v", pid="id", pvec="v").collect()}
    for i, x in ((1, [1.0] * 8), (3, [-1.0] + [0.5] * 7)):
        s = np.round(P @ np.array(x), 9)
        want = sorted(range(len(P)), key=lambda j: (-s[j], j))[:5]
        assert [top[i, r] for r in range(1, 6)] == [f"{j:05d}" for j in want]


def test_blocks_grow_rather_than_their_number(spark):
    v = staged(_vectors(spark, 6000), "test-vectors")
    index = dense_index.cluster_index(v, "id", "v", block_rows=4)
    n = index.vectors.select("_block").distinct().count()
    assert n <= 4 * dense_index.MANY_CLUSTERS * dense_index.RINGS
    q = v.filter("id % 500 = 0").select(F.col("id").alias("qid"), "v")
    rows = lambda df: sorted((r.qid, r["rank"], r.id) for r in df.collect())
    how = dict(k=3, qvec="v", pid="id", pvec="v", other_than_self=True)
    assert rows(dense.dense_topk(q, v, index=index, **how)) == rows(dense.dense_topk(q, v, **how))
