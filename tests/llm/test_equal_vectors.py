import numpy as np
import pyarrow as pa

from dialectry.llm.permutation_index import nearest


def test_a_third_of_equal_vectors(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 16))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for a in nearest(df, df.where("vec_id % 300 = 0"), k=20, pivots=64, prefix=16, least=32, shard_rows=1000).collect():
        got.setdefault(a.query_id, {})[a["rank"]] = a.vec_id
    assert sorted(got) == list(range(0, 3000, 300))
    for q, found in got.items():
        score = np.where(np.arange(3000) % 3 == 0, x[0] @ x[0], x @ x[0])
        score[q] = -np.inf
        assert [found[k] for k in range(1, 21)] == np.lexsort((np.arange(3000), -score))[:20].tolist()


def brute(rows, queries, k):
    """(query id, rank, id) by einsum over all rows, repeated ids once with their best score."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for q, v in queries:
        score = np.einsum("ij,j->i", x, np.array(v))
        for i in set(ids[ids != q].tolist()):
            out.setdefault(q, {}).setdefault(i, -np.inf)
            out[q][i] = max(out[q][i], score[ids == i].max())
    return {q: [i for i, _ in sorted(s.items(), key=lambda p: (-p[1], p[0]))[:k]] for q, s in out.items()}


def collected(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    return {q: [v for _, v in sorted(f)] for q, f in got.items()}


def test_fifty_equal_vectors_over_several_shards(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 12))
    x[r.permutation(900)[:50]] = 3 * x[0]
    rows = [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(nearest(df, df.where("vec_id % 90 = 0"), shard_rows=150, query_rows=3, share=1.0))
    assert got == brute(rows, rows[::90], 20)


def test_lengths_ids_and_sizes_of_any_kind(spark):
    r = np.random.default_rng(6)
    rows = [(int(i), [float(v) for v in r.normal(size=6)]) for i in range(80)]
    rows += [(7, [float(v) for v in r.normal(size=6)]), (7, rows[7][1]), (81, [1e-200] * 6), (82, [-1e-200, 0.0, 0.0, 0.0, 0.0, 1e-210]), (83, [1e150] * 6)]
    other = [(100 + i, [1.0, float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows + other, "vec_id long, embedding array<double>")
    # queries are mostly of the other length: theirs is not the table's
    asked = df.where("vec_id >= 100 or vec_id in (3, 81, 83)")
    got = collected(nearest(df, asked, share=1.0))
    assert got == brute(rows, [x for x in rows if x[0] in (3, 81, 83)], 20)
    twice = collected(nearest(df, df.where("vec_id = 7"), share=1.0))
    assert list(twice) == [7] and 7 not in twice[7] and len(twice[7]) == 20
    assert nearest(df, df.where("vec_id >= 100")).count() == 0


def test_recall_at_the_default_setting(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(18_000, 32)).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(18_000), "embedding": pa.array(list(x))}))
    asked = np.arange(0, 18_000, 450)
    got = collected(nearest(df, df.where("vec_id % 450 = 0")))
    hits = 0
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(got[q]))
    assert hits / (20 * len(asked)) >= 0.9
