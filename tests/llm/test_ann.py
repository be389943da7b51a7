import numpy as np

from docquarry.llm.ann import byte_tables, nearest, scan, train


def brute(ids, x, queries, k):
    out = {}
    for i in queries:
        s = x.astype(np.float64) @ x[ids.index(i)].astype(np.float64)
        out[i] = [j for _, j in sorted((-v, j) for v, j in zip(s.tolist(), ids, strict=True) if j != i)[:k]]
    return out


def test_scan_sums_tables():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 7)).astype(np.float32)
    q = train(x, rounds=2)
    tables, _ = byte_tables(q, x[:5])
    codes = q.encode(x)
    want = sum(tables[:, g][:, codes[:, g]].astype(int) for g in range(q.groups))
    assert (scan(tables, codes) == want).all()


def test_loss_prefers_parallel_accuracy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    plain, aware = train(x, threshold=0.0), train(x, threshold=0.3)

    def parallel(q):
        c = q.encode(x)
        r = x - np.concatenate([q.books[g][c[:, g]] for g in range(q.groups)], 1)
        return (((r * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2).mean()

    assert parallel(aware) < 0.5 * parallel(plain)


def test_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(9000, 64)).astype(np.float32)
    x[100:160] = x[100]  # equal vectors
    ids = [int(i) * 2 for i in rng.permutation(9000)]
    df = spark.createDataFrame([(i, v.tolist(), "z") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, id string").repartition(5)
    got = {}
    for r in nearest(df, df.filter("vec_id % 100 = 0"), fit_rows=3000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(ids, x, [i for i in ids if i % 100 == 0], 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({*got[i]} & {*want[i]}) / 20 for i in want]) >= 0.95


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 1.0]), (3, [2.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0]), (None, [1.0, 1.0]), (20, [3.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest(df, df.filter("vec_id IN (1, 4, 5, 20)")).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 20, 3.0), (1, 2, 2, 2.0), (1, 3, 3, 2.0), (20, 1, 2, 5.0), (20, 2, 3, 5.0), (20, 3, 1, 3.0)]
    assert nearest(df.limit(0)).count() == 0


def test_repeated_ids_and_double_precision(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [1e39, 1.0]), (2, [3.0, 1.0]), (3, [1.0 + 2**-40, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in nearest(df, df.filter("vec_id = 1")).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 5e38), (1, 2, 3, 0.5 + 2**-41)]


def test_every_nearest_vector_on_other_rows(spark):
    rng = np.random.default_rng(5)
    close = rng.normal(size=(3, 24))[rng.integers(0, 3, 2500)] + 1e-3 * rng.normal(size=(2500, 24))  # finer than a code
    long = rng.normal(size=(1500, 24)) * rng.lognormal(0, 2, (1500, 1))
    signs = rng.integers(0, 2, (1500, 24)) * 2.0 - 1  # many equal scores
    x = np.concatenate([close, long, signs]).astype(np.float32)
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in nearest(df, df.filter("vec_id % 50 = 0"), fit_rows=2000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    for i in (i for i in ids if i % 50 == 0):
        total = np.zeros(len(x))
        for a, b in zip(x.astype(np.float64).T, x[ids.index(i)].astype(np.float64), strict=True):
            total += a * b
        assert got[i] == [(j, -v) for v, j in sorted((-v, j) for v, j in zip(total.tolist(), ids, strict=True) if j != i)[:20]]


def test_repeats_of_one_row_hide_no_other(spark):
    rows = [(1, [3.0, 1.0])] * 30 + [(1, [3.0 + n, 0.0]) for n in range(30)] + [(n, [3.0, 1.0]) for n in range(2, 6)] + [(9, [1.0, 0.0])]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2), spark.createDataFrame([(9, [1.0, 0.0])], "vec_id long, embedding array<float>"), k=4)
    assert [(r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 32.0), (2, 3.0), (3, 3.0), (4, 3.0)]
