import numpy as np

from dialectry.operators import linear, linear_blocks


def test_same_optimum_as_the_whole_problem(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(80, 13)) * (r.random((80, 13)) < 0.5), r.integers(0, 3, 80)
    x[7] = 0  # a row without cells
    data = [(n, int(k), [int(i) for i in np.flatnonzero(v)], [float(f) for f in v[v != 0]]) for n, (k, v) in enumerate(zip(y, x))]
    rows = spark.createDataFrame(data, "row_id long, label int, indices array<int>, values array<double>").repartition(3)
    counts = np.bincount(y, minlength=3).tolist()
    whole = linear.fit(rows, 13, counts, c=0.7, tol=1e-4)
    table = linear_blocks.fit(rows, 13, counts, c=0.7, tol=1e-4, max_iter=40, feature_block=4, row_block=10)
    w = np.zeros((14, 3))
    for i, k, v in table.collect():
        w[i, k] = v
    assert np.abs(w - whole).max() < 5e-3
    assert dict(linear_blocks.predict(rows, table, 13, "row_id").collect()) == dict(linear.predict(rows, w, "row_id", "long").collect())


def test_no_step(spark):
    rows = spark.createDataFrame([(0, 0, [0], [1.0]), (1, 1, [1], [1.0])], "row_id long, label int, indices array<int>, values array<double>")
    assert linear_blocks.fit(rows, 2, [1, 1], max_iter=0).count() == 0
