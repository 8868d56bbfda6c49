"""Banded DTW, nearest neighbours by lower bounds, the condensed form, and
cuts by threshold and with ties."""

import numpy as np
import pyspark.sql.functions as F

from tapflow.operators import cluster as C
from tapflow.operators import distance as D


def dtw_ref(x, y, band=None):
    n, m = len(x), len(y)
    reach = n + m if band is None else max(band, abs(n - m))
    acc = np.full((n + 1, m + 1), np.inf)
    acc[0, 0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if abs(i - j) <= reach:
                acc[i, j] = abs(x[i - 1] - y[j - 1]) + min(acc[i - 1, j], acc[i, j - 1], acc[i - 1, j - 1])
    return acc[n, m]


def items_of(spark, series):
    return spark.createDataFrame([(f"i{k:03d}", [float(v) for v in s]) for k, s in enumerate(series)],
                                 "item string, values array<double>")


def some_series(n, seed):
    rng = np.random.default_rng(seed)
    out = [np.sin(np.linspace(rng.random() * 6, 9, int(rng.integers(3, 14)))) * (1 + k % 4) for k in range(n)]
    return out + [out[0], out[1]]  # repeated series tie at zero


def test_the_kernel_and_its_bounds_with_every_band():
    rng = np.random.default_rng(1)
    for t in range(150):
        n, m, p, band = int(rng.integers(1, 12)), int(rng.integers(1, 12)), 4, [None, 0, 1, 3, 100][t % 5]
        x, y = rng.normal(size=(p, n)), rng.normal(size=(p, m))
        got, bounds = D.dtw_batch(x, y, band), D.dtw_bounds(x, y, band)
        for k in range(p):
            assert np.isclose(got[k], dtw_ref(x[k], y[k], band))
            assert bounds[k, k] <= got[k] + 1e-9
        if band == 100:
            assert np.array_equal(got, D.dtw_batch(x, y))
    assert list(D.dtw_batch(np.zeros((2, 0)), np.zeros((2, 0)))) == [0.0, 0.0]
    assert np.isinf(D.dtw_batch(np.zeros((2, 0)), np.ones((2, 3)))).all()


def test_nearest_neighbours_equal_those_of_all_pairs(spark):
    series = some_series(60, 3)
    items = items_of(spark, series)
    for band in (None, 2):
        full = {}
        for r in D.pairwise(items, "item", "values", "dtw", band=band).collect():
            for a, b in ((r.id_a, r.id_b), (r.id_b, r.id_a)):
                full[a] = min(full.get(a, (np.inf, "")), (round(r.distance, 9), b))
        for blocks in (1, 3):
            rows = D.nearest(items, "item", "values", band, blocks).collect()
            assert {r.id: (r.distance, r.neighbour) for r in rows} == full
            evaluated, skipped = sum(r.evaluated for r in rows), sum(r.skipped for r in rows)
            assert evaluated + skipped == len(series) * (len(series) - 1)
            assert skipped > evaluated


def test_condensed_vector_and_back(spark):
    pairs = D.pairwise(items_of(spark, some_series(23, 5)), "item", "values", "dtw")
    vector, items = D.condensed(pairs)
    numbers = {r.id: r.number for r in items.collect()}
    assert [numbers[k] for k in sorted(numbers)] == list(range(25))
    n = len(numbers)
    assert sorted(r.place for r in vector.collect()) == list(range(n * (n - 1) // 2))
    want = {(numbers[r.id_a], numbers[r.id_b]): r.distance for r in pairs.collect()}
    got = {(r.i, r.j): r.distance for r in D.uncondensed(vector, F.lit(n)).collect()}
    assert got == want
    names = {v: k for k, v in numbers.items()}
    square = {(r.i, r.j): r.distance for r in D.mirrored(pairs).collect()}
    assert all(square[names[i], names[j]] == d == square[names[j], names[i]] for (i, j), d in got.items())


def test_places_of_many_items_are_found_again(spark):
    n = 3_000_000
    rows = [(i, j) for i in (0, 1, n // 2, n - 3, n - 2) for j in (i + 1, (i + n) // 2 + 1, n - 1) if j < n and j > i]
    places = [(n * i - i * (i + 1) // 2 + j - i - 1, 0.0) for i, j in rows]
    got = D.uncondensed(spark.createDataFrame(places, "place bigint, distance double"), F.lit(n).cast("bigint")).collect()
    assert sorted({(r.i, r.j) for r in got}) == sorted(set(rows))


def test_tied_heights_give_fewer_clusters(spark):
    merges = spark.createDataFrame([(1, "a", "b", 1.0, 2, 1), (2, "c", "d", 1.0, 2, 1), (3, "e", "f", 2.0, 2, 1),
                                    (4, "a", "c", 3.0, 4, 2), (5, "a", "e", 3.0, 6, 3)],
                                   "step int, left string, right string, height double, size bigint, round int")

    def clusters(df, key):
        found = {}
        for r in df.collect():
            found.setdefault(r[key], {}).setdefault(r.cluster, set()).add(r.item)
        return {k: ["".join(sorted(v[c])) for c in sorted(v)] for k, v in found.items()}

    assert clusters(C.cut_sweep(merges, [1, 2, 3, 4, 5, 6, 9]), "k") == {
        1: ["abcdef"], 2: ["abcdef"], 3: ["ab", "cd", "ef"], 4: ["ab", "cd", "e", "f"], 5: ["ab", "cd", "e", "f"],
        6: list("abcdef"), 9: list("abcdef")}
    assert clusters(C.cut_heights(merges, [0.5, 1.0, 2.9, 3.0]), "height") == {
        0.5: list("abcdef"), 1.0: ["ab", "cd", "e", "f"], 2.9: ["ab", "cd", "ef"], 3.0: ["abcdef"]}


def test_squared_distances_by_products_are_right_for_near_pairs():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 8)) + 1000.0
    y = np.vstack([x[:20] + rng.normal(size=(20, 8)) * 1e-7, x[20:30], rng.normal(size=(9, 8))])
    want = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2)
    assert np.allclose(D.squared_matrix(x, y), want, rtol=1e-8, atol=0)


def test_distance_sums_take_each_block_pair_once(spark, monkeypatch):
    """720,000 vectors of 64 are shuffled 2 x 44 / 2 times, not 2 x 2,813 times."""
    assert D.n_blocks(720_000, D.VECTOR_BLOCK_ITEMS, 12) == 44
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(70, 4)), rng.integers(0, 3, 70)
    rows = [(f"p{i}", str(label[i]), x[i].tolist()) for i in range(70)]
    points = spark.createDataFrame(rows, "id string, label string, v array<double>")
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    for blocks in (1, 4):
        got = {(r.id, r.other_label): (r.dist_sum, r.n) for r in D.distance_sums(points, "id", "label", "v", blocks).collect()}
        assert len(got) == 210
        for (i, c), (total, n) in got.items():
            own = label == int(c)
            assert n == own.sum() and np.isclose(total, d[int(i[1:]), own].sum())


def test_block_pairs_are_not_merged_into_few_tasks(spark):
    """The pairs of few bytes are spread over the cores, and 77,520 items are
    shuffled 77 times each, not 304 times."""
    assert D.pair_blocks(77_520, 12) == 76
    assert D.pair_blocks(7_820, 8) == 12 and D.pair_blocks(40, 8) == 2
    series = some_series(60, 7)
    items = items_of(spark, series)
    for band in (None, 1):
        rows = D.pairwise(items, "item", "values", "dtw", blocks=4, band=band).withColumn("task", F.spark_partition_id()).collect()
        assert len({r.task for r in rows}) > 1
        assert len({(r.id_a, r.id_b) for r in rows}) == len(rows) == 62 * 61 // 2
        for r in rows[::50]:
            assert r.id_a < r.id_b
            assert np.isclose(r.distance, dtw_ref(series[int(r.id_a[1:])], series[int(r.id_b[1:])], band))


def test_steps_of_the_kernel_by_the_length_of_diagonals():
    assert D.kernel_pairs(80, 56) == D.KERNEL_PAIRS == D.kernel_pairs(0, 0, 4) == D.kernel_pairs(80, 10, 4)
    assert D.kernel_pairs(80, 78, 4) == 4 * D.KERNEL_PAIRS


def test_pairs_of_missing_and_repeated_ids(spark):
    rows = [("b", [1.0]), ("b", [5.0]), ("a", [1.0, 4.0]), (None, [2.0]), ("c", [])]
    items = spark.createDataFrame(rows, "item string, values array<double>")
    got = sorted(tuple(r) for r in D.pairwise(items, "item", "values", "dtw", blocks=1).collect())
    inf = float("inf")
    assert got == [("None", "a", 3.0), ("None", "b", 1.0), ("None", "b", 3.0), ("None", "c", inf), ("a", "b", 3.0), ("a", "b", 5.0),
                   ("a", "c", inf), ("b", "c", inf), ("b", "c", inf)]


def test_mixed_lengths_and_range_bounds_equal_those_of_equal_lengths():
    rng = np.random.default_rng(31)
    series = [rng.normal(size=n) for n in (0, 1, 1, 2, 5, 9, 9, 30, 4)] + [np.array([1.0, np.nan])]
    (x, n), ends = D._padded(series), [len(v) for v in series]
    i, j = (a.ravel() for a in np.meshgrid(np.arange(9), np.arange(9), indexing="ij"))
    want = np.array([D.dtw_batch(series[a][None], series[b][None])[0] for a, b in zip(i, j)])
    assert np.array_equal(D.dtw_mixed(x[i], n[i], x[j], n[j]), want) and ends[7] == 30
    bounds = D.range_bounds(series, series)
    assert np.isnan(bounds[9]).all() and np.isnan(bounds[:, 9]).all()
    old = np.array([D.dtw_bounds(series[a][None], series[b][None])[0, 0] for a, b in zip(i, j)]).reshape(9, 9)
    assert np.allclose(bounds[:9, :9], old, atol=1e-11) and (bounds[:9, :9] <= old + 1e-15).all()


def test_a_distance_of_nearest_serves_both_items(spark):
    rng = np.random.default_rng(32)
    items = items_of(spark, {f"p{k}": [float(v) for v in rng.normal(size=6)] for k in range(12)}.values())
    rows = D.nearest(items, "item", "values", blocks=3).collect()
    assert sum(r.evaluated for r in rows) <= 12 * 11 // 2  # all ordered pairs might be evaluated before
    assert sum(r.evaluated + r.skipped for r in rows) == 12 * 11
