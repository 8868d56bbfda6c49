from datetime import datetime, time

import numpy as np
import pyspark.sql.functions as F

from tapflow.functions import (histogram_bin, in_band, linear_scale, operational_weekday,
                               weekday_numbers, zero_pad)


def test_zero_pad_never_truncates(spark):
    df = spark.createDataFrame([("7",), ("1234",), ("12345",), ("123456",)], "c string")
    got = [r[0] for r in df.select(zero_pad("c")).collect()]
    assert got == ["00007", "01234", "12345", "123456"]


def test_operational_weekday_rolls_back_before_three(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 8, 2, 59),), (datetime(2024, 1, 8, 3, 0),)],
                               "t timestamp_ntz")
    got = [r[0] for r in df.select(operational_weekday("t")).collect()]
    assert got == [6, 0]  # Monday 02:59 belongs to Sunday
    assert weekday_numbers(["Monday", "sunday"]) == [0, 6]


def test_band_is_inclusive_on_whole_seconds(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 8, 9, 30, 0, 700000),), (datetime(2024, 1, 8, 9, 30, 1),),
                                (datetime(2024, 1, 8, 7, 30),)], "t timestamp_ntz")
    got = [r[0] for r in df.select(in_band("t", time(7, 30), time(9, 30))).collect()]
    assert got == [True, False, True]


def test_histogram_bin_matches_numpy(spark):
    rng = np.random.default_rng(7)
    rows, expect = [], []
    for g in range(300):
        n = int(rng.integers(2, 40))
        x = np.cumsum(rng.integers(1, 50, n)) / 10.0
        x = x / x[-1]
        lo, hi = x.min(), x.max()
        for k, v in enumerate(x):
            onehot = np.zeros(n)
            onehot[k] = 1.0
            h, _ = np.histogram(x, bins=10, weights=onehot)  # the uniform-bin path
            expect.append(int(np.argmax(h)))
            rows.append((g, float(v), float(lo), float(hi)))
    df = spark.createDataFrame(rows, "g int, x double, lo double, hi double")
    got = [r[0] for r in df.select(histogram_bin(F.col("x"), F.col("lo"), F.col("hi"), 10)).collect()]
    assert got == expect


def test_histogram_constant_range_uses_middle_bin(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5)], "x double, lo double, hi double")
    assert df.select(histogram_bin(F.col("x"), F.col("lo"), F.col("hi"), 10)).first()[0] == 5
    counts, _ = np.histogram([0.5, 0.5], bins=10)
    assert int(np.argmax(counts)) == 5


def test_linear_scale_includes_zero_and_midpoint(spark):
    df = spark.createDataFrame([(5.0, 5.0, 10.0), (0.0, 0.0, 0.0)], "v double, lo double, hi double")
    got = [r[0] for r in df.select(linear_scale(F.col("v"), F.col("lo"), F.col("hi"), 0.1, 0.5)).collect()]
    assert np.allclose(got, [0.3, 0.3])
