"""Pairwise operators over items with vector values (J6, M4, M5, and the
pair sums behind the exact silhouette M9).

All-pairs work is split into blocks: items are hashed into ``B`` blocks, each
item row is replicated to the ``B`` block pairs it takes part in, and every
block pair is one group (``cogroup``) that evaluates its distances with NumPy.
Rows shuffled are n x B, that is n^2 over the items of a block where ``B``
grows with n, and no group holds more than two blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapflow.operators.common import cut_lineage

# Items per block at most, on average (blocks are hash blocks); fewer where
# the cores would otherwise be idle.
BLOCK_ITEMS = 256
MIN_BLOCK_ITEMS = 16
# Items per block of a pair table: a block pair gives a million rows at most, on
# average, and its pairs of equal lengths are enough for full kernel steps.
PAIR_BLOCK_ITEMS = 1_024
# Tasks at most for the block pairs; with more, a task takes several.
PAIR_TASKS = 10_000
# Vectors of one length in a block at most, on average: 8 MB of 64 doubles each.
VECTOR_BLOCK_ITEMS = 16_384
# Bytes of one temporary of a pair task.
TASK_BYTES = 32 << 20


def n_blocks(n: int, block_items: int = BLOCK_ITEMS, cores: int = 1) -> int:
    """Blocks for ``n`` items: enough for ``block_items`` in each and, while
    blocks hold ``MIN_BLOCK_ITEMS``, for two block pairs on every core."""
    for_cores = math.ceil(math.sqrt(4 * cores))
    return max(1, math.ceil(n / block_items), min(for_cores, n // MIN_BLOCK_ITEMS))


def _blocks_for(src: DataFrame, block_items: int = BLOCK_ITEMS) -> int:
    return n_blocks(src.count(), block_items, src.sparkSession.sparkContext.defaultParallelism)


def pair_blocks(n: int, cores: int = 1) -> int:
    """Blocks of a pair table: of ``PAIR_BLOCK_ITEMS``, or of fewer down to
    ``BLOCK_ITEMS`` while there are not eight block pairs for every core."""
    return max(n_blocks(n, PAIR_BLOCK_ITEMS, cores), min(n_blocks(n, BLOCK_ITEMS, cores), math.ceil(math.sqrt(16 * cores))))


def _blocked(items: DataFrame, id_col: str, blocks: int) -> DataFrame:
    return items.withColumn("_blk", F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(blocks)).cast("int"))


def block_pairs(items: DataFrame, id_col: str, blocks: int, upper: bool):
    """J6 as block pairs: (left, right) DataFrames keyed by (bi, bj). With
    ``upper`` only block pairs bi <= bj are formed (each unordered item pair
    then meets exactly once); otherwise every ordered block pair is formed."""
    b = _blocked(items, id_col, blocks)
    # both keys are int on both sides, so matching block pairs meet in one group
    partners = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = (b.withColumn("_p", partners)
            .select(F.col("_blk").alias("bi"), F.col("_p").cast("int").alias("bj"), "*"))
    right = (b.withColumn("_p", partners)
             .select(F.col("_p").cast("int").alias("bi"), F.col("_blk").alias("bj"), "*"))
    if upper:
        left = left.filter(F.col("bi") <= F.col("bj"))
        right = right.filter(F.col("bi") <= F.col("bj"))
    left, right = left.drop("_blk", "_p"), right.drop("_blk", "_p")
    # both sides come from one DataFrame: fresh aliases keep their columns apart
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    # a task for each block pair: the work is in the pairs, and tasks merged by
    # their few bytes would leave cores idle
    tasks = min(PAIR_TASKS, blocks * (blocks + 1) // 2 if upper else blocks * blocks)
    return left.repartition(tasks, "bi", "bj"), right.repartition(tasks, "bi", "bj")


def dtw_batch(x: np.ndarray, y: np.ndarray, band: int | None = None) -> np.ndarray:
    """Exact dynamic time warping distance for P pairs at once (point cost
    |x - y|, steps (1,0), (0,1), (1,1)). x: (P, n), y: (P, m). A ``band``
    allows only |i - j| <= max(band, |n - m|); none allows every path.

    Works by anti-diagonals: the cells (i, k - i) of diagonal k depend on the
    two diagonals before it alone, so one step evaluates a diagonal of every
    pair. Cells are kept by i, with those outside the grid or band infinite."""
    if x.shape[1] > y.shape[1]:
        x, y = y, x  # the distance is the same to the last bit, and the buffers are shorter
    p, n = x.shape
    m = y.shape[1]
    if n == 0 or m == 0:
        return np.full(p, 0.0 if n == m else np.inf)
    reach = n + m if band is None else max(band, abs(n - m))
    xt, yt = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T[::-1])  # y backwards: a diagonal is a slice of both
    before, last, now = (np.full((n + 2, p), np.inf) for _ in range(3))
    cost = np.empty((n, p))
    before[0] = 0.0
    for k in range(2, n + m + 1):  # i + j = k, counted from 1
        lo, hi = max(1, k - m, -((reach - k) // 2)), min(n, k - 1, (k + reach) // 2)
        if lo > hi:
            now[hi:lo + 1] = np.inf
        else:
            now[lo - 1] = now[hi + 1] = np.inf  # the ends beside the diagonal are read later
            c, d = cost[:hi - lo + 1], now[lo:hi + 1]
            np.subtract(xt[lo - 1:hi], yt[m - k + lo:m - k + hi + 1], out=c)
            np.abs(c, out=c)
            np.minimum(last[lo - 1:hi], last[lo:hi + 1], out=d)
            np.minimum(d, before[lo - 1:hi], out=d)
            d += c
        before, last, now = last, now, before
    return last[n].copy()


def dtw_mixed(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``dtw_batch`` without a band for pairs of different lengths: row r of x
    counts up to ``n[r]``, of y up to ``m[r]``. A cell depends on no later
    value, so what is behind the ends does not matter; a pair is read off at
    its last cell and then left out."""
    out = np.where(n == m, 0.0, np.inf)
    rows = np.flatnonzero((n > 0) & (m > 0))
    rows = rows[np.argsort(-(n + m)[rows], kind="stable")]  # the pairs still open are the first columns
    if not len(rows):
        return out
    n, m = n[rows], m[rows]
    width, height, last_step = int(n.max()), int(m.max()), n + m
    xt, yt = np.ascontiguousarray(x[rows, :width].T), np.ascontiguousarray(y[rows, :height].T[::-1])
    before, last, now = (np.full((width + 2, len(rows)), np.inf) for _ in range(3))
    cost = np.empty((width, len(rows)))
    before[0] = 0.0
    p = len(rows)
    for k in range(2, int(last_step[0]) + 1):
        lo, hi = max(1, k - height), min(width, k - 1)
        now[lo - 1, :p] = now[hi + 1, :p] = np.inf
        c, d = cost[:hi - lo + 1, :p], now[lo:hi + 1, :p]
        np.subtract(xt[lo - 1:hi, :p], yt[height - k + lo:height - k + hi + 1, :p], out=c)
        np.abs(c, out=c)
        np.minimum(last[lo - 1:hi, :p], last[lo:hi + 1, :p], out=d)
        np.minimum(d, before[lo - 1:hi, :p], out=d)
        d += c
        done = p
        while p and last_step[p - 1] == k:
            p -= 1
        out[rows[p:done]] = now[n[p:done], np.arange(p, done)]
        before, last, now = last, now, before
    return out


def euclidean_batch(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.sum((x - y) ** 2, axis=1))


# Squared distances below this share of both squared lengths are not left to
# the matrix product, whose error is relative to the lengths.
NEAR_SHARE = 1e-6


def squared_matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of every x to every y by one matrix product;
    those of near pairs by coordinates, so all are right to 1e-9 of their size."""
    lengths = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :]
    out = x @ y.T
    out *= -2.0
    out += lengths
    lengths *= NEAR_SHARE
    i, j = np.nonzero(out <= lengths)
    step = max(1, TASK_BYTES // (8 * max(1, x.shape[1])))
    for s in range(0, len(i), step):
        out[i[s:s + step], j[s:s + step]] = ((x[i[s:s + step]] - y[j[s:s + step]]) ** 2).sum(axis=1)
    return out


KERNELS = {"dtw": dtw_batch, "euclidean": euclidean_batch}
PAIR_SCHEMA = T.StructType([T.StructField("id_a", T.StringType()), T.StructField("id_b", T.StringType()),
                            T.StructField("distance", T.DoubleType())])


def _by_length(values: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, stacked vectors) for each vector length."""
    rows = [np.asarray(v, dtype=float) for v in values]
    sizes = np.array([len(v) for v in rows])
    return [(at, np.stack([rows[i] for i in at])) for n in np.unique(sizes) for at in [np.flatnonzero(sizes == n)]]


# Pairs that one step of the DTW kernel evaluates: its buffers stay in cache.
KERNEL_PAIRS = 512
# Distances that agree to so many places are tied.
TIE_PLACES = 9


def kernel_pairs(n: int, m: int, band: int | None = None) -> int:
    """Pairs of one kernel step: ``KERNEL_PAIRS``, up to four times as many
    where a band makes the diagonals shorter."""
    width = n if band is None else min(n, max(band, abs(n - m)) + 1)
    return KERNEL_PAIRS * min(4, max(1, n // max(1, width)))


def _pair_task(metric: str, band: int | None = None):
    kernel = (lambda x, y: dtw_batch(x, y, band)) if metric == "dtw" else KERNELS[metric]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right, same = left.to_pandas(), right.to_pandas(), key[0].as_py() == key[1].as_py()
        out = [pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())],
                        names=PAIR_SCHEMA.names)]
        if left.empty or right.empty:
            return out[0]
        # ids are compared by their places in order, and written by them
        names, place = np.unique(np.concatenate([left["id"].astype(str).to_numpy(object), right["id"].astype(str).to_numpy(object)]),
                                 return_inverse=True)
        li, ri, names = place[:len(left)], place[len(left):], pa.array(names, pa.string())
        for la, x in _by_length(left["v"]):
            for rb, y in _by_length(right["v"]):
                # pairs of equal lengths are evaluated together, a bounded number at a time
                a, b = li[la][:, None], ri[rb][None, :]
                ia, ib = np.nonzero(a < b if same else a != b)
                if not len(ia):
                    continue
                a, b, step, d = li[la[ia]], ri[rb[ib]], kernel_pairs(x.shape[1], y.shape[1], band), np.empty(len(ia))
                for k in range(0, len(ia), step):
                    d[k:k + step] = kernel(x[ia[k:k + step]], y[ib[k:k + step]])
                out.append(pa.table([names.take(pa.array(np.minimum(a, b))), names.take(pa.array(np.maximum(a, b))), pa.array(d)],
                                    names=PAIR_SCHEMA.names))
        return pa.concat_tables(out)

    return run


def pairwise(items: DataFrame, id_col: str, value_col: str, metric: str = "dtw",
             blocks: int | None = None, band: int | None = None) -> DataFrame:
    """M4 (``dtw``) or Euclidean distances for every unordered item pair:
    (id_a, id_b, distance) with id_a < id_b. ``blocks`` defaults to
    ``pair_blocks`` of the items and cores (one count job). ``band`` limits how
    far DTW may warp (see ``dtw_batch``)."""
    if metric not in KERNELS:
        raise ValueError(f"metric must be one of {sorted(KERNELS)}")
    # the item table (n rows) is materialised once: both block sides and the
    # count read it instead of re-running the plan that produced it
    src = cut_lineage(items.select(F.col(id_col).cast("string").alias("id"),
                                   F.col(value_col).cast("array<double>").alias("v")))
    if blocks is None:
        blocks = pair_blocks(src.count(), src.sparkSession.sparkContext.defaultParallelism)
    left, right = block_pairs(src, "id", blocks, upper=True)
    return (left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj"))
            .applyInArrow(_pair_task(metric, band), PAIR_SCHEMA))


def dtw_bounds(x: np.ndarray, y: np.ndarray, band: int | None = None) -> np.ndarray:
    """Lower bounds of the DTW distances of every x (P, n) to every y (Q, m):
    each value of the one is aligned with a value of the other within the
    band, so it costs at least its distance to their range (the envelope);
    the larger of both directions. A matrix (P, Q)."""
    def one_way(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = a.shape[1], b.shape[1]
        reach = n + m if band is None else max(band, abs(n - m))
        out = np.zeros((len(a), len(b)))
        for i in range(n):
            if n > 1 and i in (0, n - 1) and m:  # the ends are aligned with each other
                out += np.abs(a[:, i:i + 1] - b[None, :, 0 if i == 0 else m - 1])
                continue
            lo, hi = max(0, i - reach), min(m, i + reach + 1)
            if lo < hi:
                low, high = b[:, lo:hi].min(axis=1), b[:, lo:hi].max(axis=1)
                v = a[:, i:i + 1]
                out += np.maximum(np.maximum(low[None, :] - v, v - high[None, :]), 0)
        return out

    return np.maximum(one_way(x, y), one_way(y, x).T)


def _one_way_ranges(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    low, high, first, last = (np.array([f(v) if len(v) else 0.0 for v in b]) for f in (np.min, np.max, lambda v: v[0], lambda v: v[-1]))
    out = np.zeros((len(a), len(b)))
    excess = lambda v: np.maximum(np.maximum(low - v, v - high), 0)
    for row, v in zip(out, a):
        if len(v):
            order, sums = np.sort(v), np.concatenate([[0.0], np.cumsum(np.sort(v))])
            below, upto = order.searchsorted(low), order.searchsorted(high, "right")
            row += low * below - sums[below] + (sums[-1] - sums[upto]) - high * (len(v) - upto)
            if len(v) > 1:  # the ends are aligned with each other
                row += np.abs(v[0] - first) - excess(v[0]) + np.abs(v[-1] - last) - excess(v[-1])
    out[:, [not len(v) for v in b]] = 0.0
    return out


def range_bounds(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``dtw_bounds`` without a band for series of any lengths at once, less
    what sums in another order can be off by: a series' costs to a range are
    read off its sorted values and their running sums. NaN for values that are
    not finite."""
    out = np.maximum(_one_way_ranges(a, b), _one_way_ranges(b, a).T)
    sides = [(max(map(len, s), default=0), max((np.abs(v[np.isfinite(v)]).max(initial=0.0) for v in s), default=0.0)) for s in (a, b)]
    out -= 1e-14 * max(n for n, _ in sides) * max(v for _, v in sides)
    for s, rows in ((a, out), (b, out.T)):
        rows[[not np.isfinite(v).all() for v in s]] = np.nan
    return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(v) for v in rows])
    out = np.zeros((len(rows), int(sizes.max(initial=0))))
    for v, into in zip(rows, out):
        into[:len(v)] = v
    return out, sizes


def _block_bounds(lv: pd.Series, rv: pd.Series, band: int | None) -> np.ndarray:
    if band is None:
        with np.errstate(invalid="ignore"):
            return range_bounds(*([np.asarray(v, dtype=float) for v in side] for side in (lv, rv)))
    out = np.full((len(lv), len(rv)), np.inf)
    for la, x in _by_length(lv):
        for rb, y in _by_length(rv):
            out[np.ix_(la, rb)] = dtw_bounds(x, y, band)
    return out


def _block_distances(lv: pd.Series, rv: pd.Series, band: int | None):
    """A function (i, j) -> the distances of these pairs: without a band pairs
    of like lengths together, else of equal lengths."""
    (x, n), (y, m) = (_padded([np.asarray(v, dtype=float) for v in side]) for side in (lv, rv))

    def of(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, order = np.empty(len(i)), np.lexsort((m[j], n[i]))
        cuts = np.flatnonzero(np.diff(n[i[order]]) | np.diff(m[j[order]])) + 1 if band is not None else []
        for same in np.split(order, cuts):
            for k in range(0, len(same), KERNEL_PAIRS):
                at = same[k:k + KERNEL_PAIRS]
                p, q = i[at], j[at]
                out[at] = dtw_mixed(x[p], n[p], y[q], m[q]) if band is None else dtw_batch(x[p, :n[p[0]]], y[q, :m[q[0]]], band)
        return out

    return of


def _nearest_task(band: int | None):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"id": pd.Series([], dtype=object), "neighbour": pd.Series([], dtype=object),
                                 "distance": pd.Series([], dtype="float64"), "evaluated": pd.Series([], dtype="int64"),
                                 "skipped": pd.Series([], dtype="int64")})
        left, right = left.sort_values("id"), right.sort_values("id")  # of tied distances the smaller id is found first
        within = key[0] == key[1]
        if within:
            right = left
        li, ri = left["id"].astype(str).to_numpy(), right["id"].astype(str).to_numpy()
        distances = _block_distances(left["v"], right["v"], band)
        bound = _block_bounds(left["v"], right["v"], band)
        bound *= 1 - 1e-12  # a bound is a sum in another order than the distance
        bound[li[:, None] == ri[None, :]] = np.inf
        open_pairs = np.isfinite(bound)
        total, known = int(open_pairs.sum()) * (1 if within else 2), np.full(bound.shape, np.inf)
        # the most promising candidates of every item of both sides first, twice as many each turn, while they can still be as near
        share, evaluated = 1, 0
        while open_pairs.any():
            left_out = np.where(open_pairs, bound, np.inf)
            chosen = np.zeros_like(open_pairs)
            for axis in (0, 1):
                most = min(share, bound.shape[axis])
                np.put_along_axis(chosen, np.take(np.argpartition(left_out, most - 1, axis=axis), range(most), axis=axis), True, axis=axis)
            if within:
                chosen |= chosen.T
            chosen &= open_pairs
            open_pairs &= ~chosen
            i, j = np.nonzero(np.triu(chosen) if within else chosen)
            known[i, j] = distances(i, j).round(TIE_PLACES)
            if within:
                known[j, i] = known[i, j]
            evaluated += len(i)
            # what stays open has a bound below the best so far of one of its items
            best = np.maximum(known.min(axis=1)[:, None], known.min(axis=0)[None, :])
            open_pairs &= bound <= best + 10.0 ** -TIE_PLACES
            share *= 2
        found = []
        for ids, others, d in ((li, ri, known), (ri, li, known.T))[:1 if within else 2]:
            who = d.argmin(axis=1)
            nearest_d = d[np.arange(len(ids)), who]
            at = np.flatnonzero(np.isfinite(nearest_d))
            found.append(pd.DataFrame({"id": ids[at], "neighbour": others[who[at]], "distance": nearest_d[at]}))
        out = pd.concat(found, ignore_index=True).assign(evaluated=0, skipped=0)
        if len(out):  # the counts of the task are on its first row
            out.loc[0, ["evaluated", "skipped"]] = evaluated, total - evaluated
        return out

    return run


def nearest(items: DataFrame, id_col: str, value_col: str, band: int | None = None,
            blocks: int | None = None) -> DataFrame:
    """M4: the nearest other item of every item by DTW, ties by the smaller
    id, where distances are rounded to ``TIE_PLACES`` so that ties do not hang
    on the last bits of a sum: (id, neighbour, distance, evaluated, skipped). Candidates are taken by
    rising lower bound, and a pair whose bound is above the best so far of both its items
    is skipped. A distance serves both items: of the ordered pairs, as many as distances are
    evaluated, the others skipped; both numbers are summed over the items that a
    block's tasks listed first (their totals are those of the whole)."""
    src = cut_lineage(items.select(F.col(id_col).cast("string").alias("id"),
                                   F.col(value_col).cast("array<double>").alias("v")))
    if blocks is None:  # large blocks know a near one sooner
        blocks = n_blocks(src.count(), PAIR_BLOCK_ITEMS, src.sparkSession.sparkContext.defaultParallelism)
    left, right = block_pairs(src, "id", blocks, upper=True)
    part = (left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj"))
            .applyInPandas(_nearest_task(band), "id string, neighbour string, distance double, evaluated bigint, skipped bigint"))
    return (part.groupBy("id").agg(F.min(F.struct("distance", "neighbour")).alias("m"), F.sum("evaluated").alias("evaluated"),
                                   F.sum("skipped").alias("skipped"))
            .select("id", "m.neighbour", "m.distance", "evaluated", "skipped"))


def numbered(ids: DataFrame, id_col: str) -> DataFrame:
    """(id, number): the distinct ids numbered from 0 in their order, without
    one task that sees all of them: ids are range-partitioned and sorted, and
    each partition's numbers start at the sum of the sizes before it."""
    ordered = cut_lineage(ids.select(F.col(id_col).alias("id")).distinct().repartitionByRange("id").sortWithinPartitions("id")
                          .select("id", F.spark_partition_id().alias("part"),
                                  F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ordered.join(F.broadcast(starts), "part").select("id", (F.col("start") + F.col("at")).alias("number"))


def condensed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5: the pair table as a condensed vector (place, distance), the upper
    triangle row by row, and the items' numbers (id, number). The pair (i, j)
    of n items, i < j, is at n i - i (i + 1) / 2 + j - i - 1."""
    items = cut_lineage(numbered(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")), "id"))
    n = items.select(F.count(F.lit(1))).scalar()
    i, j = F.col("i"), F.col("j")
    placed = (pairs.join(items.toDF("id_a", "i"), "id_a").join(items.toDF("id_b", "j"), "id_b")
              .select((n * i - F.expr("i * (i + 1) div 2") + j - i - 1).alias("place"), "distance"))
    return placed, items


def uncondensed(vector: DataFrame, n: F.Column) -> DataFrame:
    """(place, i, j, distance) from a condensed vector over ``n`` items. The
    row is the root of a quadratic, mended by one where the double is off."""
    start = lambda i: n * i - F.floor(i * (i + 1) / 2)  # noqa: E731  place of the first pair of row i
    guess = F.floor((2 * n - 1 - F.sqrt((2 * n - 1) * (2 * n - 1) - 8 * F.col("place"))) / 2).cast("bigint")
    i = F.when(start(guess) > F.col("place"), guess - 1).when(start(guess + 1) <= F.col("place"), guess + 1).otherwise(guess)
    rows = vector.withColumn("i", i)
    return rows.select("place", "i", (F.col("place") - start(F.col("i")) + F.col("i") + 1).cast("bigint").alias("j"), "distance")


def mirrored(pairs: DataFrame) -> DataFrame:
    """M5: the square matrix as a long table: both orientations of every pair
    plus a zero diagonal (rows i, j, distance)."""
    ids = pairs.select(F.col("id_a").alias("i")).union(pairs.select(F.col("id_b").alias("i"))).distinct()
    return (pairs.select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), "distance")
            .unionByName(pairs.select(F.col("id_b").alias("i"), F.col("id_a").alias("j"), "distance"))
            .unionByName(ids.select("i", F.col("i").alias("j"), F.lit(0.0).alias("distance"))))


SUMS_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("other_label", T.StringType()),
                            T.StructField("dist_sum", T.DoubleType()), T.StructField("n", T.LongType())])


def list_matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column as the rows of one matrix, without a
    Python object for each. They must be there and of one length."""
    sizes = column.value_lengths()
    if column.null_count or len(sizes.unique()) > 1:
        raise ValueError("vectors must not be null and must be of one length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(len(column), sizes[0].as_py() if len(column) else 0)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def _label_sums(ids, sums: np.ndarray, uniq, counts) -> pd.DataFrame:
    return pd.DataFrame({"id": np.repeat(ids, len(uniq)), "other_label": np.tile(uniq, len(ids)),
                         "dist_sum": sums.ravel(), "n": np.tile(counts, len(ids)).astype(np.int64)})


def _sums_task(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The sums of both blocks' points over the labels of the other block; a
    block against itself gives them once."""
    if left.empty or right.empty:
        return pd.DataFrame({"id": pd.Series([], dtype=object), "other_label": pd.Series([], dtype=object),
                             "dist_sum": pd.Series([], dtype="float64"), "n": pd.Series([], dtype="int64")})
    sides = []
    for rows in (left, right):
        uniq, inv = np.unique(rows["label"].astype(str).to_numpy(), return_inverse=True)
        member = np.zeros((len(rows), len(uniq)))
        member[np.arange(len(rows)), inv] = 1.0
        sides.append((rows["id"].astype(str).to_numpy(), _stacked(rows["v"]), uniq, member))
    (li, lv, lu, lm), (ri, rv, ru, rm) = sides
    to_right, to_left = np.zeros((len(lv), len(ru))), np.zeros((len(rv), len(lu)))
    chunk = max(1, TASK_BYTES // (8 * len(rv)))  # bounds the (chunk, m) temporaries
    for s in range(0, len(lv), chunk):
        d = np.sqrt(squared_matrix(lv[s:s + chunk], rv))
        to_right[s:s + chunk] = d @ rm
        if key[0] != key[1]:
            to_left += d.T @ lm[s:s + chunk]
    out = [_label_sums(li, to_right, ru, rm.sum(axis=0))]
    if key[0] != key[1]:
        out.append(_label_sums(ri, to_left, lu, lm.sum(axis=0)))
    return pd.concat(out, ignore_index=True)


def distance_sums(points: DataFrame, id_col: str, label_col: str, value_col: str,
                  blocks: int | None = None) -> DataFrame:
    """For every point and every cluster label: the sum of Euclidean
    distances from the point to the members of that cluster, and their
    number (self included). Output is n x (labels) rows."""
    src = cut_lineage(points.select(F.col(id_col).cast("string").alias("id"),
                                    F.col(label_col).cast("string").alias("label"),
                                    F.col(value_col).cast("array<double>").alias("v")))
    if blocks is None:
        blocks = _blocks_for(src, VECTOR_BLOCK_ITEMS)
    left, right = block_pairs(src, "id", blocks, upper=True)
    part = (left.groupBy("bi", "bj").cogroup(right.groupBy("bi", "bj"))
            .applyInPandas(_sums_task, SUMS_SCHEMA))
    return part.groupBy("id", "other_label").agg(F.sum("dist_sum").alias("dist_sum"), F.sum("n").alias("n"))


MULTI_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("k_index", T.IntegerType()),
                             T.StructField("other_label", T.StringType()),
                             T.StructField("dist_sum", T.DoubleType()), T.StructField("n", T.LongType())])


def _multi_sums_task(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"id": pd.Series([], dtype=object), "k_index": pd.Series([], dtype="int32"),
                             "other_label": pd.Series([], dtype=object),
                             "dist_sum": pd.Series([], dtype="float64"), "n": pd.Series([], dtype="int64")})
    lv = np.stack([np.asarray(v, dtype=float) for v in left["v"]])
    rv = np.stack([np.asarray(v, dtype=float) for v in right["v"]])
    labels = np.stack([np.asarray(x, dtype=object) for x in right["labels"]]).astype(str)  # (m, K)
    ids = left["id"].astype(str).to_numpy()
    groups = [np.unique(labels[:, k], return_inverse=True) for k in range(labels.shape[1])]
    sums = [np.zeros((len(lv), len(u))) for u, _ in groups]
    members = [(np.arange(len(u))[None, :] == inv[:, None]).astype(float) for u, inv in groups]
    chunk = max(1, TASK_BYTES // (8 * max(1, rv.size)))
    for s0 in range(0, len(lv), chunk):
        d = np.sqrt(((lv[s0:s0 + chunk, None, :] - rv[None, :, :]) ** 2).sum(axis=2))
        for k, member in enumerate(members):
            sums[k][s0:s0 + chunk] = d @ member
    frames = []
    for k, (uniq, inv) in enumerate(groups):
        counts = np.bincount(inv, minlength=len(uniq))
        frames.append(pd.DataFrame({
            "id": np.repeat(ids, len(uniq)), "k_index": np.int32(k), "other_label": np.tile(uniq, len(ids)),
            "dist_sum": sums[k].ravel(), "n": np.tile(counts, len(ids)).astype(np.int64)}))
    return pd.concat(frames, ignore_index=True)


def distance_sums_multi(points: DataFrame, id_col: str, labels_col: str, value_col: str,
                        blocks: int | None = None) -> DataFrame:
    """``distance_sums`` for K labellings at once: ``labels_col`` is an array
    with one label per labelling. Each distance is computed once and added
    to the sums of every labelling (rows id, k_index, other_label, dist_sum,
    n), so a sweep over K values of k costs one all-pairs pass, not K."""
    src = cut_lineage(points.select(F.col(id_col).cast("string").alias("id"),
                                    F.col(labels_col).cast("array<string>").alias("labels"),
                                    F.col(value_col).cast("array<double>").alias("v")))
    if blocks is None:
        blocks = _blocks_for(src)
    left, right = block_pairs(src, "id", blocks, upper=False)
    part = (left.select("bi", "bj", "id", "v").groupBy("bi", "bj")
            .cogroup(right.select("bi", "bj", "labels", "v").groupBy("bi", "bj"))
            .applyInPandas(_multi_sums_task, MULTI_SCHEMA))
    return (part.groupBy("id", "k_index", "other_label")
            .agg(F.sum("dist_sum").alias("dist_sum"), F.sum("n").alias("n")))
