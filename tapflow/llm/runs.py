"""Periodic runs of words by maximal-pair enumeration.

Two places i < j form a maximal pair of length l if the l words from each are
equal, the words before them differ and the words after them differ. If
l >= j - i, the stretch from i to j + l has period j - i and no neighbouring
word extends it. So the maximal pairs whose distance p satisfies
l >= max(min_length - p, (exponent - 1) * p) are exactly the runs of length
max(min_length, exponent * p) or more, each found once for its smallest period
and once for multiples of it that fit as often; the smallest distance of a
stretch is its period. No stretch is extended afterwards.

Pairs are enumerated on the tree of LCP intervals, bottom-up. The words of a
slice of documents are numbered apart for each document, so one suffix order
of all of them serves the slice and no interval spans two documents. The order
comes from prefix doubling, whose ranks also give the length of the common
prefix of two places. An interval carries its places by the word on their
left: sorted, with the places marked where a new class of left words begins.
When a child joins its parent, each place of the smaller side looks, in the
larger side, through the places within the distance that the length allows,
and leaps over those of its own class. Every place met is thus a pair to
report, and no list of a whole class is formed against another. Intervals
too short for any run are never opened.

Places before the first and after the last word differ from every word.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapflow.llm.text import map_texts

MIN_LENGTH, EXPONENT = 6, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def number_words(texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The words of each text, all words as numbers that are equal only for
    equal words of one text, and the places where texts start (with the end)."""
    split = [WORD.findall(t) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    numbers, base = np.empty(int(ends[-1]), np.int64), 0
    for k, words in enumerate(split):
        seen: dict[str, int] = {}
        numbers[ends[k]:ends[k + 1]] = [seen.setdefault(w, len(seen)) for w in words]
        numbers[ends[k]:ends[k + 1]] += base
        base += len(seen)
    return split, numbers, ends


def suffix_order(numbers: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in suffix order (a suffix ends with its text), and for each two
    neighbours in it the number of words they share."""
    n = len(numbers)
    rank = np.unique(numbers, return_inverse=True)[1].astype(np.int64) + 1
    stop = np.repeat(ends[1:], np.diff(ends))  # end of the text of each place
    levels, span = [rank], 1
    order = np.argsort(rank, kind="stable")
    while True:
        at = np.arange(n) + span
        ahead = np.where(at < stop, rank[np.minimum(at, n - 1)], 0)  # 0: the text has ended
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        done = int(new.max()) == n or span >= n
        rank = new
        if done:
            break
        span *= 2
        levels.append(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < stop[order[:-1]]) & (b < stop[order[1:]])
        # ranks of a level are equal where 2**k words are, or both texts end alike, which two places of one text never do
        equal = inside.copy()
        equal[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        shared += equal * (1 << k)
        a += equal * (1 << k)
        b += equal * (1 << k)
    return order, shared


class Places:
    """Places of an LCP interval, sorted, and those of them whose left word
    differs from that of the place before them (a new class begins)."""

    __slots__ = ("all", "starts")

    def __init__(self, place: int):
        self.all, self.starts = [place], [place]

    def add(self, other: "Places", left: list[int]) -> None:
        if len(other.all) * 8 < len(self.all):
            for x in other.all:
                self.insert(x, left)
            return
        self.all = sorted(self.all + other.all)
        before = [None, *map(left.__getitem__, self.all)]
        self.starts = [x for x, a, b in zip(self.all, before, before[1:]) if a != b]

    def insert(self, x: int, left: list[int]) -> None:
        at = bisect_left(self.all, x)
        if at == 0 or left[self.all[at - 1]] != left[x]:
            insort(self.starts, x)
        self.all.insert(at, x)
        if at + 1 < len(self.all):
            after = self.all[at + 1]
            k = bisect_left(self.starts, after)
            marked = k < len(self.starts) and self.starts[k] == after
            if (left[after] != left[x]) != marked:
                if marked:
                    del self.starts[k]
                else:
                    self.starts.insert(k, after)

    def partners(self, x: int, reach: int, left: list[int]):
        """The places within ``reach`` of ``x`` of another class than its own."""
        own, places, starts = left[x], self.all, self.starts
        at = bisect_right(places, x)
        k = at
        while k < len(places) and places[k] - x <= reach:
            if left[places[k]] != own:
                yield places[k]
                k += 1
            else:  # leap to where the next class begins
                s = bisect_right(starts, places[k])
                if s == len(starts):
                    break
                k = bisect_left(places, starts[s])
        k = at - 1
        while k >= 0 and x - places[k] <= reach:
            if left[places[k]] != own:
                yield places[k]
                k -= 1
            else:  # leap over the class that this place is in
                s = bisect_right(starts, places[k]) - 1
                k = bisect_left(places, starts[s]) - 1


def interval_pairs(order: list[int], shared: list[int], left: list[int], min_length: int, exponent: int):
    """Maximal pairs (i, j, length) that are runs, of the places ``order`` in
    suffix order, of which neighbours share ``shared`` words. The stack holds
    the open intervals, from the root down."""
    def join(parent: Places, child: Places, length: int):
        small, large = (parent, child) if len(parent.all) < len(child.all) else (child, parent)
        reach = length // (exponent - 1)
        for x in small.all:
            for y in large.partners(x, reach, left):
                i, j = (x, y) if x < y else (y, x)
                if length >= min_length - (j - i):
                    yield i, j, length
        large.add(small, left)
        return large

    stack = [(0, None)]  # (length, places): places is None while the interval has no child
    node = Places(order[0])
    for place, length in zip([*order[1:], None], [*shared, 0]):
        while stack[-1][0] > length:
            top, places = stack.pop()
            node = yield from join(places, node, top)
        if place is None:
            return
        if stack[-1][0] == length and stack[-1][1] is not None:
            top, places = stack.pop()
            node = yield from join(places, node, top)
        elif stack[-1][0] == length:
            stack.pop()
        stack.append((length, node))
        node = Places(place)


def find_runs(numbers: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH,
              exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(ends) - 1)]
    if len(numbers) > 1:
        order, shared = suffix_order(numbers, ends)
        # the shortest common prefix of a run: (exponent - 1) p words, and min_length - p
        least = min(max(min_length - p, (exponent - 1) * p) for p in range(1, min_length + 1))
        long = np.concatenate([[False], shared >= least, [False]])
        edges = np.flatnonzero(long[1:] != long[:-1])  # stretches of places in intervals long enough
        if len(edges):
            left = numbers[np.arange(len(numbers)) - 1].copy()
            firsts = ends[:-1][np.diff(ends) > 0]
            left[firsts] = -1  # before the first word
            left, text_of = left.tolist(), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                text = int(text_of[order[a]])
                runs, offset = found[text], int(ends[text])
                for i, j, length in interval_pairs(order[a:b + 1].tolist(), shared[a:b].tolist(), left, min_length, exponent):
                    key = (i - offset, j - i + length)
                    runs[key] = min(runs.get(key, j - i), j - i)
    return [sorted(((s, n, p) for (s, n), p in runs.items()), key=lambda r: (r[0], r[2])) for runs in found]


def kept_words(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


def scan_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              exponent: int = EXPONENT) -> DataFrame:
    """(id, runs, collapsed) of every row: all runs as an array of (start,
    length, period) by start and period, and the text's words without the
    repeats, joined by one space.

    Defined results: a null or empty text has no runs and collapses to the
    empty string; a text of any length is searched whole; every row has its
    own result, repeated rows and null ids included; an empty table gives no
    rows; columns other than the id and the text are not read, so their names
    never clash."""
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))

    def kernel():
        def run(texts: list[str]) -> list[pa.Array]:
            split, numbers, ends = number_words(texts)
            runs = find_runs(numbers, ends, min_length, exponent)
            flat = np.array([r for x in runs for r in x], np.int64).reshape(-1, 3)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            return [pa.ListArray.from_arrays(pa.array(offsets), structs),
                    pa.array([" ".join(kept_words(w, r)) for w, r in zip(split, runs)], pa.string())]
        return run

    return map_texts(df, id_col, text_col, [("runs", run_type), ("collapsed", T.StringType())], kernel)
