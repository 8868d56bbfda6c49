"""Ranked lexical search with per-term geometric blocking.

The documents with the most weight of each item's terms are found, exactly.
A document's weight of a term depends on the term and the document alone, so a
document is a vector over the items' terms and its score the sum of the
coordinates that the item has.

1. One scan makes the forward table: for each document its number of terms and
   the counts of the terms that items have. Its totals and the document counts
   of the terms give the weights.
2. Tasks read the forward table a shard of documents at a time. Within a shard
   each term's posting list is clustered by the similarity of its documents
   (nearest pivot by cosine, of random projections), and every cluster is a
   block with the coordinatewise maximum of its documents as its summary.
   Items meet their terms from the rarest to the commonest. A block whose
   summary, summed over the item's terms, is below the item's lowest place so
   far holds no document that could enter and is skipped; the others are
   scored in full. A document that an earlier list of the item held is decided
   already, so a summary needs only the terms not yet met, and an item is done
   once the greatest coordinates of those add up to less than its lowest
   place. Bounds are sums of exact maxima: nothing is lost by skipping.
3. A first search through one hash class of documents in ``FLOOR_PART`` gives
   each item a floor, the score of its last place there, below which no
   document can be among its best. The search through all documents starts
   from the floors, so tasks return few documents beyond the result, however
   many tasks there are; a ranking of those is the only shuffle.

Items are taken in passes of at most ``PASS_BYTES`` of text on average, which
bounds what is broadcast.

Defined results: a null or empty document has no terms and is never found;
items without terms, or whose terms no document has, get no rows; rows of one
item id are one item with the terms of all its rows, a null id included; rows
of one document id are documents of their own, each ranked; equal scores rank
by document id, null last; texts of any length are read whole; empty tables
give no rows; other columns of either table are not read, so their names never
clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapflow.llm.text import strings, text_slices
from tapflow.operators.common import cut_lineage

TOP = 50
PASS_BYTES = 256 << 10  # item text of one pass
SHARD_CELLS = 4 << 20  # cells of a shard's matrix of documents and terms
BLOCK = 32  # documents of a block, on average
PROJECTIONS = 32
FLOOR_PART = 16  # the floors come from one document in so many
# Bytes that terms are made of, upper-case letters as lower-case, others as spaces.
LETTERS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    """The terms of a text: stretches of digits, letters and characters
    beyond ASCII, with A-Z lowered."""
    return text.encode("utf-8").translate(LETTERS).split()


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def coordinates(weights: np.ndarray, counts: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Weight of a term in a document: of the term's weight, its count in the
    document and the document's number of terms."""
    m = 50 + (50 * lengths * documents) // total
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


class Best:
    """The ``top`` best (score, id) of an item, and the score to reach."""

    __slots__ = ("top", "rows", "reach")

    def __init__(self, top: int, floor: int):
        self.top, self.rows, self.reach = top, [], max(1, floor)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.reach)
        if len(good) > self.top:
            last = np.partition(scores[good], len(good) - self.top)[len(good) - self.top]
            good = good[scores[good] >= last]
        if len(good):
            new = [(-s, i is None, i) for s, i in zip(scores[good].tolist(), ids[good].tolist())]
            self.rows = sorted(self.rows + new, key=lambda r: r if not r[1] else r[:2])[:self.top]
            if len(self.rows) == self.top:
                self.reach = max(self.reach, -self.rows[-1][0])


class Search:
    """Items searched shard by shard. ``items`` holds the sorted term numbers
    of each item; terms are numbered from the rarest."""

    def __init__(self, items: list[np.ndarray], floors: list[int], top: int = TOP, block: int = BLOCK):
        self.items, self.block = items, block
        self.best = [Best(top, f) for f in floors]
        self.users: dict[int, list[int]] = {}
        for q, terms in enumerate(items):
            for t in terms.tolist():
                self.users.setdefault(t, []).append(q)
        self.blocks = self.skipped = 0

    def clusters(self, docs: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a posting list ordered by cluster, and where the
        clusters start."""
        n = -(-len(docs) // self.block)
        if n < 2:
            return docs, np.zeros(1, np.int64)
        pivots = docs[(np.arange(n) * len(docs)) // n]
        nearest = np.argmax(points[docs] @ points[pivots].T, axis=1)
        order = np.argsort(nearest, kind="stable")
        nearest = nearest[order]
        return docs[order], np.flatnonzero(np.concatenate([[True], nearest[1:] != nearest[:-1]]))

    def shard(self, ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray) -> None:
        """Search documents ``ids``; entry k says that document ``rows[k]``
        has the coordinate ``values[k]`` (above 0) at term ``terms[k]``."""
        if not len(rows):
            return
        local, column = np.unique(terms, return_inverse=True)
        matrix = np.zeros((len(ids), len(local)), np.int64)
        matrix[rows, column] = values
        greatest = matrix.max(axis=0)
        own, rest, live = {}, {}, set()
        for q, wanted in enumerate(self.items):
            at = np.searchsorted(local, wanted)
            at = at[(at < len(local)) & (local[np.minimum(at, len(local) - 1)] == wanted)]
            if len(at) and greatest[at].sum() >= self.best[q].reach:
                own[q], rest[q] = at, np.cumsum(greatest[at][::-1])[::-1]
                live.add(q)
        if not live:
            return
        signs = np.random.default_rng(7).choice(np.float32([-1, 1]), (len(local), PROJECTIONS))
        points = matrix.astype(np.float32) @ signs
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1)
        by_column = np.argsort(column, kind="stable")
        ends = np.cumsum(np.bincount(column, minlength=len(local)))
        met, seen = dict.fromkeys(live, 0), {q: np.zeros(len(ids), bool) for q in live}
        for c, t in enumerate(local.tolist()):
            asking = []
            for q in self.users.get(t, ()):
                if q in live:
                    k = met[q]
                    met[q] = k + 1
                    if rest[q][k] < self.best[q].reach:
                        live.remove(q)  # what is left cannot reach
                    else:
                        asking.append((q, own[q][k:]))
            if not asking:
                continue
            posting = rows[by_column[(ends[c - 1] if c else 0):ends[c]]]
            docs, starts = self.clusters(posting, points)
            wanted = np.unique(np.concatenate([left for _, left in asking]))
            summary = np.maximum.reduceat(matrix[np.ix_(docs, wanted)], starts, axis=0)
            sizes = np.diff(np.append(starts, len(docs)))
            for q, left in asking:
                open_block = summary[:, np.searchsorted(wanted, left)].sum(axis=1) >= self.best[q].reach
                self.blocks += len(starts)
                self.skipped += len(starts) - int(open_block.sum())
                if open_block.any():
                    found = docs[np.repeat(open_block, sizes)]
                    found = found[~seen[q][found]]
                    seen[q][found] = True
                    self.best[q].offer(matrix[np.ix_(found, own[q])].sum(axis=1), ids[found])


def item_passes(items: DataFrame, item_col: str, text_col: str, pass_bytes: int) -> Iterator[list[tuple]]:
    """The items of each pass as (id, set of terms) on the driver."""
    rows = items.select(F.col(item_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).distinct()
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    passes = int(max(1, -(-total // pass_bytes)))
    for k in range(passes):
        found: dict = {}
        for r in rows.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == k).collect():
            found.setdefault(r["i"], set()).update(terms_of(r["t"]))
        yield [(i, t) for i, t in found.items() if t]


def forward_table(df: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """(id, n, terms, counts) of the documents with terms: the number of all
    terms, and those of ``vocabulary`` by their place in it."""
    number = df.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches):
        known = number.value
        for batch in batches:
            for part in text_slices(batch, 1):
                at, lengths, terms, counts = [], [], [], []
                for k, text in enumerate(strings(part.column(1))):
                    words = terms_of(text)
                    if words:
                        held = Counter(filter(known.__contains__, words))
                        at.append(k)
                        lengths.append(len(words))
                        terms.append([known[w] for w in held])
                        counts.append(list(held.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(lengths, pa.int64()),
                     pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], schema.names)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def best_documents(forward: DataFrame, items: list[np.ndarray], order: np.ndarray, weights: np.ndarray,
                   documents: int, total: int, floors: list[int], top: int) -> DataFrame:
    """(item, id, score) of the documents that each task ranks among its best
    of an item, an item being its place in ``items``."""
    given = forward.sparkSession.sparkContext.broadcast((items, order, weights, floors))
    schema = T.StructType([T.StructField("item", T.IntegerType()), forward.schema["id"], T.StructField("score", T.LongType())])

    def run(batches):
        items, order, weights, floors = given.value
        search = Search(items, floors, top)
        rows_each = max(1, SHARD_CELLS // max(1, len(weights)))
        for batch in batches:
            id_type_here = batch.column(0).type
            for start in range(0, batch.num_rows, rows_each):
                part = batch.slice(start, rows_each)
                sizes = np.asarray(part.column(2).value_lengths())
                rows = np.repeat(np.arange(part.num_rows), sizes)
                terms = order[np.asarray(part.column(2).flatten())]
                values = coordinates(weights[terms], np.asarray(part.column(3).flatten()).astype(np.int64),
                                     np.asarray(part.column(1))[rows], documents, total)
                keep = values > 0
                ids = np.empty(part.num_rows, object)
                ids[:] = part.column(0).to_pylist()
                search.shard(ids, rows[keep], terms[keep], values[keep])
        out = [(q, i, -s) for q, best in enumerate(search.best) for s, _, i in best.rows]
        if out:
            q, i, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, id_type_here), pa.array(s, pa.int64())],
                                             schema.names)

    return forward.mapInArrow(run, schema)


def search_items(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", top: int = TOP,
                 pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(item id, rank, id, score): the ``top`` best documents of every item."""
    spark, out = df.sparkSession, None
    item_field, id_field = items.schema[item_col], df.schema[id_col]
    place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)

    for chosen in item_passes(items, item_col, item_text, pass_bytes):
        vocabulary = sorted(set().union(*(t for _, t in chosen)))
        forward = cut_lineage(forward_table(df, id_col, text_col, vocabulary))
        size = forward.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        if not vocabulary or not size["n"]:
            continue
        holding = np.zeros(len(vocabulary), np.int64)
        for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            holding[r["t"]] = r["count"]
        order = np.empty(len(vocabulary), np.int64)  # rarest first
        order[np.argsort(holding, kind="stable")] = np.arange(len(vocabulary))
        weights = np.empty(len(vocabulary), np.int64)
        weights[order] = [term_weight(size["n"], h) for h in holding.tolist()]
        number = {t: int(order[k]) for k, t in enumerate(vocabulary) if holding[k]}
        terms = [np.array(sorted(number[t] for t in s if t in number), np.int64) for _, s in chosen]
        search = (terms, order, weights, size["n"], size["l"])
        part = forward.filter(F.pmod(F.xxhash64("id", "n"), F.lit(FLOOR_PART)) == 0)
        floors = [0] * len(chosen)
        for r in ranked(best_documents(part, *search, floors, top)).filter(F.col("rank") == top).collect():
            floors[r["item"]] = r["score"]
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(chosen)],
                                      T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", item_field.dataType)]))
        found = (ranked(best_documents(forward, *search, floors, top)).join(F.broadcast(names), "item")
                 .select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], T.StructType([
            T.StructField(item_col, item_field.dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(id_col, id_field.dataType), T.StructField("score", T.LongType())]))
    return out
