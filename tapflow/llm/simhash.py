"""SimHash near-duplicates: fingerprints, and exact pairs within a few bits
through vantage-point trees.

A fingerprint has 64 bits; a bit is set if more than half of the shingle
hashes (XXH64, shingles with repeats) have it. Distinct fingerprints are dealt
to shards by a vantage-point tree built from a bounded sample: a node holds a
vantage fingerprint and a radius ``mu``; what lies within ``mu + limit`` goes
to the near side and what lies beyond ``mu`` to the far side, so the border
shell goes to both. By the triangle inequality two fingerprints within
``limit`` bits always have a side in common: if neither is beyond
``mu + limit``, the near one, else both are beyond ``mu``. Every pair
therefore meets in at least one shard, and no pair outside a shard has to be
looked at. Inside a shard the same splitting goes on down to small blocks,
where distances are computed.

A block yields no pairs but, for each fingerprint, the smallest fingerprint
that it is connected to inside the block, so a dense group of copies yields
as many rows as it has members. The links between these are joined into
components by star contraction.

A text without words has the fingerprint zero and is linked like any other. A
null text counts as empty. Equal fingerprints form one class from the start
(grouped with map-side combining), so exact copies never meet pairwise. A null
id belongs to its component but is never the component's smallest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapflow.llm.components import connected_components, group_labels
from tapflow.llm.text import free_name, hash_sample, map_texts, strings, text_slices
from tapflow.operators.common import cut_lineage

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SAMPLE_ROWS = 8192  # fingerprints from which the shared part of the tree is built
SHARD_ROWS = 4096  # fingerprints that a shard is meant to hold
BLOCK_ROWS = 1024  # fingerprints compared directly
STRIPE_PAIRS = 1 << 20  # distances held at once
VANTAGES = 6  # candidates tried for each node
# Ids of rows to drop are broadcast up to this size; above it they are joined by a shuffle.
BROADCAST_BYTES, ID_BYTES = 32 << 20, 32


# --- fingerprints ----------------------------------------------------------
def fingerprint(raw: bytes, shingle: int = SHINGLE_WORDS) -> bytes:
    """The 8 bytes (big-endian) of a UTF-8 text's fingerprint."""
    import xxhash
    words = raw.lower().split()  # bytes: only A-Z, and \\x20 and \\x09-\\x0D
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = (ends - 1).tolist()
    k = min(shingle, len(words))
    counts = np.zeros(64, dtype=np.int64)
    n = len(words) - k + 1
    digest = xxhash.xxh64_digest
    for at in range(0, n, 65536):
        stop = min(n, at + 65536)
        buf = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:stop], last[at + k - 1:stop + k - 1])])
        bits = np.unpackbits(np.frombuffer(buf, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) for every row; ``fp`` holds the 64 bits as a signed long."""
    def kernel():
        def run(texts: list[str]) -> list[pa.Array]:
            raw = b"".join([fingerprint(t.encode("utf-8"), shingle) for t in texts])
            return [pa.array(np.frombuffer(raw, ">i8").astype(np.int64))]

        return run

    return map_texts(df, id_col, text_col, [("fp", T.LongType())], kernel)


# --- vantage-point trees ---------------------------------------------------
def distances(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v)


def split(x: np.ndarray, limit: int) -> tuple[np.uint64, int] | None:
    """(vantage, mu) that parts ``x`` best: least comparisons left when both
    sides are compared inside themselves. None if no split takes off a
    twentieth (all lie within the shell of every vantage tried)."""
    n, best = len(x), None
    for i in np.linspace(0, n - 1, VANTAGES).astype(int):
        within = np.cumsum(np.bincount(distances(x, x[i]), minlength=65 + limit)).astype(float)
        near, far = within[limit:65 + limit], n - within[:65]
        cost = near ** 2 + far ** 2
        cost[far == 0] = np.inf  # nothing beyond: not a split
        mu = int(np.argmin(cost))
        if np.isfinite(cost[mu]) and max(near[mu], far[mu]) <= 0.95 * n and (best is None or cost[mu] < best[0]):
            best = (cost[mu], x[i], mu)
    return None if best is None else best[1:]


def build_tree(sample: np.ndarray, total: int, limit: int, target: int) -> list[tuple]:
    """Nodes (vantage, mu, near, far); a child that is not positive is the
    leaf with that number negated. ``total`` fingerprints stand behind the sample."""
    nodes: list[tuple] = []
    scale, leaves = total / max(1, len(sample)), 0
    todo = [(np.sort(sample), None, 0)]
    while todo:
        x, parent, side = todo.pop()
        cut = split(x, limit) if len(x) > 8 and len(x) * scale > target else None
        if cut is None:
            here, leaves = -leaves, leaves + 1
        else:
            here = len(nodes) + 1
            d = distances(x, cut[0])
            nodes.append([cut[0], cut[1], 0, 0])
            todo += [(x[d <= cut[1] + limit], here, 2), (x[d > cut[1]], here, 3)]
        if parent is not None:
            nodes[parent - 1][side] = here
    return [tuple(n) for n in nodes]


def deal(x: np.ndarray, nodes: list[tuple], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, index into x) of every place that each fingerprint goes to."""
    if not nodes:
        return np.zeros(len(x), np.int64), np.arange(len(x))
    leaf, index, todo = [], [], [(1, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        if at <= 0:
            leaf.append(np.full(len(rows), -at, np.int64))
            index.append(rows)
            continue
        vantage, mu, near, far = nodes[at - 1]
        d = distances(x[rows], vantage)
        todo += [(near, rows[d <= mu + limit]), (far, rows[d > mu])]
    if not leaf:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(leaf), np.concatenate(index)


def block_links(x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint connected inside ``x``) for those
    that have a smaller one; ``x`` sorted and distinct. Rows of distances are
    reduced to labels a stripe at a time."""
    n = len(x)
    labels, stripe = np.arange(n), max(1, min(256, STRIPE_PAIRS // max(1, n)))
    for at in range(0, n, stripe):
        i, j = np.nonzero(distances(x[at:, None].T, x[at:at + stripe, None]) <= limit)
        i, j = i + at, j + at
        off = i != j
        if off.any():
            labels = group_labels(labels, i[off], j[off])
    moved = np.flatnonzero(labels != np.arange(n))
    return x[moved], x[labels[moved]]


def shard_links(x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one shard, split further down to blocks."""
    todo, left, right = [np.unique(x)], [], []
    while todo:
        part = todo.pop()
        cut = split(part, limit) if len(part) > BLOCK_ROWS else None
        if cut is None:
            a, b = block_links(part, limit)
            left.append(a)
            right.append(b)
        else:
            d = distances(part, cut[0])
            todo += [part[d <= cut[1] + limit], part[d > cut[1]]]
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(distinct: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints ``fp`` within
    ``limit`` bits of each other, b the smaller; at most one row for each
    fingerprint and block."""
    total = distinct.count()
    sample = np.array([r["fp"] for r in hash_sample(distinct, "fp", SAMPLE_ROWS).collect()],
                      dtype=np.int64).view(np.uint64)
    tree = distinct.sparkSession.sparkContext.broadcast(build_tree(sample, total, limit, SHARD_ROWS))

    def route(batches):
        for batch in batches:
            x = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
            leaf, index = deal(x, tree.value, limit)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(x[index].view(np.int64))], ["shard", "fp"])

    def link(group: pa.Table) -> pa.Table:
        a, b = shard_links(group.column("fp").to_numpy().view(np.uint64), limit)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(route, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(link, "a long, b long")


# --- components ------------------------------------------------------------
def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """(id, fp, fingerprint, component_id, root) for every row: the
    fingerprint as hexadecimal digits, the smallest id reachable over links,
    and the smallest fingerprint of the component (which tells components
    apart that share an id)."""
    marked = cut_lineage(fingerprints(df, id_col, text_col, shingle))
    # One row for each distinct fingerprint; copies combine before the shuffle.
    classes = cut_lineage(marked.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected_components(fingerprint_links(classes, limit))
    rooted = (classes.join(roots, classes["fp"] == roots["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(least, "root").select(F.col("fp").alias("class_fp"), "component_id", "root")
    return (marked.join(known, marked["fp"] == known["class_fp"])
            .select(id_col, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                    "root"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """The rows of ``df``, all columns, that represent their component: the
    one with its smallest id. Where that id repeats, or a component has no id
    at all, one of its rows with the least fingerprint and text stays.

    Ids that occur once are settled by id alone; only rows of repeated ids are
    matched by their fingerprints again."""
    found = cut_lineage(simhash_components(df, id_col, text_col, shingle, limit))
    found = found.withColumnRenamed(id_col, "id").withColumn("mine", F.col("id").eqNullSafe(F.col("component_id")))
    ids = cut_lineage(found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("mine").alias("mine")))
    name = free_name(df, "gone")
    gone = ids.filter("n > 1 or not mine").select(F.col("id").alias(name))
    if gone.count() * ID_BYTES <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    kept = df.join(gone, F.col(id_col).eqNullSafe(F.col(name)), "left_anti")
    repeated = ids.filter("n > 1 and mine").select(F.col("id").alias("again"))
    if repeated.isEmpty():
        return kept

    schema = T.StructType([T.StructField("row", df.schema), T.StructField("again", df.schema[id_col].dataType),
                           T.StructField("row_text", T.StringType()), T.StructField("row_fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2):
                raw = b"".join([fingerprint(t.encode("utf-8"), shingle) for t in strings(part.column(2))])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], [f.name for f in schema])

    chosen = (found.filter("mine").join(repeated, F.col("id").eqNullSafe(F.col("again")), "left_semi")
              .groupBy("root", "id").agg(F.min("fp").alias("fp")))
    rows = (df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("row_id"),
                      F.col(text_col).cast("string").alias("row_text"))
            .join(repeated, F.col("row_id").eqNullSafe(F.col("again")), "left_semi").mapInArrow(run, schema))
    one = (rows.join(chosen, F.col("again").eqNullSafe(F.col("id")) & (F.col("row_fp") == F.col("fp")))
           .groupBy("root").agg(F.min_by("row", "row_text").alias("row")))
    return kept.unionByName(one.select("row.*"))
