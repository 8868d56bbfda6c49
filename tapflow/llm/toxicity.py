"""Toxicity scores from a bidirectional gated recurrent network.

A word enters as word inputs (the log odds of its hash among toxic documents,
and a learned embedding) and character inputs (largest and mean log odds of
its byte n-grams, and a learned embedding of them), so inflected and unseen
forms of a word still show. The network reads windows of ``WINDOW`` words that
overlap by half; all windows of the whole text are scored, and a document's
score is its highest window's, calibrated.

The model is trained on the driver from at most ``SAMPLE_ROWS`` labelled texts
of up to ``SAMPLE_CHARS`` characters, a documented bound that no other step
has. Only whole documents are labelled, so training picks the windows: those
that score highest so far, from toxic and from clean documents. Log odds that
a training document sees are counted on the other folds.

Defined results: a null or empty text, or one without words, scores 0 where a
model could be trained; repeated rows score equally; without labelled rows of
both classes every score is the share of toxic labels (0 without labels); an
empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapflow.llm.recurrent import Adam, init, logits_of_gates, sigmoid, train_step
from tapflow.llm.text import filter_texts, hash_sample, map_texts

WINDOW, STRIDE = 32, 16
HIDDEN = 8
GRAMS = (3, 4, 5, 6)  # bytes, with marks at both ends of the word
ODDS_BITS, EMBED_BITS, EMBED = 17, 12, 4
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 10_000
FOLDS, EPOCHS, STEPS, BATCH = 4, 6, 100, 96  # STEPS: least number of steps in an epoch
THRESHOLD = 0.3
WORD_CACHE = 60_000  # words of a task whose inputs are remembered
WORDS = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


# --- inputs ----------------------------------------------------------------
def hash_words(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, word of each n-gram, hash of each n-gram)."""
    raw = [b"\x02" + w.encode("utf-8") + b"\x03" for w in words]
    sizes = np.array([len(r) for r in raw], np.int64)
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32) + np.uint32(1)
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(buf))  # bytes to the end of the word
    owner, grams = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ buf[at + k]
        owner.append(word[at].astype(np.int32))
        grams.append(scramble(h))
    whole = np.zeros(len(words), np.uint32)
    powers = np.multiply.accumulate(np.concatenate([[1], np.full(int(sizes.max(initial=1)), 0x01000193)]).astype(np.uint32))
    np.add.at(whole, word, buf * powers[left])
    return scramble(whole), np.concatenate(owner), np.concatenate(grams)


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return h ^ (h >> np.uint32(13))


def odds_inputs(hashed, word_odds: np.ndarray, gram_odds: np.ndarray) -> np.ndarray:
    """(words, 3): log odds of the word, largest and mean of its n-grams."""
    whole, owner, grams = hashed
    values = gram_odds[grams & np.uint32((1 << ODDS_BITS) - 1)]
    top = np.full(len(whole), -np.inf, np.float32)
    np.maximum.at(top, owner, values)
    count = np.maximum(np.bincount(owner, minlength=len(whole)), 1)
    mean = np.bincount(owner, values, len(whole)) / count
    return np.column_stack([word_odds[whole & np.uint32((1 << ODDS_BITS) - 1)], top, mean]).astype(np.float32)


def embedding_inputs(hashed, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """(words, 2 x EMBED): embedding of the word, mean embedding of its n-grams."""
    whole, owner, h = hashed
    count = np.maximum(np.bincount(owner, minlength=len(whole)), 1)
    rows = grams[h >> np.uint32(32 - EMBED_BITS)]
    mean = np.column_stack([np.bincount(owner, rows[:, k], len(whole)) / count for k in range(EMBED)])
    return np.column_stack([words[whole >> np.uint32(32 - EMBED_BITS)], mean]).astype(np.float32)


def log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Log odds of occurring in toxic documents, shrunk where occurrences are few."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    seen = pos + neg
    return (odds * seen / (seen + 4)).astype(np.float32)


# --- windows ---------------------------------------------------------------
def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of all windows of texts of so many words;
    a text of up to ``WINDOW`` words is one window, and the last window of a
    longer one ends with it."""
    extra = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // STRIDE), 0)
    doc = np.repeat(np.arange(len(sizes)), extra + 1)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
    start = np.minimum(k * STRIDE, np.maximum(sizes - WINDOW, 0)[doc])
    return doc, start, np.minimum(sizes[doc], WINDOW)


def score_windows(p, gates: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logits of windows of the word ids. ``gates`` (words, 6H) has each
    word's input part of both directions; windows shorter than ``WINDOW`` are
    masked, and read apart from the others."""
    out = np.empty(len(first), np.float32)
    half = gates.shape[1] // 2
    steps = np.arange(WINDOW)[:, None]
    for full in (True, False):
        todo = np.flatnonzero((size == WINDOW) == full)
        for at in range(0, len(todo), 2048):
            rows = todo[at:at + 2048]
            where = first[rows] + (steps if full else np.minimum(steps, np.maximum(size[rows] - 1, 0)))
            mask = None if full else (steps < size[rows]).astype(np.float32)
            where = np.minimum(where, len(ids) - 1)  # a text without words, all masked
            g = gates[ids[where]] if len(ids) else np.zeros((WINDOW, len(rows), 2 * half), np.float32)
            out[rows] = logits_of_gates(p, g[:, :, :half], g[:, :, half:], mask)
    return out


# --- training --------------------------------------------------------------
def train(texts: list[str], labels: list[int], seed: int = 7) -> dict:
    """Model parameters as plain arrays, from labelled texts."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    tokens = [words_of(t) for t in texts]
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for t in tokens for w in t))}
    if not vocab or y.min() == y.max():
        return {"share": float(y.mean()) if len(y) else 0.0}
    ids = [np.array([vocab[w] for w in t], np.int64) for t in tokens]
    hashed = hash_words(list(vocab))
    whole, owner, grams = hashed
    ptr = np.searchsorted(np.sort(owner), np.arange(len(vocab) + 1))
    by_word = np.argsort(owner, kind="stable").astype(np.int32)
    low = np.uint32((1 << ODDS_BITS) - 1)

    # Document counts by fold and class, of words and of n-grams.
    fold = rng.permutation(len(texts)) % FOLDS
    counts = np.zeros((2, FOLDS, 2, 1 << ODDS_BITS), np.float32)
    for d, doc in enumerate(ids):
        u = np.unique(doc)
        g = np.concatenate([by_word[ptr[w]:ptr[w + 1]] for w in u]) if len(u) else np.zeros(0, np.int64)
        counts[0, fold[d], int(y[d]), np.unique(whole[u] & low)] += 1
        counts[1, fold[d], int(y[d]), np.unique(grams[g] & low)] += 1
    n_docs = np.array([[np.sum((fold == f) & (y == c)) for c in (0, 1)] for f in range(FOLDS)], np.float32)

    def tables(left_out: int | None):
        use = [f for f in range(FOLDS) if f != left_out]
        n = n_docs[use].sum(axis=0)
        return [log_odds(counts[k, use, 1].sum(axis=0), counts[k, use, 0].sum(axis=0), n[1], n[0]) for k in (0, 1)]

    static = np.stack([odds_inputs(hashed, *tables(f)) for f in range(FOLDS)])
    p = init(3 + 2 * EMBED, HIDDEN, rng)
    emb = {"Ew": np.zeros((1 << EMBED_BITS, EMBED), np.float32), "Ec": np.zeros((1 << EMBED_BITS, EMBED), np.float32)}
    word_at, gram_at = whole >> np.uint32(32 - EMBED_BITS), grams >> np.uint32(32 - EMBED_BITS)

    flat = np.concatenate(ids)
    base = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    sizes = np.diff(base)
    doc, start, size = windows(sizes)
    first = base[doc] + start
    share = float(y.mean())
    balance = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    adam, adam_e = Adam(0.01), Adam(0.003)

    def all_logits() -> np.ndarray:
        out = np.empty(len(doc), np.float32)
        embedded = embedding_inputs(hashed, emb["Ew"], emb["Ec"])
        for f in range(FOLDS):
            x = np.column_stack([static[f], embedded])
            gates = np.column_stack([x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]])
            rows = np.flatnonzero(fold[doc] == f)
            out[rows] = score_windows(p, gates, flat, first[rows], size[rows])
        return out

    def batch_inputs(rows: np.ndarray):
        steps = np.arange(WINDOW)[:, None]
        where = np.minimum(first[rows] + np.minimum(steps, np.maximum(size[rows] - 1, 0)), len(flat) - 1)
        mask = (steps < size[rows]).astype(np.float32)
        w = flat[where]
        u, inverse = np.unique(w, return_inverse=True)
        spans = np.concatenate([by_word[ptr[k]:ptr[k + 1]] for k in u])
        per = ptr[u + 1] - ptr[u]
        own = np.repeat(np.arange(len(u)), per)
        mean = np.column_stack([np.bincount(own, emb["Ec"][gram_at[spans], k], len(u)) / np.maximum(per, 1)
                                for k in range(EMBED)])
        x = np.concatenate([static[fold[doc[rows]], w], emb["Ew"][word_at[w]],
                            mean[inverse.reshape(w.shape)].astype(np.float32)], axis=2)
        return x, mask, (w, u, inverse.reshape(w.shape), spans, per, own)

    for epoch in range(EPOCHS):
        if epoch == 0:  # before the network knows anything: the largest n-gram odds in a window
            top = np.concatenate([static[fold[d], x, 1] for d, x in enumerate(ids)])
            steps = np.arange(WINDOW)[:, None]
            at = np.minimum(first + np.minimum(steps, np.maximum(size - 1, 0)), len(flat) - 1)
            rank = top[at].max(axis=0)
        else:
            rank = all_logits()
        order = np.lexsort((-rank, doc))
        place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        chosen = order[(place == 0) | (place == 1) & (y[doc[order]] == 0)]
        other = rng.choice(len(doc), min(len(doc), len(texts)), replace=False)
        chosen = np.concatenate([chosen, other[y[doc[other]] == 0]])
        passes = -(-STEPS * BATCH // len(chosen))
        chosen = np.concatenate([rng.permutation(chosen) for _ in range(passes)])
        for at in range(0, len(chosen), BATCH):
            rows = chosen[at:at + BATCH]
            x, mask, (w, u, inverse, spans, per, own) = batch_inputs(rows)
            _, g, dx = train_step(p, x, y[doc[rows]], balance[doc[rows]], mask)
            adam.step(p, g, 1e-4)
            dx = dx * mask[:, :, None]
            g_word, g_gram = np.zeros_like(emb["Ew"]), np.zeros_like(emb["Ec"])
            np.add.at(g_word, word_at[w.ravel()], dx[:, :, 3:3 + EMBED].reshape(-1, EMBED))
            d_mean = np.zeros((len(u), EMBED), np.float32)
            np.add.at(d_mean, inverse.ravel(), dx[:, :, 3 + EMBED:].reshape(-1, EMBED))
            np.add.at(g_gram, gram_at[spans], (d_mean / np.maximum(per, 1)[:, None])[own].astype(np.float32))
            adam_e.step(emb, {"Ew": g_word, "Ec": g_gram}, 1e-3)

    # One-dimensional logistic calibration of the document's highest window.
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, doc, all_logits())
    scale, shift = calibrate(best, y)
    words, chars = tables(None)
    return {"p": p, "Ew": emb["Ew"], "Ec": emb["Ec"], "words": words, "grams": chars, "scale": scale, "shift": shift}


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(scale, shift) of a logistic fit with a small ridge, by Newton's method."""
    beta, design = np.array([1.0, 0.0]), np.column_stack([x, np.ones_like(x)])
    penalty = ridge * len(x) * np.eye(2) * [0.05, 0.001]
    for _ in range(30):
        prob = sigmoid(design @ beta)
        grad = design.T @ (prob - y) + penalty @ (beta - [1.0, 0.0])
        beta = beta - np.linalg.solve(design.T @ (design * (prob * (1 - prob))[:, None]) + penalty, grad)
    return float(max(beta[0], 1e-3)), float(beta[1])


class Scorer:
    """Scores of texts; remembers the inputs of the words of a task."""

    def __init__(self, model: dict):
        self.model = model
        self.known: dict[str, int] = {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    def ids(self, tokens: list[list[str]]) -> np.ndarray:
        m, p = self.model, self.model["p"]
        used = set().union(*tokens)
        new = [w for w in used if w not in self.known]
        if len(self.known) + len(new) > WORD_CACHE:
            kept = [w for w in used if w in self.known]
            self.gates = self.gates[[self.known[w] for w in kept]] if kept else self.gates[:0]
            self.known = {w: i for i, w in enumerate(kept)}
        if new:
            hashed = hash_words(new)
            x = np.column_stack([odds_inputs(hashed, m["words"], m["grams"]), embedding_inputs(hashed, m["Ew"], m["Ec"])])
            at = len(self.known)
            self.gates = np.concatenate([self.gates, np.column_stack(
                [x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"]]).astype(np.float32)])
            self.known.update(zip(new, range(at, at + len(new))))
        get = self.known.__getitem__
        return np.array([i for t in tokens for i in map(get, t)], np.int64)

    def score(self, texts: list[str]) -> np.ndarray:
        m = self.model
        if "share" in m or not texts:
            return np.full(len(texts), m.get("share", 0.0))
        tokens = [words_of(t) for t in texts]
        ids = self.ids(tokens)
        sizes = np.array([len(t) for t in tokens], np.int64)
        doc, start, size = windows(sizes)
        logit = score_windows(m["p"], self.gates, ids, (np.cumsum(sizes) - sizes)[doc] + start, size)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, logit)
        return np.where(sizes > 0, np.clip(sigmoid(m["scale"] * best + m["shift"]), 0.0, 1.0), 0.0)


# --- on DataFrames ---------------------------------------------------------
def held_out(id_col: Column) -> Column:
    """Whether labels of this id may not be learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_model(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> dict:
    """Model from at most ``rows`` labelled rows of ``df`` that are not held
    out, at most half of them toxic; an id with several labels counts as toxic
    if any says so."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
             .groupBy("id").agg(F.max("y").alias("y")))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")) \
        .filter(F.length("t").between(1, SAMPLE_CHARS))
    found = known.join(docs.select("id"), "id", "left_semi")
    picked = (hash_sample(found.filter("y = 1"), "id", rows // 2)
              .unionByName(hash_sample(found.filter("y = 0"), "id", rows // 2)))
    sample = (docs.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("t").alias("t"), F.first("y").alias("y"))
              .orderBy("id").collect())
    return train([r["t"] for r in sample], [r["y"] for r in sample])


def score_toxicity(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        scorer = Scorer(shared.value)
        return lambda texts: [pa.array(scorer.score(texts).astype(np.float64))]

    return map_texts(df, id_col, text_col, [("score", T.DoubleType())], kernel)


def drop_toxic(df: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, with all columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        scorer = Scorer(shared.value)
        return lambda texts: scorer.score(texts) < threshold

    return filter_texts(df, text_col, kernel)
