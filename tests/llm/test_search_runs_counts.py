"""Ranked search, periodic runs and token counts against brute force and the
tokenizers library, with their edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F
import pytest

from conftest import SF_SMALL
from tapflow.llm import queries as Q
from tapflow.llm import ranked as RK
from tapflow.llm import runs as RN
from tapflow.llm import tokencounts as TC

DOCS = "doc_id bigint, text string"


# ------------------------------------------------------------ ranked search
def plain_ranking(docs, items, top=50):
    """Every document scored for every item; docs and items are (id, text)."""
    held = [(i, Counter(RK.terms_of(t or ""))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(RK.terms_of(t or ""))
    out = {}
    for item, terms in wanted.items():
        scored = []
        for (doc, c), size in zip(held, sizes):
            if size:
                m = 50 + 50 * size * n // total
                s = sum(RK.term_weight(n, df[t]) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
                if s > 0:
                    scored.append((-s, doc is None, doc))
        best = sorted(scored, key=lambda r: r if not r[1] else r[:2])[:top]
        out.update({(item, k + 1): (d, -s) for k, (s, _, d) in enumerate(best)})
    return out


def ranking(df):
    rows = df.collect()
    assert len({(r["item_id"], r["rank"]) for r in rows}) == len(rows)
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}


def prose(rng, n_docs, n_words, longest):
    # words of falling frequency, documents that repeat passages, and many copies of one
    words = [f"w{k}" for k in range(n_words)]
    weights = [1 / (k + 1) for k in range(n_words)]
    docs = [" ".join(rng.choices(words, weights, k=rng.randint(1, longest))) for _ in range(n_docs)]
    return docs + [docs[0]] * (n_docs // 2)


def test_ranked_search_equals_scoring_every_document(spark):
    rng = random.Random(2)
    texts = prose(rng, 400, 300, 60)
    docs = [*enumerate(texts), (7, texts[3]), (None, texts[5]), (None, texts[0]), (9001, None), (9002, ""), (9003, " .,! "),
            (9004, "w1 " * 30000 + "Ünï W299 w298")]
    items = [(k, " ".join(rng.choices(texts[rng.randrange(400)].split(), k=12)) + f" w{rng.randrange(300)}") for k in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (3, "W1 w2"), (3, "W1 w2"), (None, "w250 ünï"), (None, texts[0])]
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain_ranking(docs, items)
    assert ranking(RK.search_items(df, bench)) == want
    # many passes, other column names, and columns of the names used inside
    extra = df.selectExpr("doc_id as id", "text as terms", "1 as n", "2 as counts", "3 as score", "4 as item", "5 as rank")
    got = RK.search_items(extra, bench.selectExpr("item_id as name", "text as t", "0 as item_id"), id_col="id",
                          text_col="terms", item_col="name", item_text="t", pass_bytes=600)
    assert ranking(got.selectExpr("name as item_id", "rank", "id as doc_id", "score")) == want
    assert ranking(RK.search_items(df, bench, top=3)) == plain_ranking(docs, items, 3)


def test_ranked_search_of_string_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "x")], "doc_id string, text string")
    bench = spark.createDataFrame([(1, "x y")], "item_id int, text string")
    got = [(r["rank"], r["doc_id"]) for r in RK.search_items(df, bench).orderBy("rank").collect()]
    assert got == [(1, "a"), (2, "b"), (3, "c")]
    assert RK.search_items(df.limit(0), bench).count() == 0
    assert RK.search_items(df, bench.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_blocks_are_skipped_by_their_summaries_and_nothing_is_lost():
    rng = np.random.default_rng(4)
    n_docs, n_terms = 3000, 60
    # documents of 30 topics that share few terms
    topic = rng.integers(0, 30, n_docs)
    dense = rng.integers(1, 1000, (n_docs, n_terms)) * (rng.random((n_docs, n_terms)) < 0.05)
    for k in range(30):
        dense[topic == k, 2 * k] = rng.integers(500, 5000, (topic == k).sum())
    rows, terms = np.nonzero(dense)
    items = [np.sort(rng.choice(n_terms, 8, replace=False)) for _ in range(40)]
    search = RK.Search(items, [0] * 40, top=10)
    ids = np.empty(n_docs, object)
    ids[:] = list(range(n_docs))
    search.shard(ids, rows, terms, dense[rows, terms])
    for terms_q, best in zip(items, search.best):
        s = dense[:, terms_q].sum(axis=1)
        order = np.lexsort((np.arange(n_docs), -s))[:10]
        assert [(-a, i) for a, _, i in best.rows] == [(s[i], i) for i in order]
    assert 0.3 * search.blocks < search.skipped < search.blocks


# ------------------------------------------------------------ periodic runs
def plain_runs(w, min_length=6, exponent=4):
    found = {}
    for p in range(1, len(w)):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(min_length, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def run_texts():
    rng = random.Random(6)
    texts = ["", " \n\t", "a", "a " * 6, "a " * 5, "a b " * 4, "a b c " * 3, "x " + "a b c " * 4 + "a b d", "a b " * 40 + "b a " * 40,
             "é　é é　é é　é é　é é　é é　é"]
    for _ in range(150):
        w = [rng.choice("abc"[:rng.randint(1, 3)]) for _ in range(rng.randint(1, 80))]
        if rng.random() < .7:
            a, p = rng.randrange(len(w)), rng.randint(1, 8)
            w = w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < len(w) else "z" for i in range(a, len(w))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    return texts


def test_runs_equal_the_plain_search(spark):
    texts = run_texts()
    docs = [*enumerate(texts), (3, texts[3]), (None, texts[7]), (999, None)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "1 as runs", "2 as collapsed").repartition(3)
    got = Counter((r["doc_id"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in RN.scan_runs(df).collect())
    want = Counter()
    for i, t in docs:
        w = RN.WORD.findall(t or "")
        runs = plain_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want[i, tuple(runs), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert got == want
    assert RN.scan_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("exponent, least", [(2, 4), (3, 9)])
def test_runs_of_other_exponents(exponent, least):
    texts = run_texts()
    _, numbers, ends = RN.number_words(texts)
    got = RN.find_runs(numbers, ends, least, exponent)
    assert got == [plain_runs(RN.WORD.findall(t), least, exponent) for t in texts]


def test_runs_of_very_long_texts():
    fib = ["a ", "a b "]
    while len(fib[-1]) < 100_000:
        fib.append(fib[-1] + fib[-2])
    for text, runs in [("a " * 200_000, [(0, 200_000, 1)]), ("a b c " * 50_000, [(0, 150_000, 3)]), (fib[-1], []),
                       ("".join(f"p q r s t u v{i} " for i in range(20_000)), [])]:
        _, numbers, ends = RN.number_words([text])
        assert RN.find_runs(numbers, ends) == [runs]


def test_one_document_in_ten_is_made_periodic(spark):
    docs = [(i, " ".join(f"t{k}" for k in range(i % 23))) for i in range(200)] + [(None, "x y"), (6, None), (37, "")]
    got = Counter(tuple(r) for r in Q.with_loops(spark.createDataFrame(docs, DOCS)).collect())
    want = Counter()
    for i, text in docs:
        h, w = (zlib.crc32(str(i).encode()) if i is not None else 1), (text or "").split()
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            text = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(len(w)))
        want[i, text] += 1
    assert got == want


# ------------------------------------------------------------- token counts
def library_counts(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(Q.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_equal_the_library(spark):
    rng = random.Random(8)
    letters = "ab thing \n\t'sé日本語　<|endoftext|>1x٣ʼ😀ÀŞ"
    texts = ["", " ", "a" * 3000, "<|endoftext|><|endoftext|> x", "<|endoftext|", "ab" * 20000, "日本語" * 400, "hello world " * 200]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(800)]
    docs = [*enumerate(texts), (2, texts[2]), (None, "x y"), (5000, None)]
    df = spark.createDataFrame(docs, DOCS).selectExpr("doc_id", "text", "1 as n_tokens", "2 as n_bytes").repartition(3)
    got = Counter(tuple(r) for r in TC.count_tokens(df, Q.vocabulary_path()).collect())
    plain = [t or "" for _, t in docs]
    want = Counter((i, len(t.encode()), n, n > 512) for (i, _), t, n in zip(docs, plain, library_counts(plain)))
    assert got == want
    assert TC.count_tokens(df.limit(0), Q.vocabulary_path()).count() == 0


def test_token_counts_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    want = dict(zip((r["doc_id"] for r in docs), library_counts([r["t"] for r in docs])))
    assert {r["doc_id"]: r["n_tokens"] for r in Q.QUERIES["op13_token_counts"](spark, SF_SMALL).collect()} == want


def test_proven_strings_are_one_token_each():
    proven = TC.prove_vocabulary(Q.vocabulary_path())
    some = sorted(proven["alone"])[::37]
    assert len(proven["alone"]) > 45_000
    count = TC.piece_counter(proven)
    # a proven string that is one piece is one token; the library agrees on all of them
    assert [count(t) for t in some] == library_counts(some)
    merges = proven["merges"]
    rng = random.Random(3)
    for _ in range(500):
        piece = "".join(rng.choice("abcinthe ") for _ in range(rng.randint(1, 70))).encode()
        assert merges.count_short(piece) == merges.count_long(piece)
