"""URL verdicts by reputation against SQL, the verdict of the quality rules and
the scores of the network against plain versions."""

import math
import random

import duckdb
import numpy as np
import pytest

from tapflow.llm import quality, toxicity
from tapflow.llm.queries import ORACLE, QUERIES

# --- URL filter ------------------------------------------------------------
SITES = {  # host: share of its pages with a bad outcome
    "www.bad.co.uk": 1.0, "m.bad.co.uk": 0.9, "blog.bad.co.uk": 1.0, "www.good.co.uk": 0.0, "shop.good.co.uk:8080": 0.1,
    "spam.github.io": 1.0, "fine.github.io": 0.0, "www.ck": 0.0, "a.b.ck": 1.0, "x.a.b.ck": 0.9, "10.0.0.1": 0.5,
    "BAD.example.org": 1.0, "example.com": 0.2, "sub.example.net": 0.9, "city.kobe.jp": 0.3, "x.y.kobe.jp": 0.8, "co.uk": 0.4,
    "localhost": 0.0, "odd..host": 0.6,
}


def test_url_verdicts_and_bounds_match_sql_on_listed_suffixes(spark, tmp_path):
    rng, pages, labels = random.Random(5), [], []
    for host, share in SITES.items():
        for k in range(rng.choice([3, 40, 200])):
            pages.append((len(pages), f"http://{host}/{rng.choice(['', 'en/', 'de/', 'fr/x?y'])}"))
            if rng.random() < 0.7:
                bad = rng.random() < share
                labels.append((len(pages) - 1, int(not bad), int(bad and k % 2)))
    labels += labels[:5] + [(None, 0, 1), (10 ** 9, 0, 1)]
    pages += [(len(pages), None), (len(pages) + 1, ""), (len(pages) + 2, "no scheme/x"), (None, "http://m.bad.co.uk")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op2_url_filter"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    res = con.execute(ORACLE["op2_url_filter"])
    assert sorted(got.columns) == sorted(d[0] for d in res.description)
    expected = res.fetchall()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0]))
    plain, ours = order(expected), order([tuple(r) for r in got.collect()])
    assert [r[:3] for r in ours if r[0] is not None] == [r[:3] for r in plain if r[0] is not None]
    judged = [(a, b) for a, b in zip(ours, plain) if a[0] is not None]
    assert [a[3:5] for a, _ in judged] == [b[3:5] for _, b in judged]
    assert [a[5] for a, _ in judged] == pytest.approx([b[5] for _, b in judged], abs=2e-6)
    by_method = {a[1]: a[4] for a, _ in judged if a[3] is None}
    assert by_method["www.bad.co.uk"] == by_method["spam.github.io"] == "block"
    assert by_method["www.good.co.uk"] == by_method["fine.github.io"] == by_method[""] == "allow"


# --- quality rules ---------------------------------------------------------
def plain_verdict(text, s):
    """Names of all rules that reject, from their definitions."""
    words, lines = text.split(), text.split("\n")
    out = set()
    mean = s[1] / s[0]
    if mean < 2 or mean > 14:
        out.add("word_length")
    if s[2] / s[0] > 0.1:
        out.add("symbols")
    if s[3] / len(lines) > 0.3:
        out.add("dup_lines")
    if s[4] / s[0] > 0.2:
        out.add("repeats")
    if sum(any(c.isalpha() for c in w) for w in words) / s[0] < 0.7:
        out.add("few_letters")
    if len(words) >= 100 and not set(text) & set(".!?"):
        out.add("no_sentences")
    return out


def test_quality_verdict_matches_plain_rules(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefgé", k=n))
    texts = [None, "", "only few words."]
    for k in range(240):
        n = rng.choice([49, 50, 60, 99, 100, 150])
        size = rng.choice([1, 5, 6, 7, 20]) if k % 3 == 0 else 6
        digits = rng.choice([0, 0, 0, 0.25, 0.35])
        words = [word(size) if rng.random() >= digits else str(rng.randrange(10 ** 6)) for _ in range(n)]
        for i in rng.sample(range(n), rng.choice([0, 0, n // 12, n // 8])):
            words[i] += "#"
        if k % 4 == 0:
            words[n // 2:n // 2 + 7] = words[:7]  # 14 words in windows found twice
        lines = [" ".join(words[i:i + 10]) for i in range(0, n, 10)]
        if k % 5 == 0:  # the same one-word line after some of the others
            lines = [x for line in lines for x in ([line, "menu"] if rng.random() < 0.7 else [line])]
        texts.append("\n".join(lines) + rng.choice([".", ""]))
    rows = quality.quality_cascade(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    named = set()
    for r in rows:
        text = texts[r["doc_id"]] or ""
        s = quality.base_stats(text.encode())
        base = s[0] < 50 or s[4] / s[0] > 0.5
        rejects = set() if base else plain_verdict(text, s)
        assert r["kept"] == (not base and not rejects), (r["doc_id"], rejects)
        assert r["rejected_by"] == "base" if base else r["rejected_by"] in (rejects or {None})
        named |= rejects
    assert named == {rule.name for rule in quality.RULES} and sum(r["kept"] for r in rows) > 10


# --- toxicity --------------------------------------------------------------
def plain_inputs(model, word):
    m32, prime = 0xFFFFFFFF, 0x01000193

    def scramble(h):
        h = ((h ^ h >> 15) * 0x2C1B3C6D) & m32
        return h ^ h >> 13

    raw = [b + 1 for b in b"\x02" + word.encode() + b"\x03"]
    whole, grams = 0, []
    for b in raw:
        whole = (whole + b) * prime & m32
    for n in toxicity.GRAMS:
        for at in range(len(raw) - n + 1):
            h = n
            for b in raw[at:at + n]:
                h = h * prime & m32 ^ b
            grams.append(scramble(h))
    whole, low, high = scramble(whole), (1 << toxicity.ODDS_BITS) - 1, 32 - toxicity.EMBED_BITS
    odds = [float(model["grams"][g & low]) for g in grams]
    return np.array([model["words"][whole & low], max(odds), sum(odds) / len(odds), *model["Ew"][whole >> high],
                     *np.mean([model["Ec"][g >> high] for g in grams], axis=0)], np.float64)


def plain_score(model, text):
    """One word and one window after the other, in doubles."""
    words = toxicity.words_of(text)
    if not words:
        return 0.0
    p, size = {k: v.astype(np.float64) for k, v in model["p"].items()}, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))

    def states(xs, d):
        h, out = np.zeros(size), []
        for x in xs:
            g, hu = x @ p["W" + d] + p["c" + d], h @ p["U" + d]
            z, r = sig(g[:size] + hu[:size]), sig(g[size:2 * size] + hu[size:2 * size])
            h = (1 - z) * h + z * np.tanh(g[2 * size:] + r * hu[2 * size:])
            out.append(h)
        return out

    x, n = [plain_inputs(model, w) for w in words], len(words)
    starts = [0] if n <= 32 else sorted({*range(0, n - 32, 16), n - 32})
    best = -math.inf
    for s in starts:
        part = x[s:s + 32]
        both = [np.concatenate(hs) for hs in zip(states(part, "f"), states(part[::-1], "b")[::-1])]
        e = np.exp([h @ p["a"] for h in both])
        best = max(best, float(sum(w * h for w, h in zip(e / e.sum(), both)) @ p["w"] + p["b"][0]))
    return float(sig(model["scale"] * best + model["shift"]))


def test_scores_match_a_plain_forward_pass(monkeypatch):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdeéñ", k=rng.randrange(1, 9))) for _ in range(80)]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    monkeypatch.setattr(toxicity, "EPOCHS", 2)
    monkeypatch.setattr(toxicity, "STEPS", 20)
    texts = [some(rng.randrange(5, 60)) + (" vile" if k % 2 else "") for k in range(60)]
    model = toxicity.train(texts, [k % 2 for k in range(60)])
    cases = ["", " .,", "a", "vile", "vilest word", some(31), some(32), some(33), some(48), some(49), some(500) + " vile",
             "Never Seen Before", "字母 " * 40]
    got = toxicity.Scorer(model).score(cases)
    assert got == pytest.approx([plain_score(model, t) for t in cases], abs=1e-3)
    assert got.max() - got[2:].min() > 0.2  # the cases tell scores apart
    monkeypatch.setattr(toxicity, "WORD_CACHE", 10)
    scorer = toxicity.Scorer(model)
    assert np.concatenate([scorer.score([t]) for t in cases]) == pytest.approx(got, abs=1e-5)
