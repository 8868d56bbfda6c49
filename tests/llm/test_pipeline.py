"""Every stage of the corpus pipeline, on what the stage before it kept,
against a brute-force version."""

import hashlib

import pytest

import corpus_pipeline
from tapflow.llm import simhash, toxicity
from tapflow.llm.queries import table, vocabulary_path
from tapflow.operators.common import cut_lineage

from .test_corpus_operators import plain_components, plain_dedup, plain_fingerprint
from .test_text_operators import plain_hits

SF = "/root/testdata/sf0.001"


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark):
    """Input of each stage, and the result of the last."""
    docs = table(spark, SF, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF)))
    return out


def test_stages_in_order_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup",
                                                     "benchmark decontamination", "BPE encoding"]
    assert all(s.schema == stages[0].schema for s in stages[1:-1])


def test_toxicity_stage_drops_what_scores_high(spark, stages):
    before = texts_of(stages[0])
    model = toxicity.train_model(stages[0], table(spark, SF, "labels"))
    ids = sorted(before)
    scores = toxicity.Scorer(model).score([before[i] for i in ids])
    assert set(texts_of(stages[1])) == {i for i, s in zip(ids, scores) if s < toxicity.THRESHOLD}


def test_line_stage(stages):
    assert texts_of(stages[2]) == plain_dedup(sorted(texts_of(stages[1]).items()))


def test_near_dedup_stage_keeps_one_of_each_component(stages):
    before = texts_of(stages[2])
    ids = sorted(before)
    root = plain_components([plain_fingerprint(before[i]) for i in ids],
                            lambda a, b: (a ^ b).bit_count() <= simhash.MAX_BITS)
    assert set(texts_of(stages[3])) == {ids[r] for r in root}


def test_decontamination_stage(spark, stages):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    before = texts_of(stages[3])
    clean = {i for i, t in before.items() for n, hit, _ in [plain_hits(t, items)] if not (hit and 20 * hit >= n)}
    assert set(texts_of(stages[4])) == clean


def test_bpe_stage_equals_the_library(stages):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(vocabulary_path())
    tok.no_truncation()
    tok.no_padding()
    before = texts_of(stages[4])
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(before) and len(rows) == len(before)
    for r in rows:
        ids = tok.encode(before[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest()


def test_run_is_the_stages_applied(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "ids_sha256").collect())) == \
        sorted(map(tuple, stages[5].select("doc_id", "ids_sha256").collect()))


def test_pipeline_stages_take_edge_rows(spark):
    rows = [(1, "plain text here", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0),
            (2, "", "en", "s", 0), (3, "x " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .selectExpr("*", "'a' as places", "'b' as fp", "'c' as n_words", "'d' as ids")
    for frame in (docs, docs.limit(0)):
        out = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = cut_lineage(stage(spark, out, SF))
            assert out.columns == docs.columns
        assert sorted((r["doc_id"] or -1) for r in corpus_pipeline.bpe(spark, out, SF).collect()) == (
            [1, 2, 3] if frame is docs else [])
