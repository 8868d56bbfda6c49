"""Tables with a column of every name that the operators use inside: results
are those without these columns, and stages hand them on unchanged."""

import ast
import re
from pathlib import Path

import pyspark.sql.functions as F
import pytest

import tapflow.llm
from tapflow.llm import queries as Q
from tapflow.llm.bpe import encode_texts
from tapflow.llm.chat import format_chats
from tapflow.llm.decontamination import remove_contaminated, remove_spans, scan_documents
from tapflow.llm.licenses import scan_licenses
from tapflow.llm.linededup import dedup_lines
from tapflow.llm.quality import quality_cascade
from tapflow.llm.ranked import search_items
from tapflow.llm.reputation import judge_urls
from tapflow.llm.runs import scan_runs
from tapflow.llm.secrets import redact_secrets, scan_secrets
from tapflow.llm.simhash import keep_one_of_each, simhash_components
from tapflow.llm.text import filter_texts
from tapflow.llm.tokencounts import count_tokens

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
LINES = [f"line {k} of a passage with some words in it that are its own number {k * 7}" for k in range(12)]
TEXTS = ["\n".join(LINES), "before it\n" + "\n".join(LINES) + "\nafter it", "other words here", "other words here", None, "",
         "token = abcdefghijklmnop1234", "This is a text. " * 30]


def inner_names():
    """All words in the string constants of the package, where columns are named."""
    found = {"places_doc", "places_", "gone_", "_p", "_e"}
    for path in Path(tapflow.llm.__file__).parent.glob("*.py"):
        if path.name in ("public_suffixes.py", "license_digests.py", "queries.py"):
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Constant) and isinstance(node.value, str) and len(node.value) < 80:
                found |= {w.lower() for w in NAME.findall(node.value) if len(w) < 25}
    return sorted(found)


def crowded(df):
    own = {c.lower() for c in df.columns}
    extra = [n for n in inner_names() if n not in own]
    assert len(extra) > 150
    return df.select("*", *[F.lit(f"kept {n}").alias(n) for n in extra]), extra


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)) + [(3, TEXTS[0]), (3, TEXTS[0])], "doc_id bigint, text string")


def rows(df, names):
    return sorted((tuple(str(r[n]) for n in names) for r in df.select(*[F.col(f"`{n}`") for n in names]).collect()))


@pytest.mark.parametrize("operator", [
    "dedup_lines", "keep_one_of_each", "remove_contaminated", "remove_spans", "redact_secrets"])
def test_stages_keep_all_columns(spark, docs, operator):
    bench = spark.createDataFrame([(1, LINES[3])], "item_id bigint, text string")
    run = {"dedup_lines": dedup_lines, "keep_one_of_each": keep_one_of_each, "redact_secrets": redact_secrets,
           "remove_contaminated": lambda d: remove_contaminated(d, bench), "remove_spans": lambda d: remove_spans(d, bench)}[operator]
    df, extra = crowded(docs)
    got = run(df)
    assert got.columns == df.columns
    assert rows(got, ["doc_id", "text"]) == rows(run(docs), ["doc_id", "text"])
    assert all(r[n] == f"kept {n}" for r in got.collect() for n in extra)


@pytest.mark.parametrize("operator", ["scan_documents", "scan_secrets", "scan_licenses", "quality_cascade", "simhash_components",
                                      "encode_texts", "scan_runs", "count_tokens", "search_items"])
def test_results_do_not_depend_on_other_columns(spark, docs, operator):
    bench = spark.createDataFrame([(1, LINES[3] + " other words")], "item_id bigint, text string")
    path = Q.vocabulary_path()
    run = {"scan_documents": lambda d, b: scan_documents(d, b), "scan_secrets": lambda d, b: scan_secrets(d),
           "scan_licenses": lambda d, b: scan_licenses(d), "quality_cascade": lambda d, b: quality_cascade(d),
           "simhash_components": lambda d, b: simhash_components(d), "encode_texts": lambda d, b: encode_texts(d, path),
           "scan_runs": lambda d, b: scan_runs(d), "count_tokens": lambda d, b: count_tokens(d, path),
           "search_items": lambda d, b: search_items(d, b)}[operator]
    plain = run(docs, bench)
    got = run(crowded(docs)[0], crowded(bench)[0])
    assert got.columns == plain.columns
    assert rows(got, plain.columns) == rows(plain, plain.columns)


def test_pages_and_conversations(spark):
    pages = spark.createDataFrame([(1, "http://a.example.net/en/x"), (2, None), (3, "https://b.co.uk/y?z")], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(1, True), (3, False)], "id bigint, bad boolean")
    plain = judge_urls(pages, outcomes, Q.URL_RULES)
    names = ["page_id", "host", "path", "rule", "verdict"]
    assert rows(judge_urls(crowded(pages)[0], outcomes, Q.URL_RULES), names) == rows(plain, names)
    chats = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", None), (2, 1, "x", "c")],
                                  "conv_id bigint, turn int, role string, text string")
    plain = format_chats(chats)
    assert rows(format_chats(crowded(chats)[0]), plain.columns) == rows(plain, plain.columns)


def test_filtered_texts(docs):
    df, _ = crowded(docs)
    assert filter_texts(df, "text", lambda: lambda texts: [len(t) > 20 for t in texts]).columns == df.columns
