"""Secret scan: Aho-Corasick keyword prefilter, regular expressions anchored
at the keyword hits, then checksum validation of tokens that embed one.

Kinds of span (code points, end exclusive):

* ``assign`` - ``password = value`` and the like, value of 12 or more characters;
* ``access`` - access key ids ``AKIA...`` of 18 or more characters;
* ``hex`` - runs of 16 or more lower-case hexadecimal digits;
* ``prefixed`` - ``ghp_``/``gho_``/``ghu_``/``ghs_``/``ghr_``/``npm_`` tokens of
  36 characters whose last six are the base-62 CRC-32 of the first thirty. A
  token whose checksum fails is not reported under this kind.

Hexadecimal runs have no keyword of their own; they are found by one pass of
a single character class. A null text has no spans. Rows are independent:
repeated rows give equal results, and an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapflow.llm.text import map_texts, text_slices

KINDS = ("assign", "access", "hex", "prefixed")  # order of spans that start together
BASE_KINDS = 3
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

# Fixed values of public token formats.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS_PREFIX = "akia"
TOKEN_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
PREFIXED = r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"


def base62_crc(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def scanner():
    """Returns ``spans(text)`` -> sorted list of (start, kind index, end)."""
    import ahocorasick
    words = ahocorasick.Automaton()
    for kind, group in ((0, KEYWORDS), (1, (ACCESS_PREFIX,)), (3, TOKEN_PREFIXES)):
        for w in group:
            words.add_word(w, (kind, len(w)))
    words.make_automaton()
    assign, access = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS)
    hexa, prefixed = re.compile(HEX[:-1] + "{%d,}" % HEX_MIN), re.compile(PREFIXED)

    def spans(text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 2, m.end()) for m in hexa.finditer(text)]
        # Only A-Z change, so positions in the lowered text are those in the text.
        lowered = text.encode("utf-8").lower().decode("utf-8")
        taken = [0, 0, 0, 0]
        for end, (kind, size) in sorted(words.iter(lowered), key=lambda h: h[0] - h[1][1]):
            at = end - size + 1
            if at < taken[kind]:
                continue
            m = (assign, access, None, prefixed)[kind].match(text, at)
            if m is None:
                continue
            taken[kind] = m.end()
            if kind == 0 and len(m[2]) >= ASSIGN_MIN or kind == 1 and m.end() - at >= ACCESS_MIN \
                    or kind == 3 and base62_crc(m[1]) == m[2]:
                found.append((at, kind, m.end()))
        return sorted(found)

    return spans


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_prefixed, base_spans, spans, secrets)
    for every row; ``secrets`` holds the matched strings in span order."""
    def kernel():
        spans = scanner()

        def run(texts: list[str]) -> list[pa.Array]:
            counts = [[], [], [], []]
            base, full, found = [], [], []
            for text in texts:
                s = spans(text)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in s))
                base.append(render([x for x in s if x[1] < BASE_KINDS]))
                full.append(render(s))
                found.append([text[a:b] for a, _, b in s])
            return [*(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()),
                    pa.array(full, pa.string()), pa.array(found, pa.list_(pa.string()))]

        return run

    fields = [(f"n_{k}", T.LongType()) for k in KINDS]
    return map_texts(df, id_col, text_col, fields + [("base_spans", T.StringType()), ("spans", T.StringType()),
                                                     ("secrets", T.ArrayType(T.StringType()))], kernel)


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by ``mark`` (overlapping
    spans once); a null text stays null."""
    at = df.columns.index(text_col)

    def clean(text: str, spans) -> str:
        out, done = [], 0
        for a, _, b in spans(text):
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join(out) + text[done:]

    def run(batches):
        spans = scanner()
        for batch in batches:
            for part in text_slices(batch, at):
                cleaned = [None if t is None else clean(t, spans) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(cleaned, part.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
