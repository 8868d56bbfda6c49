"""Contract queries of the operators over the given tables.

``QUERIES`` maps a name to a function (spark, sf_dir) -> DataFrame, ``ORACLE``
a name to DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapflow.llm.bpe import encode_texts
from tapflow.llm.chat import format_chats
from tapflow.llm.decontamination import scan_documents
from tapflow.llm.licenses import COPYRIGHT_LINE, SPELLINGS, known_texts, scan_licenses
from tapflow.llm.linededup import MIN_WORDS, dedup_lines
from tapflow.llm.public_suffixes import BELOW, EXACT, EXCEPT, MOST_LABELS
from tapflow.llm.quality import quality_cascade
from tapflow.llm.ranked import search_items
from tapflow.llm.reputation import MAX_BAD, RHO_MAX, RHO_MIN, Z, judge_urls
from tapflow.llm.runs import scan_runs
from tapflow.llm.secrets import scan_secrets
from tapflow.llm.simhash import simhash_components
from tapflow.llm.tokencounts import count_tokens
from tapflow.llm.toxicity import THRESHOLD, held_out, score_toxicity, train_model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: base kinds as a digest, all kinds as text."""
    return (scan_secrets(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_assign", "n_access", "n_hex",
                    F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans"))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@register
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url. The labels with the page's id are its
    outcome: bad if of low quality or toxic. ``bad_share_low`` is the lower
    posterior bound of the host's bad share, by which the method judges."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("id"),
                             ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    return (judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)
            .withColumn("bad_share_low", F.round("low", 6)).drop("low"))


def _names(names: frozenset[str]) -> str:
    """A column ``name`` of all ``names``, in SQL."""
    return f"select unnest([{', '.join(repr(x) for x in sorted(names))}]) as name"


def _level(name: str, groups: str, key: str) -> str:
    """SQL of one level of shrinkage: ``groups`` has key, n, bad and the
    parent's share m and variance pv; the result has share and var."""
    return f"""
{name}_rho as (select 1 / least({RHO_MAX}, greatest({RHO_MIN}, coalesce((s - v) / nullif(w, 0), {RHO_MIN}))) - 1 as c
  from (select sum(n * (bad / n - m) * (bad / n - m)) as s, sum(m * (1 - m)) as v, sum(m * (1 - m) * (n - 1)) as w
        from {groups} where n > 0)),
{name} as (select {key}, share, share * (1 - share) / (c + n + 1) + pv * (c / (c + n)) * (c / (c + n)) as var
           from (select *, (c * m + bad) / (c + n) as share from {groups}, {name}_rho))"""


ORACLE["op2_url_filter"] = rf"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest
           from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(verdict, rule) as (values ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'),
                            ('allow', 'org/fr/')),
rp as (select *, split_part(rule, '/', 1) as rh, substr(rule, strpos(rule, '/')) as rpath from r),
fit as (select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict
        from p, rp where (host = rh or suffix(host, '.' || rh)) and starts_with(path, rpath)
        group by page_id, host, path),
lab as (select doc_id, max(case when quality = 0 or toxic = 1 then 1.0::double else 0 end) as bad from labels group by 1),
h0 as (select host, cast(count(bad) as double) as n, coalesce(sum(bad), 0) as bad,
              regexp_replace(host, ':[0-9]*$', '') as bare
       from p left join lab on page_id = doc_id group by host),
psl as ({_names(EXACT)}), below as ({_names(BELOW)}), but as ({_names(EXCEPT)}),
ends as (select bare, k, array_to_string(labels[len(labels) - k + 1:], '.') as name
         from (select distinct bare, string_split(bare, '.') as labels from h0), range(2, {MOST_LABELS} + 1) as x(k)
         where len(labels) >= k),
sfx as (select bare, arg_max(name, k) as suffix from ends
        where name in (from psl) or (substr(name, strpos(name, '.') + 1) in (from below) and name not in (from but))
        group by bare),
h1 as (select host, n, bad, case when number then bare
                                 else regexp_extract(left(bare, length(bare) - length(suffix)), '[^.]*\.?$') || suffix end as domain,
              suffix
       from (select host, n, bad, bare, regexp_matches(bare, '^[0-9.]+$') as number,
                    case when number then bare else coalesce(suffix, regexp_extract(bare, '[^.]*$')) end as suffix
             from h0 left join sfx using (bare))),
d1 as (select domain, suffix, sum(n) as n, sum(bad) as bad from h1 group by 1, 2),
s1 as (select suffix, sum(n) as n, sum(bad) as bad from d1 group by 1),
o as (select coalesce(sum(bad) / nullif(sum(n), 0), 0) as m, sum(n) as total from s1),
s2 as (select suffix, n, bad, m, m * (1 - m) / (total + 1) as pv from s1, o),
{_level("s3", "s2", "suffix")},
d2 as (select domain, d1.suffix, n, bad, share as m, var as pv from d1 join s3 using (suffix)),
{_level("d3", "d2", "domain, suffix")},
h2 as (select host, n, bad, share as m, var as pv from h1 join d3 using (domain, suffix)),
{_level("h3", "h2", "host")},
low as (select host, share - {Z} * sqrt(greatest(var, 0)) as low from h3)
select p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.verdict, case when low > {MAX_BAD} then 'block' else 'allow' end) as verdict,
       round(low, 6) as bad_share_low
from p join low using (host) left join fit using (page_id, host, path)
"""


@register
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


@register
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repaired and rendered turns of every conversation."""
    return format_chats(table(spark, sf_dir, "conversations"))


@register
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier place has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=("n_lines", "n_removed"))


# The shortest runs of more than 50 words from each line, forwards and
# backwards, compared as texts.
ORACLE["op5_line_dedup"] = rf"""
with l as (select doc_id, i, lines[i] as line, len(regexp_extract_all(lines[i], '[^ 	-
]+')) as w
           from (select doc_id, string_split(text, chr(10)) as lines, unnest(range(1, len(lines) + 1)) as i
                 from documents where text is not null)),
c as (select *, sum(w) over (partition by doc_id order by i) as upto from l),
runs as (
  select a.doc_id, a.i as s, min(b.i) as e from c a join c b on a.doc_id = b.doc_id and b.i >= a.i
         and b.upto - a.upto + a.w > {MIN_WORDS} where a.w > 0 group by all
  union
  select b.doc_id, max(a.i) as s, b.i as e from c a join c b on a.doc_id = b.doc_id and b.i >= a.i
         and b.upto - a.upto + a.w > {MIN_WORDS} where b.w > 0 group by b.doc_id, b.i),
t as (select runs.doc_id, s, e, array_to_string(list(line order by i), chr(10)) as t
      from runs join c on runs.doc_id = c.doc_id and i between s and e group by all),
gone as (select distinct doc_id, unnest(range(s, e + 1)) as i
         from (select *, row_number() over (partition by t order by doc_id, s) as k from t) where k > 1)
select d.doc_id, coalesce(array_to_string(list(line order by c.i) filter (gone.i is null and c.i is not null), chr(10)),
                          case when d.text is null then null else '' end) as text,
       count(c.i) as n_lines, count(gone.i) as n_removed
from documents d left join c on d.doc_id = c.doc_id left join gone on c.doc_id = gone.doc_id and c.i = gone.i
group by d.doc_id, d.text
"""


@register
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    found = scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


# Words and windows as lists; windows of documents meet those of items as text.
ORACLE["op6_decontamination"] = r"""
with letters as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as u, 'abcdefghijklmnopqrstuvwxyz' as l),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l),
                                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents, letters),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), u, l),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark, letters),
iw as (select distinct item_id, least(13, len(w)) as size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') as t
       from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct size from iw),
dw as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as t
       from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, sizes where len(w) >= size)),
hits as (select doc_id, i, size, item_id from dw join iw using (size, t)),
hitwords as (select doc_id, count(distinct p) as n_hit
             from (select doc_id, unnest(range(i, i + size)) as p from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items,
                 string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s
          from hits group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hitwords using (doc_id) left join found using (doc_id)
"""


@register
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that documents, or lines of them, are."""
    return (scan_licenses(table(spark, sf_dir, "documents"))
            .withColumn("notice_licenses", F.array_join("notice_licenses", ",")))


def _canonical(x: str) -> str:
    """The canonical form of a line, in SQL."""
    form = f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    form = (f"trim(regexp_replace(case when regexp_matches({form}, '{COPYRIGHT_LINE}') then '' else {form} end, "
            r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))")
    for pattern, to in SPELLINGS:
        form = f"regexp_replace({form}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return form


ORACLE["op7_license_scan"] = f"""
with known as (select sha256(f) as h, min(lic) as lic from (
  select lic, {_canonical("t")} as f from (values {", ".join(
      "('" + k + "', '" + t.replace("'", "''") + "')" for k, t in known_texts())}) x(lic, t)) group by 1),
lines as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
                                     lambda x: {_canonical("x")}), lambda y: y <> '') as forms from documents),
whole as (select doc_id, sha256(array_to_string(forms, ' ')) as text_digest, forms from lines),
notes as (select doc_id, count(*) as n, string_agg(distinct lic, ',' order by lic) as s
          from (select doc_id, unnest(list_transform(forms, lambda x: sha256(x))) as h from lines) join known using (h)
          group by 1)
select doc_id, known.lic as text_license, text_digest, coalesce(notes.n, 0) as n_notice_lines,
       coalesce(notes.s, '') as notice_licenses
from whole left join known on text_digest = known.h left join notes using (doc_id)
"""


@register
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the cascade's verdict."""
    return quality_cascade(table(spark, sf_dir, "documents")).drop("rejected_by")


# All counts and all six rules on every text, in no order. Letters are what is
# alphanumeric but no decimal digit; words of that rule end at any white space.
ORACLE["op8_quality_rules"] = r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w,
                  string_split(t, chr(10)) as lines,
                  list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as worded,
                  regexp_extract_all(t, '[^\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')
                    as parts
           from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
      from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select doc_id, count(distinct j) as n
      from (select doc_id, unnest([i, i + 1, i + 2]) as j
            from (select *, count(*) over (partition by doc_id, g) as k from g) where k > 1) group by doc_id),
s as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
             len(worded) - len(list_distinct(worded)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
             len(lines) as n_lines,
             len(list_filter(parts, lambda x: regexp_matches(x, '[\p{L}\p{Nl}\p{No}]'))) as n_lettered,
             regexp_matches(t, '[.!?\x{3002}\x{061F}\x{0964}]') as has_end
      from d left join r using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or word_chars < 2 * n_words or word_chars > 14 * n_words or 10 * n_symbols > n_words
            or 10 * n_dup_lines > 3 * n_lines or 5 * n_repeat_words > n_words or 10 * n_lettered < 7 * n_words
            or (n_words >= 100 and not has_end)) as kept
from b
"""


@register
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash_components(table(spark, sf_dir, "documents")).drop("fp", "root")


@register
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@register
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Every document scored for every item with a term in common.
ORACLE["op11_ranked_search"] = r"""
with letters as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as u, 'abcdefghijklmnopqrstuvwxyz' as l,
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' as p),
d as (select doc_id, regexp_extract_all(translate(text, u, l), p) as w from documents, letters where text is not null),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, u, l), p)) as term from benchmark, letters),
size as (select cast(count(*) as bigint) as n_docs, cast(sum(len(w)) as bigint) as n_terms from d where len(w) > 0),
tf as (select doc_id, len(w) as n, term, count(*) as tf from (select doc_id, w, unnest(w) as term from d) group by all),
weight as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1))) as bigint) as w
           from tf, size group by term, n_docs),
score as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))
                                       as bigint) as score
          from tf join weight using (term) join q using (term), size group by item_id, doc_id)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from score where score > 0)
where rank <= 50
"""


def _words(text: str) -> str:
    return rf"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+', 0)"


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of one document in ten, chosen by the
    CRC-32 of its id, made periodic from a word on; in plain SQL functions."""
    w = docs.selectExpr("doc_id", "text", "crc32(encode(cast(doc_id as string), 'UTF-8')) as h") \
        .selectExpr("*", f"if(h % 10 = 0, {_words('text')}, null) as w") \
        .selectExpr("*", "h div 10 as g", "cast(size(w) as bigint) as n")
    w = w.selectExpr("*", "g % nullif(n, 0) as a").selectExpr("*", "1 + ((n - a) div (3 + g % 8)) as p")
    looped = "array_join(transform(sequence(0L, n - 1), i -> get(w, cast(if(i < a, i, a + (i - a) % p) as int))), ' ')"
    return w.selectExpr("doc_id", f"if(h % 10 = 0 and n > 0, {looped}, text) as text")


@register
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document."""
    runs = scan_runs(with_loops(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = ("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> "
            "if(b is null or r.length > b.length, r, b))")  # of equal lengths the first, by start and period
    listed = r"concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))"
    return (runs.selectExpr("*", f"{best} as best")
            .selectExpr("doc_id", "cast(size(runs) as bigint) as n_runs", "best.start", "best.length", "best.period",
                        "(1000 * best.length) div best.period as exponent_milli",
                        f"sha2(encode({listed}, 'UTF-8'), 256) as runs_sha256",
                        "sha2(encode(collapsed, 'UTF-8'), 256) as collapsed_sha256"))


# CRC-32 bit by bit. A run holds a five-word window twice at the distance of
# its period, so periods come from equal windows; places in a row at one
# distance are a stretch, as long as it can be.
ORACLE["op12_periodic_runs"] = r"""
with id as (select doc_id, text, cast(doc_id as varchar) as s from documents),
h as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
             xor(4294967295, list_reduce(list_prepend(4294967295::bigint, range(8 * len(s))),
               lambda c, k: xor(xor(c, case when k % 8 = 0 then ascii(s[k // 8 + 1])::bigint else 0 end) >> 1,
                 3988292384 * (xor(c, case when k % 8 = 0 then ascii(s[k // 8 + 1])::bigint else 0 end) & 1)))) as h from id),
p as (select *, h // 10 as g, len(w) as n, a0 as a, 1 + (len(w) - a0) // (3 + (h // 10) % 8) as p
      from (select *, case when len(w) > 0 then (h // 10) % len(w) else 0 end as a0 from h)),
t as (select doc_id, n, case when h % 10 = 0 and n > 0
        then list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) else w end as w from p),
win as (select doc_id, n, i, array_to_string(w[i + 1:i + 5], ' ') as five from (select *, unnest(range(n - 4)) as i from t)),
same as (select a.doc_id, a.i, b.i - a.i as p from win a join win b using (doc_id, five)
         where b.i > a.i and 4 * (b.i - a.i) <= a.n),
stretch as (select doc_id, p, min(i) as start, count(*) + 4 + p as length
            from (select *, i - row_number() over (partition by doc_id, p order by i) as isle from same) group by doc_id, p, isle),
runs as (select doc_id, start, length, min(p) as period from stretch
         where length >= greatest(6, 4 * p) group by doc_id, start, length),
sums as (select doc_id, count(*) as n_runs, arg_max(r, (length, -start, -period)) as best,
                string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed
         from (select *, {'start': start, 'length': length, 'period': period} as r from runs) group by doc_id),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as words
         from (select doc_id, unnest(w) as word, unnest(range(n)) as i from t) anti join gone using (doc_id, i) group by doc_id)
select t.doc_id, coalesce(n_runs, 0) as n_runs, cast(best.start as bigint) as start, cast(best.length as bigint) as length,
       cast(best.period as bigint) as period, cast(1000 * best.length // best.period as bigint) as exponent_milli,
       sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from t left join sums using (doc_id) left join kept using (doc_id)
"""


@register
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path())
