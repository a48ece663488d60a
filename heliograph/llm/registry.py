"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import read_back, reconstruct, render, streamed
from .jaccard import jaccard_groups
from .licenses import PHRASES, TEMPLATES, compile_template, items_of, scan_licenses
from .lines import dedup_lines
from .neighbours import nearest
from .packing import pack
from .pieces import decode_pieces, encode_pieces
from .quality import PROSE, STOP_WORDS, quality_report
from .substrings import dedup_substrings
from .urls import judge_urls


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_read(spark, sf_dir, "documents"), width=3, percent=90)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024).drop("ids")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_read(spark, sf_dir, "documents"), least=10, report=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: The rules that the query is asked for.
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(_read(spark, sf_dir, "pages"), rules)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_read(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(_read(spark, sf_dir, "documents"), path), path)
    return decoded.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = rows.unionByName(more)
    return read_back(render(reconstruct(streamed(rows))))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_read(spark, sf_dir, "documents"), k=20, report=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_packing": op2_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_license_scan": op5_license_scan,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_chat_format": op9_chat_format,
    "op10_substring_dedup": op10_substring_dedup,
}

#: ASCII white space, and a word, as DuckDB's regular expressions write them.
_WS, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _licenses_sql() -> str:
    """Templates as regular expressions over words that each are followed by a blank."""

    def pattern(markup: str) -> str:
        marks = {"<<optional>>": "(?:", "<<end>>": ")?"}
        return "".join(marks.get(x) or (f"(?:[^ ]+ ){{0,{x[6:-2]}}}" if x.startswith("<<any") else f"{x} ") for x in items_of(markup))

    found, leads = [], set()
    for base, group in ((True, PHRASES), (False, TEMPLATES)):
        for markup, label in group:
            first, reach = items_of(markup)[0], compile_template(markup, label).reach
            found.append(f"""select row_id, s, '{label}' as label, {str(base).lower()} as base, regexp_extract(array_to_string(words[s + 1 : s + {reach}], ' ') || ' ', '^{pattern(markup)}') as m
  from starts join docs using (row_id) where w = '{first}'""")
            leads.add(first)
    union = "\n  union all ".join(found)
    return rf"""
with docs as (
  select doc_id, row_number() over () as row_id,
         list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as words from documents),
starts as (select * from (select row_id, unnest(words) as w, unnest(range(len(words))) as s from docs) where w in ({", ".join(f"'{w}'" for w in sorted(leads))})),
found as (select row_id, s, label, base, length(m) - length(replace(m, ' ', '')) as n from ({union}) where m <> ''),
cover as (select row_id, count(distinct s + j) as covered from (select row_id, s, unnest(range(n)) as j from found) group by row_id),
said as (
  select row_id, count(*) filter (base) as n_base, min(s) filter (base) as first_word, max(s) filter (base) as last_word,
         coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels, coalesce(string_agg(distinct label, ',' order by label), '') as labels
  from found group by row_id)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(covered, 0) / greatest(len(words), 1) as score
from docs left join said using (row_id) left join cover using (row_id)"""


ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": rf"""
with recursive docs as (
  select doc_id, row_number() over () as row_id,
         list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{_WS}+'), lambda w: w <> '') as words from documents),
sets as (
  select doc_id, row_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')]
         else list_distinct([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)]) end as grams from docs),
names as (select grams, min(row_id) as s, len(grams) as n, min(doc_id) as doc_id from (select doc_id, row_id, list_sort(grams) as grams from sets) where len(grams) > 0 group by grams),
entries as (select s, n, unnest(grams) as gram from names),
pairs as (
  select a.s as a, b.s as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as common
  from entries a join entries b on a.gram = b.gram and a.s < b.s and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) group by a.s, b.s),
links as (select a, b from pairs where 100 * common >= 90 * (n + m - common)),
edges as (select a, b from links union all select b, a from links),
reach as (select s as a, s as b from names union select r.a, e.b from reach r join edges e on r.b = e.a),
groups as (select r.a as s, min(n.doc_id) as component_id from reach r join names n on r.b = n.s group by r.a)
select t.doc_id, cast(len(t.grams) as bigint) as n_shingles, coalesce(g.component_id, t.doc_id) as component_id
from sets t left join names n on list_sort(t.grams) = n.grams left join groups g on g.s = n.s""",
    "op5_license_scan": _licenses_sql(),
    "op3_line_dedup": rf"""
with lines as (
  select doc_id, row_id, i, line, {_LOWER.format(rf"regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', '')")} as key
  from (select doc_id, row_id, unnest(parts) as line, unnest(range(len(parts))) as i
        from (select doc_id, row_number() over () as row_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))),
hot as (select key from lines where key <> '' group by key having count(distinct row_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (h.key is not null) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (h.key is null), '')) as kept_sha256
from lines left join hot h on lines.key = h.key group by doc_id, row_id""",
    "op10_substring_dedup": rf"""
with docs as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '') as words from documents),
windows as (
  select doc_id, s, array_to_string(words[s + 1 : s + 20], ' ') as seq
  from (select doc_id, words, unnest(range(len(words) - 19)) as s from docs)),
late as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by seq order by doc_id, s) as r from windows) where r > 1),
gone as (select doc_id, list(distinct s + j) as places from late, range(20) t(j) group by doc_id),
kept as (
  select d.doc_id, len(words) as n_words, list_filter(words, lambda w, i: not list_contains(coalesce(places, []), i - 1)) as left_words
  from docs d left join gone g using (doc_id))
select doc_id, n_words, n_words - len(left_words) as n_removed, sha256(array_to_string(left_words, ' ')) as kept_sha256 from kept""",
    "op7_quality_rules": rf"""
with docs as (
  select doc_id, row_number() over () as row_id, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORD}')) as lines from documents),
windows as (
  select row_id, s, array_to_string(words[s + 1 : s + 8], ' ') as seq
  from (select row_id, words, unnest(range(len(words) - 7)) as s from docs)),
twice as (select row_id, s from (select row_id, s, count(*) over (partition by row_id, seq) as c from windows) where c > 1),
covered as (select row_id, count(distinct s + j) as n from twice, range(8) t(j) group by row_id),
m as (
  select doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
         cast(len(lines) as bigint) as n_lines,
         cast(len(list_filter(words, lambda w: w in ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) as bigint) as n_stop,
         cast(len(list_filter(lines, lambda l: regexp_matches(l, '^ *[-*•‣]'))) as bigint) as n_bullets
  from docs left join covered c using (row_id)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select *, not base_failed and {" and ".join(f"coalesce({r.value.replace(' / ', '::double / ')} between {r.low} and {r.high}, true)" for r in PROSE)} as kept
from j""",
    "op4_url_filter": rf"""
with p as (
  select page_id, row_number() over () as row_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
rules(h, p, v) as (values {", ".join(str(r) for r in URL_RULES)}),
found as (
  select row_id, h || p as rule, v, row_number() over (partition by row_id order by length(h) desc, length(p) desc, v) as r
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, rules.p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from p left join found f on p.row_id = f.row_id and r = 1""",
    "op9_chat_format": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as n,
         len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<</?SYS>>|</?s>|\[/?INST\]')) as marks
  from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + length(text) + marks + 12 + 1 + 12) as bigint) as formatted_chars
from o group by conv_id""",
}
