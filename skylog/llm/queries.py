"""Registered queries of the operators and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, fingerprints, html_text, lm_score, ngram_join, oracle_sql, packing, prefix_trie, spelling, substring_dedup, token_counts, toxicity, url_lists
from .tables import read

_SPACE = r"[\x20\x09-\x0D]+"


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures of a day by page_id, against list events derived from the hosts of all pages."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", day(F.col("page_id") * 7919 % 366).alias("fetched"))
    hosts = pages.select(
        F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)).alias("host"), "page_id"
    ).groupBy("host").agg(F.min("page_id").alias("m"))
    m, first = F.col("m"), F.col("m") * 31 % 300
    event = lambda name, pattern, action, n: F.struct(F.lit(name).alias("list_name"), pattern.alias("pattern"), F.lit(action).alias("action"), day(n).alias("effective"))
    host, parent = F.col("host"), F.regexp_replace("host", r"^[^.]+\.", "")
    blocks = F.array(event("spam", host, "add", first), event("spam", host, "remove", first + 45), event("spam", host, "add", first + 120))
    allows = F.when(
        m % 5 == 0, F.array(event("allow", parent, "add", m * 17 % 366), event("allow", parent, "remove", m * 17 % 366 + 20))
    ).otherwise(F.array().cast("array<struct<list_name:string,pattern:string,action:string,effective:date>>"))
    entries = hosts.where("host != ''").select(F.inline(F.concat(blocks, allows)))
    return url_lists.judge(captures, entries).select(
        "capture_id", "fetched", "n_active", F.array_join("lists", ",").alias("lists"), "blocked"
    )


_OP3 = """
with captures as (
  select page_id as capture_id, url, date '2024-01-01' + cast(page_id * 7919 % 366 as integer) as fetched,
         lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) as host from pages),
hosts as (select host, min(capture_id) as m from captures where host <> '' group by host),
entries as (
  select 'spam' as list_name, host as pattern, true as added, m * 31 % 300 as day from hosts
  union all select 'spam', host, false, m * 31 % 300 + 45 from hosts
  union all select 'spam', host, true, m * 31 % 300 + 120 from hosts
  union all select 'allow', regexp_replace(host, '^[^.]+[.]', ''), true, m * 17 % 366 from hosts where m % 5 = 0
  union all select 'allow', regexp_replace(host, '^[^.]+[.]', ''), false, m * 17 % 366 + 20 from hosts where m % 5 = 0),
days as (
  select list_name, pattern, date '2024-01-01' + cast(day as integer) as from_day, bool_and(added) as added
  from entries group by all),
changes as (
  select * from (select *, lag(added, 1, false) over (partition by list_name, pattern order by from_day) as before from days)
  where added <> before),
valid as (
  select * from (select *, lead(from_day) over (partition by list_name, pattern order by from_day) as until_day from changes)
  where added),
keys as (
  select capture_id, fetched, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) as pattern
  from captures where host <> ''),
met as (
  select k.capture_id, count(*) as n_active, string_agg(distinct v.list_name, ',' order by v.list_name) as lists
  from keys k join valid v on v.pattern = k.pattern and v.from_day <= k.fetched and (v.until_day is null or k.fetched < v.until_day)
  group by k.capture_id)
select c.capture_id, c.fetched, coalesce(n_active, 0) as n_active, coalesce(lists, '') as lists,
       coalesce(lists, '') <> '' and not contains(coalesce(lists, ''), 'allow') as blocked
from captures c left join met using (capture_id)
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    learnt = read(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(documents, toxicity.fit(documents, learnt))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    good = read(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.score_within(documents, good).drop("key", "salt")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = fingerprints.compare_with_next(read(spark, sf_dir, "documents"))
    return compared.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: a word cut near its start, words put in its middle, its last eighth put anew."""
    documents = read(spark, sf_dir, "documents")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda k, start, end, new: F.struct(F.lit(k).alias("n"), start.cast("long").alias("start"), end.cast("long").alias("end"), new.alias("new_text"))
    a, b, c = F.floor(n / 10), F.floor(n / 2), F.floor(n * 7 / 8)
    text = F.coalesce("text", F.lit(""))
    new = F.array(
        edit(1, a, a + 5, F.lit("")), edit(2, b, b, F.concat(F.lit(" edited: "), F.substr(text, F.lit(1), F.lit(12)))),
        edit(3, c, F.least(c + 40, n), F.upper(F.substr(text, (c + 1).cast("int"), F.lit(40)))),
    )
    return token_counts.count_edited(documents, documents.select("doc_id", F.explode(new).alias("e")).select("doc_id", "e.*"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), _SPACE, " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(read(spark, sf_dir, "documents"), slip=97)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(read(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_openings(turns))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_chars, the end of the last token's offsets, is the text's length."""
    # a text without tokens has no last one
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents"), parts=True).select(
        "doc_id", "part", "last", "ids", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_chars")
    )
    return byte_bpe.digests(byte_bpe.decode(encoded))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline, "op1_ngram_join": op1_ngram_join, "op2_html_text": op2_html_text, "op3_url_lists": op3_url_lists,
    "op4_toxicity": op4_toxicity, "op5_lm_score": op5_lm_score, "op6_fingerprints": op6_fingerprints,
    "op7_packing": op7_packing, "op8_token_counts": op8_token_counts, "op9_decontamination": op9_decontamination,
    "op10_substring_dedup": op10_substring_dedup, "op11_spelling_variants": op11_spelling_variants, "op12_prefix_trie": op12_prefix_trie,
    "op13_byte_bpe": op13_byte_bpe
}
SQL: dict[str, str] = {
    "op1_ngram_join": oracle_sql.OP1, "op3_url_lists": _OP3, "op9_decontamination": oracle_sql.OP9,
    "op10_substring_dedup": oracle_sql.OP10, "op11_spelling_variants": oracle_sql.OP11, "op12_prefix_trie": oracle_sql.OP12
}
