"""Queries of this subpackage: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read_once, read_table
from . import langid, leakage, mainbody, near_dup, packing, quality, residue, site_lines, split


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "crawler_pages")


def _once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Pages without the rows that were delivered twice."""
    return read_once(spark, sf_dir, "crawler_pages", "id", "id", *columns)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _near_dup(spark, sf_dir, min_words):
    return near_dup.near_duplicates(_pages(spark, sf_dir), "id", "markdown", size=3, similarity=0.7, min_words=min_words)


def p1_found(spark, sf_dir):
    return near_dup.expanded(*_near_dup(spark, sf_dir, 80))


def p1_groups(spark, sf_dir):
    """Groups of all pages, short ones included; the least number of words belongs to p1_found alone."""
    return near_dup.near_duplicate_groups(*_near_dup(spark, sf_dir, 1), _pages(spark, sf_dir).select("id"))


def p2_reasons(spark, sf_dir):
    return residue.residue(_pages(spark, sf_dir), "id", "final_url", "markdown")


def p2_found(spark, sf_dir):
    return p2_reasons(spark, sf_dir).select("id")


def p2_real_pages(spark, sf_dir):
    return residue.real_pages(_once(spark, sf_dir, "final_url", "markdown"), "id", "final_url", "markdown").select("id")


def p3_found(spark, sf_dir):
    return split.oversized_blocks(_once(spark, sf_dir, "markdown"), "id", "markdown").select("id", "block_no")


def p3_pieces(spark, sf_dir):
    return split.split_pieces(_once(spark, sf_dir, "markdown"), "id", "markdown")


def p5_main_blocks(spark, sf_dir):
    return mainbody.main_blocks(_once(spark, sf_dir, "final_url", "html_content"), "id", "final_url", "html_content")


def p5_found(spark, sf_dir):
    return mainbody.main_blocks(_pages(spark, sf_dir), "id", "final_url", "html_content").select("id", "block_key").distinct()


def _quality(spark, sf_dir):
    return quality.text_quality(_once(spark, sf_dir, "markdown"), "id", "markdown", read_table(spark, sf_dir, "common_words"))


def p6_found(spark, sf_dir):
    return quality.poor_quality(_quality(spark, sf_dir)).select("id")


def p6_stats(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "ended_share", "common_share")]
    return _quality(spark, sf_dir).select("id", "n_words", *rounded)


def p6_line_kinds(spark, sf_dir):
    return _quality(spark, sf_dir).select("id", *(f"{s}_share" for s in quality.STATES), "kind")


def p7_found(spark, sf_dir):
    return site_lines.repeated_lines(_pages(spark, sf_dir), "id", "final_url", "markdown")


def p7_clean(spark, sf_dir):
    pages = _once(spark, sf_dir, "final_url", "markdown")
    return site_lines.without_repeated_lines(pages, "id", "final_url", "markdown").select("id", "site_text")


def p7_template_lines(spark, sf_dir):
    """Lines repeated with small differences: those of p7_found and lines that differ in a slot of their template."""
    return site_lines.template_lines(_pages(spark, sf_dir), "id", "final_url", "markdown")


def p7_templates(spark, sf_dir):
    return site_lines.site_templates(_pages(spark, sf_dir), "id", "final_url", "markdown")


def _packed(spark, sf_dir):
    return packing.pack(spark, packing.token_counts(_documents(spark, sf_dir), "doc_id", "text"))


def p8_found(spark, sf_dir):
    return _packed(spark, sf_dir).filter("part_no >= 1").select(F.col("id").alias("doc_id")).distinct()


def p8_containers(spark, sf_dir):
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p8_fill(spark, sf_dir):
    """How the containers are filled: documents packed, tokens lost, containers over the capacity, and whether they are at
    most 2 % more than the tokens need."""
    counted = packing.token_counts(_documents(spark, sf_dir), "doc_id", "text")
    packed = packing.pack(spark, counted)
    tokens = counted.agg(F.sum("n_tokens").alias("tokens"))
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count("*").alias("boxes"), F.sum("n").alias("packed"), F.count_if(F.col("n") > packing.CAPACITY).alias("overfull"))
    docs = packed.agg(F.count_distinct("id").alias("docs"))
    all_ = docs.crossJoin(F.broadcast(boxes)).crossJoin(F.broadcast(tokens))  # single rows
    return all_.select("docs", (F.col("tokens") - F.col("packed")).alias("lost_tokens"), "overfull", (F.col("boxes") <= F.ceil(1.02 * F.ceil(F.col("tokens") / packing.CAPACITY))).alias("well_filled"))


def _leaks(spark, sf_dir):
    return leakage.leaked_spans(_documents(spark, sf_dir), read_table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


def p9_found(spark, sf_dir):
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_spans(spark, sf_dir):
    return _leaks(spark, sf_dir)


def p9_runs(spark, sf_dir):
    """Each leaked passage of its own."""
    return leakage.leaked_runs(_documents(spark, sf_dir), read_table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


def p9_cut(spark, sf_dir):
    """Whole documents, without their leaked passages."""
    cut = leakage.without_leaked_spans(_documents(spark, sf_dir).select("doc_id", "text"), read_table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")
    return cut.select("doc_id", F.md5("clean_text").alias("clean_md5"), F.length("clean_text").alias("n_chars"))


def p9_clean(spark, sf_dir):
    return leakage.without_leaks(_documents(spark, sf_dir), read_table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text").select("doc_id")


def _samples(spark, sf_dir):
    """Texts of known language; the common words of a language are such texts too."""
    return read_table(spark, sf_dir, "lang_samples").select("lang", "text").unionByName(read_table(spark, sf_dir, "common_words").select("lang", F.col("word").alias("text")))


def p10_found(spark, sf_dir):
    return langid.mislabelled_segments(_documents(spark, sf_dir), "doc_id", "text", "lang", _samples(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p10_segments(spark, sf_dir):
    return langid.segment_languages(_documents(spark, sf_dir), "doc_id", "text", _samples(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p10_documents(spark, sf_dir):
    return langid.document_languages(langid.segment_languages(_documents(spark, sf_dir), "doc_id", "text", _samples(spark, sf_dir))).withColumnRenamed("id", "doc_id")


_WS = r"[\t\n\x0B\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_P6 = rf"""with p as (select distinct id, markdown from crawler_pages), c as (select list(distinct word) as l from common_words),
w as (select id, markdown, list_filter(regexp_split_to_array(markdown, '{_WS}+'), lambda x: x <> '') as words,
  list_filter(list_transform(string_split(markdown, chr(10)), lambda x: regexp_replace(x, '{_WS}+$', '')), lambda x: x <> '') as lines from p),
s as (select id, markdown, len(words) as n_words, list_sum(list_transform(words, lambda x: length(x))) as chars,
  length(regexp_replace(markdown, '[\p{{L}}\p{{N}}]|{_WS}', '', 'g')) as symbols, len(lines) as n_lines,
  len(list_filter(lines, lambda x: right(x, 1) in ('.', '!', '?'))) as ended,
  len(list_filter(words, lambda x: list_contains(c.l, lower(x)) or list_contains(c.l, regexp_replace(lower(x), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')))) as common from w, c),
r as (select id, cast(n_words as bigint) as n_words, case when n_words > 0 then chars / n_words end as mean_word_length, case when n_words > 0 then symbols / chars end as symbol_ratio,
  case when n_words > 0 then ended / n_lines end as ended_share, case when n_words > 0 then common / n_words end as common_share from s)"""

_P1 = r"""with w as (select id, regexp_extract_all(lower(markdown), '[\p{L}\p{N}]+') as w from (select distinct id, markdown from crawler_pages where markdown is not null)),
s as (select distinct id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 80)),
n as (select id, count(*) as n from s group by id), m as (select a.id as id_a, b.id as id_b, count(*) as m from s a join s b on a.g = b.g and a.id < b.id group by 1, 2)
select id_a, id_b from m join n x on x.id = id_a join n y on y.id = id_b where 10 * m >= 7 * (x.n + y.n - m)"""

_P3 = rf"""with p as (select distinct id, markdown from crawler_pages where length(markdown) > 4000),
l as (select id, i, lines[i] as raw, regexp_replace(lines[i], '{_WS}+$', '') as t from (select id, lines, unnest(range(1, len(lines) + 1)) as i from (select id, string_split(markdown, chr(10)) as lines from p))),
f as (select *, case when regexp_matches(raw, '^{_WS}*```') then 1 else 0 end as fence from l),
c as (select *, sum(fence) over (partition by id order by i) as k, sum(fence) over (partition by id) as total from f),
b as (select *, t <> '' or (k % 2 = 1 and k < total) as part from c),
s as (select *, case when part and not coalesce(lag(part) over (partition by id order by i), false) then 1 else 0 end as opens from b),
g as (select id, t, part, sum(opens) over (partition by id order by i) - 1 as block_no from s)
select id, cast(block_no as integer) as block_no from g where part group by id, block_no having sum(length(t) + 1) - 1 > 4000"""

_P7 = rf"""with p as (select distinct id, markdown, regexp_replace(regexp_replace(regexp_extract(regexp_replace(lower(trim(final_url)), '^[a-z][a-z0-9+.-]*://', ''), '^([^/?#]*)', 1), ':[0-9]*$', ''), '^www\.', '') as host from crawler_pages where markdown is not null and final_url is not null),
l as (select id, host, i - 1 as line_no, lines[i] as line, trim(regexp_replace(regexp_replace(lower(lines[i]), '[0-9]', '', 'g'), '{_WS}+', ' ', 'g')) as key from (select id, host, lines, unnest(range(1, len(lines) + 1)) as i from (select id, host, string_split(markdown, chr(10)) as lines from p where host <> ''))),
n as (select host, count(distinct id) as pages from p group by host),
k as (select host, key from (select host, key, count(distinct id) as docs from l group by host, key) join n using (host) where docs >= 5 and docs * 5 >= pages)
select id, cast(line_no as integer) as line_no from l join k using (host, key) where len(regexp_extract_all(line, '\p{{L}}+')) >= 3"""

_P9 = r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
e as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
dg as (select doc_id, array_to_string(w[i:i+11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
eg as (select item_id, array_to_string(w[i:i+11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e)),
f as (select distinct doc_id, item_id from dg join eg using (g)) """

_P7_CLEAN = f"""with r as ({_P7}), l as (select id, i, lines[i] as line from (select id, lines, unnest(range(1, len(lines) + 1)) as i from (select id, string_split(markdown, chr(10)) as lines from (select distinct id, markdown from crawler_pages))))
select p.id as id, case when p.markdown is null then null else coalesce(t, '') end as site_text from (select distinct id, markdown from crawler_pages) p left join (select l.id as id, array_to_string(list(line order by i), chr(10)) as t from l anti join r on r.id = l.id and r.line_no = l.i - 1 group by l.id) k on k.id = p.id"""

_P9_SPANS = r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
e as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_items),
dg as (select doc_id, i, array_to_string(w[i:i+11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from d)),
eg as (select distinct item_id, array_to_string(w[i:i+11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as i from e))
select doc_id, item_id, cast(min(i) - 1 as integer) as first_word, cast(max(i) + 10 as integer) as last_word, cast(count(*) as integer) as n_windows from dg join eg using (g) group by doc_id, item_id"""

_P9_RUNS = _P9_SPANS[: _P9_SPANS.rindex("select doc_id, item_id, cast(min(i)")] + """select doc_id, item_id, cast(min(i) - 1 as integer) as first_word, cast(max(i) + 10 as integer) as last_word
from (select *, i - row_number() over (partition by doc_id, item_id order by i) as island from (select distinct doc_id, item_id, i from dg join eg using (g))) group by doc_id, item_id, island"""

QUERIES = {
    "p1_found": (p1_found, _P1),
    "p1_groups": (p1_groups, None),
    "p2_found": (p2_found, None),
    "p2_reasons": (p2_reasons, None),
    "p2_real_pages": (p2_real_pages, None),
    "p3_found": (p3_found, _P3),
    "p3_pieces": (p3_pieces, None),
    "p5_found": (p5_found, None),
    "p5_main_blocks": (p5_main_blocks, None),
    "p6_found": (p6_found, _P6 + " select id from r where n_words >= 20 and (case when mean_word_length < 3.5 or mean_word_length > 7.5 then 1 else 0 end) + (case when symbol_ratio > 0.12 then 1 else 0 end) + (case when ended_share < 0.28 then 1 else 0 end) + (case when common_share < 0.15 then 1 else 0 end) >= 2"),
    "p6_stats": (p6_stats, _P6 + " select id, case when markdown is null then null else n_words end as n_words, round(mean_word_length, 6) as mean_word_length, round(symbol_ratio, 6) as symbol_ratio, round(ended_share, 6) as ended_share, round(common_share, 6) as common_share from r join p using (id)"),
    "p6_line_kinds": (p6_line_kinds, None),
    "p7_found": (p7_found, _P7),
    "p7_clean": (p7_clean, _P7_CLEAN),
    "p7_template_lines": (p7_template_lines, None),
    "p7_templates": (p7_templates, None),
    # a token never spans two words, so more than 1,024 words are more than 1,024 tokens; no document is near the limit
    "p8_found": (p8_found, r"select doc_id from documents where len(regexp_extract_all(text, '\S+')) > 1024"),
    "p8_containers": (p8_containers, None),
    "p8_fill": (p8_fill, "select count(*) as docs, cast(0 as bigint) as lost_tokens, cast(0 as bigint) as overfull, true as well_filled from documents where text <> ''"),
    "p9_found": (p9_found, _P9 + "select doc_id, item_id from f"),
    "p9_spans": (p9_spans, _P9_SPANS),
    "p9_runs": (p9_runs, _P9_RUNS),
    "p9_cut": (p9_cut, None),
    "p9_clean": (p9_clean, _P9 + "select doc_id from documents where doc_id not in (select doc_id from f)"),
    "p10_found": (p10_found, None),
    "p10_segments": (p10_segments, None),
    "p10_documents": (p10_documents, None),
}
