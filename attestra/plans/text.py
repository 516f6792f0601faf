"""Queries of the text operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import text as T
from .registry import query
from .views import HEADED, LINES, headed, lines, table

c = F.col

_TRIM = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
_LEVEL = r"""case when regexp_matches(s, '^#\s+(.+)$') then 1 when regexp_matches(s, '^(ARTICLE|Article)\s+[IVXLCDM\d]+') then 1 when regexp_matches(s, '^(SECTION|Section)\s+[\d.]+') then 2
 when regexp_matches(s, '^##\s+(.+)$') then 2 when regexp_matches(s, '^###\s+(.+)$') then 3 when regexp_matches(s, '^\s*\d+\.\d+\s+[A-Z]') then 3
 when regexp_matches(s, '^(EXHIBIT|Exhibit|SCHEDULE|Schedule)\s+[A-Z\d]') then 1 when regexp_matches(s, '^#\s*Page\s+\d+') then 1 end"""
SECTIONS = f"""{HEADED}, hl as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no, length(text) as size from headed),
 placed as (select *, coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as start_char, trim(line, {_TRIM}) as s from hl),
 lv as (select *, {_LEVEL} as level from placed),
 sections as (select doc_id, substr(trim(regexp_replace(s, '^#+', ''), {_TRIM}), 1, 120) as name, cast(start_char as bigint) as start_char, cast(coalesce(lead(start_char) over (partition by doc_id order by line_no), size) as bigint) as end_char, level from lv where level is not null
  union all select doc_id, 'Full Document', 0, length(text), 1 from headed where doc_id not in (select doc_id from lv where level is not null))"""


@query("section_index", f"with {SECTIONS} select * from sections")
def section_index(spark, sf_dir):
    return T.section_index(headed(table(spark, sf_dir, "documents")))


@query("section_lookup", f"""with {SECTIONS}, want as (select doc_id, name as wanted from (select *, row_number() over (partition by doc_id order by start_char desc) as n from sections) where n = 1),
 hit as (select s.doc_id, w.wanted, s.start_char, s.end_char, row_number() over (partition by s.doc_id order by case when lower(s.name) = lower(w.wanted) then 0 else 1 end, s.start_char) as n
  from sections s join want w using (doc_id) where lower(s.name) = lower(w.wanted) or contains(lower(s.name), lower(w.wanted)) or contains(lower(w.wanted), lower(s.name)))
 select h.doc_id, wanted, substr(text, start_char + 1, least(end_char - start_char, 24000)) as body from hit h join headed using (doc_id) where n = 1""")  # fmt: skip
def section_lookup(spark, sf_dir):
    docs = headed(table(spark, sf_dir, "documents"))
    sections = T.section_index(docs)
    last = Window.partitionBy("doc_id").orderBy(F.desc("start_char"))
    want = sections.withColumn("n", F.row_number().over(last)).where("n = 1").select("doc_id", F.col("name").alias("wanted"))
    a, b = F.lower("name"), F.lower("wanted")
    hit = sections.join(want, "doc_id").where((a == b) | F.contains(a, b) | F.contains(b, a))
    best = hit.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(a == b, 0).otherwise(1), "start_char"))).where("n = 1")
    return best.join(docs, "doc_id").select("doc_id", "wanted", F.substring("text", (F.col("start_char") + 1).cast("int"), F.least(F.col("end_char") - F.col("start_char"), F.lit(24_000)).cast("int")).alias("body"))


@query("chunk_overlap", f"""with s as (select doc_id, text, unnest(range(0, greatest(length(text), 1), 900)) as start_char from documents)
 select doc_id, cast(start_char // 900 + 1 as integer) as part, cast(start_char as integer) as start_char, substr(text, start_char + 1, 1000) as chunk from s where length(trim(substr(text, start_char + 1, 1000), {_TRIM})) >= 50""")
def chunk_overlap(spark, sf_dir):
    return T.overlapping_chunks(table(spark, sf_dir, "documents"), 1000, 900, 50)


@query("chunk_fixed", """with c as (select doc_id, length(text) as size, greatest(cast(ceil(length(text) / 2000.0) as integer), 1) as total from documents), n as (select *, unnest(range(1, total + 1)) as number from c)
 select doc_id, cast(number as integer) as number, total, unnest(['extract', 'inventory']) as mode, cast((number - 1) * 2000 as integer) as start_char, cast(least(number * 2000, size) as integer) as end_char from n""")
def chunk_fixed(spark, sf_dir):
    return T.fixed_chunks(table(spark, sf_dir, "documents"), 2000)


@query("excerpt3", """select doc_id, case when length(text) <= 900 then text else substr(text, 1, 300) || chr(10) || '...' || chr(10) || substr(text, cast(floor(length(text) / 2) as bigint) - 149, 300) || chr(10) || '...' || chr(10) || substr(text, -300, 300) end as excerpt from documents""")
def excerpt3(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt(F.col("text"), 900).alias("excerpt"))


@query("path_parts", """with p as (select page_id, list_filter(string_split(url, '/'), lambda x: x <> '') as parts from pages), f as (select *, parts[1:len(parts) - 1] as folders from p)
 select page_id, array_to_string(folders[greatest(len(folders) - 1, 1):], '/') as category, array_to_string(parts[greatest(len(parts) - 2, 1):], '/') as hint from f""")
def path_parts(spark, sf_dir):
    category, hint = T.path_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", category.alias("category"), hint.alias("hint"))


@query("headings", f"with {HEADED} select doc_id, len(h) as n_headings, h[1] as first_heading from (select doc_id, regexp_extract_all(text, '(?m)^#{{1,4}}[ \\t]+(.+)$', 1) as h from headed)")
def headings(spark, sf_dir):
    h = F.regexp_extract_all("text", F.lit(r"(?m)^#{1,4}[ \t]+(.+)$"), 1)
    return headed(table(spark, sf_dir, "documents")).select("doc_id", h.alias("h")).select("doc_id", F.size("h").cast("long").alias("n_headings"), F.get("h", F.lit(0)).alias("first_heading"))


@query("doc_sample", "select doc_id, substr(text, 1, 2000) as head, substr(text, -500) as tail, case when length(text) > 2500 then true else false end as cut from documents")
def doc_sample(spark, sf_dir):
    text = F.col("text")
    tail = F.when(F.length(text) <= 500, text).otherwise(F.substring(text, -500, 500))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(text, 1, 2000).alias("head"), tail.alias("tail"), (F.length(text) > 2500).alias("cut"))


@query("claim_lines", rf"""with {LINES}, c as (select *, substr(regexp_replace(trim(regexp_replace(trim(line, {_TRIM}), '^[#*\-\s\d.():]+', ''), {_TRIM}), '\s+', ' ', 'g'), 1, 600) as clean from lines),
 f as (select *, row_number() over (partition by doc_id, lower(substr(clean, 1, 180)) order by line_no) as n from c where length(clean) between 30 and 700 and regexp_matches(clean, '(?i)(licensed|version|[0-9]+)') and regexp_matches(clean, '[.!?)]$|[A-Za-z0-9_]$')),
 r as (select *, row_number() over (partition by doc_id order by line_no) as rank from f where n = 1)
 select doc_id, cast(rank as integer) as rank, clean as line from r where rank <= 80""")
def claim_lines(spark, sf_dir):
    return T.claim_lines(lines(table(spark, sf_dir, "documents")), "(?i)(licensed|version|[0-9]+)")


#: A name in brackets for every line, in turns; lines of kind 2 become headings.
_ASKED = ["[Amount]", "[Party Name]", "[tbd]", "[Deadline]", "[XXX]", "[_____]", "[Someone]", "[Insert]"]


@query("placeholders", f"""with {LINES}, m as (select doc_id, line_no, case when line_no % 3 = 2 then '## ' else '' end || line || ' ' || {_ASKED}[line_no % 8 + 1] || ' and [tba]' as line from lines)
 select doc_id, line_no, unnest(regexp_extract_all(line, '{T.PLACEHOLDER}')) as placeholder, substr(trim(line, {_TRIM}), 1, 200) as context from m
 where not regexp_matches(line, '^\\s*#{{1,6}}\\s+') and not (regexp_matches(line, '^\\s*\\d+\\.\\s+\\S') and length(trim(line, {_TRIM})) <= 80)""")
def placeholders(spark, sf_dir):
    line, n = F.col("line"), F.col("line_no").cast("int")
    composed = F.concat(F.when(n % 3 == 2, "## ").otherwise(""), line, F.lit(" "), F.get(F.array(*map(F.lit, _ASKED)), n % 8), F.lit(" and [tba]"))
    return T.placeholders(lines(table(spark, sf_dir, "documents")).withColumn("line", composed)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "placeholder", "context")


@query("trigrams", r"""with w as (select doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda x: x <> '') as w, trim(lower(text), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as t from documents)
 select doc_id, case when len(w) >= 3 then len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) else 1 end as n_trigrams from w""")
def trigrams(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.word_trigrams(F.col("text"))).cast("long").alias("n_trigrams"))


@query("usable_text", "select source, count(*) filter (length(trim(case when doc_id % 7 = 0 then '  ' else text end)) > 0) as kept, count(*) filter (not length(trim(case when doc_id % 7 = 0 then '  ' else text end)) > 0) as failed from documents group by source")
def usable_text(spark, sf_dir):
    ok = F.length(F.trim(F.when(F.col("doc_id") % 7 == 0, F.lit("  ")).otherwise(F.col("text")))) > 0
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("failed"))


@query("clean_lines", rf"""with {LINES}, b as (select *, trim(line, {_TRIM}) as s from lines), k as (select *, case when s <> '' then regexp_replace(lower(trim(regexp_replace(s, '^#+\s*', ''), {_TRIM})), '[^a-z0-9]+', ' ', 'g') end as key from b),
 p as (select *, last_value(key ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as before, lag(s = '') over (partition by doc_id order by line_no) as after_blank from k)
 select doc_id, cast(line_no as integer) as line_no, line from p where not case when s = '' then coalesce(after_blank, true) else coalesce(key = before and length(s) <= 80, false) end""")
def clean_lines(spark, sf_dir):
    return T.cleaned_lines(lines(table(spark, sf_dir, "documents")))


@query("claim_rows", r"select doc_id, substr(regexp_replace(text, '\s+', ' ', 'g'), 1, 500) as content, substr(text, 1, 220) as evidence from documents")
def claim_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 500).alias("content"), F.substring("text", 1, 220).alias("evidence"))


@query("text_page", "select doc_id, substr(text, 501, 400) as page, least(900, length(text)) as end_char, length(text) > 900 as truncated, length(text) as total from documents")
def text_page(spark, sf_dir):
    total = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 501, 400).alias("page"), F.least(F.lit(900), total).cast("long").alias("end_char"), (total > 900).alias("truncated"), total.alias("total"))


@query("assemble", """with l as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem)
 select l_orderkey, string_agg('part ' || l_partkey || ' from ' || l_suppkey || ' x' || cast(cast(l_quantity as integer) as varchar), chr(10) order by l_linenumber, l_partkey, l_suppkey, l_quantity) as text, count(*) as parts from l group by l_orderkey""")
def assemble(spark, sf_dir):
    line = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" from "), F.col("l_suppkey").cast("string"), F.lit(" x"), F.col("l_quantity").cast("int").cast("string"))
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", line.alias("line"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(parts["line"], "\n").alias("text"), F.count(F.lit(1)).alias("parts"))


@query("page_text", r"""with t as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g') as t from pages)
 select page_id, substr(trim(regexp_replace(replace(replace(replace(replace(t, '&copy;', '(c)'), '&middot;', '-'), '&lt;', '<'), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g')), 1, 15000) as text from t""")
def page_text(spark, sf_dir):
    t = F.col("html")
    for pattern in (r"(?s)<(script|style)[^>]*>.*?</(script|style)>", r"(?s)<!--.*?-->", r"<[^>]+>"):
        t = F.regexp_replace(t, pattern, " ")
    for mark, char in (("&copy;", "(c)"), ("&middot;", "-"), ("&lt;", "<"), ("&amp;", "&")):
        t = F.replace(t, F.lit(mark), F.lit(char))
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.trim(F.regexp_replace(t, "[ \t\r\n\f]+", " ")), 1, 15_000).alias("text"))


@query("window_score")
def window_score(spark, sf_dir):
    """All items with all their terms against all documents."""
    return T.scored_windows(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("context_words", "select doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda w: w not in (" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "))[1:5] as words from documents")
def context_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.context_words(F.col("text")).alias("words"))


@query("strip_heading", r"""with d as (select doc_id, source, trim(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12)) as body from documents)
 select doc_id, case doc_id % 3 when 2 then 'Notes' || case when body = '' then '' else chr(10) || body end else body end as text from d""")
def strip_heading(spark, sf_dir):
    """Documents under a heading that repeats their source, a sheet heading that does, or another heading (which stays)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.trim(F.coalesce("text", F.lit("")), F.lit(T.BLANKS + "\n")).alias("text"))
    top = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n## 1. **"), F.upper("source"), F.lit("**\n\n"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("# Sheet:  "), F.col("source"), F.lit("\n"))).otherwise("Notes\n")
    return docs.select("doc_id", T.without_heading(F.concat(top, "text"), F.col("source")).alias("text"))


_SHEETS = f"""{LINES}, m as (select doc_id as text_id, line_no, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as w, case when line_no % 7 = 3 then '## Sheet: S' || line_no % 3 || '/' || doc_id % 2 when line_no % 7 = 4 then '|---|:---:|' when line_no % 7 in (5, 6) then '| ' || line || ' | x|' || line_no || ' |' else line end as line from lines)"""


@query("sheet_cells", rf"""with {_SHEETS}, z as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as z from m), n as (select *, case when line_no % 7 = 3 then 'S' || line_no % 3 || ' ' || text_id % 2 end as opened from z where z <> ''),
 r as (select *, coalesce(last_value(opened ignore nulls) over (partition by text_id order by line_no), 'Analysis') as sheet from n), k as (select * from r where opened is null and not regexp_matches(z, '^\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)+\|?$'))
 select text_id, sheet, row_number() over (partition by text_id, sheet order by line_no) as row_no, case when length(z) - length(replace(z, '|', '')) >= 2 then list_transform(string_split(trim(z, '|'), '|'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) else [z] end as cells from k""")
def sheet_cells(spark, sf_dir):
    k, line = c("line_no") % 7, c("line")
    marked = F.when(k == 3, F.concat(F.lit("## Sheet: S"), (c("line_no") % 3).cast("string"), F.lit("/"), (c("doc_id") % 2).cast("string"))).when(k == 4, "|---|:---:|").when(k.isin(5, 6), F.concat(F.lit("| "), line, F.lit(" | x|"), c("line_no").cast("string"), F.lit(" |"))).otherwise(line)
    return T.sheet_rows(lines(table(spark, sf_dir, "documents")).select(c("doc_id").alias("text_id"), "line_no", marked.alias("line")))


@query("typed_paragraphs", f"""with {LINES}, m as (select doc_id, line_no, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as w from lines)
 select doc_id, line_no, case line_no % 5 when 0 then 'heading' when 1 then 'bullet' when 2 then 'numbered' when 3 then 'blank' else case when w = '' then 'blank' else 'text' end end as kind, case when line_no % 5 = 0 then line_no % 4 + 1 end as level, case when line_no % 5 = 3 then '' else w end as text from m where w <> '' or line_no % 5 > 2""")
def typed_paragraphs(spark, sf_dir):
    k, line = c("line_no") % 5, T.stripped(c("line"))
    marked = F.when(k == 0, F.concat(F.repeat(F.lit("#"), (c("line_no") % 4 + 1).cast("int")), F.lit(" "), line)).when(k == 1, F.concat(F.lit("* "), line)).when(k == 2, F.concat(F.lit("12) "), line)).when(k == 3, " ").otherwise(c("line"))
    rows = lines(table(spark, sf_dir, "documents")).where((line != "") | (k > 2)).select("doc_id", c("line_no").cast("long").alias("line_no"), T.typed_paragraph(marked).alias("p"))
    return rows.select("doc_id", "line_no", "p.*")
