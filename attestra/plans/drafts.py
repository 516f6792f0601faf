"""Queries of telling phrases, risky lines, target documents and due files."""

from pyspark.sql import functions as F

from ..operators import drafts as D
from .registry import query
from .views import LINES, table

c = F.col
#: Letters that both engines write in capitals in the same way.
_SMALL, _LARGE = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query("phrases_top10", rf"""with seg as (select doc_id, unnest(regexp_split_to_array(lower(text), '{D.SEGMENT_END}')) as s from documents), w as (select doc_id, regexp_extract_all(s, '[a-z][a-z0-9''-]*') as w from seg),
 n as (select doc_id, w, unnest([2, 3, 4]) as n from w), g as (select distinct doc_id, p from (select doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) as p from n where len(w) >= n)),
 v as (select doc_id, p, array_to_string(p, ' ') as phrase, len(list_filter(p, lambda x: x in ({_in(D.HINT_WORDS)}))) as hints from g where len(list_filter(p, lambda x: length(x) < 4 or x in ({_in(D.PHRASE_STOP_WORDS)}))) = 0 and len(list_distinct(p)) >= 2),
 s as (select doc_id, phrase, cast(5 * len(p) + least(length(array_to_string(p, '')), 40) + 10 * hints + case when hints > 0 then 8 else 0 end as bigint) as score from v where phrase not in ({_in(D.LOW_VALUE_PHRASES)}) and length(phrase) <= 90)
 select doc_id, place, phrase, score from (select *, row_number() over (partition by doc_id order by score desc, phrase) as place from s) where place <= 10""")  # fmt: skip
def phrases_top10(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(D.phrases(c("text"))).alias("place", "p"))
    return found.select("doc_id", (c("place") + 1).cast("long").alias("place"), c("p.phrase").alias("phrase"), c("p.score").alias("score"))


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("quarantine_lines", rf"""with r as (select doc_id, 0 as seq, translate(substr(text, 21, 60), '{_SMALL}', '{_LARGE}') as claim, ['unsupported', 'supported', 'overstated', 'needs_source', 'unsupported'][doc_id % 5 + 1] as status, ['high', 'low', 'medium'][doc_id % 3 + 1] as severity from documents
  union all select doc_id, 1, string_split(text, chr(10))[-1] || ' in Q3', 'needs_source', 'critical' from documents where doc_id % 7 = 0),
 k as (select doc_id, seq, status, {_STRIP.format("claim")} as claim from r where status <> 'supported' and severity <> 'low'),
 m as (select doc_id, seq, status, lower(claim) as claim, list_transform(regexp_extract_all(claim, '{D.CLAIM_NUMBERS}'), lambda x: lower(x)) as ns, regexp_extract_all(lower(claim), '[a-z][a-z0-9_-]{{3,}}') as ws from k where claim <> ''),
 d as (select doc_id, seq, status, claim, list_transform(list_filter(list_zip(ns, range(1, len(ns) + 1)), lambda p: list_position(ns, p[1]) = p[2]), lambda p: p[1])[1:8] as numbers,
  list_filter(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda p: list_position(ws, p[1]) = p[2]), lambda p: p[1]), lambda x: x not in ({_in(D.CLAIM_STOP_WORDS)}))[1:12] as words from m),
 {LINES}, b as (select doc_id, line_no, line, lower({_STRIP.format("line")}) as low from lines),
 h as (select b.doc_id, b.line_no, arg_min(status, seq) as status from b join d using (doc_id) where low <> '' and (contains(low, claim) or contains(claim, low)
  or (len(numbers) > 0 and len(list_filter(numbers, lambda x: not contains(low, x))) = 0 and len(list_filter(words, lambda x: contains(low, x))) >= least(3, len(words)))) group by 1, 2),
 j as (select doc_id as text_id, string_agg(coalesce('[SOURCE-CHECK QUARANTINED: ' || h.status || ' final-output claim removed; see Source Support Caveats]', line), chr(10) order by line_no) as text, count(h.status) as quarantined from b left join h using (doc_id, line_no) group by 1)
 select doc_id as text_id, coalesce(j.text, '') as text, coalesce(quarantined, 0) as quarantined from documents left join j on text_id = doc_id""")  # fmt: skip
def quarantine_lines(spark, sf_dir):
    """Documents as drafts; two claims each at most, one cut from the text in capitals, one its last line with a quarter added."""
    docs, words = table(spark, sf_dir, "documents"), lambda *w: F.array(*map(F.lit, w))
    at = lambda a, n: F.get(a, (c("doc_id") % n).cast("int"))
    one = docs.select(c("doc_id").alias("text_id"), F.lit(0).alias("seq"), F.translate(F.substring("text", 21, 60), _SMALL, _LARGE).alias("claim"), at(words("unsupported", "supported", "overstated", "needs_source", "unsupported"), 5).alias("status"), at(words("high", "low", "medium"), 3).alias("severity"))
    two = docs.where("doc_id % 7 = 0").select(c("doc_id").alias("text_id"), F.lit(1).alias("seq"), F.concat(F.element_at(F.split("text", "\n"), -1), F.lit(" in Q3")).alias("claim"), F.lit("needs_source").alias("status"), F.lit("critical").alias("severity"))
    return D.without_risky_lines(docs.select(c("doc_id").alias("text_id"), "text"), one.unionByName(two))


@query("target_docs", """with i as (select c_custkey as item_id, c_custkey % 5 as board_id, case c_custkey % 4 when 0 then [] when 1 then [upper(substr(n_name, 2, 4))] when 2 then [n_name || '.docx', ''] else ['no such file'] end as requested, case when c_custkey % 3 = 0 then [lower(n_name)] else [] end as parents from customer join nation on c_nationkey = n_nationkey),
 d as (select n_regionkey as board_id, n_name as name, n_nationkey as place from nation),
 h as (select item_id, name, place from i join d using (board_id) where (len(requested) = 0 and len(parents) = 0) or len(list_filter(requested, lambda r: r <> '' and (contains(lower(name), lower(r)) or contains(lower(r), lower(name))))) > 0 or list_contains(parents, lower(name)))
 select item_id, name, place from (select *, row_number() over (partition by item_id order by place, name) as rn from h) where rn <= 3""")  # fmt: skip
def target_docs(spark, sf_dir):
    """Customers as gaps, nations as the documents of a region's board."""
    k, none = c("c_custkey"), F.array().cast("array<string>")
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey"))
    requested = F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(F.upper(F.substring("n_name", 2, 4)))).when(k % 4 == 2, F.array(F.concat("n_name", F.lit(".docx")), F.lit(""))).otherwise(F.array(F.lit("no such file")))
    items = both.select(k.alias("item_id"), (k % 5).alias("board_id"), requested.alias("requested"), F.when(k % 3 == 0, F.array(F.lower("n_name"))).otherwise(none).alias("parents"))
    docs = table(spark, sf_dir, "nation").select(c("n_regionkey").alias("board_id"), c("n_name").alias("name"), c("n_nationkey").alias("place"))
    return D.target_documents(items, docs)


@query("artifact_texts", "select l.doc_id % 10 as board_id, l.doc_id || '.txt' as file, coalesce(d.text, '') as text, d.doc_id is not null as exists from labels l left join (select * from documents where doc_id % 3 <> 0) d using (doc_id)")
def artifact_texts(spark, sf_dir):
    """Labelled documents are due; every third of them wasn't written."""
    named = lambda df: df.withColumns({"board_id": c("doc_id") % 10, "file": F.concat(c("doc_id").cast("string"), F.lit(".txt"))})
    return D.due_texts(named(table(spark, sf_dir, "labels")), named(table(spark, sf_dir, "documents").where("doc_id % 3 <> 0")))
