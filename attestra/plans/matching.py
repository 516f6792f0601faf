"""Queries of the matching operators and of the joins between claims, targets and sources."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import upper_each
from ..operators import matching as M
from .registry import query
from .views import ORDER_TEXT, order_text, table

_CLAIMS = """claims as (select item_id as claim_id, text as content, text as evidence from benchmark
 union all select 1000000 + item_id, text, '' from benchmark where item_id % 5 = 0 union all select 2000000 + item_id, text || ' 77', text from benchmark where item_id % 3 = 0)"""


def _claims(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    own = b.select(F.col("item_id").alias("claim_id"), F.col("text").alias("content"), F.col("text").alias("evidence"))
    empty = b.where("item_id % 5 = 0").select((F.col("item_id") + 1_000_000).alias("claim_id"), F.col("text").alias("content"), F.lit("").alias("evidence"))
    digits = b.where("item_id % 3 = 0").select((F.col("item_id") + 2_000_000).alias("claim_id"), F.concat("text", F.lit(" 77")).alias("content"), F.col("text").alias("evidence"))
    return own.unionByName(empty).unionByName(digits)


@query("claim_admission", f"""with {_CLAIMS}, hit as (select claim_id, doc_id, strpos(text, trim(evidence)) - 1 as start_char, row_number() over (partition by claim_id order by doc_id) as n from claims, documents where evidence <> '' and contains(text, trim(evidence))),
 j as (select c.claim_id, case when evidence = '' then 'empty_evidence' when h.doc_id is null then 'unsupported_quote' when content <> evidence then 'unsupported_digits' else 'admitted' end as reason, h.doc_id, h.start_char, h.start_char + length(trim(evidence)) as end_char from claims c left join hit h on c.claim_id = h.claim_id and h.n = 1)
 select claim_id, reason, doc_id as text_id, start_char, end_char from j""")
def claim_admission(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    out = M.admission(_claims(spark, sf_dir), docs)
    return out.select("claim_id", "reason", "text_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


@query("admission_summary", f"""with {_CLAIMS}, hit as (select distinct claim_id from claims, documents where evidence <> '' and contains(text, trim(evidence)))
 select case when evidence = '' then 'empty_evidence' when h.claim_id is null then 'unsupported_quote' when content <> evidence then 'unsupported_digits' else 'admitted' end as reason, count(*) as claims from claims c left join hit h using (claim_id) group by 1""")
def admission_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return M.admission(_claims(spark, sf_dir), docs).groupBy("reason").agg(F.count(F.lit(1)).alias("claims"))


@query("quote_find", """with q as (select item_id as quote_id, case item_id % 3 when 0 then text when 1 then upper(text) else regexp_replace(text, ' ', '  ', 'g') end as quote from benchmark),
 n as (select *, trim(regexp_replace(quote, '\\s+', ' ', 'g')) as cq from q), d as (select doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as ct from documents)
 select quote_id, doc_id as text_id, case when contains(text, quote) then 1 when contains(ct, cq) then 2 else 3 end as tier from n, d where contains(text, quote) or contains(ct, cq) or contains(lower(ct), lower(cq))""")
def quote_find(spark, sf_dir):
    k = F.col("item_id") % 3
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.when(k == 0, F.col("text")).when(k == 1, upper_each(F.col("text"))).otherwise(F.regexp_replace("text", " ", "  ")).alias("quote"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return M.locate_quotes(quotes, docs).select("quote_id", "text_id", "tier")


@query("evidence_windows", """with h as (select doc_id, strpos(d.text, b.text) - 1 as a, strpos(d.text, b.text) - 1 + length(b.text) as b, length(d.text) as size from documents d, benchmark b where contains(d.text, b.text)),
 w as (select doc_id, greatest(a - 200, 0) as a, least(b + 200, size) as b from h), f as (select *, max(b) over (partition by doc_id order by a, b rows between unbounded preceding and 1 preceding) as far from w),
 i as (select *, sum(case when far is null or a > far then 1 else 0 end) over (partition by doc_id order by a, b rows unbounded preceding) as island from f)
 select doc_id as text_id, min(a) as start_char, max(b) as end_char from i group by doc_id, island""")
def evidence_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    spans = M.locate_quotes(quotes, docs).where("tier = 1").join(docs.select("text_id", F.length("text").alias("size")), "text_id")
    out = M.merged_windows(spans, 200)
    return out.select("text_id", F.col("start_char").cast("long").alias("start_char"), F.col("end_char").cast("long").alias("end_char"))


@query("bind_edges", "select o_orderkey, count(distinct l_partkey) as claims, case when count(l_orderkey) > 0 then 'evidenced' else 'discovered' end as status from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey")
def bind_edges(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    out = orders.join(edges, orders.o_orderkey == edges.l_orderkey, "left")
    return out.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("claims"), F.when(F.col("n").isNotNull(), "evidenced").otherwise("discovered").alias("status"))


@query("unbound", "select o_orderkey, o_orderpriority from orders where o_orderkey not in (select l_orderkey from lineitem)")
def unbound(spark, sf_dir):
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(items, orders.o_orderkey == items.l_orderkey, "left_anti").select("o_orderkey", "o_orderpriority")


@query("fk_check", """select 'document without label' as message, doc_id as id from documents where doc_id not in (select doc_id from labels)
 union all select 'order without line', o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)
 union all select 'line without part', l_partkey from lineitem where l_partkey not in (select p_partkey from part)
 union all select 'line without supplier', l_suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier)
 union all select 'order without customer', o_custkey from orders where o_custkey not in (select c_custkey from customer)""")
def fk_check(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    checks = [("document without label", "documents", "doc_id", "labels", "doc_id"), ("order without line", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("line without part", "lineitem", "l_partkey", "part", "p_partkey"), ("line without supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("order without customer", "orders", "o_custkey", "customer", "c_custkey")]
    parts = [t(a).select(F.col(x).alias("id")).join(t(b).select(F.col(y).alias("id")), "id", "left_anti").select(F.lit(said).alias("message"), "id") for said, a, x, b, y in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("alias_resolve", """with n as (select distinct p_name as name from part), m as (select p_partkey as mention_id, case p_partkey % 3 when 0 then upper(p_name) when 1 then replace(p_name, ' ', '_') || '.pdf' else p_name || '?' end as mention, p_name from part)
 select mention_id, case when mention_id % 3 = 2 then null else p_name end as name_id from m""")
def alias_resolve(spark, sf_dir):
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    part = table(spark, sf_dir, "part")
    mentions = part.select(F.col("p_partkey").alias("mention_id"), F.when(k == 0, F.upper(name)).when(k == 1, F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit(".pdf"))).otherwise(F.concat(name, F.lit("?"))).alias("mention"))
    # initials are left out here: two-word names share them
    m = mentions.select("mention_id", F.explode(F.slice(M.aliases(F.col("mention")), 1, 3)).alias("alias")).where("length(alias) > 2")
    names = part.select(name.alias("name_id")).distinct().select("name_id", F.lower("name_id").alias("low"))
    n = names.select("name_id", F.explode(F.array_distinct(F.array(F.col("low"), F.regexp_replace("low", " ", "")))).alias("alias"))
    hit = m.join(n, "alias").groupBy("mention_id").agg(F.min("name_id").alias("name_id"))
    return mentions.select("mention_id").join(hit, "mention_id", "left")


@query("must_include", f"""with {ORDER_TEXT}, i as (select o_orderkey, text, '$' || cast(cast(floor(o_totalprice) as bigint) + case when o_orderkey % 7 = 0 then 1 else 0 end as varchar) as want from order_text join orders using (o_orderkey))
 select o_custkey, count(*) as items, count(*) filter (contains(text, want || ' ')) as verified from i join orders using (o_orderkey) group by o_custkey""")
def must_include(spark, sf_dir):
    from ..functions import scalars as S

    orders = table(spark, sf_dir, "orders")
    wanted = orders.select("o_orderkey", (F.floor("o_totalprice") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("want"))
    values = order_text(orders).select("o_orderkey", "o_custkey", F.filter(S.checkable_values(F.col("text")), lambda v: v["type"] == "dollar")["canonical"].alias("found"))
    out = values.join(wanted, "o_orderkey")
    return out.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.array_contains("found", F.col("want"))).alias("verified"))


@query("run_compare", """with s as (select d.source, d.doc_id % 2 as run, count(*) as n, count(*) filter (quality = 1) as passed from documents d join labels using (doc_id) group by 1, 2),
 a as (select * from s where run = 0), b as (select * from s where run = 1)
 select coalesce(a.source, b.source) as source, a.passed * 100 // a.n as base_pct, b.passed * 100 // b.n as new_pct, case when a.source is null or b.source is null then 'missing' when b.passed * 100 // b.n - a.passed * 100 // a.n > 2 then 'improved' when b.passed * 100 // b.n - a.passed * 100 // a.n < -2 then 'regressed' else 'same' end as verdict from a full join b on a.source = b.source""")
def run_compare(spark, sf_dir):
    scored = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    by = scored.groupBy("source", (F.col("doc_id") % 2).alias("run")).agg(F.expr("count_if(quality = 1) * 100 div count(1)").alias("pct"))
    a, b = by.where("run = 0").select("source", F.col("pct").alias("base_pct")), by.where("run = 1").select("source", F.col("pct").alias("new_pct"))
    delta = F.col("new_pct") - F.col("base_pct")
    verdict = F.when(delta.isNull(), "missing").when(delta > 2, "improved").when(delta < -2, "regressed").otherwise("same")
    return a.join(b, "source", "full_outer").select("source", "base_pct", "new_pct", verdict.alias("verdict"))


@query("contradiction_pairs", """with l as (select d.source, d.doc_id, toxic, lag(d.doc_id) over (partition by d.source order by d.doc_id) as before from documents d join labels using (doc_id))
 select source, least(doc_id, before) as a, greatest(doc_id, before) as b from l where toxic = 1 and before is not null""")
def contradiction_pairs(spark, sf_dir):
    labelled = table(spark, sf_dir, "documents").select("source", "doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    pairs = labelled.withColumn("before", before).where("toxic = 1 and before is not null")
    return pairs.select("source", F.least("doc_id", "before").alias("a"), F.greatest("doc_id", "before").alias("b"))


@query("read_overlap", """with s as (select doc_id, unnest(range(0, 5)) as k, length(text) as size from documents), c as (select doc_id, k, k * size // 5 as a, (k + 1) * size // 5 as b, size from s),
 r as (select doc_id, length(text) // 3 as f, length(text) // 3 + 400 as t from documents where doc_id % 3 <> 0)
 select c.doc_id, count(*) filter (r.doc_id is not null and a < t and b > f) as sections_read, case when count(*) filter (r.doc_id is not null and a < t and b > f) = 0 then 'unread' when count(*) filter (r.doc_id is not null and a < t and b > f) = 5 then 'fully_read' else 'partially_read' end as status from c left join r using (doc_id) group by c.doc_id""")
def read_overlap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("size"))
    sections = docs.select("doc_id", "size", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("doc_id", F.expr("k * size div 5").alias("start_char"), F.expr("(k + 1) * size div 5").alias("end_char"), "k")
    ranges = docs.where("doc_id % 3 <> 0").select("doc_id", F.expr("size div 3").alias("from_char"), F.expr("size div 3 + 400").alias("to_char"))
    hits = sections.join(ranges, "doc_id", "left").withColumn("hit", F.coalesce((F.col("start_char") < F.col("to_char")) & (F.col("end_char") > F.col("from_char")), F.lit(False)))
    n = F.count_if("hit")
    return hits.groupBy("doc_id").agg(n.alias("sections_read"), F.when(n == 0, "unread").when(n == 5, "fully_read").otherwise("partially_read").alias("status"))


@query("task_resolve", "select s_suppkey, n_name, r_name, case when r_name = 'ASIA' then null else coalesce(r_name, 'default') end as scorer from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def task_resolve(spark, sf_dir):
    s, n, r = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = s.join(n, s.s_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return out.select("s_suppkey", "n_name", "r_name", F.when(F.col("r_name") == "ASIA", None).otherwise(F.coalesce("r_name", F.lit("default"))).alias("scorer"))


@query("cost_by_model", "select coalesce(p_brand, 'default') as model, count(*) as calls, cast(sum(cast(l_quantity as bigint)) as bigint) as tokens, cast(sum(cast(l_quantity as bigint) * coalesce(p_size, 10)) as bigint) as cost from lineitem left join part on l_partkey = p_partkey group by 1")
def cost_by_model(spark, sf_dir):
    items, prices = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    used = items.select("l_partkey", F.col("l_quantity").cast("long").alias("q")).join(prices, items.l_partkey == prices.p_partkey, "left")
    return used.groupBy(F.coalesce("p_brand", F.lit("default")).alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.sum("q").alias("tokens"), F.sum(F.col("q") * F.coalesce("p_size", F.lit(10))).alias("cost"))


@query("text_search", "select doc_id, len(string_split(lower(text), 'licensed')) - 1 as hits, substr(text, greatest(strpos(lower(text), 'licensed') - 20, 1), 60) as context from documents where contains(lower(text), 'licensed')")
def text_search(spark, sf_dir):
    low = F.lower("text")
    found = table(spark, sf_dir, "documents").where(F.contains(low, F.lit("licensed")))
    return found.select("doc_id", (F.size(F.split(low, "licensed")) - 1).cast("long").alias("hits"), F.substring("text", F.greatest(F.instr(low, F.lit("licensed")) - 20, F.lit(1)), F.lit(60)).alias("context"))


@query("survival_final", """with l as (select l_orderkey, count(*) as n, count(*) filter (l_linestatus = 'F') as f from lineitem group by 1)
 select o_orderpriority, case when l.n is null then 'not_extracted' when l.f = 0 then 'not_bound' when o_orderstatus = 'P' then 'not_in_output' else 'survived' end as stage, count(*) as n from orders left join l on o_orderkey = l_orderkey group by 1, 2""")
def survival_final(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    orders = table(spark, sf_dir, "orders")
    stage = F.when(F.col("n").isNull(), "not_extracted").when(F.col("f") == 0, "not_bound").when(F.col("o_orderstatus") == "P", "not_in_output").otherwise("survived")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").groupBy("o_orderpriority", stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("lexical_topk", r"""with b as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) as term from benchmark), d as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) as term from documents),
 s as (select item_id, doc_id, count(*) as hits from b join d using (term) group by 1, 2), r as (select *, row_number() over (partition by item_id order by hits desc, doc_id) as rank from s) select item_id, doc_id, hits, rank from r where rank <= 25""")
def lexical_topk(spark, sf_dir):
    terms = lambda df, k: df.select(k, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0))).alias("term"))
    hits = terms(table(spark, sf_dir, "benchmark"), "item_id").join(terms(table(spark, sf_dir, "documents"), "doc_id"), "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("hits"), "doc_id"))
    return hits.withColumn("rank", rank.cast("long")).where("rank <= 25")


_TOKENS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')), lambda t: length(t) >= 3 or regexp_matches(t, '[0-9]'))"


@query("evidence_support")
def evidence_support(spark, sf_dir):
    """All items against all documents; the pairs that may support."""
    return M.supporting(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("evidence_tiers")
def evidence_tiers(spark, sf_dir):
    """All passages against all documents; the claim says the passage's last five words. Tests compare with a plain table of common runs."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.substring_index("text", " ", -5).alias("content"))
    return M.evidence_tiers(items, table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("quote_fallback", "select doc_id, case when strpos(lower(text), 'licensed') > 0 then strpos(lower(text), 'licensed') - 1 else 0 end as start_char, least(length(text), case when strpos(lower(text), 'licensed') > 0 then strpos(lower(text), 'licensed') - 1 else 0 end + 3000) as end_char from documents")
def quote_fallback(spark, sf_dir):
    at = F.instr(F.lower("text"), F.lit("licensed")).cast("long")
    start = F.when(at > 0, at - 1).otherwise(F.lit(0).cast("long"))
    return table(spark, sf_dir, "documents").select("doc_id", start.alias("start_char"), F.least(F.length("text").cast("long"), start + 3000).alias("end_char"))


@query("obligation_match", "select o_custkey, count(distinct l_partkey) as shared, list_sort(list_distinct(list(l_suppkey)))[1:5] as files from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'A' group by 1")
def obligation_match(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'")  # noqa: E741
    return o.join(l, o.o_orderkey == l.l_orderkey).groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("shared"), F.slice(F.sort_array(F.collect_set("l_suppkey")), 1, 5).alias("files"))


@query("gate_eval", """with r as (select source, count(*) filter (quality = 1) * 100 // count(*) as base, count(*) filter (toxic = 0) * 100 // count(*) as new from documents join labels using (doc_id) group by 1), k as (select *, row_number() over (order by base, source) as low, row_number() over (order by base desc, source) as high from r)
 select source, base, new, case when low <= 5 then 'bottom' when high <= 5 then 'top' else 'middle' end as band, new >= base as ok from k""")
def gate_eval(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    r = d.groupBy("source").agg(F.expr("count_if(quality = 1) * 100 div count(1)").alias("base"), F.expr("count_if(toxic = 0) * 100 div count(1)").alias("new"))
    # the five rows at either end are found in parallel; nothing is ranked as a whole
    ends = [r.orderBy(order, "source").limit(5).select(F.col("source").alias(name)) for order, name in ((F.asc("base"), "low"), (F.desc("base"), "high"))]
    k = r.join(F.broadcast(ends[0]), F.col("source").eqNullSafe(F.col("low")), "left").join(F.broadcast(ends[1]), F.col("source").eqNullSafe(F.col("high")), "left")
    return k.select("source", "base", "new", F.when(F.col("low").isNotNull(), "bottom").when(F.col("high").isNotNull(), "top").otherwise("middle").alias("band"), (F.col("new") >= F.col("base")).alias("ok"))


@query("assigned_signals", "select o_custkey, min(o_orderkey) filter (o_orderpriority < '3') as first_signal, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as carrier from orders where o_orderstatus = 'O' group by 1")
def assigned_signals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.groupBy("o_custkey").agg(F.min(F.when(F.col("o_orderpriority") < "3", F.col("o_orderkey"))).alias("first_signal"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("carrier"))


@query("packet_build", "select o_orderkey, count(l_orderkey) as refs, count(l_orderkey) = 0 or bool_and(l_returnflag = 'R') as open_issue, list_sort(list_distinct(list(l_suppkey) filter (l_suppkey is not null))) as sources from orders left join lineitem on o_orderkey = l_orderkey group by 1".replace("list_sort(list_distinct(list(l_suppkey) filter (l_suppkey is not null)))", "coalesce(list_sort(list_distinct(list(l_suppkey) filter (l_suppkey is not null))), [])"))
def packet_build(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    by = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"), F.bool_and(F.col("l_returnflag") == "R").alias("r"), F.sort_array(F.collect_set("l_suppkey")).alias("s"))
    none = F.array().cast("array<bigint>")
    return o.join(by, o.o_orderkey == by.l_orderkey, "left").select("o_orderkey", F.coalesce("k", F.lit(0)).alias("refs"), F.coalesce("r", F.lit(True)).alias("open_issue"), F.coalesce("s", none).alias("sources"))


@query("file_pins", "select p_partkey, case when p_size % 10 = 0 then 'pinned_' || p_brand else 'file_' || (p_partkey % 7) end as file from part")
def file_pins(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pins = part.where("p_size % 10 = 0").select("p_partkey", F.concat(F.lit("pinned_"), "p_brand").alias("file"))
    rest = part.join(pins, "p_partkey", "left_anti").select("p_partkey", F.concat(F.lit("file_"), (F.col("p_partkey") % 7).cast("string")).alias("file"))
    return pins.unionByName(rest)


@query("assign_revise", "select l_partkey, l_suppkey from (select distinct l_partkey, l_suppkey from lineitem) where l_partkey not in (select p_partkey from part where p_size = 3) union all select p_partkey, p_partkey % 10 from part where p_size = 3")
def assign_revise(spark, sf_dir):
    revised = table(spark, sf_dir, "part").where("p_size = 3")
    old = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct().join(revised.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")
    return old.unionByName(revised.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 10).alias("l_suppkey")))


@query("folder_match", "select doc_id, lang || '/' || source as folder, case when contains('review english sources src1 and src12', source) then 'must_load' when lang = 'de' then 'should_load' else 'skip' end as rule from documents")
def folder_match(spark, sf_dir):
    rule = F.when(F.contains(F.lit("review english sources src1 and src12"), F.col("source")), "must_load").when(F.col("lang") == "de", "should_load").otherwise("skip")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("folder"), rule.alias("rule"))
