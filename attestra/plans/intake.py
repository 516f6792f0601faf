"""Queries of intake: replies as JSON, repaired or refused field by field."""

from pyspark.sql import functions as F

from .registry import query
from .views import table

c = F.col
REPLY = "claims array<struct<kind:string,content:string,evidence:string,confidence:string>>"


def _replies(spark, sf_dir):
    """One reply per turn: JSON text with a kind, a content and a confidence, some out of form."""
    conf = F.when(c("turn") % 4 == 3, "high").otherwise(F.concat((c("turn") % 4).cast("string"), F.lit(".25")))
    kind = F.when(c("turn") % 3 == 0, "observation").when(c("turn") % 3 == 1, "analysis").otherwise("musing")
    item = F.struct(kind.alias("kind"), F.substring("text", 1, 60).alias("content"), F.when(c("turn") % 2 == 0, F.substring("text", 1, 30)).alias("evidence"), conf.alias("confidence"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.array(item).alias("claims"))).alias("reply"))


_ITEMS = "items as (select conv_id, turn, case turn % 3 when 0 then 'observation' when 1 then 'analysis' else 'musing' end as kind, substr(text, 1, 60) as content, case when turn % 2 = 0 then substr(text, 1, 30) end as evidence, case when turn % 4 = 3 then null else (turn % 4) + 0.25 end as conf from conversations)"


def _items(spark, sf_dir):
    parsed = _replies(spark, sf_dir).select("conv_id", "turn", F.explode(F.from_json("reply", REPLY)["claims"]).alias("i"))
    return parsed.select("conv_id", "turn", "i.*").withColumn("conf", c("confidence").try_cast("double"))


@query("intake_findings", f"with {_ITEMS} select conv_id, turn, case when kind = 'musing' then 'observation' else kind end as kind, case when length(content) < 20 then 'too_short' when kind = 'observation' and evidence is null then 'refused' when evidence is null then 'gap' else 'kept' end as outcome from items")
def intake_findings(spark, sf_dir):
    kind = F.when(c("kind").isin("observation", "analysis"), c("kind")).otherwise("observation")
    outcome = F.when(F.length("content") < 20, "too_short").when((c("kind") == "observation") & c("evidence").isNull(), "refused").when(c("evidence").isNull(), "gap").otherwise("kept")
    return _items(spark, sf_dir).select("conv_id", "turn", kind.alias("kind"), outcome.alias("outcome"))


@query("intake_entries", f"with {_ITEMS} select conv_id, turn, cast(greatest(0, least(1, coalesce(conf, 0.6))) as double) as confidence from items")
def intake_entries(spark, sf_dir):
    return _items(spark, sf_dir).select("conv_id", "turn", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("conf", F.lit(0.6)))).alias("confidence"))


@query("quality_gate", f"with {_ITEMS} select conv_id, count(*) filter (length(content) >= 30 and (kind <> 'observation' or evidence is not null)) as kept, count(*) filter (not (length(content) >= 30 and (kind <> 'observation' or evidence is not null))) as refused from items group by 1")
def quality_gate(spark, sf_dir):
    ok = (F.length("content") >= 30) & ((c("kind") != "observation") | c("evidence").isNotNull())
    return _items(spark, sf_dir).groupBy("conv_id").agg(F.count_if(ok).alias("kept"), F.count_if(~ok).alias("refused"))


@query("bulk_valid", "select event_id, case event_id % 4 when 0 then 'ok' when 1 then 'ok' when 2 then 'failed' else 'failed' end as outcome from events")
def bulk_valid(spark, sf_dir):
    """A list of claims is valid, an empty one too; no list, or a list without a usable item, is a failure."""
    k = c("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit('{"claims": [{"content": "'), c("event_type"), F.lit('"}]}'))).when(k == 1, '{"claims": []}').when(k == 2, '{"claims": [{"content": ""}]}').otherwise('{"claims": null}')
    claims = F.from_json(reply, "claims array<struct<content:string>>")["claims"]
    usable = F.size(F.filter(claims, lambda x: F.length(F.trim(F.coalesce(x["content"], F.lit("")))) > 0))
    ok = claims.isNotNull() & ((F.size(claims) == 0) | (usable > 0))
    return table(spark, sf_dir, "events").select("event_id", F.when(ok, "ok").otherwise("failed").alias("outcome"))


@query("facet_filter", "select doc_id, source from documents join labels using (doc_id) where lang = 'en' and quality = 1 and n_chars between 200 and 4000 and contains(lower(text), 'thing')")
def facet_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang = 'en' and n_chars between 200 and 4000").where(F.contains(F.lower("text"), F.lit("thing")))
    return d.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "source")


@query("state_filter", "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('O', 'P') order by o_orderdate desc, o_orderkey desc limit 50")
def state_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(c("o_orderstatus").isin("O", "P")).orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_orderstatus")


@query("open_material", "select o_custkey, count(*) as open from orders where o_orderstatus = 'O' and o_orderpriority < '3' group by 1")
def open_material(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority < '3'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("open"))


@query("calc_items", """select o_orderkey, case when n is null then ['no parents'] when n < 2 then ['fewer than two inputs'] else [] end as errors, case when n >= 2 then 'executable' else 'diagnostic' end as status from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey""")
def calc_items(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders")
    errors = F.array_compact(F.array(F.when(c("n").isNull(), "no parents"), F.when(c("n") < 2, "fewer than two inputs")))
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select("o_orderkey", errors.alias("errors"), F.when(c("n") >= 2, "executable").otherwise("diagnostic").alias("status"))


@query("consolidations", "select distinct list_sort(list_distinct(list(l_partkey))) as parents from lineitem group by l_orderkey having count(distinct l_partkey) between 2 and 3")
def consolidations(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parents"))
    return sets.where(F.size("parents").between(2, 3)).select("parents").distinct()


@query("gap_executable", "select l_orderkey, count(distinct l_suppkey) >= 2 as relation, bool_or(l_discount > 0.05) as severity from lineitem group by 1")
def gap_executable(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.countDistinct("l_suppkey") >= 2).alias("relation"), F.bool_or(c("l_discount") > 0.05).alias("severity"))


@query("prompt_audit", "select conv_id, turn, sha256(text) as text_sha256, substr(text, 1, 500) as excerpt, contains(lower(text), 'thing') or contains(lower(text), 'tion') as flagged from conversations")
def prompt_audit(spark, sf_dir):
    marks = F.array(F.lit("thing"), F.lit("tion"))
    flagged = F.exists(marks, lambda m: F.contains(F.lower("text"), m))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("text_sha256"), F.substring("text", 1, 500).alias("excerpt"), flagged.alias("flagged"))


@query("forbidden_keys", "select event_id from events where cast(json_extract(props, '$.k') as bigint) is not null and event_type = 'error'")
def forbidden_keys(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").where(F.arrays_overlap(F.json_object_keys("props"), F.array(F.lit("k"), F.lit("secret")))).select("event_id")


@query("revision_ok", "select doc_id, length(substr(text, 1, 1500)) >= case when n_chars < 2000 then n_chars * 0.5 else greatest(1200, n_chars * 0.6) end as ok from documents")
def revision_ok(spark, sf_dir):
    least = F.when(c("n_chars") < 2000, c("n_chars") * 0.5).otherwise(F.greatest(F.lit(1200.0), c("n_chars") * 0.6))
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(F.substring("text", 1, 1500)) >= least).alias("ok"))


@query("coverage_reask", "select doc_id, l.doc_id is null as ask_again from documents d left join labels l using (doc_id) where d.lang <> 'fr'")
def coverage_reask(spark, sf_dir):
    asked = table(spark, sf_dir, "documents").where("lang <> 'fr'").select("doc_id")
    return asked.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", c("quality").isNull().alias("ask_again"))


@query("decisions_fill", "select o_orderkey, coalesce(k, 'deferred') as decision from orders left join (select l_orderkey, min(l_returnflag) as k from lineitem group by 1) on o_orderkey = l_orderkey where o_orderstatus = 'O'")
def decisions_fill(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("k"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return o.join(d, o.o_orderkey == d.l_orderkey, "left").select("o_orderkey", F.coalesce("k", F.lit("deferred")).alias("decision"))


@query("merged_source", "select l_orderkey, case when count(distinct l_suppkey) = 1 then cast(min(l_suppkey) as varchar) else 'multiple' end as section, array_to_string(list_sort(list_distinct(list(l_suppkey)))[1:6], ',') as sources from lineitem group by 1")
def merged_source(spark, sf_dir):
    s = F.sort_array(F.collect_set("l_suppkey"))
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(s.alias("s"))
    return by.select("l_orderkey", F.when(F.size("s") == 1, F.get("s", F.lit(0)).cast("string")).otherwise("multiple").alias("section"), F.array_join(F.slice("s", 1, 6).cast("array<string>"), ",").alias("sources"))


@query("work_results", "select o_orderkey, case when n is null then 'no_reply' when n >= 3 then 'computed' else 'partial' end as status, coalesce(n, 0) as replies from orders left join (select l_orderkey, count(*) as n from lineitem where l_returnflag <> 'R' group by 1) on o_orderkey = l_orderkey")
def work_results(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders")
    return o.join(n, o.o_orderkey == n.l_orderkey, "left").select("o_orderkey", F.when(c("n").isNull(), "no_reply").when(c("n") >= 3, "computed").otherwise("partial").alias("status"), F.coalesce("n", F.lit(0)).alias("replies"))


@query("plan_guard", "select coalesce(n_name, r_name) as file, n_name is not null as planned, r_name is not null as required from (select n_name, n_regionkey from nation where n_nationkey < 20) full join region on n_name = r_name")
def plan_guard(spark, sf_dir):
    plan, need = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(c("n_name").alias("file"), F.lit(True).alias("p")), table(spark, sf_dir, "region").select(c("r_name").alias("file"), F.lit(True).alias("r"))
    return plan.join(need, "file", "full_outer").select("file", c("p").isNotNull().alias("planned"), c("r").isNotNull().alias("required"))
