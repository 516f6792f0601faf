"""Queries of the roll-ups."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rollups as R
from ..operators import ranking as K
from .registry import query
from .views import ENTRIES, entries, table


def _n():
    return F.count(F.lit(1)).alias("n")


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


@query("board_summary", "select source, count(*) as n, count(*) filter (lang = 'en') as english, count(*) filter (n_chars < 200) as short, count(*) filter (l.doc_id is null) as unread, count(*) filter (toxic = 1) as disputed from documents left join labels l using (doc_id) group by source")
def board_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return R.counts_of(docs, ["source"], {"english": F.col("lang") == "en", "short": F.col("n_chars") < 200, "unread": F.col("toxic").isNull(), "disputed": F.col("toxic") == 1})


@query("convergence", """with b as (select o_custkey, count(*) filter (o_orderpriority like '1%' and o_orderstatus = 'O') as critical, count(*) filter (o_orderpriority like '2%' and o_orderstatus = 'O') as high, count(*) filter (o_orderstatus = 'P') as disputed from orders group by 1)
 select o_custkey, list_filter([case when critical > 0 then 'critical signals: ' || critical end, case when disputed > 0 then 'disputed entries: ' || disputed end], lambda x: x is not null) as blockers, greatest(0, least(100, 100 - 22 * critical - 9 * high - 7 * disputed)) as score from b""")
def convergence(spark, sf_dir):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    b = R.counts_of(table(spark, sf_dir, "orders"), ["o_custkey"], {"critical": p.startswith("1") & (s == "O"), "high": p.startswith("2") & (s == "O"), "disputed": s == "P"})
    said = lambda name, text: F.when(F.col(name) > 0, F.concat(F.lit(text), F.col(name).cast("string")))
    blockers = F.array_compact(F.array(said("critical", "critical signals: "), said("disputed", "disputed entries: ")))
    return b.select("o_custkey", blockers.alias("blockers"), R.convergence_score(F.col("critical"), F.col("high"), F.col("disputed"), F.lit(0)).alias("score"))


@query("target_blockers", """with l as (select l_orderkey, count(*) filter (l_returnflag = 'N') as raw, count(*) filter (l_returnflag = 'A') as derived, count(*) filter (l_returnflag = 'R') as against from lineitem group by 1)
 select o_orderkey, list_filter([case when coalesce(raw, 0) + coalesce(derived, 0) = 0 then 'needs_evidence' end, case when raw > 0 and derived = 0 then 'needs_analysis' end, case when against > 0 then 'has_contradiction' end, case when derived > 0 and o_orderstatus = 'P' then 'needs_verification' end], lambda x: x is not null) as blockers from orders left join l on o_orderkey = l_orderkey""")
def target_blockers(spark, sf_dir):
    f = F.col("l_returnflag")
    lines = R.counts_of(table(spark, sf_dir, "lineitem"), ["l_orderkey"], {"raw": f == "N", "derived": f == "A", "against": f == "R"}).drop("n")
    orders = table(spark, sf_dir, "orders")
    c = F.col
    blockers = F.array_compact(F.array(
        F.when(F.coalesce(c("raw"), F.lit(0)) + F.coalesce(c("derived"), F.lit(0)) == 0, "needs_evidence"), F.when((c("raw") > 0) & (c("derived") == 0), "needs_analysis"),
        F.when(c("against") > 0, "has_contradiction"), F.when((c("derived") > 0) & (c("o_orderstatus") == "P"), "needs_verification"),
    ))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", blockers.alias("blockers"))


@query("target_card", """with l as (select l_orderkey, l_partkey, min(l_returnflag) as kind, max(cast(l_quantity as integer)) as q from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_orderkey order by q desc, l_partkey) as k from l)
 select l_orderkey, count(*) as bound, count(*) filter (kind = 'N') as raw, list_sort(list_distinct(list(kind))) as kinds, list(l_partkey order by q desc, l_partkey) filter (k <= 8) as best from r group by 1""")
def target_card(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("kind"), F.max(F.col("l_quantity").cast("int")).alias("q"))
    # only the eight best of a target are gathered
    ranked = K.top_per_group(claims, ["l_orderkey"], [F.desc("q"), F.col("l_partkey")], 8)
    best = ranked.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("rank", "l_partkey")))["l_partkey"].alias("best"))
    return best.join(claims.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("bound"), F.count_if(F.col("kind") == "N").alias("raw"), F.sort_array(F.collect_set("kind")).alias("kinds")), "l_orderkey")


@query("obligation_card", "select o_custkey, count(*) as units, count(*) filter (o_orderstatus = 'F') as answered, count(*) filter (o_orderstatus = 'P') as partial, count(*) filter (o_orderstatus = 'O') as open from orders group by 1")
def obligation_card(spark, sf_dir):
    s = F.col("o_orderstatus")
    return R.counts_of(table(spark, sf_dir, "orders"), ["o_custkey"], {"answered": s == "F", "partial": s == "P", "open": s == "O"}).withColumnRenamed("n", "units")


@query("reopen", "select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey in (select l_orderkey from lineitem where l_shipdate >= timestamp '2000-01-01' or l_returnflag = 'R')")
def reopen(spark, sf_dir):
    disturbed = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp")) | (F.col("l_returnflag") == "R"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return orders.join(disturbed, orders.o_orderkey == disturbed.l_orderkey, "left_semi").select("o_orderkey")


@query("state_mix", "select user_id, count(*) as n, count(*) filter (event_type = 'view') as observation, count(*) filter (event_type = 'click') as reasoning, count(*) filter (event_type = 'purchase') as calculation, count(*) filter (event_type = 'error') as gap, (100 * count(*) filter (event_type in ('click', 'purchase'))) // count(*) as score from events group by 1")
def state_mix(spark, sf_dir):
    t = F.col("event_type")
    out = R.counts_of(table(spark, sf_dir, "events"), ["user_id"], {"observation": t == "view", "reasoning": t == "click", "calculation": t == "purchase", "gap": t == "error"})
    return out.withColumn("score", F.expr("(100 * (reasoning + calculation)) div n"))


@query("rollup_gaps", "select o_custkey, o_orderpriority, count(*) as items, count(*) filter (o_orderstatus = 'F') as survived, count(*) filter (o_orderstatus = 'P') as lost from orders group by grouping sets ((o_custkey), (o_orderpriority), ())")
def rollup_gaps(spark, sf_dir):
    s = F.col("o_orderstatus")
    return R.leveled(table(spark, sf_dir, "orders"), [["o_custkey"], ["o_orderpriority"], []], F.count(F.lit(1)).alias("items"), F.count_if(s == "F").alias("survived"), F.count_if(s == "P").alias("lost"))


@query("rollup_derived", "select l_suppkey, l_returnflag, count(*) as items, count(distinct l_orderkey) as targets from lineitem group by grouping sets ((l_suppkey, l_returnflag), (l_suppkey), ())")
def rollup_derived(spark, sf_dir):
    return R.leveled(table(spark, sf_dir, "lineitem"), [["l_suppkey", "l_returnflag"], ["l_suppkey"], []], F.count(F.lit(1)).alias("items"), F.countDistinct("l_orderkey").alias("targets"))


@query("rollup_placement", "select source, lang, count(*) as targeted, count(*) filter (contains(text, 'Licensed')) as found, count(*) filter (not contains(text, 'Licensed')) as lost from documents group by rollup (source, lang)")
def rollup_placement(spark, sf_dir):
    hit = F.contains("text", F.lit("Licensed"))
    return R.leveled(table(spark, sf_dir, "documents"), [["source", "lang"], ["source"], []], F.count(F.lit(1)).alias("targeted"), F.count_if(hit).alias("found"), F.count_if(~hit).alias("lost"))


@query("rollup_audit", "select role, turn, count(*) as prompts, count(*) filter (length(text) > 400) as hits from conversations group by grouping sets ((role, turn), (role), ())")
def rollup_audit(spark, sf_dir):
    return R.leveled(table(spark, sf_dir, "conversations"), [["role", "turn"], ["role"], []], F.count(F.lit(1)).alias("prompts"), F.count_if(F.length("text") > 400).alias("hits"))


@query("rollup_custody", "select c_mktsegment, n_name, count(*) as items, count(*) filter (c_acctbal < 0) as invalid from customer join nation on c_nationkey = n_nationkey group by cube (c_mktsegment, n_name)")
def rollup_custody(spark, sf_dir):
    c, m = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(m, c.c_nationkey == m.n_nationkey).cube("c_mktsegment", "n_name").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("c_acctbal") < 0).alias("invalid"))


@query("rollup_claims", "select source, quality, toxic, count(*) as checks from documents join labels using (doc_id) group by grouping sets ((source, quality), (toxic), ())")
def rollup_claims(spark, sf_dir):
    return R.leveled(_labelled(spark, sf_dir), [["source", "quality"], ["toxic"], []], F.count(F.lit(1)).alias("checks")).select("source", "quality", "toxic", "checks")


@query("rollup_maint", "select o_custkey % 50 as task, count(*) as n, cast(round(avg(cast(o_totalprice as decimal(18, 2))), 2) as decimal(18, 2))::double as mean_price, count(*) filter (o_totalprice > 200000) as positive from orders group by 1")
def rollup_maint(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("task")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(price), 2).cast("double").alias("mean_price"), F.count_if(F.col("o_totalprice") > 200000).alias("positive"))


@query("survival_totals", "select o_orderstatus as cause, count(*) as n, cast(sum(count(*)) over () as bigint) as total from orders group by 1")
def survival_totals(spark, sf_dir):
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("cause")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))


@query("map_merge", "select user_id, string_agg(event_type || '=' || c, ',' order by event_type || '=' || c) as counts, cast(sum(c) as bigint) as n from (select user_id, event_type, count(*) as c from events group by 1, 2) group by 1")
def map_merge(spark, sf_dir):
    return R.count_map(table(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("score_families", "select source, count(*) as tasks, count(*) filter (quality = 1 and toxic = 0) as all_pass, cast(sum(quality + 1 - toxic) as bigint) as passed, 2 * count(*) as criteria, list(doc_id order by quality + 1 - toxic, doc_id)[1:5] as worst from documents join labels using (doc_id) group by 1")
def score_families(spark, sf_dir):
    passed = F.col("quality") + 1 - F.col("toxic")
    d = _labelled(spark, sf_dir)
    low = K.top_per_group(d.select("source", passed.alias("p"), "doc_id"), ["source"], [F.asc("p"), F.asc("doc_id")], 5).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("p", "doc_id")))["doc_id"].alias("worst"))
    sums = d.groupBy("source").agg(F.count(F.lit(1)).alias("tasks"), F.count_if(passed == 2).alias("all_pass"), F.sum(passed).alias("passed"), (2 * F.count(F.lit(1))).alias("criteria"))
    return sums.join(low.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


@query("score_cube", "with u as (select source, 'quality' as kind, quality as ok from documents join labels using (doc_id) union all select source, 'toxic', 1 - toxic from documents join labels using (doc_id)) select source, kind, count(*) as n, cast(sum(ok) as bigint) as met, round(100 * sum(ok) / count(*), 1) as pct from u group by grouping sets ((source, kind), (source), (kind), ())")
def score_cube(spark, sf_dir):
    unpivoted = _labelled(spark, sf_dir).select("source", F.explode(F.array(F.struct(F.lit("quality").alias("kind"), F.col("quality").alias("ok")), F.struct(F.lit("toxic").alias("kind"), (1 - F.col("toxic")).alias("ok")))).alias("x")).select("source", "x.*")
    return R.leveled(unpivoted, [["source", "kind"], ["source"], ["kind"], []], F.count(F.lit(1)).alias("n"), F.sum("ok").alias("met"), F.round(100 * F.sum("ok") / F.count(F.lit(1)), 1).alias("pct"))


@query("file_check", "select o_orderstatus, count(*) as files, count(*) filter (n is null) as missing, count(*) filter (n >= 2) as filled from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey group by 1")
def file_check(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") >= 2).alias("filled"))


@query("usage_by_model", "select event_type as model, count(*) as calls, cast(sum(cast(value * 100 as bigint)) as bigint) as tokens, round(100.0 * sum(cast(value * 100 as bigint)) / 50000000, 1)::double as budget_pct from events group by 1")
def usage_by_model(spark, sf_dir):
    tokens = F.sum(F.round(F.col("value") * 100).cast("long"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("calls"), tokens.alias("tokens"), F.round(100.0 * tokens / 50_000_000, 1).alias("budget_pct"))


@query("loss_funnel", """with d as (select d.source, case when l.doc_id is null then 'not_extracted' when toxic = 1 then 'not_in_packet' when quality = 0 then 'not_in_output' when n_chars < 300 then 'quality' else 'passed' end as stage from documents d left join labels l using (doc_id))
 select source, stage, count(*) as n, cast(sum(count(*)) over (partition by source) as bigint) as total from d group by 1, 2""")
def loss_funnel(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    stage = F.when(F.col("quality").isNull(), "not_extracted").when(F.col("toxic") == 1, "not_in_packet").when(F.col("quality") == 0, "not_in_output").when(F.col("n_chars") < 300, "quality").otherwise("passed")
    by = d.groupBy("source", stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("total", F.sum("n").over(Window.partitionBy("source")))


@query("catalog", "select lang, source, count(*) as n, cast(sum(n_chars) as bigint) // 1024 as kb, list(doc_id order by doc_id)[1:3] as examples from documents group by 1, 2")
def catalog(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # a rank cuts each group in the map tasks already; only the three ids of a group are collected
    first = K.top_per_group(d.select("lang", "source", "doc_id"), ["lang", "source"], [F.asc("doc_id")], 3).groupBy("lang", "source").agg(F.sort_array(F.collect_list("doc_id")).alias("examples"))
    sums = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(n_chars) div 1024").alias("kb"))
    own = first.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "examples")
    return sums.join(own, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).select("lang", "source", "n", "kb", "examples")


@query("extract_depth", "select o_orderkey, o_orderkey % 8 + 1 as expected, coalesce(n, 0) as extracted, case when 2 * coalesce(n, 0) < o_orderkey % 8 + 1 then 'gap' when 10 * coalesce(n, 0) < 7 * (o_orderkey % 8 + 1) then 'warning' else 'ok' end as depth from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey")
def extract_depth(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders")
    e, x = F.col("o_orderkey") % 8 + 1, F.coalesce("n", F.lit(0))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", e.alias("expected"), x.alias("extracted"), F.when(2 * x < e, "gap").when(10 * x < 7 * e, "warning").otherwise("ok").alias("depth"))


@query("sparse_clusters", "select l_suppkey, count(*) as entries, count(distinct l_partkey) as items from lineitem group by 1 having count(*) >= 10 and 100 * count(distinct l_partkey) < 99 * count(*)")
def sparse_clusters(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("l_partkey").alias("items"))
    return by.where("entries >= 10 and 100 * items < 99 * entries")


@query("confidence_hist", "select cast(least(9, floor(value / 50)) as integer) as bin, count(*) as n from events group by 1")
def confidence_hist(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.least(F.lit(9), F.floor(F.col("value") / 50)).cast("int").alias("bin")).agg(_n())


@query("rounds", f"with {ENTRIES} select seq, count(*) filter (type = 'observation') as observation, count(*) filter (type = 'analysis') as analysis, count(*) filter (type = 'strategy') as strategy, min(board_id) as first_board from entries group by 1")
def rounds(spark, sf_dir):
    t = F.col("type")
    return entries(table(spark, sf_dir, "conversations")).groupBy("seq").agg(*[F.count_if(t == k).alias(k) for k in ("observation", "analysis", "strategy")], F.min("board_id").alias("first_board"))


@query("topics", "select lang, source, count(*) as n from documents group by 1, 2 order by n desc, lang, source limit 40")
def topics(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(_n()).orderBy(F.desc("n"), "lang", "source").limit(40)


@query("assign_balance", "with s as (select l_partkey, list_sort(list_distinct(list(l_suppkey))) as files from lineitem group by 1) select len(files) as n_files, count(*) as items, count(distinct files) as sets from s group by 1")
def assign_balance(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("files"))
    return sets.groupBy(F.size("files").cast("long").alias("n_files")).agg(F.count(F.lit(1)).alias("items"), F.countDistinct("files").alias("sets"))


@query("bulk_rates", "select user_id, round(count(*) filter (event_type <> 'error') / count(*), 4) as parsed, round(count(*) filter (event_type = 'purchase') / count(*), 4) as converted from events group by 1")
def bulk_rates(spark, sf_dir):
    t = F.col("event_type")
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 4)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(share(t != "error").alias("parsed"), share(t == "purchase").alias("converted"))


@query("resolution_status", "select l_orderkey, case when bool_or(l_returnflag = 'A') and not bool_or(l_returnflag = 'R') then 'resolved' when bool_or(l_returnflag in ('A', 'N')) then 'limited' else 'unsupported' end as status from lineitem group by 1")
def resolution_status(spark, sf_dir):
    has = lambda *k: F.bool_or(F.col("l_returnflag").isin(*k))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(has("A") & ~has("R"), "resolved").when(has("A", "N"), "limited").otherwise("unsupported").alias("status"))


@query("readiness", "with s as (select source, count(*) as n, count(l.doc_id) as sourced from documents left join labels l using (doc_id) group by 1) select source, n, sourced, case when 10 * sourced >= 5 * n then 'ready' when 10 * sourced >= 3 * n then 'partial' else 'sparse' end as grade from s")
def readiness(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").groupBy("source").agg(_n(), F.count("quality").alias("sourced"))
    return d.withColumn("grade", F.when(10 * F.col("sourced") >= 5 * F.col("n"), "ready").when(10 * F.col("sourced") >= 3 * F.col("n"), "partial").otherwise("sparse"))


@query("under_analysed", "select l_orderkey, count(*) filter (l_returnflag <> 'A') as raw, count(*) filter (l_returnflag = 'A') as derived from lineitem group by 1 having raw >= 3 and derived <= 1 order by raw desc, l_orderkey limit 15")
def under_analysed(spark, sf_dir):
    f = F.col("l_returnflag")
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(f != "A").alias("raw"), F.count_if(f == "A").alias("derived"))
    return by.where("raw >= 3 and derived <= 1").orderBy(F.desc("raw"), "l_orderkey").limit(15)


@query("final_state", "select o_custkey, count(distinct o_orderkey) as targets, count(l_orderkey) as claims, count(*) filter (l_returnflag = 'A') as derived, count(distinct o_orderkey) filter (l_orderkey is null) as unevidenced from orders left join lineitem on o_orderkey = l_orderkey group by 1")
def final_state(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    lines = l.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("l_returnflag") == "A").alias("a"))
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("targets"), F.coalesce(F.sum("k"), F.lit(0)).alias("claims"), F.coalesce(F.sum("a"), F.lit(0)).alias("derived"), F.count_if(F.col("k").isNull()).alias("unevidenced"))


@query("by_document_text", f"with {ENTRIES} select board_id, string_agg('[' || seq || '] (' || type || ') ' || substr(content, 1, 80), chr(10) order by seq) as text, count(*) as n from entries group by 1")
def by_document_text(spark, sf_dir):
    line = F.concat(F.lit("["), F.col("seq").cast("string"), F.lit("] ("), "type", F.lit(") "), F.substring("content", 1, 80))
    items = F.sort_array(F.collect_list(F.struct("seq", line.alias("line"))))
    return entries(table(spark, sf_dir, "conversations")).groupBy("board_id").agg(F.array_join(items["line"], "\n").alias("text"), _n())


@query("phase_flags", f"with {ENTRIES}, r as (select board_id, seq, count(*) as k from entries group by 1, 2) select board_id, seq, k, max(k) over (partition by board_id order by seq rows 1 preceding) <= 3 as quiet from r")
def phase_flags(spark, sf_dir):
    by = entries(table(spark, sf_dir, "conversations")).groupBy("board_id", "seq").agg(F.count(F.lit(1)).alias("k"))
    return by.withColumn("quiet", F.max("k").over(Window.partitionBy("board_id").orderBy("seq").rowsBetween(-1, 0)) <= 3)


@query("insights", "select l_returnflag, max_by(l_orderkey, (n, -l_orderkey)) as central, max(n) as n from (select l_returnflag, l_orderkey, count(*) as n from lineitem group by 1, 2) group by 1")
def insights(spark, sf_dir):
    by = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(_n())
    return by.groupBy("l_returnflag").agg(F.max_by("l_orderkey", F.struct("n", -F.col("l_orderkey"))).alias("central"), F.max("n").alias("n"))


@query("source_dependency", "select d.source, count(*) as findings, count(*) filter (toxic = 1) as disputed, count(*) filter (l.doc_id is null) as unsourced, round(100.0 * count(l.doc_id) / count(*), 1)::double as read_pct from documents d left join labels l using (doc_id) group by 1")
def source_dependency(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("findings"), F.count_if(F.col("toxic") == 1).alias("disputed"), F.count_if(F.col("quality").isNull()).alias("unsourced"), F.round(100.0 * F.count("quality") / F.count(F.lit(1)), 1).alias("read_pct"))


@query("custody_report", "select c_mktsegment as reason, count(*) as items, string_agg(distinct cast(c_nationkey as varchar), ',' order by cast(c_nationkey as varchar)) as documents from customer where c_acctbal < 0 group by 1")
def custody_report(spark, sf_dir):
    names = F.array_join(F.sort_array(F.collect_set(F.col("c_nationkey").cast("string"))), ",")
    return table(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy(F.col("c_mktsegment").alias("reason")).agg(F.count(F.lit(1)).alias("items"), names.alias("documents"))


@query("packet_report", "select l_returnflag as importance, l_linestatus as kind, count(*) as rows_, count(distinct l_orderkey) as targets from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def packet_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("importance"), F.col("l_linestatus").alias("kind"), "l_orderkey")
    return R.leveled(rows, [["importance"], ["kind"], []], F.count(F.lit(1)).alias("rows_"), F.countDistinct("l_orderkey").alias("targets"))


@query("gap_summary", "select o_orderpriority, case when o_orderkey % 4 = 0 then 'selected' else 'deferred_by_coordinator' end as status, count(*) as n from orders where o_orderstatus = 'O' group by 1, 2")
def gap_summary(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 4 == 0, "selected").otherwise("deferred_by_coordinator")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy("o_orderpriority", status.alias("status")).agg(_n())


@query("run_metrics", "select conv_id as run, count(*) as documents, cast(sum(length(text)) as bigint) as input_tokens, count(distinct role) as models, max(turn) as wall from conversations group by 1")
def run_metrics(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("run")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("input_tokens"), F.countDistinct("role").alias("models"), F.max("turn").alias("wall"))
