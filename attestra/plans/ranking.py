"""Queries of rankings, pages, budgets and packets."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ranking as K
from .registry import query
from .views import LINES, lines, table

c = F.col


@query("local_clusters", "with g as (select lang, source, doc_id, n_chars, row_number() over (partition by lang, source order by n_chars desc, doc_id) as k, count(*) over (partition by lang, source) as n from documents) select lang, source, doc_id, k, n from g where n >= 3 and k <= 6")
def local_clusters(spark, sf_dir):
    g = table(spark, sf_dir, "documents").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("lang", "source")))
    return K.top_per_group(g.where("n >= 3"), ["lang", "source"], [F.desc("n_chars"), c("doc_id")], 6, "k").select("lang", "source", "doc_id", "k", "n")


@query("safety_net", "with u as (select source, doc_id, n_chars from documents where doc_id not in (select doc_id from labels)), r as (select *, row_number() over (partition by source order by n_chars desc, doc_id) as rank from u) select source, doc_id, rank from r where rank <= 3")
def safety_net(spark, sf_dir):
    left = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return K.top_per_group(left, ["source"], [F.desc("n_chars"), c("doc_id")], 3).select("source", "doc_id", "rank")


@query("frontier", "with p as (select *, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 150 as batch from orders), d as (select *, row_number() over (partition by o_custkey, batch order by o_orderpriority, o_orderkey) as rank from p) select o_custkey, batch, rank, o_orderkey from d where rank <= 3")
def frontier(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    batched = table(spark, sf_dir, "orders").withColumn("batch", F.floor(place / 150))
    return K.top_per_group(batched, ["o_custkey", "batch"], [c("o_orderpriority"), c("o_orderkey")], 3).select("o_custkey", "batch", "rank", "o_orderkey")


@query("balanced_sample", "with r as (select source, doc_id, row_number() over (partition by source order by doc_id) as turn from documents) select source, doc_id, turn from r order by turn, source limit 50")
def balanced_sample(spark, sf_dir):
    return K.round_robin(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [c("doc_id")], 50)


@query("rotate_page", "with r as (select *, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as k, count(*) over (partition by s_nationkey) as n from supplier) select s_suppkey, s_nationkey from r where ((k - 7) % n + n) % n < 3")
def rotate_page(spark, sf_dir):
    return K.rotated(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), ["s_nationkey"], [c("s_suppkey")], F.lit(7), 3)


@query("catalog_order", "select doc_id, case when l.doc_id is null then 1 else 0 end as unread from documents d left join labels l using (doc_id) order by unread desc, n_chars desc, doc_id limit 60")
def catalog_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.withColumn("unread", F.when(c("quality").isNull(), 1).otherwise(0)).orderBy(F.desc("unread"), F.desc("n_chars"), "doc_id").limit(60).select("doc_id", "unread")


@query("stop_rules", """with d as (select user_id, cast(ts as date) as day, count(*) as n from events group by 1, 2), w as (select *, lag(n) over (partition by user_id order by day) as before, sum(n) over (partition by user_id order by day rows unbounded preceding) as spent from d),
 f as (select *, case when n <= 1 and before <= 1 then 'quiet' when spent >= 50 then 'budget' end as why from w) select user_id, cast(min(day) as varchar) as stop_day, arg_min(why, day) as why from f where why is not null group by 1""")
def stop_rules(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy("day")
    seen = days.withColumns({"before": F.lag("n").over(w), "spent": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    why = seen.withColumn("why", F.when((c("n") <= 1) & (c("before") <= 1), "quiet").when(c("spent") >= 50, "budget")).where("why is not null")
    return why.groupBy("user_id").agg(F.min("day").cast("string").alias("stop_day"), F.min_by("why", "day").alias("why"))


@query("trajectory", "with d as (select user_id, cast(ts as date) as day, count(*) filter (event_type = 'view') as a, count(*) filter (event_type = 'signup') as b, count(*) filter (event_type = 'error') as e from events group by 1, 2) select user_id, cast(day as varchar) as day, cast(2 * sum(a) over w as bigint) as built, cast(3 * sum(b) over w + 5 * sum(e) over w as bigint) as owed from d window w as (partition by user_id order by day rows unbounded preceding)")
def trajectory(spark, sf_dir):
    t = c("event_type")
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(t == "view").alias("a"), F.count_if(t == "signup").alias("b"), F.count_if(t == "error").alias("e"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("user_id", c("day").cast("string").alias("day"), (2 * F.sum("a").over(w)).alias("built"), (3 * F.sum("b").over(w) + 5 * F.sum("e").over(w)).alias("owed"))


@query("budget_wave", "with r as (select source, doc_id, sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as spent, row_number() over (partition by source order by doc_id) as k from documents) select source, count(*) filter (spent <= 40000 and k <= 30) as taken, count(*) filter (not (spent <= 40000 and k <= 30)) as skipped from r group by 1")
def budget_wave(spark, sf_dir):
    d = K.within_budget(table(spark, sf_dir, "documents"), ["source"], [c("doc_id")], c("n_chars"), F.lit(40_000))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    ok = c("fits") & (c("k") <= 30)
    return d.groupBy("source").agg(F.count_if(ok).alias("taken"), F.count_if(~ok).alias("skipped"))


@query("chunk_pack")
def chunk_pack(spark, sf_dir):
    """Lines of documents into chunks of at most 1,200 characters and 8 lines; tested by its invariants."""
    return K.packed(lines(table(spark, sf_dir, "documents")), "doc_id", "line_no", F.length("line") + 1, 1200, 8)


@query("unit_packets", "with l as (select l_orderkey, l_partkey, min(l_returnflag) as kind, max(l_quantity) as q from lineitem group by 1, 2), r as (select *, row_number() over (partition by l_orderkey order by kind, q desc, l_partkey) as rank, greatest(2, least(8, 12 // count(*) over (partition by l_orderkey))) as most from l) select l_orderkey, l_partkey, rank from r where rank <= most")
def unit_packets(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_returnflag").alias("kind"), F.max("l_quantity").alias("q"))
    w = Window.partitionBy("l_orderkey")
    most = F.greatest(F.lit(2), F.least(F.lit(8), F.floor(12 / F.count(F.lit(1)).over(w))))
    return claims.withColumns({"rank": F.row_number().over(w.orderBy("kind", F.desc("q"), "l_partkey")).cast("long"), "most": most}).where("rank <= most").select("l_orderkey", "l_partkey", "rank")


@query("target_packet", f"with {LINES}, f as (select doc_id, line, line_no, row_number() over (partition by doc_id, lower(substr(line, 1, 200)) order by line_no) as n from lines where length(line) > 20), r as (select *, row_number() over (partition by doc_id order by length(line) desc, line_no) as rank from f where n = 1) select doc_id, line_no, rank from r where rank <= 48")
def target_packet(spark, sf_dir):
    own = lines(table(spark, sf_dir, "documents")).where("length(line) > 20")
    firsts = K.top_per_group(own.withColumn("key", F.lower(F.substring("line", 1, 200))), ["doc_id", "key"], [c("line_no")], 1, "n")
    return K.top_per_group(firsts, ["doc_id"], [F.desc(F.length("line")), c("line_no")], 48).select("doc_id", c("line_no").cast("long").alias("line_no"), "rank")


@query("context_budget", "with r as (select source, doc_id, n_chars, coalesce(sum(n_chars) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from documents) select source, doc_id, cast(greatest(0, least(n_chars, 30000 - before)) as bigint) as given, before + n_chars > 30000 as truncated from r where before < 30000")
def context_budget(spark, sf_dir):
    before = F.coalesce(F.sum("n_chars").over(Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = table(spark, sf_dir, "documents").withColumn("before", before).where("before < 30000")
    return d.select("source", "doc_id", F.greatest(F.lit(0), F.least(c("n_chars"), 30_000 - c("before"))).alias("given"), (c("before") + c("n_chars") > 30_000).alias("truncated"))


@query("latest_snapshot", "select user_id, max(event_id) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by 1")
def latest_snapshot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def _top(name, score_sql, score, k):
    @query(name, f"select doc_id, {score_sql} as score from documents order by score desc, n_chars desc, doc_id limit {k}")
    def top(spark, sf_dir):
        return table(spark, sf_dir, "documents").withColumn("score", score()).orderBy(F.desc("score"), F.desc("n_chars"), "doc_id").limit(k).select("doc_id", "score")

    return top


top_calc = _top("top_calc", "case lang when 'en' then 3 when 'de' then 2 else 1 end + case when regexp_matches(text, '[0-9]') then 2 else 0 end", lambda: F.when(c("lang") == "en", 3).when(c("lang") == "de", 2).otherwise(1) + F.when(c("text").rlike("[0-9]"), 2).otherwise(0), 120)
top_gap = _top("top_gap", "case when contains(text, '|') then 2 else 0 end + case when n_chars > 2000 then 1 else 0 end", lambda: F.when(F.contains("text", F.lit("|")), 2).otherwise(0) + F.when(c("n_chars") > 2000, 1).otherwise(0), 140)
top_commit = _top("top_commit", "case when contains(text, 'Licensed') then 5 else 0 end + case when lang = 'fr' then 1 else 0 end", lambda: F.when(F.contains("text", F.lit("Licensed")), 5).otherwise(0) + F.when(c("lang") == "fr", 1).otherwise(0), 30)
top_maint = _top("top_maint", "case when n_chars > 1000 then 4 else 1 end - case when doc_id % 6 = 0 then 3 else 0 end", lambda: F.when(c("n_chars") > 1000, 4).otherwise(1) - F.when(c("doc_id") % 6 == 0, 3).otherwise(0), 180)


@query("open_ranked", "with r as (select *, row_number() over (partition by o_custkey order by o_orderpriority, o_orderkey) as rank from orders where o_orderstatus = 'O' and o_orderpriority < '3') select o_custkey, o_orderkey, rank from r where rank <= 15")
def open_ranked(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority < '3'")
    return K.top_per_group(open_, ["o_custkey"], [c("o_orderpriority"), c("o_orderkey")], 15).select("o_custkey", "o_orderkey", "rank")
