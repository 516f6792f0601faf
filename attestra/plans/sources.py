"""Queries of sources and sinks over the given tables."""

from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import urls as U
from .registry import query
from .views import table

c = F.col


@query("src_identity", "select doc_id, 'doc_' || substr(md5('doc_' || doc_id || '.txt'), 1, 8) as source_id from documents")
def src_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.source_id(F.concat(F.lit("doc_"), c("doc_id").cast("string"), F.lit(".txt"))).alias("source_id"))


@query("src_catalog", "select doc_id, lang || '/' || source || '/doc_' || doc_id || '.txt' as path, n_chars as size from documents")
def src_catalog(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), c("doc_id").cast("string"), F.lit(".txt")).alias("path"), c("n_chars").alias("size"))


@query("page_url_safe", r"""with h as (select page_id, case page_id % 5 when 0 then 'localhost' when 1 then '10.0.0.' || (page_id % 200) when 2 then '169.254.169.254' else regexp_extract(url, '^https?://([^/?#]+)', 1) end as host from pages)
 select page_id, not (host in ('localhost', '169.254.169.254') or host like '10.%' or host like '127.%' or host like '192.168.%' or regexp_matches(host, '^172\.(1[6-9]|2[0-9]|3[01])\.')) as safe from h""")
def page_url_safe(spark, sf_dir):
    k = c("page_id") % 5
    url = F.when(k == 0, "http://localhost/x").when(k == 1, F.concat(F.lit("http://10.0.0."), c("page_id") % 200, F.lit("/"))).when(k == 2, "http://169.254.169.254/meta").otherwise(c("url"))
    host = F.try_parse_url(url, F.lit("HOST"))
    private = host.isin("localhost", "metadata.google.internal") | host.rlike(r"^(10|127|0)\.|^192\.168\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.")
    return table(spark, sf_dir, "pages").select("page_id", (host.isNotNull() & ~private).alias("safe"))


@query("url_fetchable", """select page_id, case page_id % 16 when 0 then false when 1 then false when 2 then false when 3 then false when 4 then false when 5 then false when 6 then false when 7 then false when 8 then false when 9 then false when 10 then true when 11 then true when 12 then false when 13 then false else regexp_matches(url, '^https?://[a-z0-9-]+[.][a-z0-9.-]+') end as safe from pages""")
def url_fetchable(spark, sf_dir):
    """Page addresses, and inside ones in many writings: names, private and metadata IPs, whole numbers, octal and hexadecimal parts, IPv6."""
    forms = ["http://LocalHost:80/x", "http://10.1.2.3/", "http://169.254.169.254/latest", "http://2130706433/", "http://0177.0.0.1/", "http://0x7f.1/", "http://[::1]:8080/", "http://[fe80::1%25eth0]/", "https://[::ffff:192.168.0.1]/", "http://user:p@127.0.0.1:8000/", "https://8.8.8.8/dns", "https://[2606:4700:4700::1111]/", "ftp://example.com/", "http://box.internal./"]
    k = c("page_id") % 16
    url = F.coalesce(*[F.when(k == i, f) for i, f in enumerate(forms)], c("url"))
    return table(spark, sf_dir, "pages").select("page_id", U.is_safe(url).alias("safe"))


@query("jsonl_last_wins", "select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(value, (ts, event_id)) as value from events group by 1")
def jsonl_last_wins(spark, sf_dir):
    return S.last_wins(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("event_log", "select event_id, event_type as kind, user_id as board_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def event_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", c("event_type").alias("kind"), c("user_id").alias("board_id"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("score_scan", "select doc_id as task, quality + 1 - toxic as n_passed, 2 as n_criteria, quality = 1 and toxic = 0 as all_pass from labels")
def score_scan(spark, sf_dir):
    passed = c("quality") + 1 - c("toxic")
    return table(spark, sf_dir, "labels").select(c("doc_id").alias("task"), passed.alias("n_passed"), F.lit(2).alias("n_criteria"), (passed == 2).alias("all_pass"))


@query("sheet_rows", """with p as (select l_orderkey, 'Sheet: ' || l_returnflag as sheet, l_linenumber || ' | ' || l_partkey || '|' || l_suppkey as line, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey) as row_no from lineitem)
 select l_orderkey, substr(sheet, 8) as sheet, row_no, list_transform(string_split(line, '|'), lambda x: trim(x)) as cells from p""")
def sheet_rows(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    line = F.concat(c("l_linenumber").cast("string"), F.lit(" | "), c("l_partkey").cast("string"), F.lit("|"), c("l_suppkey").cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", c("l_returnflag").alias("sheet"), F.row_number().over(order).cast("long").alias("row_no"), F.transform(F.split(line, r"\|"), lambda x: F.trim(x)).alias("cells"))


@query("para_kinds", r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents), m as (select doc_id, line_no, case line_no % 5 when 0 then '# ' || line when 1 then '- ' || line when 2 then '1. ' || line when 3 then '' else line end as line from l)
 select doc_id, line_no, case when trim(line) = '' then 'blank' when regexp_matches(line, '^#{1,4}\s') then 'heading' when regexp_matches(line, '^[-*]\s') then 'bullet' when regexp_matches(line, '^[0-9]+\.\s') then 'numbered' else 'text' end as kind from m""")
def para_kinds(spark, sf_dir):
    from .views import lines

    k, line = c("line_no") % 5, c("line")
    marked = F.when(k == 0, F.concat(F.lit("# "), line)).when(k == 1, F.concat(F.lit("- "), line)).when(k == 2, F.concat(F.lit("1. "), line)).when(k == 3, "").otherwise(line)
    kind = F.when(F.trim("m") == "", "blank").when(c("m").rlike(r"^#{1,4}\s"), "heading").when(c("m").rlike(r"^[-*]\s"), "bullet").when(c("m").rlike(r"^[0-9]+\.\s"), "numbered").otherwise("text")
    return lines(table(spark, sf_dir, "documents")).withColumn("m", marked).select("doc_id", c("line_no").cast("long").alias("line_no"), kind.alias("kind"))


@query("packet_manifest", "select l_orderkey as file, l_returnflag as section, count(*) as items, count(distinct l_partkey) as claims from lineitem group by 1, 2")
def packet_manifest(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("file"), c("l_returnflag").alias("section")).agg(F.count(F.lit(1)).alias("items"), F.countDistinct("l_partkey").alias("claims"))


@query("snap_read", """select conv_id as board_id, turn as pos, 'c' || turn as id, case turn % 3 when 0 then 'observation' when 1 then 'analysis' else 'observation' end as kind, substr(text, 1, 40) as content,
 cast(case turn % 4 when 0 then 0.6 when 1 then 0.98 else 0.25 end as double) as confidence, case when turn % 2 = 0 then 3 end as start, case when turn % 2 = 0 then 9 end as "end" from conversations""")
def snap_read(spark, sf_dir):
    """A round trip: snapshots are written as JSON with fields out of form and read back repaired."""
    from ..sources import snapshots

    t = c("turn")
    claims = table(spark, sf_dir, "conversations").select(
        c("conv_id").alias("board_id"), t.alias("seq"), F.concat(F.lit("c"), t.cast("string")).alias("id"), F.when(t % 3 == 0, "observation").when(t % 3 == 1, "analysis").otherwise("musing").alias("kind"), F.substring("text", 1, 40).alias("content"),
        F.when(t % 4 == 0, "high").when(t % 4 == 1, "7.5").otherwise("0.25").alias("confidence"), F.lit("3").alias("start"), F.when(t % 2 == 0, "9").otherwise("x").alias("end"),
    )
    return snapshots.claims_of(snapshots.snapshots(claims)).drop("support_refs").withColumn("pos", c("pos").cast("long"))
