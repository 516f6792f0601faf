"""How the test tables stand in for boards: one place for each rule, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of documents, numbered from 0.
LINES = "lines as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from documents)"


def lines(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select("doc_id", *keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


#: Documents whose every fifth line is a heading.
HEADED = f"{LINES}, headed as (select doc_id, source, string_agg(case when line_no % 5 = 4 then '## ' || line else line end, chr(10) order by line_no) as text from lines group by doc_id, source)"


def headed(docs: DataFrame) -> DataFrame:
    marked = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("## "), x)).otherwise(x))
    return docs.select("doc_id", "source", F.array_join(marked, "\n").alias("text"))


#: Text with checkable values, composed from orders.
ORDER_TEXT = "order_text as (select o_orderkey, o_custkey, 'Order ' || o_orderkey || ' total $' || cast(cast(floor(o_totalprice) as bigint) as varchar) || ' due ' || strftime(o_orderdate, '%Y-%m-%d') || ', margin ' || (o_orderkey % 40) || '.5% within ' || (o_orderkey % 90 + 1) || ' days under Section ' || (o_orderkey % 12 + 1) || '.2' as text from orders)"


def order_text(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("Order "), s(k), F.lit(" total $"), s(F.floor("o_totalprice")), F.lit(" due "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", margin "), s(k % 40), F.lit(".5% within "), s(k % 90 + 1), F.lit(" days under Section "), s(k % 12 + 1), F.lit(".2"))
    return orders.select("o_orderkey", "o_custkey", text.alias("text"))


#: Turns of conversations as entries of boards; a turn supports the one before.
ENTRIES = "entries as (select conv_id as board_id, turn as seq, case role when 'user' then 'observation' when 'assistant' then 'analysis' else 'strategy' end as type, text as content from conversations)"


def entries(conversations: DataFrame) -> DataFrame:
    kind = F.when(F.col("role") == "user", "observation").when(F.col("role") == "assistant", "analysis").otherwise("strategy")
    return conversations.select(F.col("conv_id").alias("board_id"), F.col("turn").alias("seq"), kind.alias("type"), F.col("text").alias("content"))


#: Events as entries of boards, 50 consecutive ones each: views ask (one kind of question is an artifact requirement), clicks and
#: purchases address what stands two and three events before, errors supersede the entry four before.
SIGNAL_ENTRIES = "signal_entries as (select cast(event_id // 50 as varchar) as board_id, cast(event_id as varchar) as entry_id, case event_type when 'click' then 'analysis' else 'observation' end as type, ts, event_id as seq, case when event_type in ('view', 'signup') then event_id % 7 else 0 end as asks, event_type, event_id from events)"


def signal_entries(events: DataFrame) -> DataFrame:
    e, t, s = F.col("event_id"), F.col("event_type"), lambda x: x.cast("string")
    ask = lambda k: F.struct(F.when(k % 3 == 2, "artifact_requirement").otherwise("question").alias("type"), F.when(k % 2 == 1, "high").otherwise("medium").alias("priority"), F.when(k == 3, " ").otherwise("what of it").alias("content"))
    opens = F.when(t.isin("view", "signup") & (e % 7 > 0), F.transform(F.sequence(F.lit(0).cast("long"), e % 7 - 1), ask))
    at = lambda back, k: F.concat(s(e - back), F.lit(f"/{k}"))
    addresses = F.when(t.isin("click", "purchase"), F.array(at(2, 0), at(2, 2), at(3, 0), at(3, 1), at(3, 2)))
    return events.select(
        s(F.floor(e / 50)).alias("board_id"), s(e).alias("entry_id"), F.when(t == "click", "analysis").otherwise("observation").alias("type"), F.col("ts").cast("timestamp").alias("ts"), e.alias("seq"),
        opens.alias("opens"), addresses.alias("addresses"), F.when(t == "error", F.array(s(e - 1), s(e - 2))).alias("supersedes"),
    )


#: Events as rounds of users: signups are bulk work, clicks and purchases are progress.
USER_ROUNDS = "user_rounds as (select cast(user_id as varchar) as board_id, ts, event_id as seq, cast(floor(value * 10) as bigint) as tokens, case when event_type = 'signup' then 5 * cast(floor(value * 10) as bigint) else 0 end as bulk_tokens, event_type in ('click', 'purchase') as progress, event_id % 5 as open_items, event_id % 3 = 0 as converge from events)"


def user_rounds(events: DataFrame) -> DataFrame:
    e, t, tokens = F.col("event_id"), F.col("event_type"), F.floor(F.col("value") * 10).cast("long")
    bulk = F.when(t == "signup", tokens * 5).otherwise(F.lit(0).cast("long"))
    return events.select(F.col("user_id").cast("string").alias("board_id"), F.col("ts").cast("timestamp").alias("ts"), e.alias("seq"), tokens.alias("tokens"), bulk.alias("bulk_tokens"), t.isin("click", "purchase").alias("progress"), (e % 5).alias("open_items"), (e % 3 == 0).alias("converge"))
