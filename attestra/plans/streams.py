"""Batch twins of the streaming operators; tests hold the streams against them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..streaming import events as E
from ..streaming import rounds as R
from ..streaming import signals as S
from .registry import query
from .views import SIGNAL_ENTRIES, USER_ROUNDS, signal_entries, table, user_rounds

c = F.col


@query("st_event_counts", "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type as kind, count(*) as n from events group by 1, 2")
def st_event_counts(spark, sf_dir):
    return E.window_counts(table(spark, sf_dir, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "n")


@query("st_claim_dedup", "select count(*) as n, user_id from (select distinct user_id, event_type, cast(ts as date) from events) group by user_id")
def st_claim_dedup(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return E.first_of_key(events, ["user_id", "event_type", "day"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("signal_lifecycle", "select user_id, count(*) filter (event_type = 'signup') as opened, count(*) filter (event_type = 'purchase') as addressed, case when arg_max(event_type, (ts, event_id)) filter (event_type in ('signup', 'purchase')) = 'purchase' then 'addressed' else 'open' end as status from events group by 1")
def signal_lifecycle(spark, sf_dir):
    t = c("event_type")
    mine = t.isin("signup", "purchase")
    last = F.max_by(F.when(mine, t), F.when(mine, F.struct("ts", "event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(t == "signup").alias("opened"), F.count_if(t == "purchase").alias("addressed"), F.when(last == "purchase", "addressed").otherwise("open").alias("status"))


@query("signal_expiry", "select event_id from events where event_type in ('view', 'click') and ts < timestamp '2024-01-31 00:00:00' - interval 3 day and value < 5")
def signal_expiry(spark, sf_dir):
    return table(spark, sf_dir, "events").where(c("event_type").isin("view", "click") & (c("ts") < F.lit("2024-01-28 00:00:00").cast("timestamp")) & (c("value") < 5)).select("event_id")


@query("budget_stop", "with r as (select user_id, event_id, ts, sum(cast(round(value * 100) as bigint)) over (partition by user_id order by ts, event_id rows unbounded preceding) as spent from events) select user_id, min(event_id) as stop_event from r where spent >= 85000 and spent - 0 > 0 group by 1")
def budget_stop(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    r = table(spark, sf_dir, "events").withColumn("spent", F.sum(F.round(c("value") * 100).cast("long")).over(w))
    return r.where("spent >= 85000").groupBy("user_id").agg(F.min("event_id").alias("stop_event"))


@query("bind_batches", "with r as (select user_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 60 as batch from events) select user_id, batch, count(*) as n from r group by 1, 2")
def bind_batches(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").withColumn("batch", F.floor(k / 60)).groupBy("user_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("st_quiet_rounds", "with d as (select user_id, cast(ts as date) as day, count(*) as n from events group by 1, 2), w as (select *, sum(case when n > 2 then 1 else 0 end) over (partition by user_id order by day rows unbounded preceding) as run from d) select user_id, max(k) as longest from (select user_id, run, count(*) filter (n <= 2) as k from w group by 1, 2) group by 1")
def st_quiet_rounds(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    runs = days.withColumn("run", F.sum(F.when(c("n") > 2, 1).otherwise(0)).over(w)).groupBy("user_id", "run").agg(F.count_if(c("n") <= 2).alias("k"))
    return runs.groupBy("user_id").agg(F.max("k").alias("longest"))


#: Open signals of medium priority expire after six hours in these queries.
HOURS6 = 21_600
#: A fold over each signal's rows in order: step 0 opens, 1 addresses, 2 reopens.
SIGNAL_SQL = f"""with {SIGNAL_ENTRIES},
opens as (select board_id, entry_id || '/' || k as signal_id, ts, seq, 0 as step, entry_id, false as may, case when k % 3 = 2 then 'artifact_requirement' else 'question' end as type, case when k % 2 = 1 then 'high' else 'medium' end as priority
          from (select *, unnest(range(least(asks, 5))) as k from signal_entries) where k <> 3),
marks as (select board_id, (event_id - t[1]) || '/' || t[2] as signal_id, ts, seq, 1 as step, entry_id, type = 'analysis' as may
          from (select *, unnest([[2, 0], [2, 2], [3, 0], [3, 1], [3, 2]]) as t from signal_entries where event_type in ('click', 'purchase'))),
over as (select board_id, cast(event_id - b as varchar) as entry_id, ts, seq from (select *, unnest([1, 2]) as b from signal_entries where event_type = 'error')),
backs as (select o.board_id, m.signal_id, o.ts, o.seq, 2 as step, o.entry_id, false as may from over o join marks m on o.board_id = m.board_id and o.entry_id = m.entry_id and (m.ts, m.seq) <= (o.ts, o.seq)),
every_row as (select board_id, signal_id, ts, seq, step, entry_id, may from opens union all select * from marks union all select * from backs),
born as (select board_id, signal_id, min((ts, seq, step)) as first, arg_min(type, (ts, seq)) as type, arg_min(priority, (ts, seq)) as priority from opens group by all),
steps as (select r.board_id, r.signal_id, list({{ts: r.ts, step: r.step, entry: r.entry_id, may: r.may, type: b.type, priority: b.priority, status: 'open', by_: cast(null as varchar), since: r.ts, n: 1}} order by r.ts, r.seq, r.step) as rows
          from every_row r join born b using (board_id, signal_id) where (r.ts, r.seq, r.step) >= b.first and (r.step <> 0 or (r.ts, r.seq, r.step) = b.first) group by all),
ends as (select board_id, signal_id, list_reduce(rows, lambda a, x: case
    when a.status = 'open' and a.priority = 'medium' and x.ts >= a.since + interval {HOURS6} second then {{ts: x.ts, step: x.step, entry: x.entry, may: x.may, type: a.type, priority: a.priority, status: 'expired', by_: cast(null as varchar), since: a.since, n: a.n + 1}}
    when x.step = 1 and a.status = 'open' and (a.type <> 'artifact_requirement' or x.may) then {{ts: x.ts, step: x.step, entry: x.entry, may: x.may, type: a.type, priority: a.priority, status: 'addressed', by_: x.entry, since: a.since, n: a.n + 1}}
    when x.step = 2 and a.status = 'addressed' and a.by_ = x.entry then {{ts: x.ts, step: x.step, entry: x.entry, may: x.may, type: a.type, priority: a.priority, status: 'open', by_: cast(null as varchar), since: x.ts, n: a.n + 1}}
    else a end) as s from steps),
told as (select *, s.status = 'open' and s.priority = 'medium' and (select max(ts) from signal_entries) >= s.since + interval {HOURS6} second as late from ends)
select board_id, signal_id, case when late then 'expired' else s.status end as status, s.by_ as addressed_by, s.n + cast(late as int) as changes from told"""


@query("signal_states", SIGNAL_SQL)
def signal_states(spark, sf_dir):
    return S.signal_states(S.signal_changes(signal_entries(table(spark, sf_dir, "events")), HOURS6))


@query("st_signal_states", SIGNAL_SQL)
def st_signal_states(spark, sf_dir):
    """The stream itself over all events; nothing comes late in a table that is read at once."""
    at = f"{sf_dir}/events.parquet"
    changes = S.signal_stream(signal_entries(E.opened(spark, at, spark.read.parquet(at).schema)), HOURS6, "0 seconds")
    return S.signal_states(E.poured(changes, shared_folder(spark, "signals"), S.CHANGES))


BUDGET = 20_000
ROUNDS_SQL = f"""with {USER_ROUNDS}, r as (select *, row_number() over w as round, cast(sum(tokens + bulk_tokens) over so_far as bigint) as used,
    cast({BUDGET} + sum(cast(floor(bulk_tokens * 100 / {R.STOP_PCT}) as bigint)) over so_far as bigint) as budget, max(case when progress then 1 end) over so_far as any_progress,
    lag(open_items) over w as before from user_rounds window w as (partition by board_id order by ts, seq), so_far as (partition by board_id order by ts, seq rows unbounded preceding)),
q as (select *, ((used * 2000 + budget) // (2 * budget)) / 10 as pct, round - coalesce(max(case when progress then round end) over (partition by board_id order by round rows unbounded preceding), 0) as quiet,
    coalesce(round >= {R.ROUNDS // 2} and round not in {R.REFRAMES} and round - 1 not in {R.REFRAMES} and open_items >= before and before > 0, false) as closeout from r),
s as (select *, case when converge and open_items = 0 then 'converged' when round >= {R.ROUNDS} then 'max_rounds' when pct >= {R.STOP_PCT} then 'budget' when quiet >= {R.QUIET} then 'diminishing_returns' end as stop from q),
t as (select *, min(case when stop is not null then round end) over (partition by board_id order by round rows unbounded preceding) as first_stop from s)
select board_id, seq, round, used, budget, pct, quiet, closeout, stop from t where first_stop is null or round <= first_stop"""


@query("round_report", ROUNDS_SQL)
def round_report(spark, sf_dir):
    return R.round_report(user_rounds(table(spark, sf_dir, "events")), R.RunState(BUDGET)).drop("at")


@query("st_round_report", ROUNDS_SQL)
def st_round_report(spark, sf_dir):
    at, state = f"{sf_dir}/events.parquet", R.RunState(BUDGET)
    report = R.round_stream(user_rounds(E.opened(spark, at, spark.read.parquet(at).schema)), state, late="0 seconds")
    return E.poured(report, shared_folder(spark, "rounds"), f"board_id string, {R.REPORT}").drop("at")


@query("bind_rounds", """with claims as (select event_id % 50 as board, event_id, value, event_id % 4 as batch_id from events),
unmatched as (select board, batch_id, count(*) as new, count(*) filter (cast(floor(value) as bigint) % 25 >= 20) as stays from claims group by 1, 2),
grid as (select b.board, r.batch_id from (select distinct board from claims) b, (select distinct batch_id from claims) r),
counts as (select g.board, g.batch_id, coalesce(new, 0) as new, cast(coalesce(sum(stays) over (partition by g.board order by g.batch_id), 0) as bigint) as unbound, cast(coalesce(sum(stays) over (partition by g.board order by g.batch_id rows between unbounded preceding and 1 preceding), 0) as bigint) as carried from grid g left join unmatched u on u.board = g.board and u.batch_id = g.batch_id),
firsts as (select board, cast(floor(value) as bigint) % 25 as target, min(batch_id) as since from claims where cast(floor(value) as bigint) % 25 < 20 group by 1, 2),
open_ as (select g.board, g.batch_id, 20 - count(f.target) as open from grid g left join firsts f on f.board = g.board and f.since <= g.batch_id group by 1, 2)
select cast(c.board as varchar) as board_id, cast(c.batch_id as int) as batch_id, new + carried as offered, new + carried - unbound as bound, unbound, (new + carried + 59) // 60 as calls, open, open = 0 and unbound = 0 as may_stop from counts c join open_ o on o.board = c.board and o.batch_id = c.batch_id where new + carried > 0""")
def bind_rounds(spark, sf_dir):
    """Four rounds of claims as micro-batches of one stream, each bound and judged before the next."""
    events, folder = table(spark, sf_dir, "events"), shared_folder(spark, "binding")
    s = lambda x: x.cast("string")
    target = s(F.floor("value") % 25)
    claims = events.select(s(c("event_id") % 50).alias("board_id"), s(c("event_id")).alias("claim_id"), c("event_id").alias("seq"), target.alias("content"), (c("event_id") % 4).alias("round"))
    boards = claims.select("board_id").distinct()
    targets = boards.select("board_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(19)), s)).alias("target_id"))
    barrier = R.BindingBarrier(folder, targets, lambda offered: offered.select("board_id", "claim_id", c("content").alias("target_id")))
    for n in range(4):
        claims.where(c("round") == n).drop("round").write.mode("append").parquet(f"{folder}/claims")
        stream = spark.readStream.schema(claims.drop("round").schema).parquet(f"{folder}/claims")
        stream.writeStream.foreachBatch(barrier).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return barrier.table(spark, "judged")
