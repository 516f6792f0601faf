"""Queries of effects between entries and of frontier checks."""

from pyspark.sql import functions as F

from ..operators import boards as B
from ..operators import ranking as K
from .registry import query
from .views import table

c = F.col

#: Turns as entries, two a batch; every third contradicts the turn two before and the next one, every fourth supersedes the one before.
_E = """e as (select conv_id as board_id, turn as pos, turn // 2 as batch, text as content, case when turn % 5 = 1 then 'resolved' else 'active' end as status from conversations),
 g as (select board_id, pos, 'contradicts' as kind, 0 as place, pos - 2 as target from e where pos % 3 = 2 union all select board_id, pos, 'contradicts', 1, pos + 1 from e where pos % 3 = 2 union all select board_id, pos, 'supersedes', 0, pos - 1 from e where pos % 4 = 3),
 m as (select g.* from g join e a on a.board_id = g.board_id and a.pos = g.pos join e b on b.board_id = g.board_id and b.pos = g.target and b.batch <= a.batch)"""


def _entries(spark, sf_dir):
    t = c("turn")
    return table(spark, sf_dir, "conversations").select(c("conv_id").alias("board_id"), t.alias("pos"), F.floor(t / 2).alias("batch"), c("text").alias("content"), F.when(t % 5 == 1, "resolved").otherwise("active").alias("status"))


def _edges(e):
    edge = lambda when, kind, place, step: e.where(when).select("board_id", "pos", F.lit(kind).alias("kind"), F.lit(place).alias("place"), (c("pos") + step).alias("target"))
    return edge("pos % 3 = 2", "contradicts", 0, -2).unionByName(edge("pos % 3 = 2", "contradicts", 1, 1)).unionByName(edge("pos % 4 = 3", "supersedes", 0, -1))


@query("status_effects", f"""with {_E}, w as (select board_id, target as pos, 'disputed' as new, pos * 100 + 10 + place as spot from m where kind = 'contradicts' union all select board_id, pos, 'disputed', pos * 100 + 10 + place from m where kind = 'contradicts' union all select board_id, target, 'superseded', pos * 100 + 20 + place from m where kind = 'supersedes'),
 l as (select board_id, pos, arg_max(new, spot) as new from w group by 1, 2) select e.board_id, e.pos, coalesce(new, status) as status from e left join l on l.board_id = e.board_id and l.pos = e.pos""")
def status_effects(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return B.statuses(e, _edges(e))


@query("conflict_rows", f"""with {_E} select m.board_id, m.pos, m.place, m.target, 'CONFLICT: [' || m.pos || '] ' || substr(a.content, 1, 150) || '... vs [' || m.target || '] ' || substr(b.content, 1, 150) || '...' as content, 'Resolve conflict between ' || m.pos || ' and ' || m.target as signal, 'critical' as priority
 from m join e a on a.board_id = m.board_id and a.pos = m.pos join e b on b.board_id = m.board_id and b.pos = m.target where kind = 'contradicts'""")
def conflict_rows(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return B.conflicts(e, _edges(e))


@query("signals_reopened", f"""with {_E} select e.board_id, e.pos as signal_id, case when x.target is null then case when e.pos % 2 = 0 then 'addressed' else 'open' end else 'open' end as status, case when x.target is null and e.pos % 2 = 0 then e.pos end as addressed_by
 from e left join (select distinct board_id, target from m where kind = 'supersedes') x on x.board_id = e.board_id and x.target = e.pos and e.pos % 2 = 0""")
def signals_reopened(spark, sf_dir):
    """One signal a turn; every other one was answered by the turn's entry."""
    e = _entries(spark, sf_dir)
    answered = c("pos") % 2 == 0
    signals = e.select("board_id", c("pos").alias("signal_id"), F.when(answered, "addressed").otherwise("open").alias("status"), F.when(answered, c("pos")).alias("addressed_by"))
    return B.reopened(signals, e, _edges(e))


@query("frontier_checks", """with s as (select p_size % 3 as board_id, p_partkey as source_id, row_number() over (partition by p_size % 3 order by p_partkey) - 1 as place, p_partkey % 11 <> 0 as is_document from part),
 t as (select distinct board_id, n as target_id from s, (select unnest(range(1, 7)) as n)),
 k as (select s.board_id, l_linenumber as target_id, row_number() over (partition by s.board_id, l_linenumber order by l_quantity, l_orderkey, l_partkey, l_suppkey, l_returnflag) - 1 as place, l_partkey as source_id, case when l_quantity < 25 then 'definite' when l_quantity < 49 then 'maybe' else 'later' end as priority,
  case when l_orderkey % 40 <> 0 then l_returnflag end as reason, s.place // 150 + case when l_orderkey % 50 = 0 then 1 else 0 end as batch_index, l_suppkey as response_rank from lineitem join s on l_partkey = s.source_id),
 f as (select board_id, source_id from s where source_id % 4 = 0 union all select board_id, source_id from s where source_id % 20 = 0 union all select board_id, -source_id from s where source_id % 30 = 0),
 r as (select *, case priority when 'definite' then 0 when 'maybe' then 1 end as rank from k), d as (select board_id, source_id, place // 150 as batch from s where is_document), o as (select a.* from r a join r b on a.board_id = b.board_id and a.target_id = b.target_id and a.place = b.place + 1
  where (coalesce(a.rank, -1), a.batch_index, a.response_rank) < (coalesce(b.rank, -1), b.batch_index, b.response_rank)), listed as (select distinct board_id, source_id from k), fb as (select distinct board_id, source_id from f),
 v as (select board_id, 'dead_target' as kind, target_id, place, source_id from k where (board_id, target_id) not in (select board_id, target_id from t)
 union all select board_id, 'malformed', target_id, place, source_id from r where rank is null or reason is null
 union all select board_id, 'unknown_source', target_id, place, source_id from k where (board_id, source_id) not in (select board_id, source_id from d)
 union all select board_id, 'wrong_batch', target_id, place, source_id from k where (board_id, source_id) in (select board_id, source_id from d) and (board_id, source_id, batch_index) not in (select board_id, source_id, batch from d)
 union all select board_id, 'repeated', target_id, place, source_id from (select *, min(place) over (partition by board_id, target_id, source_id) as first from k) where place > first
 union all select board_id, 'out_of_order', target_id, place, source_id from o
 union all select board_id, 'over_cap', target_id, null, null from k group by board_id, target_id, batch_index having count(*) > 3
 union all select board_id, 'fallback_repeated', null, null, source_id from f group by board_id, source_id having count(*) > 1
 union all select board_id, 'fallback_unknown', null, null, source_id from fb where (board_id, source_id) not in (select board_id, source_id from d)
 union all select board_id, 'fallback_is_candidate', null, null, source_id from fb where (board_id, source_id) in (select board_id, source_id from listed)
 union all select board_id, 'uncovered', null, null, source_id from d where (board_id, source_id) not in (select board_id, source_id from listed union select board_id, source_id from f))
 select board_id, kind, cast(target_id as varchar) as target_id, place, cast(source_id as varchar) as source_id from v""")  # fmt: skip
def frontier_checks(spark, sf_dir):
    """Parts as the sources of three boards, line items as candidates for targets by line number."""
    p = table(spark, sf_dir, "part").select((c("p_size") % 3).alias("board_id"), c("p_partkey").alias("source_id"), (c("p_partkey") % 11 != 0).alias("is_document"))
    s = K.numbered(p, ["board_id"], ["source_id"], "place", K.tasks_for(p))
    targets = s.select("board_id").distinct().select("board_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("target_id"))
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    both = lines.join(s.select("board_id", "source_id", c("place").alias("source_place")), c("l_partkey") == c("source_id"))
    # three boards of seven lines: few lists, each a large share of all rows
    ranked = K.numbered(both, ["board_id", "l_linenumber"], ["l_quantity", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"], "place", K.tasks_for(lines))
    k = ranked.select(
        "board_id", c("l_linenumber").alias("target_id"), "place", "source_id", F.when(c("l_quantity") < 25, "definite").when(c("l_quantity") < 49, "maybe").otherwise("later").alias("priority"),
        F.when(c("l_orderkey") % 40 != 0, c("l_returnflag")).alias("reason"), (F.floor(c("source_place") / 150) + F.when(c("l_orderkey") % 50 == 0, 1).otherwise(0)).alias("batch_index"), c("l_suppkey").alias("response_rank"),
    )
    some = lambda when, sign=1: s.where(when).select("board_id", (c("source_id") * sign).alias("source_id"))
    fallback = some("source_id % 4 = 0").unionByName(some("source_id % 20 = 0")).unionByName(some("source_id % 30 = 0", -1))
    return B.frontier_violations(targets, s, k, fallback)
