"""Queries of support graphs and folds. Nodes are turns; a turn supports the one before."""

from pyspark.sql import functions as F

from ..operators import confidence as K
from ..operators import custody as C
from ..operators import graph as G
from ..operators import ledger as L
from .registry import query
from .views import table

_ID = "conv_id * 1000 + turn"
_NODES = f"nodes as (select {_ID} as id, conv_id, turn, role from conversations)"
_EDGES = f"{_NODES}, edges as (select a.id as src, a.id - 1 as dst from nodes a where a.id - 1 in (select id from nodes) and a.turn > 0)"
c = F.col


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((c("conv_id") * 1000 + c("turn")).alias("id"), "conv_id", "turn", "role")


def _edges(nodes):
    refs = nodes.where("turn > 0").select(c("id").alias("src"), (c("id") - 1).alias("dst"))
    return refs.join(nodes.select(c("id").alias("dst")), "dst", "left_semi").select("src", "dst")


@query("edges", f"with {_EDGES} select src, dst from edges")
def edges(spark, sf_dir):
    return _edges(_nodes(spark, sf_dir))


@query("influence", f"with {_EDGES}, i as (select dst as id, count(*) as n from edges group by 1), o as (select src as id, count(*) as n from edges group by 1) select nodes.id, 2 * coalesce(i.n, 0) + coalesce(o.n, 0) as score from nodes left join i using (id) left join o on nodes.id = o.id")
def influence(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return G.influence(nodes, _edges(nodes))


@query("support_leaves", f"with recursive {_EDGES}, w as (select id as start, id from nodes union select w.start, e.dst from w join edges e on e.src = w.id) select start, count(*) as reached, min(id) as leaf from w group by start")
def support_leaves(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    seen = G.reachable(nodes.select(c("id").alias("start"), "id"), _edges(nodes))
    return seen.groupBy("start").agg(F.count(F.lit(1)).alias("reached"), F.min("id").alias("leaf"))


@query("chain_depth", f"with recursive {_EDGES}, w as (select id, 0 as depth from nodes where turn = 0 union all select e.src, w.depth + 1 from w join edges e on e.dst = w.id) select id, max(depth) as depth from w group by id")
def chain_depth(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return G.depths(_edges(nodes), nodes.where("turn = 0"))


@query("source_reach", f"with recursive {_EDGES}, w as (select id as start, id from nodes where turn = 0 union select w.start, e.src from w join edges e on e.dst = w.id) select start, count(*) - 1 as spread from w group by start")
def source_reach(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    back = _edges(nodes).select(c("dst").alias("src"), c("src").alias("dst"))
    seen = G.reachable(nodes.where("turn = 0").select(c("id").alias("start"), "id"), back)
    return seen.groupBy("start").agg((F.count(F.lit(1)) - 1).alias("spread"))


@query("removal_test", "with s as (select l_orderkey, l_suppkey, count(distinct l_suppkey) over (partition by l_orderkey) as k from (select distinct l_orderkey, l_suppkey from lineitem)) select l_suppkey, count(*) filter (k = 1) as broken, count(*) filter (k > 1) as weakened, 10 * count(*) filter (k = 1) + 3 * count(*) filter (k > 1) as impact from s group by 1".replace("count(distinct l_suppkey) over", "count(*) over"))
def removal_test(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    k = pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("k"))
    one, many = F.count_if(c("k") == 1), F.count_if(c("k") > 1)
    return pairs.join(k, "l_orderkey").groupBy("l_suppkey").agg(one.alias("broken"), many.alias("weakened"), (10 * one + 3 * many).alias("impact"))


@query("confidence_fold", "select user_id, list_reduce(list_prepend(60, list(case event_type when 'click' then 5 when 'purchase' then 2 when 'error' then -12 else 0 end order by ts, event_id)), lambda a, d: case when d >= 0 then least(98, a + d) else greatest(10, a + d) end) as value from events group by 1")
def confidence_fold(spark, sf_dir):
    """Confidence in hundredths: support raises it up to 98, contradiction lowers it down to 10, in the order of events."""
    t = c("event_type")
    effects = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(t == "click", 5).when(t == "purchase", 2).when(t == "error", -12).otherwise(0).alias("delta"))
    step = lambda v, e: F.when(e["delta"] >= 0, F.least(F.lit(98), v + e["delta"])).otherwise(F.greatest(F.lit(10), v + e["delta"]))
    return G.folded(effects, "user_id", ["ts", "event_id"], F.lit(60), step)


@query("status_fold", "select user_id, arg_max(event_type, (ts, event_id)) filter (event_type in ('error', 'purchase')) as last_status, count(*) filter (event_type = 'error') as contradictions from events group by 1")
def status_fold(spark, sf_dir):
    t = c("event_type")
    last = F.max_by(F.when(t.isin("error", "purchase"), t), F.when(t.isin("error", "purchase"), F.struct("ts", "event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last.alias("last_status"), F.count_if(t == "error").alias("contradictions"))


@query("custody_cascade", """with e as (select distinct l_orderkey as target, l_partkey as source from lineitem), r0 as (select p_partkey as source from part where p_size = 1),
 q1 as (select distinct target from e where source in (select source from r0) and target not in (select target from e where source not in (select source from r0))),
 m as (select target, count(*) as k, count(*) filter (source in (select source from r0)) as bad from e group by 1)
 select target, k, bad, case when target in (select target from q1) then 'quarantined' else 'spared' end as status from m where bad > 0""")
def custody_cascade(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("target"), c("l_partkey").alias("source")).distinct()
    bad = table(spark, sf_dir, "part").where("p_size = 1").select(c("p_partkey").alias("source"), F.lit(1).alias("bad"))
    m = e.join(bad, "source", "left").groupBy("target").agg(F.count(F.lit(1)).alias("k"), F.count("bad").alias("bad")).where("bad > 0")
    return m.withColumn("status", F.when(c("bad") == c("k"), "quarantined").otherwise("spared"))


@query("apply_verdicts", "select d.doc_id, quality = 1 as verified, case when l.doc_id is null then 60 else greatest(5, least(98, 50 + 50 * quality - 60 * toxic)) end as confidence from documents d left join labels l using (doc_id)")
def apply_verdicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    level = F.greatest(F.lit(5), F.least(F.lit(98), 50 + 50 * c("quality") - 60 * c("toxic")))
    return d.select("doc_id", (c("quality") == 1).alias("verified"), F.when(c("quality").isNull(), 60).otherwise(level).alias("confidence"))


@query("ledger_ops", "select user_id, arg_max(value, (ts, event_id)) filter (event_type = 'purchase') as priority, bool_or(event_type = 'signup') as reopened, count(*) as ops from events group by 1")
def ledger_ops(spark, sf_dir):
    t, at = c("event_type"), F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.when(t == "purchase", c("value")), F.when(t == "purchase", at)).alias("priority"), F.bool_or(t == "signup").alias("reopened"), F.count(F.lit(1)).alias("ops"))


def _round(k: int) -> str:
    before = " union ".join(f"select board_id, pos from r{i}" for i in range(k))
    said = " union select board_id, pos from m" if k == 1 else ""
    fresh = f"(board_id, pos) in (select board_id, pos from o) and (board_id, pos) not in ({before})"
    return f"""r{k} as (select board_id, pos from (select s.board_id, s.pos from s join ({before}) g on g.board_id = s.board_id and g.pos = s.support{said}) where {fresh}
 union select board_id, pos from (select s.board_id, s.pos from s join r{k} g on g.board_id = s.board_id and g.pos = s.support where s.pos > s.support) where {fresh})"""


@query("source_custody", f"""with recursive e as (select conv_id as board_id, turn as pos, turn % 7 = 3 as invalid, turn % 5 = 4 as valid from conversations), o as (select * from e where not invalid and not valid),
 s as (select board_id, pos, pos - 1 as support from e union select board_id, pos, pos + 1 from e where pos % 4 = 1), m as (select board_id, pos from e where contains(board_id || '', '7') and pos % 6 = 0 and board_id in (select board_id from e where invalid)),
 r0 as (select distinct board_id, pos from e where invalid), {_round(1)}, {_round(2)}, {_round(3)}
 select board_id, pos, 0 as round, 'invalid_source_document' as reason from r0 """ + " ".join(f"union all select board_id, pos, {k}, 'depends_on_invalid_source_state' from r{k}" for k in (1, 2, 3)))  # fmt: skip
def source_custody(spark, sf_dir):
    """Turns as entries that build on the turn before, some on the next one; the boards are short, so the cap of 20 doesn't bind."""
    t = c("turn")
    e = table(spark, sf_dir, "conversations").select(c("conv_id").alias("board_id"), t.alias("pos"), (t % 7 == 3).alias("invalid"), (t % 5 == 4).alias("valid"))
    s = e.select("board_id", "pos", F.explode(F.when(c("pos") % 4 == 1, F.array(c("pos") - 1, c("pos") + 1)).otherwise(F.array(c("pos") - 1))).alias("support"))
    m = e.where(F.contains(c("board_id").cast("string"), F.lit("7")) & (c("pos") % 6 == 0)).select("board_id", "pos")
    return C.quarantined(e, s, m)


def _ledger(spark, sf_dir):
    """Events as operations on ten targets of each of the boards (100 consecutive events each)."""
    e, t, s = c("event_id"), c("event_type"), lambda x: x.cast("string")
    rows = table(spark, sf_dir, "events").select(s(F.floor(e / 100)).alias("board_id"), e.alias("seq"), t.alias("event_type"), F.concat(F.lit("t"), s(e * 7 % 10)).alias("target_id"), F.floor("value").cast("long").alias("v"))
    targets = rows.select("board_id").distinct().select("board_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.concat(F.lit("t"), s(k)))).alias("target_id"), F.lit("open").alias("status"), F.lit("medium").alias("materiality"), F.lit("").alias("need"))
    v = c("v")
    op = F.when(c("event_type") == "purchase", "merge").when(c("event_type") == "signup", "reopen").when(c("event_type") == "error", F.when(v % 2 == 0, "close").otherwise("waive")).when(c("event_type") == "view", F.when(v % 3 == 0, "reprioritize").otherwise("rephrase"))
    others = F.array(F.concat(F.lit("t"), s(v % 10)), F.concat(F.lit("t"), s((v + 3) % 10)))
    value = F.when(op == "reprioritize", F.element_at(F.array(F.lit("high"), F.lit("low"), F.lit("none")), (v % 3 + 1).cast("int"))).otherwise(F.concat(F.lit("need "), s(v)))
    ops = rows.where("event_type <> 'click'").select("board_id", "seq", op.alias("op"), "target_id", others.alias("others"), value.alias("value"))
    return targets, ops, rows.where("event_type = 'click'").select("board_id", F.concat(F.lit("c"), s(v)).alias("claim_id"), "target_id", "seq")


@query("ledger_replay")
def ledger_replay(spark, sf_dir):
    """All operations of all boards; tests compare the operator with a plain replay."""
    return L.replayed(*_ledger(spark, sf_dir))[0]


@query("ledger_edges")
def ledger_edges(spark, sf_dir):
    return L.replayed(*_ledger(spark, sf_dir))[1]


#: Each entry supports the two before it and contradicts the third before it if its number says so; a fold over its effects in order.
CONFIDENCE_SQL = """with e as (select event_id // 40 as b, event_id as s, event_id % 3 as d, case event_id % 4 when 0 then 950000 when 1 then 150000 else 600000 end as v from events),
u as (select e.b, e.s, t.s as x, e.d, t.d as td, p from e cross join (values (0, 1), (1, 2)) k(p, back) join e t on t.b = e.b and t.s = e.s - back where e.s % 5 <> 0),
k as (select e.b, e.s, t.s as x from e join e t on t.b = e.b and t.s = e.s - 3 where e.s % 7 = 0),
n as (select u.*, (select count(*) from u w where w.b = u.b and w.x = u.x and w.s <= u.s and w.d = w.td) as same from u),
f as (select b, x as who, s, 0 as phase, p, 0 as step, case when same > 2 then 20000 else 50000 end as delta from n union all select b, x, s, 1, 0, 0, -120000 from k union all select b, s, s, 1, 0, 1, -120000 from k
 union all select k.b, u.s, k.s, 1, 0, 2, -50000 from k join u on u.b = k.b and u.x = k.x and u.s <= k.s),
l as (select b, who, list(delta order by s, phase, p, step) as ds from f group by all)
select cast(e.b as varchar) as board_id, cast(e.s as varchar) as entry_id, list_reduce(list_prepend(v, coalesce(ds, [])), lambda a, d: case when d >= 0 then least(980000, a + d) else greatest(100000, a + d) end) / 1000000 as confidence from e left join l on l.b = e.b and l.who = e.s"""


@query("confidence_edges", CONFIDENCE_SQL)
def confidence_edges(spark, sf_dir):
    e, s = c("event_id"), lambda x: x.cast("string")
    none = F.array().cast("array<string>")
    back = lambda *k: F.array(*[s(e - x) for x in k])
    entries = table(spark, sf_dir, "events").select(
        s(F.floor(e / 40)).alias("board_id"), s(e).alias("entry_id"), e.alias("seq"), s(e % 3).alias("document"), F.when(e % 5 != 0, back(1, 2)).otherwise(none).alias("supports"), F.when(e % 7 == 0, back(3)).otherwise(none).alias("contradicts"),
        F.when(e % 4 == 0, 0.95).when(e % 4 == 1, 0.15).otherwise(0.6).alias("confidence"),
    )
    return K.confidences(entries)


_REMOVAL = """e as (select conv_id as b, turn as t, ['observation', 'analysis', 'strategy', 'gap'][turn % 4 + 1] as type, turn % 7 <> 6 as active, case when turn % 3 <> 2 then 'd' || turn * 5 % 4 end as d from conversations),
s as (select x.b, x.t as src, y.t as dst from e x join e y on x.b = y.b and (y.t = x.t - 2 or (x.t % 4 = 1 and y.t = x.t + 2))), k as (select x.b, x.t as src, y.t as dst, x.d as xd, y.d as yd from e x join e y on x.b = y.b and y.t = x.t - 3 and x.t % 5 = 0),
r as (select b, d, t from e where d is not null union select r.b, r.d, s.dst from r join s on s.b = r.b and s.src = r.t),
c as (select r.b, r.t, r.d, count(*) over (partition by r.b, r.t) as n from r join e on e.b = r.b and e.t = r.t where e.active and e.type in ('analysis', 'strategy'))"""
_DOCS = """docs as (select distinct b, 'd' || p as d, p from e cross join range(4) x(p)), h as (select b, d, count(*) as hidden from (select b, xd as d from k where xd is not null union all select b, yd from k where yd is not null and yd is distinct from xd) group by all),
f as (select docs.b, docs.d, p, count(*) filter (n = 1) as broken, count(*) filter (n > 1) as weakened, (select count(distinct t) from c where c.b = docs.b) as every from docs left join c on c.b = docs.b and c.d = docs.d group by all),
g as (select f.*, coalesce(hidden, 0) as hidden, 10 * broken + 3 * weakened + 2 * coalesce(hidden, 0) as impact from f left join h on h.b = f.b and h.d = f.d)"""


def _removal(spark, sf_dir):
    t = c("turn")
    kinds = F.array(*map(F.lit, ["observation", "analysis", "strategy", "gap"]))
    entries = table(spark, sf_dir, "conversations").select(c("conv_id").alias("board_id"), t.alias("entry_id"), F.get(kinds, (t % 4).cast("int")).alias("type"), F.when(t % 7 == 6, "superseded").otherwise("active").alias("status"), F.when(t % 3 != 2, F.concat(F.lit("d"), (t * 5 % 4).cast("string"))).alias("document"))
    known = entries.select("board_id", c("entry_id").alias("dst"))
    edge = lambda to: entries.select("board_id", c("entry_id").alias("src"), F.explode(to).alias("dst")).join(known, ["board_id", "dst"], "left_semi")
    k = c("entry_id")
    documents = entries.select("board_id").distinct().select("board_id", F.posexplode(F.array(*[F.lit(f"d{i}") for i in range(4)])).alias("pos", "document"))
    return G.removal(entries, edge(F.when(k % 4 == 1, F.array(k - 2, k + 2)).otherwise(F.array(k - 2))), edge(F.when(k % 5 == 0, F.array(k - 3))), documents)


@query("removal_impact", f"with recursive {_REMOVAL}, {_DOCS} select b as board_id, d as document, broken, weakened, every - broken - weakened as robust, hidden, impact, row_number() over (partition by b order by impact desc, p) = 1 as most_load_bearing from g")
def removal_impact(spark, sf_dir):
    """Some supports go in circles here."""
    return _removal(spark, sf_dir)[0]


@query("fragile_conclusions", f"with recursive {_REMOVAL} select b as board_id, t as entry_id, d as document from c where n = 1")
def fragile_conclusions(spark, sf_dir):
    return _removal(spark, sf_dir)[1]
