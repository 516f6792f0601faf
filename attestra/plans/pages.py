"""Target-balanced pages and items of planned sections; users are boards, parts of orders their targets and sources."""

from pyspark.sql import functions as F

from ..operators import pages as P
from .registry import query
from .views import table

c = F.col
s = lambda x: x.cast("string")


def page_inputs(spark, sf_dir):
    """Customers as boards, their orders as targets, the parts of the orders as sources."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = o.join(l, o.o_orderkey == l.l_orderkey).select(s(c("o_custkey")).alias("board_id"), s(c("o_orderkey")).alias("target_id"), "o_orderkey", "o_custkey", "o_orderstatus", "l_linenumber", c("l_partkey").alias("p"), s(c("l_partkey")).alias("source_id"))
    boards = rows.select("board_id", (c("o_custkey") % 4).alias("iteration")).distinct()
    targets = rows.select("board_id", "target_id", c("o_orderkey").alias("pos"), (c("o_orderstatus") != "F").alias("open"), (c("o_orderkey") % 3 == 0).alias("material")).distinct()
    candidates = rows.select("board_id", "target_id", (c("p") % 50 * 1000 + c("l_linenumber")).alias("pos"), (c("p") % 50).cast("string").alias("source_id"))
    sources = boards.select("board_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("pos")).select("board_id", "pos", s(c("pos")).alias("source_id"), (c("pos") % 3 == 1).alias("read"))
    return boards, targets, candidates, sources


@query("balanced_page")
def balanced_page(spark, sf_dir):
    """A page of 12 for each board; tests compare the operator with a plain dealing."""
    return P.balanced_page(*page_inputs(spark, sf_dir), limit=12)


SECTIONS_SQL = """with sec as (select distinct l_suppkey as b, l_linenumber as n, 'k' || l_linenumber as key from lineitem where l_linenumber < 6),
cl as (select l_suppkey as b, 't' || l_partkey % 9 as tid, l_orderkey as pos, 'c' || l_partkey % 40 as cid, l_partkey % 40 as c from lineitem),
tg as (select b, n, 't' || k as tid, k as tpos from sec cross join range(9) x(k) where (k + n) % 3 = 0),
cov as (select b, k as pos, 'k' || case when k % 4 = 3 then 77 else k + 1 end as key, 'o' || k % 5 as ob from (select distinct b from sec) cross join range(8) x(k)),
ap as (select b, max(n) + 1 as a from sec group by b), rt as (select cov.*, coalesce(sec.n, ap.a) as n from cov join ap on ap.b = cov.b left join sec on sec.b = cov.b and sec.key = cov.key),
fi as (select b, ob, min((n, pos)) as f from rt group by all), un as (select b, 'o' || k % 5 as ob, k as pos, 'u' || k as uid, k from (select distinct b from sec) cross join range(10) x(k)),
uc as (select fi.b, f[1] as n, fi.ob, uid, f[2] as cp, un.pos, i, 'c' || (k * 7 + i * 3) % 40 as cid, (k * 7 + i * 3) % 40 as c from fi join un on un.b = fi.b and un.ob = fi.ob cross join range(3) y(i)),
every_row as (select tg.b, n, cid, c, 0 as ph, tpos as x, cl.pos as y, 0 as z, tg.tid, null as uid, null as ob from tg join cl on cl.b = tg.b and cl.tid = tg.tid where c % 13 <> 0 union all select b, n, cid, c, 1, cp, pos, i, null, uid, ob from uc),
nth as (select *, row_number() over (partition by b, n, cid order by ph, x, y, z) as r from every_row)
select cast(b as varchar) as board_id, n as section_no, 'claim' as kind, tid as target_id, cast(null as varchar) as obligation_id, cast(null as varchar) as unit_id, [cid] as canonical, [] as context, [] as requirements from nth where ph = 0 and r = 1
union all select cast(b as varchar), n, 'unit', null, ob, uid, coalesce(list(cid order by z) filter (r = 1 and c % 13 <> 0), []), coalesce(list(cid order by z) filter (r > 1 and c % 13 <> 0), []), coalesce(list(cid order by z) filter (c % 13 = 0), []) from nth where ph = 1 group by b, n, ob, uid"""


@query("section_items", SECTIONS_SQL)
def section_items(spark, sf_dir):
    """Suppliers as boards: sections by line number, claims by part; some coverage goes to no planned section."""
    l, many = table(spark, sf_dir, "lineitem"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")  # noqa: E731,E741
    name = lambda letter, x: F.concat(F.lit(letter), s(x))
    sec = l.where("l_linenumber < 6").select(s(c("l_suppkey")).alias("board_id"), c("l_linenumber").alias("section_no"), name("k", c("l_linenumber")).alias("key")).distinct()
    boards = sec.select("board_id").distinct()
    sections = sec.select("*", many(9)).where((c("k") + c("section_no")) % 3 == 0).select("board_id", "section_no", "key", c("k").alias("target_pos"), name("t", c("k")).alias("target_id"))
    claims = l.select(s(c("l_suppkey")).alias("board_id"), name("t", c("l_partkey") % 9).alias("target_id"), c("l_orderkey").alias("pos"), name("c", c("l_partkey") % 40).alias("claim_id"))
    coverage = boards.select("board_id", many(8)).select("board_id", c("k").alias("pos"), name("k", F.when(c("k") % 4 == 3, 77).otherwise(c("k") + 1)).alias("key"), name("o", c("k") % 5).alias("obligation_id"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: name("c", (c("k") * 7 + i * 3) % 40))
    units = boards.select("board_id", many(10)).select("board_id", name("o", c("k") % 5).alias("obligation_id"), c("k").alias("pos"), name("u", c("k")).alias("unit_id"), ids.alias("claim_ids"))
    requirements = boards.select("board_id", F.explode(F.array(*[F.lit(f"c{i}") for i in (0, 13, 26, 39)])).alias("claim_id"))
    return P.section_items(sections, claims, coverage, units, requirements).drop("at")
