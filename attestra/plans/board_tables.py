"""Snapshots of boards, findings, edges and cards. Conversations are boards for the first two, suppliers for the others."""

from pyspark.sql import functions as F

from ..operators import bindings as B
from ..sources import boards as S
from .registry import query
from .views import table

c = F.col


def _snapshots(spark, sf_dir):
    """One JSON per conversation: each turn is an object in each of the six tables, with fields out of form."""
    t, text = c("turn"), F.to_json(F.array("text"))
    said = F.substring(text, F.lit(2), F.length(text) - 2)  # the whole text, quoted and escaped
    n, q = t.cast("string"), lambda letter: F.concat(F.lit(f'"{letter}'), t.cast("string"), F.lit('"'))
    obj = lambda *parts: F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v if not isinstance(v, str) else F.lit(v)) for k, v in parts]), F.lit("}"))
    items = {
        "sources": obj(("id", q("s")), ("name", said), ("size_bytes", F.when(t % 2 == 0, F.concat(F.lit('"'), n, F.lit('"'))).otherwise('"big"')), ("read_status", F.when(t % 3 == 0, "null").otherwise('"read"'))),
        "claims": obj(
            ("id", n), ("kind", F.when(t % 4 == 0, '"analysis"')), ("content", said), ("source_span", F.when(t % 3 == 0, F.concat(F.lit("["), n, F.lit(', "9"]'))).when(t % 3 == 1, '[1, "x"]').otherwise("[1, 2, 3]")), ("support_refs", F.when(t % 2 == 0, F.concat(F.lit('["c1", '), n, F.lit(", null]"))).otherwise('"c1"')),
            ("confidence", F.when(t % 3 == 0, '"0.25"').when(t % 3 == 1, '"high"').otherwise("0.5")), ("verified", F.when(t % 2 == 0, "null").otherwise("true")), ("superseded", F.when(t % 5 == 0, '"yes"').otherwise("0")),
        ),
        "targets": obj(("id", q("t")), ("need", F.when(t % 2 == 0, said)), ("claim_refs", '["c1", "c2"]'), ("resolved_iteration", F.when(t % 2 == 0, "null").otherwise(n))),
        "obligations": obj(("id", q("o")), ("mandatory", F.when(t % 3 == 0, "false").when(t % 3 == 1, "null").otherwise("1"))),
        "units": obj(("id", q("u")), ("name", said), ("status", F.when(t % 2 == 0, '"waived"')), ("claim_refs", "{}")),
        "events": obj(("iteration", F.when(t % 2 == 0, "1.9").otherwise('"x"')), ("kind", '"k"'), ("tokens", n)),
    }
    turn = table(spark, sf_dir, "conversations").select("conv_id", "turn", *[v.alias(k) for k, v in items.items()])
    lists = [F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c(k).alias("x")))), lambda r: r["x"]), ", "), F.lit(', "no object"]')).alias(k) for k in items]
    by = turn.groupBy(c("conv_id").alias("board_id")).agg(*lists)
    whole = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), c(k)) for k in items]), F.lit("}"))
    return by.select("board_id", F.parse_json(whole).alias("snapshot"))


_TURNS = "t as (select conv_id as board_id, turn, row_number() over (partition by conv_id order by turn) - 1 as pos, text from conversations)"


@query("snap_sources", f"with {_TURNS} select board_id, pos, 's' || turn as id, text as name, '' as path, 'document' as kind, case when turn % 2 = 0 then turn else 0 end as size_bytes, case when turn % 3 = 0 then 'unread' else 'read' end as read_status, 'unknown' as relevance, '' as relevance_reason from t")
def snap_sources(spark, sf_dir):
    return S.board_table(_snapshots(spark, sf_dir), "sources")


@query("snap_claims", f"""with {_TURNS} select board_id, pos, cast(turn as varchar) as id, case when turn % 4 = 0 then 'analysis' else 'observation' end as kind, text as content, case when turn % 3 = 0 then turn end as start, case when turn % 3 = 0 then 9 end as "end", case when turn % 2 = 0 then ['c1', cast(turn as varchar)] else [] end as support_refs,
 case turn % 3 when 0 then 0.25 when 1 then 0.6 else 0.5 end::double as confidence, case when turn % 2 = 1 then true end as verified, turn % 5 = 0 as superseded, 0 as iteration from t""")
def snap_claims(spark, sf_dir):
    rows = S.board_table(_snapshots(spark, sf_dir), "claims")
    return rows.select("board_id", "pos", "id", "kind", "content", "source_span.start", "source_span.end", "support_refs", "confidence", "verified", "superseded", "iteration")


@query("snap_targets", f"with {_TURNS} select board_id, pos, 't' || turn as id, case when turn % 2 = 0 then text else '' end as need, 'medium' as materiality, 'open' as status, '' as reason, ['c1', 'c2'] as claim_refs, 0 as created_iteration, case when turn % 2 = 1 then turn end as resolved_iteration, 'seed' as proposed_by, [] as closure_basis from t")
def snap_targets(spark, sf_dir):
    return S.board_table(_snapshots(spark, sf_dir), "targets")


@query("snap_obligations", f"with {_TURNS} select board_id, pos, 'o' || turn as id, '' as text, 'instruction' as origin, 'material' as coverage, turn % 3 <> 0 as mandatory, 'open' as status, '' as reason from t")
def snap_obligations(spark, sf_dir):
    return S.board_table(_snapshots(spark, sf_dir), "obligations")


@query("snap_units", f"with {_TURNS} select board_id, pos, 'u' || turn as id, text as name, '' as obligation_ref, '' as anchor, [] as claim_refs, case when turn % 2 = 0 then 'waived' else 'discovered' end as status, '' as reason from t")
def snap_units(spark, sf_dir):
    return S.board_table(_snapshots(spark, sf_dir), "units")


@query("snap_events", f"with {_TURNS} select board_id, pos, case when turn % 2 = 0 then 1 else 0 end as iteration, 'k' as kind, '' as summary, '' as model, turn as tokens, 0 as tokens_in, 0 as tokens_out from t")
def snap_events(spark, sf_dir):
    return S.board_table(_snapshots(spark, sf_dir), "events")


_FOUND = """r as (select conv_id, turn, case turn % 3 when 0 then 'observation' when 1 then 'calculation' else 'musing' end as given, trim(case when turn % 5 = 0 then 'There is no ' else '' end || text) as content, case when turn % 4 < 2 then 'doc_' || conv_id % 3 when turn % 4 = 2 then 'doc_9' end as source from conversations),
f as (select *, case given when 'musing' then 'observation' else given end as kind, source is not null and not (turn % 4 < 2 and conv_id % 3 < 2) as lost from r)"""


def _findings(spark, sf_dir):
    t, board = c("turn"), c("conv_id")
    text = F.to_json(F.array(F.concat(F.when(t % 5 == 0, "There is no ").otherwise(""), "text")))
    kind = F.when(t % 3 == 0, '"observation"').when(t % 3 == 1, '"calculation"').otherwise('"musing"')
    source = F.when(t % 4 < 2, F.concat(F.lit('"doc_'), (board % 3).cast("string"), F.lit('"'))).when(t % 4 == 2, '"doc_9"').otherwise("null")
    level = F.when(t % 4 == 0, '"0.5"').when(t % 4 == 1, "7").when(t % 4 == 2, "-1").otherwise('"high"')
    reply = F.concat(F.lit('{"findings": [{"type": '), kind, F.lit(', "content": '), F.substring(text, F.lit(2), F.length(text) - 2), F.lit(', "source_document": '), source, F.lit(', "confidence": '), level, F.lit(', "tags": ["a", 1, null]}, "none"]}'))
    turns = table(spark, sf_dir, "conversations")
    replies = turns.select(F.concat_ws("/", board.cast("string"), t.cast("string")).alias("reply_id"), board.alias("board_id"), F.parse_json(reply).alias("reply"))
    known = turns.select(board.alias("board_id")).distinct().select("board_id", F.explode(F.array(F.lit("doc_0"), F.lit("doc_1"))).alias("source"))
    return S.findings(replies, known)


@query("worker_findings", f"""with {_FOUND}, o as (select *, case when length(content) < 20 then 'too_short' when lost and kind = 'observation' then 'refused' when lost then 'gap' else 'kept' end as outcome from f)
select conv_id || '/' || turn as reply_id, 0 as pos, case when outcome = 'gap' then 'gap' else kind end as kind, content, case when outcome <> 'gap' then source end as source, case turn % 4 when 0 then 0.5 when 1 then 1 when 2 then 0 else 0.6 end::double as confidence, ['a'] as tags, outcome from o""")
def worker_findings(spark, sf_dir):
    return _findings(spark, sf_dir)


@query("finding_gate", rf"""with {_FOUND} select conv_id || '/' || turn as reply_id, (kind <> 'observation' or (source is not null and not regexp_matches(lower(content), '^(does not contain|no mention of|not found in|the document does not|there is no|the provided text does not|no information about|the text does not|no evidence of|no reference to|this document does not)')))
 and (kind <> 'calculation' or (len(regexp_extract_all(content, '[0-9]')) >= 2 and regexp_matches(content, '[=+×*/%−]'))) as passes from f where length(content) >= 20 and not lost""")
def finding_gate(spark, sf_dir):
    """The gate over what is kept of the findings."""
    return _findings(spark, sf_dir).where("outcome = 'kept'").select("reply_id", S.passes_gate(c("kind"), c("content"), c("source")).alias("passes"))


def _claims(spark, sf_dir):
    """Parts as claims of suppliers, orders as targets and units; some ends are missing."""
    l = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("board_id"), c("l_partkey").alias("claim_id"), c("l_orderkey").alias("target_id"))  # noqa: E741
    p = c("claim_id")
    claims = l.select("board_id", "claim_id").distinct().where(p % 11 != 0).select("board_id", "claim_id", F.element_at(F.array(*map(F.lit, ["observation", "analysis", "calculation"])), (p % 3 + 1).cast("int")).alias("kind"), (p % 3 == 2).alias("derived"), (p % 10 / 10).alias("confidence"))
    targets = l.select("board_id", (c("target_id") % 40).alias("target_id")).distinct().where("target_id % 13 <> 0")
    return l.select("board_id", "claim_id", (c("target_id") % 40).alias("target_id")), claims, targets


_EDGES = """e as (select distinct l_suppkey as b, l_partkey as p, l_orderkey % 40 as t from lineitem where l_partkey % 11 <> 0 and (l_orderkey % 40) % 13 <> 0)"""


@query("target_cards", f"""with {_EDGES}, r as (select *, row_number() over (partition by b, t order by p % 10 desc, p) as k from e)
select b as board_id, t as target_id, count(*) as bound, count(*) filter (p % 3 <> 2) as raw, count(*) filter (p % 3 = 2) as derived, list_sort(list_distinct(list(['observation', 'analysis', 'calculation'][p % 3 + 1]))) as kinds, list(p order by k) filter (k <= 8) as best from r group by 1, 2""")
def target_cards(spark, sf_dir):
    binds, claims, targets = _claims(spark, sf_dir)
    return B.target_cards(B.bound(binds, claims, targets, "target_id"), claims)


@query("unit_rows", f"""with {_EDGES}, u as (select distinct l_suppkey as b, l_orderkey % 40 as t from lineitem where (l_orderkey % 40) % 13 <> 0 and (l_orderkey % 40) % 5 <> 0), n as (select b, t % 4 as o, count(*) as n from u group by all),
r as (select *, row_number() over (partition by b, t order by p % 3 = 2 desc, p % 10 desc, p) as k from e)
select u.b as board_id, u.t % 4 as obligation_id, u.t as unit_id, coalesce(k, 1) as rank, p as claim_id from u join n on n.b = u.b and n.o = u.t % 4 left join r on r.b = u.b and r.t = u.t where k is null or k <= greatest(3, least(8, 240 // n))""")
def unit_rows(spark, sf_dir):
    binds, claims, targets = _claims(spark, sf_dir)
    units = targets.select("board_id", c("target_id").alias("unit_id"), (c("target_id") % 4).alias("obligation_id"), F.when(c("target_id") % 5 == 0, "waived").otherwise("discovered").alias("status"))
    edges = B.bound(binds.withColumnRenamed("target_id", "unit_id"), claims, units, "unit_id")
    return B.unit_rows(units, edges, claims)


@query("unit_status", f"""with {_EDGES}, u as (select distinct l_suppkey as b, l_orderkey % 40 as t from lineitem where (l_orderkey % 40) % 13 <> 0) select u.b as board_id, u.t as unit_id, count(p) as claims, case when u.t % 5 = 0 then 'waived' when count(p) > 0 then 'evidenced' else 'discovered' end as status from u left join e on e.b = u.b and e.t = u.t group by u.b, u.t""")
def unit_status(spark, sf_dir):
    binds, claims, targets = _claims(spark, sf_dir)
    units = targets.select("board_id", c("target_id").alias("unit_id"), F.when(c("target_id") % 5 == 0, "waived").otherwise("discovered").alias("status"))
    return B.evidenced(units, B.bound(binds.withColumnRenamed("target_id", "unit_id"), claims, units, "unit_id"))


@query("broken_references", """with l as (select distinct l_suppkey as b, l_partkey as p, l_orderkey % 40 as t from lineitem) select b as board_id, 'target of claim' as kind, p as owner, t as reference from l where t % 13 = 0
union all select distinct b, 'claim of target', t, p from l where p % 11 = 0 union all select distinct b, 'support of claim', p, p + 1 from l a where not exists (select 1 from l z where z.b = a.b and z.p = a.p + 1 and z.p % 11 <> 0)""")
def broken_references(spark, sf_dir):
    binds, claims, targets = _claims(spark, sf_dir)
    known, there = claims.select("board_id", c("claim_id").alias("id")), targets.select("board_id", c("target_id").alias("id"))
    return B.broken_references(
        ("target of claim", binds.select("board_id", c("claim_id").alias("owner"), F.array("target_id").alias("refs")).distinct(), there),
        ("claim of target", binds.select("board_id", c("target_id").alias("owner"), F.array("claim_id").alias("refs")).distinct(), known),
        ("support of claim", binds.select("board_id", c("claim_id").alias("owner")).distinct().withColumn("refs", F.array(c("owner") + 1)), known),
    )


@query("judged_claims", """with l as (select distinct l_suppkey as b, l_partkey as p from lineitem where l_partkey % 11 <> 0), v as (select l_suppkey as b, l_partkey as p, arg_max(l_linenumber % 3, (l_orderkey, l_linenumber)) as n from lineitem where l_quantity > 45 group by all)
select b as board_id, p as claim_id, ['observation', 'analysis', 'calculation'][p % 3 + 1] as kind, p % 3 = 2 as derived, case n when 0 then 0.98 when 1 then 0.05 else (p % 10) / 10 end::double as confidence, case n when 0 then true when 1 then false end as verified from l left join v using (b, p)""")
def judged_claims(spark, sf_dir):
    """Verdicts: sure, refuted, or without a word on either."""
    _, claims, _ = _claims(spark, sf_dir)
    n = c("l_linenumber") % 3
    said = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(c("l_suppkey").alias("board_id"), c("l_partkey").alias("claim_id"), F.struct("l_orderkey", "l_linenumber").alias("seq"), F.when(n == 0, True).when(n == 1, False).alias("verified"), F.when(n == 0, 1.5).when(n == 1, 0.0).alias("confidence"))
    return B.judged(claims.withColumn("verified", F.lit(None).cast("boolean")), said)
