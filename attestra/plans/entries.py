"""Queries of entry rankings, reported items, placements, fuzzy spans and merging."""

from pyspark.sql import functions as F

from ..functions.scalars import upper_each
from ..operators import dedup as D
from ..operators import entries as E
from ..operators import matching as M
from ..operators.ranking import top_per_group
from .registry import query
from .views import table

c = F.col

#: Turns as entries with tags, sources and supports, by rules on the turn.
_RICH = """rich as (select conv_id as board_id, turn as seq, ['observation', 'analysis', 'calculation', 'gap', 'strategy'][turn % 5 + 1] as type, text as content, (turn * 7) % 5 as confidence,
 case turn % 4 when 0 then [] when 1 then ['debt_sensor', 'materiality:high'] when 2 then ['plan_coverage', 'missing_work:compare', 'materiality:critical'] end as tags,
 case when turn % 3 <> 0 then 'doc_' || turn % 3 end as source_doc, turn > 0 as supported, case when turn % 6 = 5 then 'disputed' else 'active' end as status from conversations)"""


def _rich(spark, sf_dir):
    t, words = c("turn"), lambda *w: F.array(*map(F.lit, w))
    kinds = words("observation", "analysis", "calculation", "gap", "strategy")
    tags = F.when(t % 4 == 0, F.array().cast("array<string>")).when(t % 4 == 1, words("debt_sensor", "materiality:high")).when(t % 4 == 2, words("plan_coverage", "missing_work:compare", "materiality:critical"))
    return table(spark, sf_dir, "conversations").select(
        c("conv_id").alias("board_id"), t.alias("seq"), F.get(kinds, (t % 5).cast("int")).alias("type"), c("text").alias("content"), (t * 7 % 5).alias("confidence"), tags.alias("tags"),
        F.when(t % 3 != 0, F.concat(F.lit("doc_"), (t % 3).cast("string"))).alias("source_doc"), F.when(t > 0, F.array(t - 1)).otherwise(F.array().cast("array<bigint>")).alias("supports"),
        F.when(t % 6 == 5, "disputed").otherwise("active").alias("status"),
    )


def _top(score: str, where: str, length: str, k: int) -> str:
    return f"with {_RICH}, s as (select *, {score} as score from rich where {where}), r as (select *, row_number() over (partition by board_id order by score desc, confidence desc{length}, seq) as rank from s) select board_id, seq, score, rank from r where rank <= {k}"


_TYPES = "case type when 'calculation' then {} when 'analysis' then {} when 'strategy' then {} when 'gap' then {} else {} end"
_LONG = ", length(content) desc"


@query("board_top_calc", _top(_TYPES.format(5, 4, 3, 3, 2) + " + case when regexp_matches(content, '[0-9]') then 2 else 0 end", "true", "", 120))
def board_top_calc(spark, sf_dir):
    return E.for_calculation(_rich(spark, sf_dir), 120).select("board_id", "seq", "score", "rank")


@query("board_top_gap", _top(_TYPES.format(4, 4, 2, 3, 1) + " + case when seq % 4 in (1, 2) then 2 else 0 end + case when supported then 1 else 0 end", "status = 'active'", _LONG, 140))
def board_top_gap(spark, sf_dir):
    return E.for_gaps(_rich(spark, sf_dir), 140).select("board_id", "seq", "score", "rank")


@query("board_top_commit", _top("case seq % 4 when 1 then 4 when 2 then 3 else 0 end + " + _TYPES.format(4, 3, 2, 0, 1), "source_doc is not null and ((seq % 4 = 1) or (seq % 4 = 2) or (type = 'calculation' and regexp_matches(content, '[0-9]')))", _LONG, 30))
def board_top_commit(spark, sf_dir):
    return E.for_commitment(_rich(spark, sf_dir), 30).select("board_id", "seq", "score", "rank")


@query("board_top_maint", _top(_TYPES.format(5, 5, 3, 4, 2) + " + case when source_doc is not null then 2 else 0 end + case when supported then 1 else 0 end", "status = 'active' and length(trim(content)) >= 30", ", least(length(content), 1200) desc", 180))
def board_top_maint(spark, sf_dir):
    return E.for_maintenance(_rich(spark, sf_dir), 180).select("board_id", "seq", "score", "rank")


@query("grounded_entries", f"with {_RICH} select board_id, source_doc, count(*) as entries, max(confidence) as best from rich where source_doc is not null and type <> 'gap' and status = 'active' and length(content) >= 20 group by 1, 2")
def grounded_entries(spark, sf_dir):
    kept = _rich(spark, sf_dir).where("source_doc is not null and type <> 'gap' and status = 'active' and length(content) >= 20")
    return kept.groupBy("board_id", "source_doc").agg(F.count(F.lit(1)).alias("entries"), F.max("confidence").alias("best"))


@query("draft_packet", f"with {_RICH} select board_id, seq, 'strong' as part from rich where status = 'active' and confidence >= 3 union all select board_id, seq, 'disputed' from rich where status = 'disputed' union all select board_id, seq, 'open' from rich where type = 'gap' and status = 'active'")
def draft_packet(spark, sf_dir):
    """An entry can stand in several parts; one pass over the entries gives them all."""
    part = F.array_compact(F.array(F.when((c("status") == "active") & (c("confidence") >= 3), "strong"), F.when(c("status") == "disputed", "disputed"), F.when((c("type") == "gap") & (c("status") == "active"), "open")))
    return _rich(spark, sf_dir).select("board_id", "seq", F.explode(part).alias("part"))


@query("verify_packet", f"with {_RICH} select a.board_id, a.seq, coalesce(a.source_doc, b.source_doc) as source_doc, a.source_doc is null and b.source_doc is not null as borrowed from rich a left join rich b on a.board_id = b.board_id and b.seq = a.seq - 1")
def verify_packet(spark, sf_dir):
    """A claim goes with its own source, else with that of its first supporter."""
    rich = _rich(spark, sf_dir)
    first = rich.select("board_id", "seq", "source_doc", F.get("supports", F.lit(0)).alias("support"))
    of = rich.select("board_id", c("seq").alias("support"), c("source_doc").alias("theirs"))
    return first.join(of, ["board_id", "support"], "left").select("board_id", "seq", F.coalesce("source_doc", "theirs").alias("source_doc"), (c("source_doc").isNull() & c("theirs").isNotNull()).alias("borrowed"))


@query("audit_items", """with i as (select l_orderkey as board_id, l_partkey * 10 + l_suppkey % 10 as seq, p_name || ' holds' as claim, l_returnflag as flag, l_linestatus as line from lineitem join part on l_partkey = p_partkey),
 d as (select *, row_number() over (partition by board_id, lower(substr(claim, 1, 180)) order by seq, flag, line) as n from i where length(claim) >= 12), r as (select *, row_number() over (partition by board_id order by seq) as rank from d where n = 1)
 select board_id, lower(claim) as claim, rank from r where rank <= 50""")
def audit_items(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    items = lines.select(c("l_orderkey").alias("board_id"), (c("l_partkey") * 10 + c("l_suppkey") % 10).alias("seq"), F.concat("p_name", F.lit(" holds")).alias("claim"), c("l_returnflag").alias("status"), c("l_linestatus").alias("severity"))
    return E.audit_items(items, 50).select("board_id", F.lower("claim").alias("claim"), "rank")


_GAPS = """g as (select o_custkey as board_id, o_orderkey as seq, ['relation', 'source_object', 'severity', 'authority', 'rumour'][o_orderkey % 5 + 1] as type, case when o_orderkey % 3 = 0 then '' else o_orderpriority end as subtype, 'status ' || o_orderstatus || ' of it' as reason, (o_orderkey % 10) / 10.0 as confidence from orders),
 k as (select *, row_number() over (partition by board_id, type, subtype, reason order by seq) as n from g where type <> 'rumour'), clean as (select board_id, seq, type, case when subtype = '' then 'unknown' else subtype end as subtype, case when confidence >= 0.7 then 'actionable_gap' else 'diagnostic_only' end as status from k where n = 1)"""


def _gaps(spark, sf_dir):
    k = c("o_orderkey")
    kinds = F.array(*map(F.lit, ["relation", "source_object", "severity", "authority", "rumour"]))
    items = table(spark, sf_dir, "orders").select(
        c("o_custkey").alias("board_id"), k.alias("seq"), F.get(kinds, (k % 5).cast("int")).alias("type"), F.when(k % 3 == 0, "").otherwise(c("o_orderpriority")).alias("subtype"),
        F.concat(F.lit("status "), "o_orderstatus", F.lit(" of it")).alias("reason"), (k % 10 / 10.0).alias("confidence"), F.array().cast("array<string>").alias("parents"),
    )
    return E.gap_items(items)


@query("gap_items", f"with {_GAPS} select board_id, seq, type, subtype, status from clean")
def gap_items(spark, sf_dir):
    return _gaps(spark, sf_dir).select("board_id", "seq", "type", "subtype", "status")


@query("gap_entries", f"with {_GAPS} select board_id, seq, 'gap' as type, 'missing_work:' || case type when 'relation' then 'compare' when 'severity' then 'severity' when 'authority' then 'reference_framework' else 'extract' end as tag from clean where status = 'actionable_gap' and seq not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def gap_entries(spark, sf_dir):
    """Actionable gaps that no work has filled become entries with the work they ask for."""
    filled = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("seq"))
    left = _gaps(spark, sf_dir).where("status = 'actionable_gap'").join(filled, "seq", "left_anti")
    work = F.when(c("type") == "relation", "compare").when(c("type") == "severity", "severity").when(c("type") == "authority", "reference_framework").otherwise("extract")
    return left.select("board_id", "seq", F.lit("gap").alias("type"), F.concat(F.lit("missing_work:"), work).alias("tag"))


@query("repair_gaps", """with g as (select o_custkey as board_id, o_orderkey as id, o_orderpriority < '2' as top, o_orderkey % 7 as w from orders where o_orderpriority < '3' and o_orderkey % 7 < 5), r as (select *, row_number() over (partition by board_id order by top desc, w, id) as rank from g)
 select board_id, id, rank from r where rank <= 3""")
def repair_gaps(spark, sf_dir):
    works = F.array(*map(F.lit, [*E.REPAIRABLE, "none", "translate"]))
    tags = F.array(F.lit("plan_coverage"), F.concat(F.lit("missing_work:"), F.get(works, (c("o_orderkey") % 7).cast("int"))), F.concat(F.lit("materiality:"), F.when(c("o_orderpriority") < "2", "Critical").when(c("o_orderpriority") < "3", "high").otherwise("low")))
    found = table(spark, sf_dir, "orders").select(c("o_custkey").alias("board_id"), c("o_orderkey").alias("id"), F.lit("gap").alias("type"), tags.alias("tags"))
    return E.repair_gaps(found, 3).select("board_id", "id", "rank")


@query("coverage_entries", """with s as (select l_orderkey, count(distinct l_partkey) as n from lineitem where l_partkey in (select p_partkey from part where p_size > 10) group by 1)
 select o_orderkey, case when o_orderstatus = 'F' then 'analysis' else 'gap' end as type, coalesce(n, 0) as support from orders left join s on o_orderkey = l_orderkey where o_orderstatus = 'F' or n is not null""")
def coverage_entries(spark, sf_dir):
    """Answered criteria become analysis rows; others become gaps if a live entry supports them."""
    live = table(spark, sf_dir, "part").where("p_size > 10").select(c("p_partkey").alias("l_partkey"))
    n = table(spark, sf_dir, "lineitem").join(live, "l_partkey", "left_semi").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_partkey").alias("n"))
    o = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").where("o_orderstatus = 'F' or n is not null")
    return o.select("o_orderkey", F.when(c("o_orderstatus") == "F", "analysis").otherwise("gap").alias("type"), F.coalesce("n", F.lit(0)).alias("support"))


@query("convert_intake", """with s as (select l_orderkey, count(distinct l_suppkey) as docs, min(l_suppkey) as doc, bool_or(l_discount > 0) as grounded from lineitem group by 1)
 select o_orderkey, case when o_orderstatus = 'P' then 'gap' when coalesce(grounded, false) then 'kept' else 'dropped' end as outcome, case when docs = 1 then doc end as source from orders left join s on o_orderkey = l_orderkey""")
def convert_intake(spark, sf_dir):
    """Rows other than gaps need a grounded parent; the source is kept if all parents share it."""
    s = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("low"), F.max("l_suppkey").alias("top"), F.bool_or(c("l_discount") > 0).alias("grounded"))
    outcome = F.when(c("o_orderstatus") == "P", "gap").when(F.coalesce("grounded", F.lit(False)), "kept").otherwise("dropped")
    return table(spark, sf_dir, "orders").join(s, "o_orderkey", "left").select("o_orderkey", outcome.alias("outcome"), F.when(c("low") == c("top"), c("low")).alias("source"))


@query("placement_check", """with f as (select distinct l_suppkey as file, l_orderkey as term from lineitem), q as (select o_orderkey as row_id, o_custkey % 120 as target, o_orderpriority < '2' or o_orderpriority < '3' as due from orders)
 select row_id, m is null as found, m as failure_mode from (select row_id, case when exists (select 1 from f where term = row_id and file = target) then null when exists (select 1 from f where term = row_id) then 'wrong_file' when target not in (select file from f) then 'artifact_missing' else 'content_missing' end as m from q where due)""")
def placement_check(spark, sf_dir):
    lines, board = table(spark, sf_dir, "lineitem"), F.lit(1).alias("board_id")
    terms = lines.select(board, c("l_suppkey").alias("file"), c("l_orderkey").alias("term")).distinct()
    level = F.when(c("o_orderpriority") < "2", "critical").when(c("o_orderpriority") < "3", "high").otherwise("low")
    rows = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("row_id"), board, level.alias("importance"), (c("o_custkey") % 120).alias("target_file"), F.array("o_orderkey").alias("terms"))
    return E.placements(rows, terms, lines.select(board, c("l_suppkey").alias("file"))).drop("board_id")


@query("section_excerpts", """with k as (select doc_id, source, row_number() over (partition by source order by doc_id) as n from documents) select source, doc_id, substr(d.text, 1, 12000) as excerpt from k join documents d using (doc_id, source) where n <= 3 and trim(d.text) <> ''""")
def section_excerpts(spark, sf_dir):
    """The head of the first three documents of each board, blank ones left out."""
    d = table(spark, sf_dir, "documents")
    first = top_per_group(d.select("source", "doc_id"), ["source"], [c("doc_id")], 3)
    return d.join(first.select("doc_id"), "doc_id", "left_semi").where("trim(text) <> ''").select("source", "doc_id", F.substring("text", 1, 12000).alias("excerpt"))


@query("plan_items", "with l as (select conv_id, turn, unnest(string_split(text, '. ')[1:6]) as item, generate_subscripts(string_split(text, '. ')[1:6], 1) as k from conversations) select conv_id, turn, 'part_' || k as id, item from l where trim(item) <> ''")
def plan_items(spark, sf_dir):
    """Lists of a plan as rows with ids by place."""
    parts = F.slice(F.split("text", r"\. "), 1, 6)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("k", "item"))
    return rows.where("trim(item) <> ''").select("conv_id", "turn", F.concat(F.lit("part_"), (c("k") + 1).cast("string")).alias("id"), "item")


_WORDS = """regexp_extract_all({}, '[A-Za-z0-9$%.,/:;''"-]+')"""


@query("quote_fuzzy", f"""with q as (select doc_id, upper(substr(text, greatest(1, length(text) // 2 - 100), 200)) as quote, text, length(text) as size, greatest(1, cast(floor((length(text) - 600) / 200.0) as bigint) + 1) as n from documents where length(text) > 0),
 qt as (select distinct doc_id, n, size, lower(t) as token from (select doc_id, n, size, unnest({_WORDS.format("quote")}) as t from q) where length(t) > 1),
 w as (select doc_id, i * 200 as pos, substr(text, i * 200 + 1, 600) as part from (select doc_id, text, unnest(range(n)) as i from q)), wt as (select distinct doc_id, pos, lower(t) as token from (select doc_id, pos, unnest({_WORDS.format("part")}) as t from w) where length(t) > 1),
 df as (select doc_id, token, count(*) as df from wt group by 1, 2), idf as (select qt.*, ln((n + 1) / (coalesce(df, 0) + 1)) + 1 as idf from qt left join df using (doc_id, token)), whole as (select doc_id, sum(idf) as whole from idf group by 1),
 s as (select doc_id, pos, size, round(sum(idf) / (any_value(whole) + 1e-9), 9) as score from idf join wt using (doc_id, token) join whole using (doc_id) group by 1, 2, 3), b as (select *, row_number() over (partition by doc_id order by score desc, pos) as k from s)
 select doc_id, greatest(0, pos - 1200) as start_char, least(size, pos + 1800) as end_char from b where k = 1 and score >= 0.25""")
def quote_fuzzy(spark, sf_dir):
    """Quotes are the upper-cased middles of documents, so that neither an exact nor a spaced match finds them."""
    d = table(spark, sf_dir, "documents")
    start = F.greatest(F.lit(1), F.floor(F.length("text") / 2).cast("int") - 100)
    quotes = d.select(c("doc_id").alias("quote_id"), c("doc_id").alias("text_id"), upper_each(F.substring(c("text"), start, F.lit(200))).alias("quote"))
    return M.fuzzy_spans(quotes, d.select(c("doc_id").alias("text_id"), "text")).withColumnRenamed("quote_id", "doc_id")


def consolidated(items, least=15):
    """item_id, leader, board_id: near-equal items of one board and part go into the longest.

    A board of ``least`` items or more stays as it was if over 30 % of its items would vanish."""
    order = items.select("item_id", "grp", "board_id", F.array_distinct(F.filter(F.split(F.lower("summary"), r"[^\w]+"), lambda w: F.length(w) > 3)).alias("items"), F.struct(-F.length("summary"), c("item_id")).alias("place"))
    led = D.absorbed(order.select(c("place").alias("id"), "grp", "items"), 85)
    absorbed = led.select(c("id.item_id").alias("item_id"), c("leader.item_id").alias("leader"))
    joined = items.select("item_id", "board_id").join(absorbed, "item_id", "left")
    guard = joined.groupBy("board_id").agg((F.count(F.lit(1)) < least).alias("few"), (F.count("leader") * 10 <= F.count(F.lit(1)) * 3).alias("mild"))
    return joined.join(guard, "board_id").select("item_id", "board_id", F.when(c("few") | c("mild"), F.coalesce("leader", "item_id")).otherwise(c("item_id")).alias("leader"))


@query("consolidate")
def consolidate(spark, sf_dir):
    """Documents of one source and language as items; see the test for the plain form."""
    return consolidated(table(spark, sf_dir, "documents").select(c("doc_id").alias("item_id"), c("source").alias("board_id"), F.concat_ws("/", "source", "lang").alias("grp"), c("text").alias("summary")))


@query("consolidate_items")
def consolidate_items(spark, sf_dir):
    """Documents of one source as a board's items; tests compare the operator with a plain pass in order."""
    d = c("doc_id")
    kinds = F.array(*map(F.lit, ["low", "medium", "odd", "high", "critical"]))
    items = table(spark, sf_dir, "documents").select(
        c("source").alias("board_id"), d.alias("item_id"), c("lang").alias("grp"), F.coalesce("text", F.lit("")).alias("summary"), F.get(kinds, (d % 5).cast("int")).alias("importance"), F.array(F.concat(F.lit("e"), d.cast("string")), F.concat(F.lit("e"), (d % 97).cast("string"))).alias("entry_ids"),
    )
    return D.consolidated_items(items).drop("summary")


@query("section_cap", """with u as (select o_custkey % 50 as b, 's' || o_orderkey % 31 as name, count(*) as n, min(o_orderkey) as first from orders group by all), r as (select *, count(*) over (partition by b) as k, row_number() over (partition by b order by n desc, first, name) as i from u)
 select b as board_id, name, n as rows, case when k > 20 and i >= 20 then 'Additional Items' else name end as section from r""")
def section_cap(spark, sf_dir):
    k = c("o_orderkey")
    return D.capped_sections(table(spark, sf_dir, "orders").select((c("o_custkey") % 50).alias("board_id"), F.concat(F.lit("s"), (k % 31).cast("string")).alias("name"), k.alias("pos")))


def merged_sections(rows, above=20, percent=60):
    """board_id, name, merged: names of a board with over ``above`` sections go to the most used similar name."""
    used = rows.groupBy("board_id", "name").agg(F.count(F.lit(1)).alias("rows"))
    many = used.groupBy("board_id").agg(F.count(F.lit(1)).alias("k")).where(c("k") > above).select("board_id")
    words = F.filter(F.regexp_extract_all(F.lower("name"), F.lit("([a-z]+)"), 1), lambda w: (F.length(w) > 2) & ~w.isin(*E.SECTION_STOP_WORDS))
    sets = used.join(many, "board_id", "left_semi").select(F.struct(-c("rows"), c("name"), c("board_id")).alias("id"), c("board_id").alias("grp"), F.array_distinct(F.transform(words, E.stemmed)).alias("items"))
    pairs = D.similar_pairs(sets.where(F.size("items") > 0), percent).select(F.least("a", "b").alias("before"), F.greatest("a", "b").alias("after"))
    # the first similar name in order takes a name in, and goes where that one went
    root = D.roots(pairs.groupBy(c("after").alias("id")).agg(F.min("before").alias("parent")))
    into = root.select(c("id.board_id").alias("board_id"), c("id.name").alias("name"), c("root.name").alias("merged"))
    return used.join(into, ["board_id", "name"], "left").select("board_id", "name", F.coalesce("merged", "name").alias("merged"))


@query("section_merge")
def section_merge(spark, sf_dir):
    """Part names with their type are the section names, sizes the boards."""
    return merged_sections(table(spark, sf_dir, "part").select((c("p_size") % 3).alias("board_id"), F.concat_ws(" ", "p_name", "p_type").alias("name")))


@query("mentions", r"""with t as (select c_custkey as id, c_name || ' trades with ' || n_name || '.' as text from customer join nation on c_nationkey = n_nationkey)
 select id, n_name as name from t join nation on length(n_name) >= 4 and regexp_matches(lower(text), '\b' || lower(n_name) || '\b')""")
def mentions(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    home = nation.select(c("n_nationkey").alias("c_nationkey"), "n_name")
    texts = table(spark, sf_dir, "customer").join(home, "c_nationkey").select(c("c_custkey").alias("id"), F.concat("c_name", F.lit(" trades with "), "n_name", F.lit(".")).alias("text"))
    return E.mentions(texts, nation.select(c("n_name").alias("name")))


@query("must_items", f"with {_RICH} select board_id, seq, case when type = 'calculation' then 'figures' when type = 'gap' then 'limits' else 'findings' end as section, list_sort(list_distinct(regexp_extract_all(content, '[0-9]+'))) as terms from rich where type = 'calculation' or seq % 4 = 1")
def must_items(spark, sf_dir):
    """What the output has to hold: calculations and sensed gaps, with the numbers to look for."""
    due = _rich(spark, sf_dir).where((c("type") == "calculation") | F.coalesce(F.array_contains("tags", "debt_sensor"), F.lit(False)))
    section = F.when(c("type") == "calculation", "figures").when(c("type") == "gap", "limits").otherwise("findings")
    return due.select("board_id", "seq", section.alias("section"), F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit("([0-9]+)"), 1))).alias("terms"))


@query("plan_signals", "with l as (select conv_id, turn, unnest(string_split(text, '. ')[1:6]) as item, generate_subscripts(string_split(text, '. ')[1:6], 1) - 1 as k from conversations where turn = 0 or role = 'system'), n as (select *, row_number() over (partition by conv_id, lower(trim(item)) order by turn, k) as first from l where trim(item) <> '') select conv_id, turn, cast(k as int) as k, case when k = 0 then 'critical' when k < 3 then 'high' else 'medium' end as priority from n where first = 1")
def plan_signals(spark, sf_dir):
    """Questions of a plan as signals of round 0; of equal ones in a board the first stays."""
    plan = table(spark, sf_dir, "conversations").where("turn = 0 or role = 'system'").select("conv_id", "turn", F.posexplode(F.slice(F.split("text", r"\. "), 1, 6)).alias("k", "item")).where("trim(item) <> ''")
    one = D.first_wins(plan.withColumn("key", F.lower(F.trim("item"))), ["conv_id", "key"], [c("turn"), c("k")])
    return one.select("conv_id", "turn", "k", F.when(c("k") == 0, "critical").when(c("k") < 3, "high").otherwise("medium").alias("priority"))


@query("resolution_rows", """with a as (select l_orderkey as target_id, l_partkey as atom_id, l_returnflag as kind, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_returnflag) as n from lineitem where l_returnflag in ('A', 'N') and l_partkey in (select p_partkey from part where p_size > 10))
 select target_id, atom_id, kind from a where n = 1 union all select o_orderkey, null, 'gap' from orders where o_orderkey not in (select target_id from a)""")
def resolution_rows(spark, sf_dir):
    atoms = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("target_id"), c("l_partkey").alias("atom_id"), c("l_returnflag").alias("kind"), c("l_linenumber").alias("seq"))
    scope = table(spark, sf_dir, "part").where("p_size > 10").select(c("p_partkey").alias("atom_id"))
    return E.resolution_atoms(atoms, scope, table(spark, sf_dir, "orders").select(c("o_orderkey").alias("target_id")), ["A", "N"])
