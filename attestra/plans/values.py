"""Queries of the scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import matching as M
from .registry import query
from .views import ORDER_TEXT, order_text, table


@query("values_extract", f"""with {ORDER_TEXT}, v as (
 select o_orderkey, 'dollar' as type, unnest(regexp_extract_all(text, '\\$[0-9]+')) as raw from order_text
 union all select o_orderkey, 'percent', unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?\\s*%')) from order_text
 union all select o_orderkey, 'date', unnest(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) from order_text
 union all select o_orderkey, 'section_ref', unnest(regexp_extract_all(text, 'Section [0-9.]+')) from order_text
 union all select o_orderkey, 'number_unit', unnest(regexp_extract_all(text, '[0-9]+ days')) from order_text)
 select o_orderkey, type, raw, case when type = 'dollar' then cast(substr(raw, 2) as bigint) end as canonical from v""")  # fmt: skip
def values_extract(spark, sf_dir):
    return order_text(table(spark, sf_dir, "orders")).select("o_orderkey", F.inline(S.checkable_values(F.col("text"))))


@query("dollar_norm", """select o_orderkey, case o_orderkey % 4 when 0 then cast(floor(o_totalprice) as bigint) when 1 then (o_orderkey % 900) * 1000 when 2 then (o_orderkey % 90) * 1000000 + 500000 else null end as dollars from orders""")
def dollar_norm(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))).when(k % 4 == 1, F.concat(F.lit("$"), k % 900, F.lit("K"))).when(k % 4 == 2, F.concat(F.lit("$"), k % 90, F.lit(".5m"))).otherwise(F.lit("about ten"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.dollars(raw).alias("dollars"))


@query("num_parse", """select o_orderkey, case o_orderkey % 3 when 0 then cast(floor(o_totalprice) as double) when 1 then (o_orderkey % 100) / 100.0::double else cast(o_orderkey % 1000 as double) end as number from orders""")
def num_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).when(k % 3 == 1, F.concat(k % 100, F.lit(" %"))).otherwise(F.concat(F.lit("about "), k % 1000, F.lit(" items")))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.number(raw, parity=True).alias("number"))


@query("num_parse_exact", """select o_orderkey, case o_orderkey % 4 when 0 then round(o_totalprice, 2) when 1 then (o_orderkey % 100) / 100.0::double when 2 then (o_orderkey % 90) * 1000 + 250 else (o_orderkey % 1000) + 0.75 end as number from orders""")
def num_parse_exact(spark, sf_dir):
    """Amounts with cents, percentages, amounts with a suffix, plain decimals: nothing is cut."""
    k = F.col("o_orderkey")
    s = lambda x: x.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).when(k % 4 == 1, F.concat(s(k % 100), F.lit(" %"))).when(k % 4 == 2, F.concat(F.lit("$"), s(k % 90), F.lit(".25k"))).otherwise(F.concat(s(k % 1000), F.lit(".75")))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.number(raw).alias("number"))


@query("values_parity", r"""select o_orderkey, case when o_orderkey % 3 = 0 then (o_orderkey % 50) * 1000000000 when o_orderkey % 3 = 1 then o_orderkey % 50 else (o_orderkey % 50) * 1000 end as loose, case when o_orderkey % 3 = 2 then (o_orderkey % 50) * 1000 else o_orderkey % 50 end as strict from orders""")
def values_parity(spark, sf_dir):
    """The first amount of a text in both modes: ``$5 by June`` differs, ``$5 and`` and ``$5k`` don't."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("pay $"), (k % 50).cast("string"), F.when(k % 3 == 0, " by June").when(k % 3 == 1, " and more").otherwise("k a day"))
    first = lambda parity: F.filter(S.checkable_values(text, parity), lambda v: v["type"] == "dollar")[0]["canonical"]
    return table(spark, sf_dir, "orders").select("o_orderkey", first(True).alias("loose"), first(False).alias("strict"))


@query("digits_conserved", """with c as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, 'part ' || l_partkey || ' line ' || l_linenumber as content, 'line ' || l_linenumber || ' part ' || (l_partkey + case when l_suppkey % 5 = 0 then 1 else 0 end) as evidence, 'order ' || l_orderkey || ' part ' || l_partkey || ' line ' || l_linenumber as slice from lineitem)
 select l_orderkey, count(*) as claims, count(*) filter (len(list_filter(regexp_extract_all(content, '[0-9]+'), lambda x: not list_contains(regexp_extract_all(evidence, '[0-9]+'), x))) = 0 and len(list_filter(regexp_extract_all(evidence, '[0-9]+'), lambda x: not list_contains(regexp_extract_all(slice, '[0-9]+'), x))) = 0) as conserved from c group by l_orderkey""")
def digits_conserved(spark, sf_dir):
    c = lambda *a: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in a])
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    off = F.when(F.col("l_suppkey") % 5 == 0, 1).otherwise(0)
    ok = M.digits_conserved(c("part ", part, " line ", line), c("line ", line, " part ", part + off), c("order ", F.col("l_orderkey"), " part ", part, " line ", line))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("claims"), F.count_if(ok).alias("conserved"))


@query("markers", "select item_id, list_filter(list_distinct_ordered, lambda w: w not in ('the', 'and', 'for', 'with', 'from', 'that', 'this'))[1:12] as markers from (select item_id, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda p: list_position(w, p[1]) = p[2]), lambda p: p[1]) as list_distinct_ordered from (select item_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{3,}') as w from benchmark))")
def markers(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.word_markers(F.col("text"), ["the", "and", "for", "with", "from", "that", "this"]).alias("markers"))


@query("keys", "select page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) as section_key, string_split(regexp_replace(url, '^https?://', ''), '/')[1] as family, regexp_replace(url || '/scenario-' || (page_id % 3), '/scenario-[0-9]+$', '') as task_key from pages")
def keys(spark, sf_dir):
    task = F.concat(F.col("url"), F.lit("/scenario-"), (F.col("page_id") % 3).cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", S.section_key(F.col("url")).alias("section_key"), S.family(F.regexp_replace("url", "^https?://", "")).alias("family"), S.task_key(task).alias("task_key"))


@query("fingerprint", "select user_id, substr(sha256(string_agg(event_id || ':' || event_type, '|' order by event_id)), 1, 16) as fingerprint, count(*) as atoms from events group by user_id")
def fingerprint(spark, sf_dir):
    atoms = F.sort_array(F.collect_list(F.struct("event_id", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("a"))))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.substring(F.sha2(F.array_join(atoms["a"], "|"), 256), 1, 16).alias("fingerprint"), F.count(F.lit(1)).alias("atoms"))


@query("safe_names", r"select page_id, substr(regexp_replace(url, '[\[\]:*?/\\]', '_', 'g'), 1, 31) as sheet, substr(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), 1, 50) as label from pages")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.sheet_name(F.col("url")).alias("sheet"), S.snapshot_label(F.col("url")).alias("label"))


@query("size_bound", "select doc_id, strlen(text) + 200 as request_bytes, strlen(text) + 16584 as worst_bytes from documents")
def size_bound(spark, sf_dir):
    request, worst = S.size_bound(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", request.alias("request_bytes"), worst.alias("worst_bytes"))


@query("tag_value", "select o_orderkey, lower(string_split(o_orderpriority, '-')[2]) as materiality, case substr(o_orderpriority, 1, 1) when '1' then 0 when '2' then 1 when '3' then 2 else 3 end as rank from orders")
def tag_value(spark, sf_dir):
    tags = F.array(F.lit("status:open"), F.concat(F.lit("materiality:"), F.lower(F.element_at(F.split("o_orderpriority", "-"), 2))))
    value = F.substring_index(F.get(F.filter(tags, lambda t: t.startswith("materiality:")), F.lit(0)), ":", -1)
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).when(F.col("o_orderpriority").startswith("3"), 2).otherwise(3)
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("materiality"), rank.alias("rank"))


@query("calc_verify", "select l_orderkey, count(*) as checks, count(*) filter (l_partkey % 9 <> 0) as agreed from lineitem group by l_orderkey")
def calc_verify(spark, sf_dir):
    """Claimed totals against price x (1 - discount): a tolerance of a cent or half a percent."""
    actual = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    claimed = F.when(F.col("l_partkey") % 9 == 0, actual * 1.02 + 1).otherwise(F.round(actual, 2))
    ok = F.abs(claimed - actual) <= F.greatest(F.lit(0.01), 0.005 * F.abs(actual))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("checks"), F.count_if(ok).alias("agreed"))


@query("json_rescue", """select event_id, cast(json_extract(props, '$.k') as bigint) as k from events""")
def json_rescue(spark, sf_dir):
    wrapped = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    body = F.regexp_extract(wrapped, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(body, "$.k").cast("long").alias("k"))


@query("norm_tokens", r"select item_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) >= 3 or regexp_matches(t, '[0-9]'))) as tokens from benchmark where regexp_matches(text, '^[\x00-\x7f]*$')")
def norm_tokens(spark, sf_dir):
    tokens = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), lambda t: (F.length(t) >= 3) | t.rlike("[0-9]"))
    return table(spark, sf_dir, "benchmark").where(F.col("text").rlike(r"\A[\x00-\x7f]*\z")).select("item_id", F.size(tokens).cast("long").alias("tokens"))
