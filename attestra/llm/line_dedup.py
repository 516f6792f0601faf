"""Line dedup by distinct-site spread.

Each line (trimmed of blanks, empty ones aside) is hashed to 128 bits in the task that
reads it, with the sites (``source``) that hold it in a HyperLogLog sketch. Sketches
merge by aggregation: a line that a third of all rows share is one small sketch per map
task. Lines whose estimate lies clearly on one side of ``SITES`` are decided by it; those
near the threshold get exact distinct counts over (line, site) pairs. Sketches of so few
sites are exact or nearly so; the band ``NEAR`` covers their error many times. Lines on
``SITES`` or more sites are boilerplate: all their occurrences go.

Returned per row: n_lines (non-empty), n_removed (of these), n_chars_kept (code points of
what stays, lines joined by newlines), text_sha256 (of that text, UTF-8).

Defined results: null texts count as empty: 0 lines, the digest of no bytes. A null
source is no site: its lines don't spread, but boilerplate goes from it as well. Repeated
rows get a row each. Further columns are ignored by the report and kept by ``cleaned``,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, session, stored, table, whole_row

#: A line on so many sites goes. Estimates within this share of it are counted exactly.
SITES, NEAR = 8, 0.5
#: Logarithm of a sketch's registers: a relative error of about 1.04 / sqrt(2 ** 8).
REGISTERS = 8
BLANKS = " \t\r\x0b\x0c"
#: Boilerplate lines are broadcast up to this measured number, else joined by shuffle with so many salts per line.
BROADCAST_LINES, SALTS = 100_000, 32


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line, F.lit(BLANKS))))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def full(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS)) != ""


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """The keys of lines that ``sites`` or more distinct sites hold."""
    lines = docs.select(lines_of(F.col("text")).alias("lines"), F.col("source").cast("string").alias("site")).where("site is not null").select("site", F.explode(F.array_distinct(F.filter("lines", full))).alias("line"))
    keyed = lines.select(line_key(F.col("line")).alias("line"), "site")
    with scratch(docs.sparkSession) as keep:
        spread = stored(keyed.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - NEAR)), "spread")
        sure = spread.where(F.col("estimate") > sites * (1 + NEAR)).select("line")
        near = spread.where(F.col("estimate") <= sites * (1 + NEAR)).select("line")
        few = near.count() <= BROADCAST_LINES
        # lines that go through a shuffle go once for each site, however often they are there
        exact = (keyed.join(F.broadcast(near), "line") if few else keyed.distinct().join(near, "line")).groupBy("line", "site").agg(F.lit(1).alias("one")).groupBy("line").agg(F.count("one").alias("n")).where(F.col("n") >= sites).select("line")
        return keep(stored(sure.unionByName(exact), "common-lines"))


def marked(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """row (all columns of ``docs``), kept (the text that stays), n_lines, n_removed."""
    common = boilerplate(docs, sites).select(F.col("line").alias("key"))
    # rows with the same doc_id and text are alike, so their digest names what to remove
    name = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.coalesce("text", F.lit("")))))
    rows = docs.select(whole_row(docs).alias("row"), name.alias("name"), F.col("text"))
    at = rows.select("name", F.posexplode(lines_of(F.col("text"))).alias("i", "line")).where(full(F.col("line"))).select("name", "i", line_key(F.col("line")).alias("key"))
    if common.count() <= BROADCAST_LINES:
        hits = at.join(F.broadcast(common), "key")
    else:  # these lines are hot by their nature
        hits = at.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS))).join(common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long")), ["key", "salt"])
    gone = hits.groupBy("name").agg(F.collect_set("i").alias("gone"))
    joined = rows.join(gone, "name", "left").withColumn("lines", lines_of(F.col("text"))).withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    # the numbers of the lines that stay come from a hash set, so a text of many lines is still one pass
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("lines"), i)))
    return joined.select("row", F.array_join(kept, "\n").alias("kept"), F.size(F.filter("lines", full)).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"))


def cleaned(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """``docs`` without boilerplate lines; all other columns as they were."""
    text = F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text")
    return marked(docs, sites).select(*[text if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars_kept, text_sha256 of every row."""
    return marked(docs, sites).select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.length("kept").cast("long").alias("n_chars_kept"), F.sha2("kept", 256).alias("text_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(session(spark), sf_dir, "documents"))


SQL = r"""
with l as (
  select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents
), t as (select *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as k from l),
b as (select k from t where k <> '' group by k having count(distinct source) >= 8),
f as (select t.*, b.k is not null as gone from t left join b using (k)),
g as (
  select doc_id, count(*) filter (k <> '') as n_lines, count(*) filter (gone) as n_removed,
         coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as kept
  from f group by doc_id
)
select doc_id, n_lines, n_removed, length(kept) as n_chars_kept, sha256(kept) as text_sha256 from g
"""
