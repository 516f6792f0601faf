"""Rounds of boards: running budgets with an uplift, quiet streaks and stop rules as keyed state; the binding barrier.

``RunState`` follows one board round by round: what is spent against a budget that bulk work raises in mid-stream
(so that the headroom below the stop threshold stays what it was), the streak of rounds without progress, close-out, and
the first rule that stops the board. Rows after the stop give nothing. ``round_report`` is the batch twin, by windows.

``BindingBarrier`` is a ``foreachBatch`` function: claims that are new in a round are bound before the round is judged, all in
one micro-batch. Each batch writes its own partition of each table, by its id, so a batch that is replayed after a failure
writes the same again; what it reads are partitions of earlier batches only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordered import InOrder, in_order

c = F.col

# The stop threshold in percent, rounds at most, quiet rounds at most, claims of a binding batch.
STOP_PCT, ROUNDS, QUIET, BIND_BATCH = 85.0, 12, 2, 60
#: Rounds after which the history of open items starts anew.
REFRAMES = (3, 7)
REPORT = "at timestamp, seq long, round long, used long, budget long, pct double, quiet long, closeout boolean, stop string"


def stop_rule(done, n, pct, quiet, rounds: int, stop_pct: float, most_quiet: int) -> str | None:
    """The first rule that holds after a round."""
    return "converged" if done else "max_rounds" if n >= rounds else "budget" if pct >= stop_pct else "diminishing_returns" if quiet >= most_quiet else None


def percent(used: int, budget: int) -> float:
    """To one decimal, halves up."""
    return (used * 2000 + max(budget, 1)) // (2 * max(budget, 1)) / 10


class RunState(InOrder):
    """A row is a round: tokens, bulk_tokens, progress (claims, derived or resolved), open_items, converge."""

    ROW = "seq long, tokens long, bulk_tokens long, progress boolean, open_items long, converge boolean"
    STATE = "round long, used long, budget long, quiet long, open_before long, stop string"

    def __init__(self, budget: int, rounds: int = ROUNDS, stop_pct: float = STOP_PCT, most_quiet: int = QUIET, reframes: tuple[int, ...] = REFRAMES):
        self.budget, self.rounds, self.stop_pct, self.most_quiet, self.reframes = budget, rounds, stop_pct, most_quiet, reframes
        self.most = max(rounds, 1)  # the last round stops the board

    def apply(self, state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        s = state or {"round": 0, "used": 0, "budget": self.budget, "quiet": 0, "open_before": None, "stop": None}
        if s["stop"]:
            return s, []
        n, used = s["round"] + 1, s["used"] + (row["tokens"] or 0) + (row["bulk_tokens"] or 0)
        budget = s["budget"] + int((row["bulk_tokens"] or 0) * 100 // self.stop_pct)
        pct = percent(used, budget)
        quiet, open_items = 0 if row["progress"] else s["quiet"] + 1, row["open_items"] or 0
        closeout = n >= self.rounds // 2 and s["open_before"] is not None and open_items >= s["open_before"] > 0
        stop = stop_rule(row["converge"] and open_items == 0, n, pct, quiet, self.rounds, self.stop_pct, self.most_quiet)
        new = {"round": n, "used": used, "budget": budget, "quiet": quiet, "open_before": None if n in self.reframes else open_items, "stop": stop}
        return new, [{"at": row["at"], "seq": row["seq"], "round": n, "used": used, "budget": budget, "pct": pct, "quiet": quiet, "closeout": closeout and n not in self.reframes, "stop": stop}]


def round_stream(rounds: DataFrame, state: RunState, key: str = "board_id", late: str = "1 day") -> DataFrame:
    """A report row per round, as the watermark passes it; append mode. ``key`` is a string column."""
    return in_order(rounds.withWatermark("ts", late), [key], state, f"{key} string, {REPORT}")


def round_report(rounds: DataFrame, state: RunState, key: str = "board_id") -> DataFrame:
    """The batch twin."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    bulk, open_items = F.coalesce("bulk_tokens", F.lit(0)), F.coalesce("open_items", F.lit(0))
    n = F.row_number().over(w).cast("long")
    rows = rounds.withColumn("round", n).withColumn("used", F.sum(F.coalesce("tokens", F.lit(0)) + bulk).over(so_far))
    rows = rows.withColumn("budget", F.lit(state.budget) + F.sum(F.floor(bulk * 100 / F.lit(state.stop_pct)).cast("long")).over(so_far))
    rows = rows.withColumn("pct", F.expr("(used * 2000 + greatest(budget, 1)) div (2 * greatest(budget, 1))") / 10)
    rows = rows.withColumn("quiet", c("round") - F.coalesce(F.max(F.when(c("progress"), c("round"))).over(so_far), F.lit(0)))
    before = F.when(~(c("round") - 1).isin(*state.reframes), F.lag(open_items).over(w))
    rows = rows.withColumn("closeout", F.coalesce((c("round") >= state.rounds // 2) & (open_items >= before) & (before > 0), F.lit(False)) & ~c("round").isin(*state.reframes))
    rows = rows.withColumn("stop", F.when(c("converge") & (open_items == 0), "converged").when(c("round") >= state.rounds, "max_rounds").when(c("pct") >= state.stop_pct, "budget").when(c("quiet") >= state.most_quiet, "diminishing_returns"))
    rows = rows.withColumn("_stopped", F.min(F.when(c("stop").isNotNull(), c("round"))).over(so_far))
    rows = rows.where(c("_stopped").isNull() | (c("round") <= c("_stopped")))
    return rows.select(key, c("ts").alias("at"), "seq", "round", "used", "budget", "pct", "quiet", "closeout", "stop")


class BindingBarrier:
    """Called with the claims (board_id, claim_id, seq, ...) of a round and the round's id.

    ``bind``: offered claims -> replies (board_id, claim_id, target_id); replies that name no offered claim or no open target
    don't count. ``calls``: batches of ``size`` claims that a board may be offered in a round; the rest waits for the next.
    Tables below ``folder``: edges, waiting (claims without an edge), judged (per board offered, bound, unbound, calls, open)."""

    def __init__(self, folder: str, targets: DataFrame, bind: Callable[[DataFrame], DataFrame], calls: int | None = None, size: int = BIND_BATCH):
        self.folder, self.targets, self.bind, self.calls, self.size = folder, targets, bind, calls, size

    def put(self, rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        at = f"{self.folder}/{name}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(at)
        return rows.sparkSession.read.schema(rows.schema).parquet(at)

    def __call__(self, claims: DataFrame, batch_id: int) -> None:
        spark = claims.sparkSession
        unbound = claims.select("board_id", "claim_id", "seq", "content")
        if batch_id > 0:
            unbound = unbound.unionByName(spark.read.schema(unbound.schema).parquet(f"{self.folder}/waiting/batch_id={batch_id - 1}"))
        order = Window.partitionBy("board_id").orderBy("seq", "claim_id")
        unbound = self.put(unbound.withColumn("call", F.floor((F.row_number().over(order) - 1) / self.size)), "unbound", batch_id)
        offered = unbound if self.calls is None else unbound.where(c("call") < self.calls)
        replies = self.bind(offered).select("board_id", "claim_id", "target_id").distinct()
        edges = replies.join(offered.select("board_id", "claim_id").distinct(), ["board_id", "claim_id"], "left_semi").join(self.targets.select("board_id", "target_id").distinct(), ["board_id", "target_id"], "left_semi")
        edges = self.put(edges, "edges", batch_id)
        bound = edges.select("board_id", "claim_id").distinct()
        waiting = self.put(unbound.drop("call").join(bound, ["board_id", "claim_id"], "left_anti"), "waiting", batch_id)
        covered = spark.read.parquet(f"{self.folder}/edges").where(c("batch_id") <= batch_id).select("board_id", "target_id").distinct()
        open_ = self.targets.join(covered, ["board_id", "target_id"], "left_anti").groupBy("board_id").agg(F.count(F.lit(1)).alias("open"))
        counts = offered.groupBy("board_id").agg(F.count(F.lit(1)).alias("offered"), F.countDistinct("call").alias("calls"))
        bound_n = bound.groupBy("board_id").agg(F.count(F.lit(1)).alias("bound"))
        left = waiting.groupBy("board_id").agg(F.count(F.lit(1)).alias("unbound"))
        judged = counts.join(bound_n, "board_id", "left").join(left, "board_id", "left").join(open_, "board_id", "left").fillna(0, ["bound", "unbound", "open"])
        self.put(judged.withColumn("may_stop", (c("open") == 0) & (c("unbound") == 0)), "judged", batch_id)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """All batches of a table, with ``batch_id``."""
        return spark.read.parquet(f"{self.folder}/{name}")
