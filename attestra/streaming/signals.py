"""Life cycle of signals as keyed state with timers, and its batch twin.

Entries come as a stream (board_id, entry_id, type, ts, seq, opens, addresses, supersedes). What they do to signals is
made into rows per signal, so that the state is held by board and signal and a large board is many signals:

* an entry opens a signal for each of its first ``OPENS`` texts in ``opens`` (struct of type, priority, content) that isn't blank;
* it addresses signals by id; one of type ``artifact_requirement`` only if the entry is of a type in ``ANSWERS``;
* it supersedes entries: signals that those had addressed, and that nothing else did since, are open again from then on. Which
  signals that may be is a stream-stream join of the two arrays by board and entry.

A signal of priority medium or low that is open for ``expiry`` seconds expires. The state holds a signal's rows until the
watermark has passed them, so rows are applied in the order of event time (ts, seq, open before address before supersede)
in whatever order they arrive; a timer is set for the earliest of them and for the next expiry of an open signal. Signals are dealt
to a fixed number of parts that have one state each, as a call to the state takes longer than a signal's rows. So the stream gives
the changes of the batch twin, after restarts from its checkpoint as well.

Defined results: rows about a signal before it is opened, and a second opening, do nothing. Rows without board, entry or time
are left out. Rows that come later than the watermark allows are dropped by the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut
from .ordered import ManyInOrder, in_order

c = F.col

# Questions of an entry that count, entry types that answer artifact requirements, priorities that expire.
OPENS = 5
ANSWERS = ["analysis", "calculation", "strategy"]
EXPIRES = ["medium", "low"]
#: Three rounds of a day.
EXPIRY = 3 * 86_400
OPEN, ADDRESS, REOPEN, EXPIRE = 0, 1, 2, 3
KEY = ["board_id", "signal_id"]
CHANGES = "board_id string, signal_id string, at timestamp, seq long, step int, status string, addressed_by string"


def signal_rows(entries: DataFrame, late: str = "1 day") -> DataFrame:
    """board_id, signal_id, ts, seq, step (open, address, reopen), entry_id, may_answer, type, priority. Batch or stream."""
    given = entries.where("board_id is not null and entry_id is not null and ts is not null").withColumn("board_id", c("board_id").cast("string")).withColumn("entry_id", c("entry_id").cast("string"))
    given = given.withWatermark("ts", late) if entries.isStreaming else given
    may = c("type").isin(ANSWERS).alias("may_answer")
    nothing = F.lit(None).cast("string")
    opened = given.select("board_id", "entry_id", "ts", "seq", F.posexplode(F.slice("opens", 1, OPENS)).alias("k", "o")).where(F.trim("o.content") != "")
    opened = opened.select("board_id", F.concat("entry_id", F.lit("/"), c("k").cast("string")).alias("signal_id"), "ts", "seq", F.lit(OPEN).alias("step"), "entry_id", F.lit(False).alias("may_answer"), c("o.type").alias("type"), c("o.priority").alias("priority"))
    addressed = given.select("board_id", F.explode(F.array_distinct("addresses")).alias("signal_id"), "ts", "seq", F.lit(ADDRESS).alias("step"), "entry_id", may, nothing.alias("type"), nothing.alias("priority"))
    superseding = given.select("board_id", F.explode(F.array_distinct("supersedes")).alias("entry_id"), "ts", "seq")
    earlier = given.select(c("board_id").alias("b"), c("entry_id").alias("e"), c("ts").alias("was"), c("seq").alias("was_seq"), F.array_distinct("addresses").alias("was_addressed")).where(F.size("was_addressed") > 0)
    on = (c("board_id") == c("b")) & (c("entry_id") == c("e")) & (F.struct("was", "was_seq") <= F.struct("ts", "seq"))
    reopened = superseding.join(earlier, on).select("board_id", F.explode("was_addressed").alias("signal_id"), "ts", "seq", F.lit(REOPEN).alias("step"), "entry_id", F.lit(False).alias("may_answer"), nothing.alias("type"), nothing.alias("priority"))
    return opened.unionByName(addressed).unionByName(reopened)


class LifeCycle(ManyInOrder):
    """One signal: status, by whom addressed, since when open, type, priority."""

    ROW = "seq long, step int, entry_id string, may_answer boolean, type string, priority string"
    STATE = "status string, addressed_by string, since long, type string, priority string"

    def __init__(self, expiry: int = EXPIRY):
        self.expiry = expiry * 1_000_000

    def wake(self, state: dict | None) -> int | None:
        return state["since"] + self.expiry if state and state["status"] == "open" and state["priority"] in EXPIRES else None

    def idle(self, state: dict | None, now: int) -> tuple[dict | None, list[dict]]:
        at = self.wake(state)
        if at is None or now < at:
            return state, []
        return {**state, "status": "expired"}, [{"at": at, "seq": None, "step": EXPIRE, "status": "expired", "addressed_by": None}]

    def apply(self, state: dict | None, row: dict) -> tuple[dict | None, list[dict]]:
        state, out = self.idle(state, row["at"])
        status, step = state and state["status"], row["step"]
        if step == OPEN and state is None:
            state = {"status": "open", "addressed_by": None, "since": row["at"], "type": row["type"], "priority": row["priority"]}
        elif step == ADDRESS and status == "open" and (state["type"] != "artifact_requirement" or row["may_answer"]):
            state = {**state, "status": "addressed", "addressed_by": row["entry_id"]}
        elif step == REOPEN and status == "addressed" and state["addressed_by"] == row["entry_id"]:
            state = {**state, "status": "open", "addressed_by": None, "since": row["at"]}
        else:
            return state, out
        return state, [*out, {"at": row["at"], "seq": row["seq"], "step": step, "status": state["status"], "addressed_by": state["addressed_by"]}]


def signal_stream(entries: DataFrame, expiry: int = EXPIRY, late: str = "1 day") -> DataFrame:
    """The changes of all signals, as the watermark passes them; append mode."""
    return in_order(signal_rows(entries, late), KEY, LifeCycle(expiry), CHANGES)


def signal_changes(entries: DataFrame, expiry: int = EXPIRY) -> DataFrame:
    """The batch twin: the same changes, for all that is known up to the last entry's time.

    A round finds, for all open signals at once, the first row that addresses each, and then the first that reopens it:
    two minima after map-side combining, so that a signal with very many rows is nobody's single task. There are as
    many rounds as the most often reopened signal has."""
    rows = cut(signal_rows(entries))
    end = entries.where("board_id is not null and entry_id is not null").agg(F.max("ts")).first()[0]
    order = F.struct("ts", "seq", "step")
    change = [c("now.ts").alias("at"), c("now.seq").alias("seq"), c("now.step").alias("step")]
    nobody = F.lit(None).cast("string").alias("addressed_by")
    current = rows.where(c("step") == OPEN).groupBy(*KEY).agg(F.min(F.struct("ts", "seq", "step", "type", "priority")).alias("now"))
    current = cut(current.select(*KEY, F.struct("now.ts", "now.seq", "now.step").alias("now"), c("now.type").alias("type"), c("now.priority").alias("priority")))
    answers = rows.where(c("step") == ADDRESS).select(*KEY, order.alias("then"), "entry_id", "may_answer")
    again = rows.where(c("step") == REOPEN).select(*KEY, order.alias("then"), c("entry_id").alias("addressed_by"))
    out = None
    while not current.isEmpty():
        opened = current.select(*KEY, *change, F.lit("open").alias("status"), nobody)
        fit = (c("then") > c("now")) & ((c("type") != "artifact_requirement") | c("type").isNull() | c("may_answer"))
        first = answers.join(current, KEY).where(fit).groupBy(*KEY).agg(F.min(F.struct("then", "entry_id")).alias("hit"))
        ends = F.when(c("priority").isin(EXPIRES), c("now.ts") + F.make_dt_interval(secs=F.lit(expiry)))
        state = cut(current.join(first, KEY, "left").withColumn("ends", ends).withColumn("in_time", c("hit").isNotNull() & (c("ends").isNull() | (c("hit.then.ts") < c("ends")))))
        addressed = state.where("in_time").select(*KEY, "type", "priority", c("hit.then").alias("now"), c("hit.entry_id").alias("addressed_by"))
        gone = state.where(~c("in_time") & (c("ends") <= F.lit(end))).select(*KEY, c("ends").alias("at"), F.lit(None).cast("long").alias("seq"), F.lit(EXPIRE).alias("step"), F.lit("expired").alias("status"), nobody)
        new = opened.unionByName(addressed.select(*KEY, *change, F.lit("addressed").alias("status"), "addressed_by")).unionByName(gone)
        out = cut(new if out is None else out.unionByName(new))
        back = again.join(addressed, [*KEY, "addressed_by"]).where(c("then") > c("now")).groupBy(*KEY, "type", "priority").agg(F.min("then").alias("now"))
        current = cut(back)
    return out if out is not None else entries.sparkSession.createDataFrame([], CHANGES)


def signal_states(changes: DataFrame) -> DataFrame:
    """board_id, signal_id, status, addressed_by, changes: where the changes have led."""
    last = F.max_by(F.struct("status", "addressed_by"), F.struct("at", F.coalesce("seq", F.lit(2**62)), "step"))
    return changes.groupBy(*KEY).agg(last.alias("last"), F.count(F.lit(1)).alias("changes")).select(*KEY, "last.status", "last.addressed_by", "changes")
