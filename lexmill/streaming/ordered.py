"""Folds in event-time order over streams: the dialogue tracker and the day-long cache.

Rows of a key may come in any order and in any batch.  They are held until the
watermark has passed them, then folded in the order of their time, so the result
is that of the batch query.  Rows later than the watermark are left out by the
engine before the fold.  A key idle for longer than its time is forgotten: what
it knew is gone for its next row, and its state is removed by a timer.

The state store must be one that keeps column families; ``with_ordered_state``
sets it for a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from lexmill.streaming import state
from lexmill.streaming.state import _next, _out  # by name: a fold travels with what it names, and not with whole modules and what they hold

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_ordered_state(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers and several states of a key need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


class OrderedFold(StatefulProcessor):
    """Fold of each key's rows by their time.

    ``step(known, row)`` gives what is known after a row, a tuple of ``known``'s
    fields or None, and an output tuple.  ``time`` names the rows' milliseconds and
    ``order`` the columns that tell rows of one time apart.
    """

    def __init__(self, step: Callable, rows: StructType, known: StructType, out: list[str], time: str, order: list[str], idle_ms: int) -> None:
        self.step, self.rows, self.out = step, rows, out
        self.known = StructType([*known.fields, StructField("last_ms", LongType())])
        self.at = rows.fieldNames().index(time)
        self.order = [rows.fieldNames().index(c) for c in (time, *order)]
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.memory = handle.getValueState("memory", self.known)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        times = set()
        for pdf in rows:
            plain = pdf[self.rows.fieldNames()].astype(object).where(pdf.notna(), None)
            new = [tuple(r) for r in plain.itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                times |= {int(r[self.at]) for r in new}
        for t in times:
            self.handle.registerTimer(t)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if r[self.at] <= now), key=lambda r: [(r[i] is not None, r[i]) for i in self.order])
        known = tuple(self.memory.get()) if self.memory.exists() else None
        out = []
        for row in due:
            if known is not None and row[self.at] - known[-1] > self.idle_ms:
                known = None
            after, given = self.step(known and known[:-1], dict(zip(self.rows.fieldNames(), row)))
            known = (*after, int(row[self.at]))
            out.append(given)
        if due:
            left = [r for r in held if r[self.at] > now]
            self.waiting.put(left) if left else self.waiting.clear()
            self.memory.update(known)
            self.handle.registerTimer(known[-1] + self.idle_ms)
        elif known is not None and known[-1] + self.idle_ms <= now:
            self.memory.clear()
        yield pd.DataFrame(out, columns=self.out) if out else pd.DataFrame()

    def close(self) -> None:
        pass


def _fold(rows: DataFrame, key: str, step: Callable, known: str, out: str, time: str, order: list[str], idle_ms: int) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string as parsed

    columns = [c.split()[0] for c in out.split(", ")]
    held = StructType([f for f in rows.schema.fields if f.name != "at__"])
    fold = OrderedFold(step, held, parsed(known), columns, time, order, idle_ms)
    return rows.groupBy(key).transformWithStateInPandas(fold, out, "append", "eventTime")


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def _tracked(known: tuple | None, row: dict) -> tuple[tuple, tuple]:
    names = ("entity", "tax", "income", "scenario", "count")
    after, intent = _next(dict(zip(names, known)) if known else {}, _Row(row))
    return tuple(after[n] for n in names), _out(row["conv_id"], row["turn"], after, intent)


class _Row:
    def __init__(self, fields: dict) -> None:
        self.__dict__.update(fields)


def dialogue_in_order(turns: DataFrame, ts: str = "ts", late: str = "10 minutes", idle_ms: int = 3_600_000, **tables: dict[str, list[str]]) -> DataFrame:
    """The tracker's state after every user turn of a stream (conv_id, turn, role, text, ts), as ``dialogue_sessions`` gives it.

    Turns are folded by time, then turn; those without a time are left out.  A turn
    that comes later than ``late`` behind the newest one may be left out.
    """
    timed = turns.where(F.col(ts).isNotNull()).withColumn("at__", F.col(ts)).withWatermark("at__", late)
    rows = state.turn_signals(timed, keep=["at__"], **tables).withColumn("ms", _millis(F.col("at__")))
    return _fold(rows, "conv_id", _tracked, "entity string, tax string, income string, scenario string, count int", state.STATE_SCHEMA, "ms", ["turn"], idle_ms)


def sessions_by_idle(turns: DataFrame, ts: str = "ts", idle_ms: int = 3_600_000, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows with ``session__``: how often their key was idle for longer than ``idle_ms`` before."""
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = _millis(F.col(ts)) - _millis(F.lag(ts).over(w))
    fresh = F.coalesce(gap > idle_ms, F.lit(False)).cast("int")
    return turns.withColumn("fresh__", fresh).withColumn("session__", F.sum("fresh__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh__")


def dialogue_sessions(turns: DataFrame, ts: str = "ts", idle_ms: int = 3_600_000, **tables: dict[str, list[str]]) -> DataFrame:
    """``dialogue_states`` of conversations whose turns (conv_id, turn, role, text, ts) come by time and which are forgotten when idle."""
    said = turns.where((F.col("role") == "user") & F.col(ts).isNotNull())
    return state.dialogue_states(sessions_by_idle(said, ts, idle_ms), order=[ts, "turn"], within=["session__"], **tables)


def _cached(known: tuple | None, row: dict) -> tuple[tuple, tuple]:
    """A question is a hit while the entry of its key is within its time; else its answer becomes the entry."""
    made, answer, ttl_ms = known or (None, None, 0)
    hit = made is not None and row["ms"] - made <= row["ttl_ms"]
    if not hit:
        made, answer = row["ms"], row["answer"]
    return (made, answer, row["ttl_ms"]), (row["entry_id"], row["ask_id"], hit, answer)


def cache_in_order(asks: DataFrame, ts: str = "ts", late: str = "10 minutes", ttl_ms: int = 1000 * state.TTL_SECONDS) -> DataFrame:
    """Which questions (entry_id, ask_id, answer, ts) of a stream the day-long cache answers: (entry_id, ask_id, hit, answer).

    A question without an entry within its time makes one of its own answer; the
    entry is as old as the question that made it.  Entries nobody has asked for
    since their time ran out are removed.
    """
    timed = asks.where(F.col(ts).isNotNull()).withColumn("at__", F.col(ts)).withWatermark("at__", late)
    rows = timed.select("entry_id", "ask_id", "answer", _millis(F.col("at__")).alias("ms"), F.lit(ttl_ms).cast("long").alias("ttl_ms"), "at__")
    out = f"entry_id {rows.schema['entry_id'].dataType.simpleString()}, ask_id {rows.schema['ask_id'].dataType.simpleString()}, hit boolean, answer string"
    return _fold(rows, "entry_id", _cached, "made_ms long, answer string, ttl_ms long", out, "ms", ["ask_id"], ttl_ms)
