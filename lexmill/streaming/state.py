"""Stateful operators: dialogue state, cache, rate limits, counters; batch folds and their streaming forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import numbers, rules
from lexmill.operators.classify import first_label, holds_any

STATE_SCHEMA = "conv_id long, turn long, entity_type string, tax_type string, income_info string, scenario string, turn_count int, intent string"


def turn_signals(turns: DataFrame, entities: dict[str, list[str]] = rules.ENTITIES, taxes: dict[str, list[str]] = rules.TAXES, goes_on: list[str] = rules.CONTINUES, keep: list[str] = []) -> DataFrame:
    """What each user turn says: entity, tax, income, scenario, and whether it goes on from before; ``keep`` names columns that stay.

    All pattern work is done here, in columns; the fold only sees short values.
    """
    text = F.coalesce("text", F.lit(""))
    return turns.where("role = 'user'").select(
        "conv_id", "turn", first_label(text, entities).alias("entity"), first_label(text, taxes).alias("tax"), numbers.income_slot(text).alias("income"), numbers.dependents_slot(text).alias("scenario"), holds_any(F.lower(text), goes_on).alias("refs_prev"), *keep,
    )


def _next(state: dict, row) -> tuple[dict, str]:  # noqa: ANN001
    """One step of the tracker: the state after a turn, and the turn's intent.

    A turn that does not go on from before and changes both entity and tax starts
    anew; otherwise what a turn says replaces what was known.
    """
    known = {k: state.get(k) for k in ("entity", "tax", "income", "scenario")}
    empty = not any(known.values())
    new_topic = not row.refs_prev and not empty and row.tax and row.tax != known["tax"] and row.entity and row.entity != known["entity"]
    if new_topic:
        known, intent, count = dict.fromkeys(known), "new_topic", 0
    else:
        count = state.get("count", 0)
        intent = "continuation" if row.refs_prev else "new" if empty else "continuation" if row.tax or row.entity else "clarification"
    for k in known:
        known[k] = getattr(row, k) or known[k]
    return known | {"count": count + 1}, intent


def _out(conv: int, turn: int, state: dict, intent: str) -> tuple:
    return (conv, turn, state["entity"], state["tax"], state["income"], state["scenario"], state["count"], intent)


def _rows(pdf: pd.DataFrame) -> Iterator:
    clean = pdf.astype(object).where(pdf.notna(), None)
    return clean.itertuples(index=False)


COLUMNS = [c.split()[0] for c in STATE_SCHEMA.split(", ")]


def dialogue_states(turns: DataFrame, order: list[str] = ["turn"], within: list[str] = [], **tables: dict[str, list[str]]) -> DataFrame:
    """The tracker's state after every user turn, by windows over each conversation.

    Turns go by ``order``; ``within`` names columns that part a conversation further.

    A turn that starts anew names both entity and tax, so what was known of these
    before never depends on earlier starts: the turns that start anew are found
    first, and the other slots are kept from each start on.
    """
    kept = [c for c in (*order, *within) if c != "turn"]
    w = Window.partitionBy("conv_id", *within).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    was = lambda c, frame: F.last(c, ignorenulls=True).over(frame)
    slots = ("entity", "tax", "income", "scenario")
    rows = turn_signals(turns, keep=kept, **tables).withColumns({f"was_{c}": was(c, before) for c in slots})
    empty = F.coalesce(*[F.col(f"was_{c}") for c in slots]).isNull()
    other = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"was_{c}"))
    anew = ~F.col("refs_prev") & ~empty & other("tax") & other("entity")
    intent = F.when(anew, "new_topic").when(F.col("refs_prev"), "continuation").when(empty, "new").when(F.coalesce("tax", "entity").isNotNull(), "continuation").otherwise("clarification")
    rows = rows.withColumn("intent", intent).withColumn("topic", F.sum(anew.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("conv_id", *within, "topic").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = [was(c, own).alias(name) for c, name in zip(slots, ("entity_type", "tax_type", "income_info", "scenario"))]
    return rows.select("conv_id", "turn", *known, F.count(F.lit(1)).over(own).cast("int").alias("turn_count"), "intent")


def dialogue_states_no_reset(turns: DataFrame, **tables: dict[str, list[str]]) -> DataFrame:
    """The state where topics never start anew: the last known value of each slot, by windows alone."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.last(c, ignorenulls=True).over(w)
    return turn_signals(turns, **tables).select("conv_id", "turn", known("entity").alias("entity_type"), known("tax").alias("tax_type"), known("income").alias("income_info"), known("scenario").alias("scenario"), F.count(F.lit(1)).over(w).cast("int").alias("turn_count"))


def dialogue_stream(turns: DataFrame, timeout_ms: int = 3_600_000, **tables: dict[str, list[str]]) -> DataFrame:
    """The tracker over a stream of turns; a conversation is forgotten after an idle hour."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        names = ("entity", "tax", "income", "scenario", "count")
        state = dict(zip(names, held.get)) if held.exists else {}
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for row in _rows(rows):
            state, intent = _next(state, row)
            out.append(_out(row.conv_id, row.turn, state, intent))
        held.update(tuple(state.get(n) for n in names))
        held.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=COLUMNS)

    signals = turn_signals(turns, **tables)
    return signals.groupBy("conv_id").applyInPandasWithState(step, STATE_SCHEMA, "entity string, tax string, income string, scenario string, count int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def context_text(entity: Column, tax: Column, income: Column, scenario: Column) -> Column:
    """What is known of a conversation, as a line for the next question."""
    named = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("; ", named("Đối tượng", entity), named("Loại thuế", tax), named("Thu nhập", income), named("Tình huống", scenario))


# Cache rules.
SIMILAR, TTL_SECONDS, FIRST_CHANGE = 0.88, 86_400, "2025-01-01"


def stale_entries(cache: DataFrame, manifest: DataFrame, as_of: Column) -> DataFrame:
    """Cache entries with the first change of law after they were made: an as-of join with the next change.

    The changes are few: one sorted array of dates meets every entry.
    """
    day = F.coalesce("status_changed_date", "effective_from")
    changes = manifest.where(F.col("status").isin("active", "active_until_superseded", "superseded")).select(day.alias("d")).where((F.col("d") >= F.lit(FIRST_CHANGE).cast("date")) & (F.col("d") <= as_of))
    dates = changes.agg(F.array_sort(F.collect_set("d")).alias("dates"))  # one row: days on which the law changed
    late = F.filter("dates", lambda d: d.cast("timestamp") > F.col("created_at"))
    return cache.join(F.broadcast(dates), F.lit(True)).withColumn("next_change", F.get(late, F.lit(0))).drop("dates").withColumn("is_stale", F.col("next_change").isNotNull())


def next_event(rows: DataFrame, events: DataFrame, key: str, at: str, event_at: str) -> DataFrame:
    """As-of join forward: for each row the first event of its key strictly later, by one union and one window."""
    both = rows.select(key, F.col(at).alias("t"), F.lit(0).alias("is_event"), F.struct(*rows.columns).alias("r")).unionByName(
        events.select(key, F.col(event_at).alias("t"), F.lit(1).alias("is_event")), allowMissingColumns=True
    )
    later = Window.partitionBy(key).orderBy(F.desc("t"), "is_event").rowsBetween(Window.unboundedPreceding, -1)  # grows by a row at a time
    found = both.withColumn("next_at", F.min(F.when(F.col("is_event") == 1, F.col("t"))).over(later))
    return found.where("is_event = 0").select("r.*", "next_at")


def cache_hits(asked: DataFrame, cache: DataFrame, version: Column, least: float = SIMILAR) -> DataFrame:
    """The nearest entry of each question if it is near enough, of the version and not stale.

    Only the nearest one counts: if it is stale, the question is a miss.  asked
    (query_id, q), cache (entry_id, v, cache_version, is_stale).
    """
    from lexmill.operators.search import vector_top

    best = vector_top(asked, cache.select("entry_id", "v"), 1, item_id="entry_id").join(cache.select("entry_id", "cache_version", "is_stale"), "entry_id")
    return best.where((F.col("score") >= least) & (F.col("cache_version") == version) & ~F.col("is_stale")).select("query_id", "entry_id", "score")


def fresh(cache: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """Entries that users made within the last day, and all others."""
    age = now.cast("timestamp").cast("long") - F.col("created_at").cast("timestamp").cast("long")
    return cache.where((F.col("source_round") != "user") | (age <= ttl))


def cache_by_key(asked: DataFrame, cache: DataFrame, as_of: Column, now: Column) -> DataFrame:
    """Entries of the same question: asked (query_id, question, doc_ids), cache (entry_id, source_round, created_at); entries past their day are none."""
    keyed = asked.withColumn("entry_id", numbers.question_key(F.col("question"), as_of, F.col("doc_ids")))
    return keyed.join(fresh(cache, now), "entry_id").select("query_id", "entry_id")


def flushed(cache: DataFrame, source_round: str | None = None) -> DataFrame:
    """The cache emptied, or without the entries of one origin; as a table it is written over the old one."""
    return cache.limit(0) if source_round is None else cache.where(F.col("source_round") != source_round)


def cache_counts(cache: DataFrame) -> DataFrame:
    """How many entries there are of each origin."""
    return cache.groupBy("source_round").agg(F.count(F.lit(1)).alias("n"))


def store_new(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with entries whose id it does not have."""
    return cache.unionByName(entries.join(cache.select("entry_id"), "entry_id", "left_anti").select(*cache.columns))


# Rate limits.
TOKENS_PER_MINUTE, CALL_TOKENS, DAY_WARN, DAY_LIMIT, LEAST_GAP = 1_800_000, 22_000, 6_500, 10_000, 0.1


def token_bucket(calls: DataFrame, capacity: float = TOKENS_PER_MINUTE, cost: float = CALL_TOKENS) -> DataFrame:
    """When calls (key, seq, t in seconds) may start under a bucket that is empty at first: (key, seq, t, start, waited).

    The bucket refills steadily up to its capacity; a call waits until its cost is
    there.  Let z be the time from which the bucket, refilled steadily, would hold
    what it holds: a call moves it to max(z, t - fill time) + cost time, as the
    capacity cuts off what is older, and may start at z.  Unrolled, z is a running
    maximum, so one window gives all starts.
    """
    rate = capacity / 60.0
    w = Window.partitionBy("key").orderBy("t", "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = calls.withColumn("n__", F.row_number().over(w))
    old = F.max(F.col("t") - capacity / rate - (F.col("n__") - 1) * (cost / rate)).over(so_far)
    first = F.first("t").over(so_far)
    start = F.greatest(F.col("t"), F.greatest(first, old) + F.col("n__") * (cost / rate))
    return rows.select("key", "seq", "t", start.alias("start"), F.round(start - F.col("t"), 6).alias("waited"))


def rate_gaps(calls: DataFrame, key: str, t: str, least: float = LEAST_GAP) -> DataFrame:
    """How long each call would wait for the least gap to the one before."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(key).orderBy(t))
    return calls.withColumn("wait", F.greatest(F.lit(0.0), F.coalesce(F.lit(least) - gap, F.lit(0.0))))


def min_interval(calls: DataFrame, least: float = LEAST_GAP) -> DataFrame:
    """When calls (key, seq, t in seconds) start if each waits for the least gap to the start before: (key, seq, start).

    A start is the latest of what each earlier call, with a gap for every call
    since, leaves free; that is a running maximum.
    """
    w = Window.partitionBy("key").orderBy("t", "seq")
    rows = calls.withColumn("n__", F.row_number().over(w))
    ahead = F.max(F.col("t") - F.col("n__") * least).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("key", "seq", (ahead + F.col("n__") * least).alias("start"))


def day_of(ts: Column, offset: str = "17 hours") -> Column:
    """The tumbling day, in UTC+7, of a time stamp in a UTC session."""
    return F.window(ts, "1 day", "1 day", offset)


def daily_counts(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Calls of each day with their level: ok, warn or over; works on streams with a watermark as on tables."""
    n = F.count(F.lit(1))
    counted = events.groupBy(day_of(F.col(ts)).alias("w")).agg(n.alias("used"))
    level = F.when(F.col("used") >= DAY_LIMIT, "over").when(F.col("used") >= DAY_WARN, "warn").otherwise("ok")
    return counted.select(F.col("w.start").alias("day_start"), "used", F.greatest(F.lit(0), F.lit(DAY_LIMIT) - F.col("used")).alias("remaining"), level.alias("level"))


def daily_stream(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``daily_counts`` of a stream; events later than the watermark are left out."""
    return daily_counts(events.withWatermark(ts, late), ts)


def running_count(events: DataFrame, ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Each event with how many its day has had so far."""
    w = Window.partitionBy(day_of(F.col(ts))["start"]).orderBy(ts, order)
    return events.withColumn("used", F.row_number().over(w))


def router_usage(calls: DataFrame, budget: int) -> DataFrame:
    """Share of each model and what is left of the budget, by day: calls (ts, model)."""
    counted = calls.groupBy(day_of(F.col("ts")).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("model") == "premium").alias("premium"))
    return counted.select(F.col("w.start").alias("day_start"), "n", F.round(100 * F.col("premium") / F.col("n"), 2).alias("premium_percent"), F.greatest(F.lit(0), budget - F.col("premium")).alias("left"))


def repeated_calls(calls: DataFrame, key: str, order: str, *what: str) -> DataFrame:
    """Calls that a request has made before."""
    w = Window.partitionBy(key, *what).orderBy(order)
    return calls.withColumn("n__", F.row_number().over(w)).where("n__ > 1").drop("n__")


def retained(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(ts) >= now - F.expr(f"interval {days} days"))


def dedup_stream(rows: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
