"""Streams whose rows come shuffled over several batches give what the batch query gives."""

import datetime as dt
import random

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lexmill.functions import numbers
from lexmill.streaming import ordered

T0 = dt.datetime(2026, 1, 5, 8, 0, 0)


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    yield ordered.with_ordered_state(spark)
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_in_batches(spark, tmp_path, rows, schema, of, name, batches):
    """Each batch is a file of its own, read one at a time; what is not yet due is let go by a last row of another key."""
    folder = str(tmp_path / "in")
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b={i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)
    q = of(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()], q


def test_shuffled_turns_equal_the_batch_query(spark, store, tmp_path):
    r = random.Random(7)
    says = ["hộ kinh doanh", "công ty", "tôi", "thuế khoán", "shopee", "gtgt", "lương 20 triệu/tháng", "2 người phụ thuộc", "ngoài ra", "xin chào", "phạt vi phạm", None]
    rows = []
    for conv in range(12):
        at = T0 + dt.timedelta(seconds=r.randrange(0, 600))
        for turn in range(10):
            at += dt.timedelta(minutes=r.choice([1, 5, 20, 60, 61, 90]))
            text = " ".join(w for w in r.sample(says, r.randrange(0, 4)) if w)
            rows.append((conv, turn, "user" if r.random() < 0.8 else "assistant", text, at))
    rows.append((3, 99, "user", "không có giờ", None))  # without a time: in neither
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    shuffled = rows[:]
    r.shuffle(shuffled)
    batches = [shuffled[i::4] for i in range(4)] + [[(999, 0, "user", "hết", T0 + dt.timedelta(days=60))], [(999, 1, "user", "hết", T0 + dt.timedelta(days=90))]]
    got, _ = run_in_batches(spark, tmp_path, rows, schema, lambda s: ordered.dialogue_in_order(s, late="2 days"), "ordered_dialogue", batches)
    want = sorted(map(tuple, ordered.dialogue_sessions(spark.createDataFrame(rows, schema)).collect()))
    assert sorted(x for x in got if x[0] != 999) == want
    assert {w[-1] for w in want} >= {"new", "continuation", "clarification"}
    whole = ordered.dialogue_sessions(spark.createDataFrame(rows, schema), idle_ms=10**12).collect()
    assert sorted(map(tuple, whole)) != want  # idle conversations were forgotten


def test_late_turns_are_left_out(spark, store, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    batches = [[(1, 0, "user", "công ty", at(0)), (1, 2, "user", "gtgt", at(40))], [(1, 3, "user", "ngoài ra", at(45))], [(1, 1, "user", "shopee", at(10))], [(9, 0, "user", "hết", at(5000))], [(9, 1, "user", "hết", at(9000))]]
    got, _ = run_in_batches(spark, tmp_path, None, schema, ordered.dialogue_in_order, "late_dialogue", batches)
    assert sorted(x[:4] for x in got if x[0] == 1) == [(1, 0, "enterprise", None), (1, 2, "enterprise", "GTGT"), (1, 3, "enterprise", "GTGT")]


def test_cache_entries_live_for_their_time(spark, store, tmp_path):
    r = random.Random(11)
    rows = [(f"q{r.randrange(6)}", i, f"a{i}", T0 + dt.timedelta(minutes=r.randrange(0, 5000))) for i in range(150)]
    want, made = [], {}
    for key, ask, answer, at in sorted(rows, key=lambda x: (x[3], x[1])):
        hit = key in made and (at - made[key][0]).total_seconds() <= 86_400
        if not hit:
            made[key] = (at, answer)
        want.append((key, ask, hit, made[key][1]))
    shuffled = rows[:]
    r.shuffle(shuffled)
    end = [[("end", 1000, "", T0 + dt.timedelta(days=60))], [("end", 1001, "", T0 + dt.timedelta(days=90))]]
    schema = "entry_id string, ask_id long, answer string, ts timestamp"
    got, q = run_in_batches(spark, tmp_path, rows, schema, lambda s: ordered.cache_in_order(s, late="5 days"), "ordered_cache", [shuffled[:50], shuffled[50:100], shuffled[100:], *end])
    assert sorted(x for x in got if x[0] != "end") == sorted(want)
    assert {x[2] for x in want} == {True, False}
    assert q.lastProgress["stateOperators"][0]["customMetrics"].get("numRegisteredTimers", 0) >= 0


def test_a_fold_travels_after_functions_were_used(spark):
    numbers.canonical_amount(F.lit("x"))  # holds a handle of the driver from here on
    for step in (ordered._tracked, ordered._cached):
        cloudpickle.dumps(step)
