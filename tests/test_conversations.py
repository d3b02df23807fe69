"""Conversations: the step, the stream and the batch form against a plain fold."""

import datetime
import random
import tempfile

import pytest

from trivalent.streaming import conversations as c

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def history(seed, sessions=6, turns=50):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        at = START
        for n in range(turns):
            at += datetime.timedelta(minutes=rng.choice([44, 45, 50, 200]) if rng.random() < 0.08 else rng.randrange(1, 6))
            turn = f"t{n:03}" if rng.random() < 0.85 or not n else f"t{rng.randrange(n):03}"
            rows.append((s, turn, at, rng.choice(c.EVENTS), rng.choice([None, "age", "income"]), rng.choice([None, "1", "2"])))
    return rows


def plain(rows, remember_all=True):
    """session: place, ignored, sessions; and what is told of each turn."""
    out, told = {}, []
    for s in sorted({r[0] for r in rows}):
        place, last, ignored, sessions, seen, profile, pending, version = c.START, None, 0, 1, [], {}, None, 0
        for _, turn, at, event, field, value in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            if remember_all and turn in seen:
                continue
            if last and at - last >= datetime.timedelta(minutes=45):
                told.append((s, None, "EXPIRED", "COMPLETED", version, 0))
                place, sessions, profile, pending, version = c.START, sessions + 1, {}, None, 0
                if not remember_all:
                    seen = []
            if turn in seen:
                told.append((s, turn, "DUPLICATE", place[0], version, len(profile)))
                continue
            place, meant = c.step(place, event, field is not None)
            profile, pending, other = c.profile_step(profile, pending, event, field, value, meant)
            version += other
            seen.append(turn)
            last, ignored = at, ignored + (not meant)
            told.append((s, turn, "APPLIED" if meant else "IGNORED", place[0], version, len(profile)))
        out[s] = (*place[:3], ignored, sessions)
    return out, told


@pytest.mark.parametrize("parts", [1, 7])
def test_composed_runs_are_the_plain_fold(spark, parts):
    rows = history(1)
    got = {r.session_id: tuple(r)[1:] for r in c.states(spark.createDataFrame(rows, c.EVENT), parts=parts).collect()}
    assert got == plain(rows)[0]


def test_guards_and_ways_back():
    at = lambda *events: [p := c.START, *[p := c.step(p, e, f)[0] for e, f in events]][-1]
    start = ("SESSION_STARTED", False), ("NEED_PROVIDED", True)
    assert at(*start, ("MORE_INFO_REQUIRED", True))[0] == "WAITING_FOR_PROFILE_VALUE"
    assert at(*start, ("MORE_INFO_REQUIRED", False))[0] == "PROCESSING_DISCOVERY"  # no field was asked for
    ask = *start, ("MORE_INFO_REQUIRED", True)
    assert at(*ask, ("PROFILE_VALUE_CORRECTED", False))[0] == "WAITING_FOR_PROFILE_VALUE"  # nothing to confirm
    confirm = *ask, ("PROFILE_VALUE_CORRECTED", True)
    assert at(*confirm) == ("WAITING_FOR_CONFIRMATION", True, True, None)
    assert at(*confirm, ("PROFILE_VALUE_CONFIRMED", False))[:2] == ("PROCESSING_DISCOVERY", False)
    assert at(*confirm, ("CITIZEN_QUERY_RECEIVED", False), ("QUERY_ANSWERED", False))[0] == "WAITING_FOR_CONFIRMATION"
    assert at(*confirm, ("SCHEME_SELECTED", False)) == at(*confirm) and not c.step(at(*confirm), "SCHEME_SELECTED", False)[1]
    assert at(*confirm, ("START_OVER_REQUESTED", False)) == ("WAITING_FOR_NEED", False, False, None)
    assert at(*confirm, ("LANGUAGE_CHANGED", False)) == at(*confirm) and at(*confirm, ("MAX_TURNS_REACHED", False))[0] == "COMPLETED"


def test_profiles_take_what_is_extracted_or_confirmed():
    step = c.profile_step
    assert step({}, None, "PROFILE_VALUE_EXTRACTED", "age", "3", True) == ({"age": "3"}, None, True)
    assert step({"age": "3"}, None, "PROFILE_VALUE_CORRECTED", "age", "4", True) == ({"age": "3"}, ("age", "4"), False)
    assert step({"age": "3"}, ("age", "4"), "PROFILE_VALUE_CONFIRMED", None, None, True) == ({"age": "4"}, None, True)
    assert step({"age": "3"}, ("age", "4"), "PROFILE_VALUE_REJECTED", None, None, True) == ({"age": "3"}, None, False)
    assert step({"age": "3"}, None, "PROFILE_VALUE_DECLINED", "age", None, True) == ({}, None, True)
    assert step({"age": "3"}, ("x", "1"), "START_OVER_REQUESTED", None, None, True) == ({}, None, True)
    assert step({"age": "3"}, None, "PROFILE_VALUE_EXTRACTED", "age", "9", False) == ({"age": "3"}, None, False)


def stream(spark, folder, name):
    q = (
        c.told(spark.readStream.schema(c.EVENT).option("maxFilesPerTrigger", 1).parquet(folder)).writeStream.format("memory").queryName(name)
        .option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return [tuple(r) for r in spark.table(name).collect()]


def test_stream_tells_of_duplicates_and_late_turns_and_ends_where_the_batch_does(spark):
    import os
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = sorted(history(2, sessions=4, turns=30), key=lambda r: (r[2], r[1]))
    half = len(rows) // 2
    late = (0, "late", START - datetime.timedelta(days=1), "START_OVER_REQUESTED", None, None)
    for n, part in enumerate((rows[:half], rows[half:], [late])):
        path = f"{folder}/part{n}"
        spark.createDataFrame(part, c.EVENT).coalesce(1).write.parquet(path)
        f = next(x for x in os.listdir(path) if x.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{path}/{f}", f"{folder}/in/{n}.parquet")
        os.utime(f"{folder}/in/{n}.parquet", (time.time() - 100 + n,) * 2)
    got = stream(spark, f"{folder}/in", "told_turns")
    turns = lambda told: sorted((x for x in told if x[2] != "EXPIRED"), key=str)
    want, told = plain(rows, remember_all=False)
    assert turns(got) == turns(told) and any(x[2] == "DUPLICATE" for x in told) and not any(x[1] == "late" for x in got)
    assert {x[0] for x in got if x[2] == "EXPIRED"} >= {x[0] for x in told if x[2] == "EXPIRED"}
    once = {s: [r for r in rows if r[0] == s] for s in want}
    last = {}
    for x in told:
        if x[2] != "EXPIRED":
            last[x[0]] = x[3]
    assert set(last) == set(once) and all(want[s][0] == last[s] for s in last)


def test_no_turns(spark):
    assert c.states(spark.createDataFrame([], c.EVENT)).collect() == []


def test_only_a_partitions_first_session_is_followed_from_all_places(spark, monkeypatch):
    rows = [*history(5, sessions=12, turns=20), (None, "a", START, "SESSION_STARTED", None, None), (None, "b", START, "NEED_PROVIDED", None, None)]
    kept, keep = [], c.written
    monkeypatch.setattr(c, "written", lambda df: kept.append(keep(df)) or kept[-1])
    turns = spark.createDataFrame(rows, c.EVENT)
    want = {r.session_id: tuple(r) for r in c.states(turns, parts=1).collect()}
    assert want[None][1] == "PROCESSING_DISCOVERY"
    assert {r.session_id: tuple(r) for r in c.states(turns, parts=5).collect()} == want
    runs = kept[-1].groupBy("part").agg({"table": "count", "session_id": "count"}).collect()
    assert len(runs) == 5 and all(r["count(table)"] == 1 < r["count(session_id)"] for r in runs)
