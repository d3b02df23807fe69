"""Conversations with citizens: their states, guards and profiles, as a stream and over whole histories.

One step is the same for both. The stream keeps each session in state: a value for where the conversation is, a map for the profile, and a timer
that ends it. The batch form takes an event as a function from every place of a conversation to the next; functions of a run of events
are composed in the task that has the run, and runs of a session are put together in order, so that no history is gathered."""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.ranges import in_ranges
from ..operators.sizes import written

# States and, for each, what an event leads to; events that are the same in all states.
MOVES = {
    "NEW_SESSION": {"SESSION_STARTED": "WAITING_FOR_NEED"},
    "WAITING_FOR_NEED": {"NEED_PROVIDED": "PROCESSING_DISCOVERY", "PROFILE_VALUE_EXTRACTED": "PROCESSING_DISCOVERY", "PROFILE_VALUE_EXTRACTED_CONFIRMATION_REQUIRED": "WAITING_FOR_CONFIRMATION"},
    "PROCESSING_DISCOVERY": {"MORE_INFO_REQUIRED": "WAITING_FOR_PROFILE_VALUE", "ELIGIBLE_RESULTS_FOUND": "SHOWING_RESULTS", "NO_RESULTS_FOUND": "NO_RESULTS", "CANNOT_RESOLVE_MORE": "CANNOT_RESOLVE", "DISCOVERY_COMPLETED": "SHOWING_RESULTS"},
    "WAITING_FOR_PROFILE_VALUE": {
        "PROFILE_VALUE_EXTRACTED": "PROCESSING_DISCOVERY", "PROFILE_VALUE_EXTRACTED_CONFIRMATION_REQUIRED": "WAITING_FOR_CONFIRMATION", "CLARIFICATION_REQUIRED": "NEED_CLARIFICATION",
        "PROFILE_VALUE_UNKNOWN": "PROCESSING_DISCOVERY", "PROFILE_VALUE_DECLINED": "PROCESSING_DISCOVERY", "CITIZEN_QUERY_RECEIVED": "HANDLING_CITIZEN_QUERY", "PROFILE_VALUE_CORRECTED": "WAITING_FOR_CONFIRMATION",
    },
    "WAITING_FOR_CONFIRMATION": {"PROFILE_VALUE_CONFIRMED": "PROCESSING_DISCOVERY", "PROFILE_VALUE_REJECTED": "WAITING_FOR_PROFILE_VALUE", "PROFILE_VALUE_CORRECTED": "WAITING_FOR_CONFIRMATION", "CITIZEN_QUERY_RECEIVED": "HANDLING_CITIZEN_QUERY"},
    "NEED_CLARIFICATION": {"CLARIFICATION_PROVIDED": "WAITING_FOR_PROFILE_VALUE", "CITIZEN_QUERY_RECEIVED": "HANDLING_CITIZEN_QUERY"},
    "HANDLING_CITIZEN_QUERY": {"QUERY_ANSWERED": "WAITING_FOR_PROFILE_VALUE"},
    "SHOWING_RESULTS": {"SCHEME_SELECTED": "SHOWING_RESULTS", "CITIZEN_QUERY_RECEIVED": "HANDLING_CITIZEN_QUERY", "CHANGE_NEED_REQUESTED": "PROCESSING_DISCOVERY", "PROFILE_VALUE_CORRECTED": "WAITING_FOR_CONFIRMATION"},
    "NO_RESULTS": {"CHANGE_NEED_REQUESTED": "PROCESSING_DISCOVERY"},
    "CANNOT_RESOLVE": {"CHANGE_NEED_REQUESTED": "PROCESSING_DISCOVERY"},
    "ERROR": {},
    "COMPLETED": {},
}
STATES = tuple(MOVES)
ALWAYS = {"START_OVER_REQUESTED": "WAITING_FOR_NEED", "END_CONVERSATION_REQUESTED": "COMPLETED", "MAX_TURNS_REACHED": "COMPLETED", "PROCESSING_FAILED": "ERROR", "LANGUAGE_CHANGED": None, "REPEAT_REQUESTED": None}
#: Events that propose a value, that ask for a field, and that settle a proposal.
PROPOSES = ("PROFILE_VALUE_EXTRACTED_CONFIRMATION_REQUIRED", "PROFILE_VALUE_CORRECTED")
ASKS = ("MORE_INFO_REQUIRED", "CLARIFICATION_PROVIDED")
SETTLES = ("PROFILE_VALUE_CONFIRMED", "PROFILE_VALUE_REJECTED")
#: Minutes without an event after which a session is over, and turns that are remembered.
TTL, REMEMBERED = 45, 50
#: A conversation's place: state, whether a value waits for confirmation, whether a field was asked for, and the state to go back to.
Place = tuple[str, bool, bool, str | None]
START: Place = ("NEW_SESSION", False, False, None)
EVENTS = tuple(dict.fromkeys([*ALWAYS, *(e for m in MOVES.values() for e in m)]))
EVENT = "session_id long, turn_id string, at timestamp, event string, field string, value string"


def step(place: Place, event: str, has_field: bool) -> tuple[Place, bool]:
    """The next place, and whether the event meant anything here; else the place stays.

    What waits for confirmation needs a proposed value, what waits for a value a field that was asked for; without these the conversation goes where it
    can go on."""
    state, pending, expected, back = place
    if event == "START_OVER_REQUESTED":
        return ("WAITING_FOR_NEED", False, False, None), True
    if event in ALWAYS:
        return (ALWAYS[event] or state, pending, expected, back), True
    if state == "HANDLING_CITIZEN_QUERY" and event == "QUERY_ANSWERED":
        return (back or "WAITING_FOR_PROFILE_VALUE", pending, expected, None), True
    target = MOVES[state].get(event)
    if target is None:
        return place, False
    pending = (pending or event in PROPOSES and has_field) and event not in SETTLES
    expected = (expected or event in ASKS and has_field) and event != "PROFILE_VALUE_EXTRACTED"
    if event == "CITIZEN_QUERY_RECEIVED":
        back = state
    if target == "WAITING_FOR_CONFIRMATION" and not pending:
        if state == "WAITING_FOR_CONFIRMATION":
            target = "WAITING_FOR_PROFILE_VALUE" if expected else "PROCESSING_DISCOVERY"
        else:
            target = "PROCESSING_DISCOVERY" if state == "WAITING_FOR_PROFILE_VALUE" and not expected else state
    if target == "WAITING_FOR_PROFILE_VALUE" and not expected:
        target = "PROCESSING_DISCOVERY"
    return (target, pending, expected, back), True


def profile_step(profile: dict, pending: tuple | None, event: str, field: str | None, value: str | None, meant: bool) -> tuple[dict, tuple | None, bool]:
    """Profile, proposed (field, value), and whether the profile is another version.

    An extracted value is taken as it is, a proposed one when it is confirmed; a null value or a refusal takes the field out. Events that mean nothing change nothing."""
    if event == "START_OVER_REQUESTED":
        return {}, None, bool(profile)
    if not meant:
        return profile, pending, False
    if event in PROPOSES and field:
        return profile, (field, value), False
    if event == "PROFILE_VALUE_CONFIRMED" and pending:
        return {**profile, pending[0]: pending[1]}, None, True
    if event in SETTLES:
        return profile, None, False
    if event in ("PROFILE_VALUE_EXTRACTED", "PROFILE_VALUE_DECLINED", "PROFILE_VALUE_UNKNOWN") and field:
        kept = value if event == "PROFILE_VALUE_EXTRACTED" else None
        return {k: v for k, v in {**profile, field: kept}.items() if v is not None}, pending, True
    return profile, pending, False


class Sessions(StatefulProcessor):
    """Turns in order of time; told is APPLIED, IGNORED (it means nothing here), DUPLICATE (its turn was seen) or EXPIRED (the session's end)."""

    OUTPUT = "session_id long, turn_id string, told string, state string, version long, n_known long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.where = handle.getValueState("where", "state string, pending boolean, expected boolean, back string, field string, value string, version long, expires long, turns array<string>")
        self.profile = handle.getMapState("profile", "field string", "value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.at, r.turn_id)):  # one session's part of a micro-batch
            at = int(r.at.timestamp() * 1000)
            w = self.where.get() if self.where.exists() else None
            if w and at >= w[7]:
                self.handle.deleteTimer(w[7])
                self._end()
                yield Row(session_id=key[0], turn_id=None, told="EXPIRED", state="COMPLETED", version=w[6], n_known=0)
                w = None
            place, pending, version, turns = ((w[0], w[1], w[2], w[3]), (w[4], w[5]) if w[4] else None, w[6], list(w[8])) if w else (START, None, 0, [])
            known = {k[0]: v[0] for k, v in self.profile.iterator()} if w else {}
            if r.turn_id in turns:
                yield Row(session_id=key[0], turn_id=r.turn_id, told="DUPLICATE", state=place[0], version=version, n_known=len(known))
                continue
            after, meant = step(place, r.event, r.field is not None)
            now, pending, other = profile_step(known, pending, r.event, r.field, r.value, meant)
            for k in known.keys() - now.keys():
                self.profile.removeKey((k,))
            for k, v in now.items():
                if known.get(k) != v:
                    self.profile.updateValue((k,), (v,))
            expires = at + TTL * 60_000
            if w:
                self.handle.deleteTimer(w[7])
            self.handle.registerTimer(expires)
            self.where.update((*after, *(pending or (None, None)), version + other, expires, [*turns, r.turn_id][-REMEMBERED:]))
            yield Row(session_id=key[0], turn_id=r.turn_id, told="APPLIED" if meant else "IGNORED", state=after[0], version=version + other, n_known=len(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.where.exists() and self.where.get()[7] <= expiredTimerInfo.getExpiryTimeInMs():
            version = self.where.get()[6]
            self._end()
            yield Row(session_id=key[0], turn_id=None, told="EXPIRED", state="COMPLETED", version=version, n_known=0)

    def _end(self) -> None:
        self.where.clear()
        self.profile.clear()

    def close(self) -> None:
        pass


def told(turns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """What becomes of each turn of a stream (EVENT): see Sessions. Turns later than the watermark are left out."""
    return turns.withWatermark("at", late).groupBy("session_id").transformWithState(Sessions(), Sessions.OUTPUT, "Append", "EventTime")


PLACES: tuple[Place, ...] = tuple(itertools.product(STATES, (False, True), (False, True), (None, *STATES)))
_NUMBER = {p: i for i, p in enumerate(PLACES)}


@functools.cache
def moves(event: str, has_field: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every place the next one's number, and 1 where the event means nothing."""
    after = [step(p, event, has_field) for p in PLACES]
    return np.array([_NUMBER[p] for p, _ in after], np.int16), np.array([not meant for _, meant in after], np.int64)


_RUN = "session_id long, part int, first long, last long, at int, state string, pending boolean, expected boolean, n_ignored long, n_again long, table binary, ignored binary"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_RUN_ARROW = pa.schema([(c.split(" ")[0], k) for c, k in zip(_RUN.split(", "), _KINDS)])
_HERE = np.arange(len(PLACES), dtype=np.int16)
_NEW = np.full(len(PLACES), _NUMBER[START], np.int16)


@functools.cache
def _move(place: int, event: str, has_field: bool) -> tuple[int, int]:
    after, meant = step(PLACES[place], event, has_field)
    return _NUMBER[after], not meant


def states(turns: DataFrame, ttl: int = TTL, parts: int | None = None) -> DataFrame:
    """session_id, state, pending, expected, n_ignored, n_sessions after all turns (session_id, turn_id, at, event, field), in order of time and turn.

    A pause of ttl minutes begins a session anew. A turn that repeats another's session and turn_id is left out, whenever it comes: its first stays.
    Null events mean nothing. Turns are dealt by ranges of session and time, so only a partition's first session can have begun in another: its events
    are composed for all places, the others are followed from the start. A session in several partitions is put together from a row each."""
    first = turns.groupBy("session_id", "turn_id").agg(F.min(F.struct("at", "event", "field")).alias("t")).select("session_id", "turn_id", "t.*")
    order = [F.col(c) for c in ("session_id", "at", "turn_id")]
    ordered = in_ranges(first, order, parts).select("part", "session_id", F.unix_micros(F.col("at")).alias("us"), F.coalesce("event", F.lit("")).alias("event"), F.col("field").isNotNull().alias("has_field"))
    pause, start = ttl * 60_000_000, _NUMBER[START]

    def run(batches):
        now, out, tables = START, [], None  # no session has this name

        def done():
            out.append((now, part, begun, last, at, *PLACES[at][:3], n_ignored, n_again, *(t.tobytes() for t in tables or ()), *(() if tables else (None, None))))

        def handed():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _RUN_ARROW)], schema=_RUN_ARROW)
            out.clear()
            return batch

        for batch in batches:
            for part, session, us, event, has_field in zip(*(c.to_pylist() for c in batch.columns)):
                if session != now:
                    if now is not START:
                        done()
                    # the first may go on from another partition, so from any place
                    tables = (_HERE, np.zeros(len(PLACES), np.int64)) if now is START else None
                    now, begun, last, at, n_ignored, n_again = session, us, us, start, 0, 0
                if us - last >= pause:
                    at, n_again = start, n_again + 1
                    tables = tables and (_NEW, tables[1])
                if tables:
                    to, ignored = moves(event, has_field)
                    tables = to[tables[0]], tables[1] + ignored[tables[0]]
                at, nothing = _move(at, event, has_field)
                n_ignored, last = n_ignored + nothing, us
            if len(out) > 5_000:
                yield handed()
        if now is not START:
            done()
            yield handed()

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, n_ignored, sessions, last = start, 0, 1, None
        for r in rows.sort_values("part").itertuples():  # at most one a partition
            if last is not None and r.first - last >= pause:
                at, sessions = start, sessions + 1
            if r.table is None:
                at, n_ignored = r.at, n_ignored + r.n_ignored
            else:
                n_ignored += int(np.frombuffer(r.ignored, np.int64)[at])
                at = int(np.frombuffer(r.table, np.int16)[at])
            sessions, last = sessions + r.n_again, r.last
        state, pending, expected, _ = PLACES[at]
        return pd.DataFrame({"session_id": [key[0]], "state": [state], "pending": [pending], "expected": [expected], "n_ignored": [n_ignored], "n_sessions": [sessions]})

    runs = written(ordered.mapInArrow(run, _RUN))
    first = F.broadcast(runs.where("table is not null").select(F.col("session_id").alias("s")).distinct())  # one a partition at most; a session in several is among them
    here = F.col("session_id").eqNullSafe(F.col("s"))
    whole = runs.join(first, here, "left_anti").select("session_id", "state", "pending", "expected", "n_ignored", (F.col("n_again") + 1).alias("n_sessions"))
    several = runs.join(first, here, "left_semi").groupBy("session_id").applyInPandas(joined, "session_id long, state string, pending boolean, expected boolean, n_ignored long, n_sessions long")
    return whole.union(several)
