"""Saved sets kept up to date from a stream of steps, in Spark's state store.

State holds one small row per (user_id, id): the membership up to the watermark, the last
put or delete after it, and the toggles after that one.  A step may come late by as much as the
watermark's delay and still takes its place in the order; what the watermark has passed is
folded into the membership.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import batched
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stackroom.operators.saved import KEY
from stackroom.streaming.state_calls import KeyedState

DELAY = "1 day"
STATE = "member"
MEMBER = "settled boolean, set_ts bigint, set_seq bigint, saved boolean, toggles array<struct<ts: bigint, seq: bigint>>"
CHANGES = "user_id bigint, id string, saved boolean"
_STEPS = "user_id bigint, id string, ts timestamp, seq bigint, op string"
BUCKETS = 4096  # of keys, whose steps are handed over together: it tells where a key's state lies, so it stays
_CHUNK = 1024  # keys whose state is asked for at a time


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps in order of key and time, without those that a later put or delete of the same key, in the same batch, makes void."""
    for steps in batches:
        if not steps.num_rows:
            continue
        column = {name: steps.column(name) for name in ("user_id", "id", "ts", "seq", "op")}
        keys = column["user_id"].to_numpy(), column["id"].dictionary_encode().indices.to_numpy()
        seq, unknown = column["seq"].fill_null(0).to_numpy(), column["seq"].is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((seq, unknown, column["ts"].cast("int64").to_numpy(), *keys[::-1]))
        user, item = (key[order] for key in keys)
        is_first = np.ones(len(order), bool)
        is_first[1:] = (user[1:] != user[:-1]) | (item[1:] != item[:-1])
        is_set = pc.not_equal(column["op"], "toggle").to_numpy(zero_copy_only=False)[order]
        place = np.arange(len(order))
        last_set = np.maximum.reduceat(np.where(is_set, place, -1), place[is_first])
        yield steps.take(pa.array(order[place >= last_set[np.cumsum(is_first) - 1]]))


class Membership(StatefulProcessor):
    """Folds the steps of a key into its state; gives the membership after each batch that has some."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._member = handle.getValueState(STATE, MEMBER)

    def _known(self) -> list[Any]:
        found = self._member.get()
        return [*found[:4], [tuple(t) for t in found[4] or []]] if found else [False, None, None, None, []]

    def _settle(self, member: list[Any], upto: int) -> None:
        """No step up to this time can come any more: fold it into the membership."""
        settled, ts, seq, saved, toggles = member
        if ts is not None and ts <= upto:
            settled, ts, seq, saved = saved, None, None, None
        if ts is None:
            passed = sum(t[0] <= upto for t in toggles)
            settled, toggles = settled != (passed % 2 == 1), toggles[passed:]
        member[:] = settled, ts, seq, saved, toggles

    def _store(self, member: list[Any], upto: int) -> None:
        self._settle(member, upto)
        settled, ts, _, _, toggles = member
        if not settled and ts is None and not toggles:
            self._member.clear()
            return
        self._member.update((*member[:4], toggles))

    def _remind(self, member: list[Any]) -> None:
        """A put or delete alone takes no more room than what it settles to; toggles are to be folded."""
        _, ts, _, _, toggles = member
        if toggles:
            self._handle.registerTimer(max(toggles[-1][0], ts or 0) // 1000 + 1)

    def _fold(self, steps: Iterable[tuple[int, int | None, str]], upto: int) -> bool:
        """Take in steps (time, seq, op) of the key; gives its membership."""
        member = self._known()
        for ts, seq, op in steps:
            if member[1] is not None and (ts, seq) <= (member[1], member[2]):
                continue
            if op == "toggle":
                member[4].append((ts, seq))
            else:
                member[1:4] = ts, seq, op == "put"
                member[4] = [t for t in member[4] if t > (ts, seq)]
        member[4].sort()
        settled, ts, _, saved, toggles = member
        now = (settled if ts is None else saved) != (len(toggles) % 2 == 1)
        self._store(member, upto)
        self._remind(member)
        return now

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        steps = [(step.at, step.seq, step.op) for step in rows]
        yield Row(user_id=key[0], id=key[1], saved=self._fold(steps, timerValues.getCurrentWatermarkInMs() * 1000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self._store(self._known(), timerValues.getCurrentWatermarkInMs() * 1000)
        return iter(())

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self._member.update((True, None, None, None, []))

    def close(self) -> None:
        pass


class Memberships(Membership):
    """The same for a bucket of keys at a time, whose steps come and whose changes go as one frame.

    A key's state lies under the key itself, in the partition of its bucket.
    """

    def __init__(self, begins_empty: bool):
        self._begins_empty = begins_empty

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._member = self._handle = KeyedState(handle, STATE, MEMBER)
        self._expired: dict[tuple, None] = {}
        task = TaskContext.get()
        # what the first batch begins with is known without asking
        self._asks = not (self._begins_empty and task and task.getLocalProperty("streaming.sql.batchId") == "0")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        upto, steps = timerValues.getCurrentWatermarkInMs() * 1000, defaultdict(list)
        for frame in rows:
            for step in frame["step"]:
                at, seq, op, one = step.split("\t", 3)
                steps[one].append((int(at), int(seq) if seq else None, op))
        keys = [(int(user), item) for user, _, item in (one.partition("\t") for one in steps)]
        saved, each = [], iter(steps.values())
        for chunk in batched(keys, _CHUNK):
            self._member.fetch(chunk if self._asks else ())
            for one in chunk:
                self._member.at(one)
                saved.append(self._fold(next(each), upto))
        self._member.fetch(())
        yield pd.DataFrame({"user_id": [user for user, _ in keys], "id": [item for _, item in keys], "saved": saved})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Ask for the key's state; what it settles to is stored when many have been asked for."""
        self._upto = timerValues.getCurrentWatermarkInMs() * 1000
        self._member.ask(key)
        self._expired[key] = None
        if len(self._expired) >= _CHUNK:
            self._settle_expired()
            self._member.name(key)  # the worker goes on with it
        return iter(())

    def _settle_expired(self) -> None:
        self._member.drain()
        for one in self._expired:
            self._member.at(one)
            self._store(self._known(), self._upto)
        self._member.fetch(())
        self._expired = {}

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        for user, item in zip(initialState["holder"], initialState["item"]):
            self._member.at((None if user is None else int(user), item))
            super().handleInitialState(key, None, timerValues)

    def close(self) -> None:
        self._settle_expired()
        self._member.close()


def membership_changes(events: DataFrame, delay: str = DELAY, initial: DataFrame | None = None) -> DataFrame:
    """For each micro-batch the keys it has steps of, with their membership after it: user_id, id, saved.

    Order is ``(ts, seq)``, whatever batch a step comes in, as long as it is not later than ``delay``
    behind the newest step seen; what is later is dropped, as are steps without key or time.
    ``initial`` holds the keys (user_id, id) that are saved before the first batch.  Steps that
    others of their task make void go before the shuffle, so that a key with very many
    steps sends few.  They are handed over a bucket of keys at a time, which a task holds the steps
    of, and the state server is called for many keys at once: alone, a key's frame and calls cost
    more than its state does.
    """
    has_key = F.col("user_id").isNotNull() & F.col("id").isNotNull() & F.col("ts").isNotNull()
    steps = events.where(has_key & F.col("op").isin("put", "delete", "toggle"))
    columns = [F.col(name).cast(kind).alias(name) for name, kind in (part.split() for part in _STEPS.split(", "))]
    thin = steps.select(*columns).mapInArrow(_thin, _STEPS)
    seq = F.coalesce(F.col("seq").cast("string"), F.lit(""))
    step = F.concat_ws("\t", F.unix_micros("ts"), seq, "op", "user_id", "id").alias("step")
    start = None if initial is None else initial.select(F.col("user_id").cast("string").alias("holder"), F.col("id").cast("string").alias("item")).distinct()
    return (
        thin.withWatermark("ts", delay)
        .select(*_bucket("user_id", "id"), "ts", step)
        .groupBy(*KEY)
        .transformWithStateInPandas(
            Memberships(initial is None), CHANGES, "Update", "eventTime",
            initialState=None if start is None else start.select(*_bucket(F.col("holder").cast("bigint"), "item"), "*").groupBy(*KEY),
        )
    )


def _bucket(user_id: str | Column, item: str) -> list[Column]:
    """The key by which a bucket's rows are handed over; nothing is stored under it."""
    return [F.pmod(F.xxhash64(user_id, item), F.lit(BUCKETS)).alias("user_id"), F.lit("").alias("id")]


def saved_state_stream(
    events: DataFrame, checkpoint: str, delay: str = DELAY, initial: DataFrame | None = None
) -> StreamingQuery:
    """Take all steps there are into the state kept in ``checkpoint``; :func:`members` reads it.

    A run that fails starts again from its last whole batch; Spark keeps state and progress together.
    State lies in the partition of its key's bucket.  A checkpoint of the code that dealt keys out one by
    one has it elsewhere: begin anew, with that one's :func:`members` as ``initial``.
    """
    return (
        membership_changes(events, delay, initial)
        .writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def members(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Keys saved after the last whole batch, read from the state itself."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", STATE).load()
    value = F.col("value")
    saved = F.when(value["set_ts"].isNull(), value["settled"]).otherwise(value["saved"])
    flipped = F.size(value["toggles"]) % 2 == 1
    return state.where(saved != flipped).select(*[F.col("key")[name].alias(name) for name in KEY])
