"""Held tips that end by themselves: by a response of their recipient, or by a timer.

Every held tip is state of its recipient's group and has a timer for its limit, so it
ends although nothing more arrives. With the wall clock Spark runs a batch for due timers
even when the input is silent; with the event clock timers follow the watermark, and a
replayed log gives the transitions of the batch operators.  Recipients share groups by
their hash, so that the calls into Python follow the number of groups, not of names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import ESCROW
from ..settings import DEFAULT, Settings
from .state import GROUPS, PACKED, packed, unpacked

TRANSITION = "action_id long, service_id long, state string, settled_at timestamp, debit string, credit string, coin_val decimal(20,8)"
ROW = ("t", "is_response", "action_id", "kind", "service", "name", "sender", "amount")
ENDED = {"accept": "completed", "decline": "declined"}


def _events(log: DataFrame, parts: int, groups: int) -> DataFrame:
    """Held tips under one of their recipient's parts, responses under all of them; a part is in one of ``groups``."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    tip = (F.col("type") == "givetip") & (F.col("state") == "pending") & F.col("to_user").isNotNull()
    own = F.array(F.pmod(F.xxhash64("action_id"), F.lit(parts)).cast("int"))
    everywhere = F.array(*map(F.lit, range(parts)))
    response = F.col("type").isin(*ENDED)
    # Without a time a tip cannot end and a response cannot end one.
    events = log.where((tip | response) & F.col("ts").isNotNull()).select(
        F.col("service_id").cast("string").alias("service"), F.lower(F.when(tip, F.col("to_user")).otherwise(F.col("from_user"))).alias("name"),
        F.explode(F.when(tip, own).otherwise(everywhere)).alias("part"), F.coalesce(F.col("action_id").cast("long"), F.lit((1 << 63) - 1)).alias("action_id"),
        F.when(tip, "tip").otherwise(F.col("type")).alias("kind"), (~tip).alias("is_response"), F.col("ts").cast("timestamp").alias("ts"), t.alias("t"),
        F.when(tip, F.lower("from_user")).alias("sender"), F.when(tip, F.col("coin_val").cast("string")).alias("amount"),
    )
    return events.withColumn("part", F.pmod(F.xxhash64("service", "name", "part"), F.lit(groups)))


def _order(row: tuple) -> tuple:
    """Of one instant tips come before responses, which end them at once."""
    return (*row[:4], row[6] or "", row[7] or "")


def _ending(span: int, wall: bool):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # By recipient: held tips with limit, sender and amount; and a time that none of the limits is before.
        held: dict[tuple, dict[int, tuple[int, str, str]]] = {}
        due: dict[tuple, int] = {}
        out: list[tuple[Any, ...]] = []

        def hold(who: tuple, action_id: int, limit: int, sender: str, amount: str) -> None:
            held.setdefault(who, {}).setdefault(action_id, (limit, sender, amount))
            due[who] = min(limit, due.get(who, limit))

        def end(who: tuple, action_id: int, how: str, at: int) -> None:
            _, sender, amount = held[who].pop(action_id)
            service, name = who
            credit = name if how == "completed" else sender
            out.append((action_id, None if service is None else int(service), how, at, ESCROW, credit, amount))

        def expire(who: tuple, before: int) -> None:
            if due[who] >= before:
                return
            for i in [i for i, (limit, _, _) in held[who].items() if limit < before]:
                end(who, i, "expired", held[who][i][0])
            if held[who]:
                due[who] = min(limit for limit, _, _ in held[who].values())
            else:
                del held[who], due[who]

        if state.exists:
            for service, name, *tip in unpacked(state.get):
                hold((service, name), *tip)
        rows = sorted((row for f in frames for row in zip(*(f[c].tolist() for c in ROW))), key=_order)
        for t, _, action_id, kind, service, name, sender, amount in rows:
            who = (service, name)
            if who in held:
                expire(who, t)
            if kind == "tip":
                hold(who, action_id, t + span, sender, amount)
            elif who in held:
                for i in [i for i, (limit, _, _) in held[who].items() if limit - span <= t]:
                    end(who, i, ENDED[kind], t)
                if not held[who]:
                    del held[who], due[who]
        clock = state.getCurrentProcessingTimeMs() if wall else state.getCurrentWatermarkMs()
        for who in list(held):
            expire(who, clock * 1000)
        if held:
            state.update(packed([(*who, i, *tip) for who, tips in held.items() for i, tip in tips.items()]))
            first = min(due.values()) // 1000 + 1
            if wall:
                state.setTimeoutDuration(max(1, first - clock))
            else:
                state.setTimeoutTimestamp(max(first, clock + 1))
        elif state.exists:
            state.remove()
        if out:
            frame = pd.DataFrame(out, columns=["action_id", "service_id", "state", "settled_at", "debit", "credit", "coin_val"])
            yield frame.assign(settled_at=pd.to_datetime(frame["settled_at"], unit="us"))

    return run


def stream_expiry(log: DataFrame, settings: Settings = DEFAULT, clock: str = "wall", late: str = "0 seconds", parts: int = 16, groups: int = GROUPS) -> DataFrame:
    """Transitions of the held tips of a stream of commands, each once, as the tips end.

    ``log``: action_id, ts, service_id, type, state, from_user, to_user, coin_val; held tips are
    pending tips to a name. A recipient's next accept or decline at or after a tip and
    within its limit ends it, otherwise the limit does. ``clock``: ``wall`` ends tips
    when their limit has passed on the machine's clock, also on a silent input; ``event``
    when the watermark has passed it, ``late`` behind the latest event. A recipient's tips
    are dealt over ``parts``, so that one of many tips is not one group, and the parts over ``groups`` by hash. Events
    of one recipient are taken in order within a batch; a tip that is delivered again while
    it is held is one tip.
    """
    if clock not in ("wall", "event"):
        raise ValueError("clock is 'wall' or 'event'")
    wall = clock == "wall"
    events = _events(log, parts, groups)
    if not wall:
        events = events.withWatermark("ts", late)
    span = settings.expire_hours * 3600 * 1_000_000
    timeout = GroupStateTimeout.ProcessingTimeTimeout if wall else GroupStateTimeout.EventTimeTimeout
    raw = TRANSITION.replace("coin_val decimal(20,8)", "coin_val string")
    ended = events.groupBy("part").applyInPandasWithState(_ending(span, wall), raw, PACKED, "append", timeout)
    return ended.withColumn("coin_val", F.col("coin_val").cast("decimal(20,8)"))
