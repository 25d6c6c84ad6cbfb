"""Lease state machines, folded over ordered command logs; and reports that join leases with plans.

A command log of one key is ordered and its outcome depends on all before, so each key is folded by
itself in one grouped function; keys are spread over tasks. Folds are plain classes, shared with
the streaming form.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.log import VP

LONG_MAX = 2**63 - 1


@dataclass
class ProducerLease:
    """Who may write a partition. Expired at the very instant of its expiry; a released row keeps what it reserved."""

    holder: str | None = None
    session: str | None = None
    epoch: int = 0
    expiry: int = 0
    max_seq: int | None = None

    def _reserve(self, size: int) -> tuple[str, int | None, int | None]:
        if size <= 0:
            return "InvalidSize", None, None
        start = 0 if self.max_seq is None else self.max_seq + 1
        if start + size - 1 > LONG_MAX:
            return "Overflow", None, None
        return "Ok", start, start + size - 1

    def apply(self, cmd: str, now: int, holder: str, session: str, duration: int, size: int | None) -> dict:
        status, start, end = "Ok", None, None
        own = (self.holder, self.session) == (holder, session)
        if cmd == "acquire":
            if self.epoch and self.expiry > now and not own:
                status = "HeldByOther"
            else:
                if size is not None:
                    status, start, end = self._reserve(size)
                if status == "Ok":
                    if not self.epoch or self.expiry <= now or self.session != session:
                        self.epoch += 1
                    self.holder, self.session, self.expiry = holder, session, now + duration
                    self.max_seq = self.max_seq if end is None else end
        elif not self.epoch or self.expiry <= now:
            status = "Expired"
        elif not own:
            status = "HeldByOther"
        elif cmd == "heartbeat":
            self.expiry = now + duration
        elif cmd == "reserve":
            status, start, end = self._reserve(size or 0)
            if status == "Ok":
                self.max_seq = end
        elif cmd == "release":
            self.expiry = now
        else:
            status = "UnknownCommand"
        return {"status": status, "epoch": self.epoch, "expiry_ms": self.expiry, "block_start": start, "block_end": end, "max_seq": self.max_seq}


@dataclass
class ConsumerLease:
    """Who may read a partition for a group. The cursor survives every change of owner."""

    owner: str | None = None
    generation: int = 0
    expiry: int = 0
    cursor: int | None = None
    graceful: bool = False
    known: bool = False

    def apply(self, cmd: str, now: int, owner: str, generation: int, duration: int, cursor: int | None) -> dict:
        status, transition = "Ok", None
        if cmd == "assign":
            if not self.known:
                transition = "Initial"
            elif self.expiry <= now:
                transition = "Retained" if self.owner == owner else "GracefulHandoff" if self.graceful else "ExpiryTakeover"
            elif self.owner != owner or generation < self.generation:
                status = "HeldByOther"
            else:
                transition = "Retained"
            if status == "Ok":
                self.owner, self.generation, self.expiry, self.graceful, self.known = owner, generation, now + duration, False, True
        elif not self.known or self.expiry <= now:
            status = "Expired"
        elif (self.owner, self.generation) != (owner, generation):
            status = "HeldByOther"
        elif cmd == "heartbeat":
            self.expiry = now + duration
            self.cursor = self.cursor if cursor is None else cursor
        elif cmd == "commit":
            self.cursor = cursor
        elif cmd == "release":
            self.expiry, self.graceful = now, True
        else:
            status = "UnknownCommand"
        return {"status": status, "transition": transition, "owner": self.owner, "generation": self.generation, "expiry_ms": self.expiry, "cursor": self.cursor}


@dataclass
class PlannerLease:
    """Who may publish a group's plan: held by member and session; a plan names its planner."""

    member: str | None = None
    session: str | None = None
    expiry: int = 0
    version: int = 0

    def apply(self, cmd: str, now: int, member: str, session: str, duration: int, planner: str | None) -> dict:
        own = (self.member, self.session) == (member, session)
        status = "Ok"
        if cmd == "acquire":
            if self.expiry > now and not own:
                status = "HeldByOther"
            else:
                self.member, self.session, self.expiry = member, session, now + duration
        elif cmd == "publish":
            if not own or self.expiry <= now or planner != member:
                status = "Rejected"
            else:
                self.version += 1
        else:
            status = "UnknownCommand"
        return {"status": status, "version": self.version, "expiry_ms": self.expiry}


def _none(value):
    return None if value is None or value != value else value


def _fold(events: DataFrame, keys: list[str], machine: type, arguments: list[str], schema: str) -> DataFrame:
    kinds = dict(events.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "ts_ms", "seq", "cmd"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts_ms", "seq"], kind="stable")
        state, out = machine(), []
        for r in rows.to_dict("records"):
            given = [_none(r[a]) for a in arguments]
            given = [int(x) if isinstance(x, float) else x for x in given]
            out.append({k: r[k] for k in [*keys, "ts_ms", "seq", "cmd"]} | state.apply(r["cmd"], int(r["ts_ms"]), *given))
        frame = pd.DataFrame(out)
        for c in frame.columns:
            if c in ("block_start", "block_end", "max_seq", "cursor"):
                frame[c] = frame[c].astype("Int64")
        return frame

    return events.groupBy(*keys).applyInPandas(run, f"{head}, {schema}")


def fold_producer_leases(events: DataFrame) -> DataFrame:
    """events: topic, vp, ts_ms, seq, cmd, holder, session, duration_ms, size. One result row each command."""
    return _fold(events, VP, ProducerLease, ["holder", "session", "duration_ms", "size"], "status string, epoch long, expiry_ms long, block_start long, block_end long, max_seq long")


def fold_consumer_leases(events: DataFrame) -> DataFrame:
    """events: topic, group_id, vp, ts_ms, seq, cmd, owner, generation, duration_ms, cursor_seq."""
    return _fold(
        events, ["topic", "group_id", "vp"], ConsumerLease, ["owner", "generation", "duration_ms", "cursor_seq"], "status string, transition string, owner string, generation long, expiry_ms long, cursor long"
    )


def fold_planner_leases(events: DataFrame) -> DataFrame:
    """events: topic, group_id, ts_ms, seq, cmd, member, session, duration_ms, planner."""
    return _fold(events, ["topic", "group_id"], PlannerLease, ["member", "session", "duration_ms", "planner"], "status string, version long, expiry_ms long")


def active(leases: DataFrame, now_ms: int) -> DataFrame:
    return leases.where(F.col("expiry_ms") > now_ms)


def lease_plan_report(leases: DataFrame, plan: DataFrame, now_ms: int) -> DataFrame:
    """Every leased partition with its desired owner, and planned ones that nobody leases.

    leases: topic, vp, owner, expiry_ms. plan: topic, vp, member_id.
    """
    out = leases.join(plan.withColumnRenamed("member_id", "desired"), VP, "full")
    live = F.coalesce(F.col("expiry_ms") > now_ms, F.lit(False))
    state = (
        F.when(F.col("owner").isNull(), "unleased")
        .when(F.col("desired").isNull(), "unplanned")
        .when(~live, "expired")
        .when(F.col("owner") == F.col("desired"), "settled")
        .otherwise("moving")
    )
    return out.select(*VP, "owner", "desired", live.alias("live"), state.alias("state"))


def claim_counts(results: DataFrame) -> DataFrame:
    return results.where(F.col("transition").isNotNull()).groupBy("topic", "transition").agg(F.count(F.lit(1)).alias("claims"))
