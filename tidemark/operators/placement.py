"""Who serves which partition: balanced and sticky assignment, repair, and the checks on plans.

Assignment itself is a small sequential problem (a few thousand partitions) and runs on the driver;
what scales with records or leases (loads, validity, movement) are DataFrame operators.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.log import VP


def score(*parts: object) -> int:
    """A stable 64-bit score of some values, for rendezvous."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def distinct_nodes(nodes: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Nodes by id, of one id the least address."""
    least: dict[str, str] = {}
    for node, address in nodes:
        least[node] = min(address, least.get(node, address))
    return sorted(least.items())


def inventory(topics: list[tuple[str, int]], writer: int) -> list[tuple[str, int]]:
    """The virtual partitions that belong to a writer: a stretch of each topic's."""
    return [(t, writer * n + k) for t, n in sorted(topics) for k in range(n)]


def balanced(partitions: list[tuple[str, int]], nodes: list[str]) -> dict[tuple[str, int], str]:
    """Partition by partition, of the nodes with the least load the one with the highest score; loads differ by one at most."""
    load = {n: 0 for n in sorted(set(nodes))}
    out = {}
    for topic, vp in sorted(set(partitions)):
        if not load:
            break
        low = min(load.values())
        node = min((n for n in load if load[n] == low), key=lambda n: (-score(topic, vp, n), n))
        out[topic, vp] = node
        load[node] += 1
    return out


def rendezvous_owner(keys: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """key..., owner: of all nodes the one with the highest hash of key and node, of equals the least id.

    nodes is a membership snapshot (its few rows are broadcast); each key sees each node once.
    """
    members = nodes.select("node_id").distinct().agg(F.sort_array(F.collect_list("node_id")).alias("__nodes"))
    scored = F.transform("__nodes", lambda n: F.struct((-F.xxhash64(*[F.col(k) for k in key], n)).alias("s"), n.alias("n")))
    return keys.join(F.broadcast(members)).select(*keys.columns, F.array_min(scored)["n"].alias("owner"))


def capacities(total: int, owners: list[str], preference: dict[str, int] | None = None, previous: dict[str, int] | None = None) -> dict[str, int]:
    """An equal share each; the remainder one by one to owners by preference, then by what they had most of, then id."""
    preference, previous = preference or {}, previous or {}
    order = sorted(set(owners), key=lambda o: (preference.get(o, 0), -previous.get(o, 0), o))
    if not order:
        return {}
    share, rest = divmod(total, len(order))
    return {o: share + (k < rest) for k, o in enumerate(order)}


def sticky(partitions: list[int], logical: int, members: list[str], previous: dict[int, str], preference: dict[str, int] | None = None) -> dict[int, str]:
    """Who gets which virtual partition of a topic, keeping what can stay.

    Partitions of one logical partition are a group. First each keeps its owner while there is
    room; then each group's rest goes to one owner whole if that owner has all of the group so
    far, else one by one to the emptiest.
    """
    vps, owners = sorted(set(partitions)), sorted(set(members))
    if not owners:
        return {}
    had = Counter(previous[v] for v in vps if previous.get(v) in owners)
    room = capacities(len(vps), owners, preference, had)
    groups = defaultdict(list)
    for v in vps:
        groups[v % logical].append(v)
    order = sorted(groups, key=lambda g: (-len(groups[g]), g))
    out: dict[int, str] = {}
    for g in order:
        for v in groups[g]:
            o = previous.get(v)
            if room.get(o, 0) > 0:
                out[v] = o
                room[o] -= 1
    for g in order:
        missing = [v for v in groups[g] if v not in out]
        inside = {out[v] for v in groups[g] if v in out}
        whole = next((o for o in owners if missing and room[o] >= len(missing) and inside <= {o}), None)
        for v in missing:
            o = whole or min((o for o in owners if room[o]), key=lambda o: (-room[o], o))
            out[v] = o
            room[o] -= 1
    return out


def pod_aware(partitions: list[int], logical: int, members: dict[str, str | None], previous: dict[int, str]) -> dict[int, str]:
    """Sticky by pod first, then by member within each pod; flat if any member's pod isn't known."""
    if not members or any(p is None for p in members.values()):
        return sticky(partitions, logical, list(members), previous)
    pods = defaultdict(list)
    for m, p in members.items():
        pods[p].append(m)
    weighted = [f"{p}\x1f{k}" for p in pods for k in range(len(pods[p]))]  # a slot for each member, so pods get shares by size
    slot_of = {m: f"{p}\x1f{k}" for p in pods for k, m in enumerate(sorted(pods[p]))}
    before = {v: slot_of[m] for v, m in previous.items() if m in slot_of}
    by_pod = defaultdict(list)
    for v, slot in sticky(partitions, logical, weighted, before).items():
        by_pod[slot.split("\x1f")[0]].append(v)
    out: dict[int, str] = {}
    for p, vps in by_pod.items():
        out |= sticky(vps, logical, pods[p], {v: m for v, m in previous.items() if m in pods[p]})
    return out


def quality(plan: dict[int, str], logical: int) -> tuple[int, int]:
    """How many groups are split, and by how much beyond two owners."""
    owners = defaultdict(set)
    for v, o in plan.items():
        owners[v % logical].add(o)
    return sum(len(o) > 1 for o in owners.values()), sum(max(0, len(o) - 2) for o in owners.values())


def repair(plan: dict[int, str], logical: int, percent: int) -> dict[int, str]:
    """Swaps that bring split groups together: for each one proposal, within a budget of moved partitions, if it is strictly better."""
    n = len(plan)
    budget = 0 if percent == 0 else min(n, max(2, n // 100 * percent + n % 100 * percent // 100))
    moved = 0
    for g in sorted({v % logical for v in plan}):
        mine = [v for v in sorted(plan) if v % logical == g]
        count = Counter(plan[v] for v in mine)
        if len(count) < 2:
            continue
        to = min(count, key=lambda o: (-count[o], o))
        trial, changed, done = dict(plan), 0, True
        for v in (v for v in mine if plan[v] != to):
            source = trial[v]
            whole = Counter((u % logical) for u in trial if trial[u] == to)
            size = Counter(u % logical for u in trial)
            at_source = Counter(u % logical for u in trial if trial[u] == source)
            back = [u for u in trial if trial[u] == to and u % logical != g]
            if not back:
                done = False
                break
            u = min(back, key=lambda u: (whole[u % logical] == size[u % logical], -at_source[u % logical], u))
            trial[v], trial[u] = to, source
            changed += 2
        if done and changed and moved + changed <= budget and quality(trial, logical) < quality(plan, logical):
            plan, moved = trial, moved + changed
    return plan


def balance_violations(plan: DataFrame, members: DataFrame) -> DataFrame:
    """topic, members, least, most, spread of topics whose loads differ by more than one. members: topic, member_id."""
    load = members.join(plan.groupBy("topic", "member_id").agg(F.count(F.lit(1)).alias("n")), ["topic", "member_id"], "left")
    out = load.groupBy("topic").agg(F.count(F.lit(1)).alias("members"), F.min(F.coalesce("n", F.lit(0))).alias("least"), F.max(F.coalesce("n", F.lit(0))).alias("most"))
    return out.withColumn("spread", F.col("most") - F.col("least")).where(F.col("spread") > 1)


def colocation(plan: DataFrame, logical: int) -> DataFrame:
    """For each logical partition: its virtual ones, its owners, and whether it has just one."""
    group = F.pmod("vp", F.lit(logical)).alias("logical")
    out = plan.groupBy("topic", group).agg(F.count(F.lit(1)).alias("vps"), F.count_distinct("member_id").alias("owners"))
    return out.withColumn("colocated", F.col("owners") == 1)


def movement(plan: DataFrame, previous: DataFrame, members: DataFrame) -> DataFrame:
    """How each topic's partitions moved: stayed, orphaned before, new, within a pod, across pods, or where a pod isn't known.

    members: member_id, pod_id; an owner that is no member any more left an orphan.
    """
    pods = members.select("member_id", "pod_id")
    out = plan.join(previous.select(*VP, F.col("member_id").alias("before")), VP, "left")
    out = out.join(F.broadcast(pods), "member_id", "left").join(F.broadcast(pods.select(F.col("member_id").alias("before"), F.col("pod_id").alias("pod_before"), F.lit(True).alias("alive"))), "before", "left")
    kind = (
        F.when(F.col("before").isNull(), "new")
        .when(F.col("before") == F.col("member_id"), "stayed")
        .when(F.col("alive").isNull(), "orphan")
        .when(F.col("pod_id").isNull() | F.col("pod_before").isNull(), "unknown_pod")
        .when(F.col("pod_id") == F.col("pod_before"), "within_pod")
        .otherwise("across_pods")
    )
    return out.groupBy("topic", kind.alias("movement")).agg(F.count(F.lit(1)).alias("partitions"))


def plan_violations(plan: DataFrame, partitions: DataFrame, members: DataFrame) -> DataFrame:
    """topic, vp, violation: partitions assigned twice, unknown, missing, or to no member. partitions: topic, vp; members: topic, member_id."""
    twice = plan.groupBy(*VP).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*VP, F.lit("assigned_twice").alias("violation"))
    unknown = plan.join(partitions, VP, "left_anti").select(*VP, F.lit("unknown_partition").alias("violation"))
    missing = partitions.join(plan, VP, "left_anti").select(*VP, F.lit("unassigned").alias("violation"))
    stranger = plan.join(F.broadcast(members), ["topic", "member_id"], "left_anti").select(*VP, F.lit("unknown_member").alias("violation"))
    return twice.unionByName(unknown).unionByName(missing).unionByName(stranger)
