"""State machines over ordered events, one for each key.

What a window can say is a window. The rest folds: rows are dealt by key and sorted inside the partition, a small step
function walks over them with the key's state, and the state is carried from one Arrow batch to the next, so a key of
any length is never held in memory. A key's own order is sequential by nature; keys run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = [(0.95, "critical"), (0.8, "high"), (0.6, "elevated")]


def fold(rows: DataFrame, key: str, order: str, inputs: list[str], start: Callable[[], dict], step: Callable[..., dict], out: str) -> DataFrame:
    """``key``, ``order`` and the columns of ``out`` (DDL), which ``step(state, *inputs)`` gives for each row as a dict."""
    names = [part.split()[0] for part in out.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), {}
        for batch in batches:
            found: dict[str, list] = {n: [] for n in names}
            for k, *values in zip(batch[key], *(batch[c] for c in inputs), strict=True):
                if k != at:
                    at, state = k, start()
                got = step(state, *values)
                for n in names:
                    found[n].append(got[n])
            yield pd.DataFrame({key: batch[key], order: batch[order], **found})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (key, order))
    return rows.select(key, order, *inputs).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{kinds}, {out}")


def pressure(signals: DataFrame, *scope: str) -> DataFrame:
    """Sum of positive signals (reason, value) of each tick and scope, its level and the reason that adds most."""
    by = signals.where("value > 0").groupBy("tick", *scope, "reason").agg(F.sum("value").alias("v"))
    g = by.groupBy("tick", *scope).agg(F.sum("v").alias("total"), F.max_by("reason", F.struct("v", "reason")).alias("dominant"))
    level = F.lit("normal")
    for at, name in reversed(LEVELS):
        level = F.when(F.col("total") >= at, name).otherwise(level)
    return g.withColumn("level", level)


def debounced(rows: DataFrame, key: str, order: str, high: Column, up: int, down: int) -> DataFrame:
    """``state``: up after ``up`` high ticks in a row, down after ``down`` low ones, else as before (down at first).

    A run's length is the distance to the last tick of the other kind; the state is the last tick that decides.
    """
    upto = W.partitionBy(key).orderBy(order)
    n = F.row_number().over(upto)
    base = rows.withColumn("_high", high).withColumn("_n", n)
    since = lambda flag: F.col("_n") - F.coalesce(F.max(F.when(flag, F.col("_n"))).over(upto), F.lit(0))
    decided = F.when(since(~F.col("_high")) >= up, True).when(since(F.col("_high")) >= down, False)
    return base.withColumn("_d", decided).withColumn("state", F.coalesce(F.last("_d", ignorenulls=True).over(upto), F.lit(False))).drop("_high", "_n", "_d")


def leases(rows: DataFrame, key: str, order: str, tick: str, ttl: int) -> DataFrame:
    """``held``: whether the last of grant and revoke was a grant at most ``ttl`` ticks ago."""
    upto = W.partitionBy(key).orderBy(order)
    last = F.last(F.when(F.col("act").isin("grant", "revoke"), F.struct("act", tick)), ignorenulls=True).over(upto)
    return rows.withColumn("_l", last).withColumn("held", F.coalesce((F.col("_l.act") == "grant") & (F.col(tick) - F.col(f"_l.{tick}") <= ttl), F.lit(False))).drop("_l")


def admission(rows: DataFrame) -> DataFrame:
    verdict = F.when(F.col("level") == "critical", "reject_pressure").when(F.col("credits") <= 0, "reject_credit").when(F.col("deadline") < F.col("tick"), "reject_deadline").when(F.col("node").isNull(), "defer").otherwise("admit")
    return rows.withColumn("decision", verdict)


def eligible(jobs: DataFrame, panels: DataFrame) -> DataFrame:
    """The panels (panel, tags) whose tags hold all of a need (map of tags; distinct rows): tags are joined one by one and counted."""
    needs = jobs.withColumn("need", F.xxhash64(F.to_json("needs"))).select("need", "needs", F.explode("needs").alias("k", "v"))
    tags = panels.select("panel", F.explode("tags").alias("k", "v"))
    met = needs.join(tags, ["k", "v"]).groupBy("need", "panel").agg(F.count(F.lit(1)).alias("met"), F.first(F.size("needs")).alias("size"))
    return met.where("met = size").select("need", "panel")


def round_robin(jobs: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The slot (0 to n - 1) of each job in its key's turn."""
    return jobs.withColumn("slot", ((F.row_number().over(W.partitionBy(key).orderBy(order)) - 1) % n).cast("int"))


def token_bucket(rows: DataFrame, key: str, order: str, tick: str, cost: str, capacity: int, refill: int) -> DataFrame:
    """``accepted`` and ``tokens`` left: tokens grow by ``refill`` a tick up to capacity, an accepted row takes its cost; a tick that goes back is an error."""

    def step(s: dict, t: int, c: int) -> dict:
        if s["tick"] is not None and t < s["tick"]:
            return {"accepted": "tick_regression", "tokens": s["tokens"]}
        s["tokens"] = min(capacity, s["tokens"] + (0 if s["tick"] is None else (t - s["tick"]) * refill))
        s["tick"] = t
        ok = s["tokens"] >= c
        s["tokens"] -= c if ok else 0
        return {"accepted": "yes" if ok else "no", "tokens": s["tokens"]}

    return fold(rows, key, order, [tick, cost], lambda: {"tokens": capacity, "tick": None}, step, "accepted string, tokens long")


def epoch_budget(rows: DataFrame, key: str, order: str, unit: str, cost: str, budget: int) -> DataFrame:
    """``result``: units are taken greedily until the epoch's budget is spent; one that does not fit takes nothing, a repeated one is rejected.

    The units of one epoch that were accepted are remembered, which the budget bounds.
    """

    def step(s: dict, u: int, c: int) -> dict:
        if u in s["seen"]:
            return {"result": "duplicate", "spent": s["spent"]}
        if s["spent"] + c > budget:
            return {"result": "over", "spent": s["spent"]}
        s["seen"].add(u)
        s["spent"] += c
        return {"result": "taken", "spent": s["spent"]}

    return fold(rows, key, order, [unit, cost], lambda: {"seen": set(), "spent": 0}, step, "result string, spent long")


def capacity_gate(rows: DataFrame, key: str, order: str, dt: int, tu: int, backlog: int) -> DataFrame:
    """Rows (act, need_dt, need_tu): ``start`` takes capacity if both suffice, waits while the backlog has room, else is rejected; ``end`` gives back the oldest."""

    def step(s: dict, act: str, a: int, b: int) -> dict:
        if act == "start":
            if s["dt"] + a <= dt and s["tu"] + b <= tu:
                s["dt"], s["tu"], result = s["dt"] + a, s["tu"] + b, "run"
                s["running"].append((a, b))
            elif s["waiting"] < backlog:
                s["waiting"], result = s["waiting"] + 1, "wait"
            else:
                result = "reject"
        elif s["running"]:
            x, y = s["running"].pop(0)
            s["dt"], s["tu"], s["waiting"], result = s["dt"] - x, s["tu"] - y, max(0, s["waiting"] - 1), "release"
        else:
            result = "idle"
        return {"result": result, "used_dt": s["dt"], "used_tu": s["tu"]}

    return fold(rows, key, order, ["act", "need_dt", "need_tu"], lambda: {"dt": 0, "tu": 0, "waiting": 0, "running": []}, step, "result string, used_dt long, used_tu long")


def gear(rows: DataFrame, key: str, order: str, tick: str, load: str, top: int = 4, up: float = 0.8, down: float = 0.3, cooldown: int = 3, emergency: float = 0.97) -> DataFrame:
    """``gear``: straight to the top in an emergency; else one up above ``up`` or one down below ``down``, not within the cooldown of the last change."""

    def step(s: dict, t: int, x: float) -> dict:
        g = s["gear"]
        if x >= emergency:
            g = top
        elif s["at"] is None or t - s["at"] >= cooldown:
            g = min(top, g + 1) if x > up else max(1, g - 1) if x < down else g
        if g != s["gear"]:
            s["gear"], s["at"] = g, t
        return {"gear": g}

    return fold(rows, key, order, [tick, load], lambda: {"gear": 1, "at": None}, step, "gear int")


def top_gear_events(geared: DataFrame, top: int, *facts: str) -> DataFrame:
    """The samples at which the gear is the top one, each with an instant derived from its facts and gear alone (no clock)."""
    digest = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in (*facts, "gear"))), 256)
    return geared.where(F.col("gear") == top).withColumn("event", F.lit("PRESSURE_ENERGY")).withColumn("ts_hex", F.substring(digest, 1, 16))


def recent_duplicates(rows: DataFrame, key: str, order: str, print_: str, keep: int) -> DataFrame:
    """``duplicate``: whether the fingerprint is among the last ``keep`` different ones of its key, first in first out. Rows are tagged, not dropped."""

    def step(s: dict, p: str) -> dict:
        seen = s["seen"]
        if p in seen:
            return {"duplicate": True}
        seen[p] = None
        if len(seen) > keep:
            del seen[next(iter(seen))]
        return {"duplicate": False}

    return fold(rows, key, order, [print_], lambda: {"seen": {}}, step, "duplicate boolean")


def circuit(rows: DataFrame, key: str, order: str, tick: str, ok: str, failures: int = 3, rest: int = 5) -> DataFrame:
    """``circuit`` after each outcome: open after so many failures in a row, half_open once it has rested, closed by a success."""

    def step(s: dict, t: int, good: bool) -> dict:
        if s["state"] == "open" and t - s["at"] >= rest:
            s["state"] = "half_open"
        if s["state"] == "open":
            return {"circuit": "open"}
        s["bad"] = 0 if good else s["bad"] + 1
        if good:
            s["state"] = "closed"
        elif s["state"] == "half_open" or s["bad"] >= failures:
            s["state"], s["at"], s["bad"] = "open", t, 0
        return {"circuit": s["state"]}

    return fold(rows, key, order, [tick, ok], lambda: {"state": "closed", "bad": 0, "at": 0}, step, "circuit string")


def job_lifecycle(rows: DataFrame, key: str, order: str, tick: str, outcome: str, retries: int = 3, timeout: int = 50) -> DataFrame:
    """``state`` and ``due`` of a job after each report (ok, fail): retried with doubling delay, failed when retries or time run out, archived after."""

    def step(s: dict, t: int, what: str) -> dict:
        if s["state"] in ("done", "failed", "timed_out"):
            return {"state": "archived", "due": 0}
        s["first"] = t if s["first"] is None else s["first"]
        if t - s["first"] > timeout:
            s["state"], s["due"] = "timed_out", 0
        elif what == "ok":
            s["state"], s["due"] = "done", 0
        elif s["tries"] >= retries:
            s["state"], s["due"] = "failed", 0
        else:
            s["tries"] += 1
            s["state"], s["due"] = "retry", t + 2 ** s["tries"]
        return {"state": s["state"], "due": s["due"]}

    return fold(rows, key, order, [tick, outcome], lambda: {"state": "new", "tries": 0, "first": None, "due": 0}, step, "state string, due long")


def live_messages(rows: DataFrame, now: int, ttl: int, transit: int = 60) -> DataFrame:
    """Messages (sent, received) within their time to live whose transit did not take too long."""
    return rows.where((F.lit(now) - F.col("sent") <= ttl) & (F.col("received") - F.col("sent") <= transit))


def stage_faults(rows: DataFrame, key: str, stage: str, status: str) -> DataFrame:
    """Stages that began before the stage before them was complete."""
    before = F.lag(status).over(W.partitionBy(key).orderBy(stage))
    return rows.withColumn("_b", before).where((F.col(status) != "pending") & F.col("_b").isNotNull() & (F.col("_b") != "complete")).drop("_b")


def intake(rows: DataFrame) -> DataFrame:
    """quarantine for critical anomalies, review for any, clean else (anomalies: array of severities)."""
    return rows.withColumn("gate", F.when(F.exists("anomalies", lambda a: a == "critical"), "quarantine").when(F.size("anomalies") > 0, "review").otherwise("clean"))
