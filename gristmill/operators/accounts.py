"""Tenants: provisioning, plan changes, settings and their audit trail, as folds over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.findings import first_wins

# Fixed values.
FREE, FREE_CAP = "free", 5.0
PAID, CHANGED = "transaction.completed", "subscription.updated"
DOWNGRADES = ("subscription.canceled", "transaction.payment_failed")
# End of fixed values.


def provisioned(events: DataFrame, orgs: DataFrame) -> DataFrame:
    """One row per installation of `events` (installation, seq, source_event): last_seen, whether its org is created, and the event that did it.

    The first event of an installation without an org (`orgs`: installation) creates it with the free
    plan, default settings and one audit row; further deliveries only move last_seen.
    """
    g = events.groupBy("installation").agg(F.max("seq").alias("last_seen"), F.min_by("source_event", "seq").alias("first_event"))
    known = orgs.select("installation").distinct().withColumn("_known", F.lit(True))
    joined = g.join(known, "installation", "left")
    created = F.col("_known").isNull()
    return joined.select("installation", "last_seen", created.alias("created"), F.when(created, FREE).alias("plan"), F.when(created, FREE_CAP).alias("cap_usd"), F.when(created, F.col("first_event")).alias("source_event"))


def plan_state(events: DataFrame, tiers: DataFrame) -> DataFrame:
    """State of each org after its events (org, seq, event, tier, customer, subscription): plan, cap_usd, customer, subscription.

    A payment sets plan, cap, customer and subscription; an update plan, cap and subscription; a
    cancelled or failed one falls back to the free plan and drops the subscription, but keeps the
    customer. So the last event decides all but the customer, which the last payment decides; other
    events don't count. `tiers`: tier, cap_usd.
    """
    counted = events.where(F.col("event").isin(PAID, CHANGED, *DOWNGRADES)).join(F.broadcast(tiers.select("tier", F.col("cap_usd").alias("_cap"))), "tier", "left")  # a handful of tiers
    down = F.col("event").isin(*DOWNGRADES)
    last = F.max_by(F.struct(F.when(down, FREE).otherwise(F.col("tier")).alias("plan"), F.when(down, FREE_CAP).otherwise(F.col("_cap")).alias("cap_usd"), F.when(~down, F.col("subscription")).alias("subscription")), "seq")
    paid = F.col("event") == PAID
    return counted.groupBy("org").agg(last.alias("s"), F.max_by(F.when(paid, F.col("customer")), F.when(paid, F.col("seq"))).alias("customer"), F.count("*").alias("audit_rows")).select("org", "s.*", "customer", "audit_rows")


def is_https(url: Column) -> Column:
    """Whether a trimmed URL is an https one with a host."""
    return F.trim(url).rlike(r"(?i)^https:/*[^\s/?#]+")


def hook_error(hook: Column) -> Column:
    """What is wrong with a hook URL, or null: none is needed."""
    return F.when(hook.isNotNull() & (hook != "") & ~is_https(hook), "slackWebhookUrl must be an https:// URL")


def settings_changes(old: DataFrame, new: DataFrame, key: str = "tenant") -> DataFrame:
    """key, fields: the settings that differ between `old` and `new` rows (severity, globs, enabled, hook), comma-joined in that order; tenants without a change are left out."""
    names = {"severity": "severityThreshold", "globs": "ignoredGlobs", "enabled": "enabledDetectors", "hook": "slackWebhookUrl"}
    joined = new.alias("n").join(old.alias("o"), key)
    moved = [F.when(~F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")), label) for c, label in names.items()]
    return joined.select(key, F.concat_ws(",", *moved).alias("fields")).where("fields <> ''")


def call_totals(calls: DataFrame, by: list[str], since: Column) -> DataFrame:
    """Per group calls, priced calls and cost since a snapshot (call number `seq` after `since`): a figure is measured where all calls are priced."""
    new = F.col("seq") > since
    g = calls.groupBy(*by).agg(F.count_if(new).alias("calls"), F.count_if(new & F.col("cost_usd").isNotNull()).alias("priced_calls"), F.coalesce(F.sum(F.when(new, F.col("cost_usd"))), F.lit(0)).alias("cost_usd"))
    return g.withColumn("measured", (F.col("calls") > 0) & (F.col("calls") == F.col("priced_calls")))


def failures_since(calls: DataFrame, by: list[str], since: Column) -> DataFrame:
    """Per group and reason the failed calls (seq, ok, reason) after a snapshot, beside all attempts after it."""
    new = calls.where(F.col("seq") > since)
    attempts = new.groupBy(*by).agg(F.count("*").alias("attempted"))
    return new.where("NOT ok").groupBy(*by, "reason").agg(F.count("*").alias("failed")).join(attempts, by)


def deadlines(runs: DataFrame, now: Column, minutes: int) -> DataFrame:
    """`runs` (started_at, finished_at) with the time left until their deadline, in seconds, and whether it passed unfinished."""
    left = F.unix_timestamp("started_at") + minutes * 60 - F.unix_timestamp(now)
    return runs.withColumns({"seconds_left": F.when(F.col("finished_at").isNull(), F.greatest(left, F.lit(0))), "expired": F.col("finished_at").isNull() & (left <= 0)})


def first_audit(audit: DataFrame) -> DataFrame:
    """One audit row per (org, action, delivery): repeated deliveries of one webhook don't repeat the trail."""
    return first_wins(audit, ["org", "action", "delivery"], ["seq"])


def deadline_outcomes(events: DataFrame, now: Column, deadline_s: int, grace_s: int) -> DataFrame:
    """run_id, outcome, at from events (run_id, ts, state: started or settled), as far as time has come.

    A run is settled, or timed_out at its deadline. Its slot is then released by a later settling, or leaked after the grace. The first start
    counts, and the first settling from it on; a settling at the very deadline is too late.
    """
    began = events.where("state = 'started'").groupBy("run_id").agg(F.min("ts").alias("start"))
    ended = events.where("state = 'settled'").join(began, "run_id").where("ts >= start").groupBy("run_id").agg(F.min("ts").alias("settled"))
    after = lambda s: F.col("start") + F.make_dt_interval(secs=F.lit(s))
    runs = began.join(ended, "run_id", "left").withColumns({"due": after(deadline_s), "last": after(deadline_s + grace_s)})
    row = lambda outcome, at, when: F.when(when, F.struct(F.lit(outcome).alias("outcome"), at.alias("at")))
    settled, due, last = F.col("settled"), F.col("due"), F.col("last")
    in_time = F.coalesce(settled < due, F.lit(False))
    rows = F.array_compact(F.array(row("settled", settled, in_time), row("timed_out", due, ~in_time), row("released", settled, (settled >= due) & (settled < last)), row("leaked", last, settled.isNull() | (settled >= last))))
    return runs.select("run_id", F.explode(rows).alias("r")).select("run_id", "r.*").where(F.col("at") <= now)
