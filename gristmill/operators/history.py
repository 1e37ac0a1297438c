"""Scan history and spend: visibility, trends, budgets, and the state of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.findings import first_wins
from gristmill.runtime import small_side

# Fixed values.
STALE_MINUTES = 10
SWEEP_LIMIT = 20
WEEKS = 12
PENDING = ("pending", "running", "retrying")
CACHE_WRITE, CACHE_READ = 1.25, 0.10
ROUTE_CALLS, CALL_USD, FILE_SECONDS, CALL_SECONDS = 3, 0.012, 1.5, 3.8
SCANNED_ACTIONS = ("opened", "synchronize", "reopened")
NON_CODE_ACTIONS = (
    "assigned", "unassigned", "labeled", "unlabeled", "milestoned", "demilestoned", "locked", "unlocked", "review_requested", "review_request_removed",
    "auto_merge_enabled", "auto_merge_disabled", "enqueued", "dequeued", "converted_to_draft", "ready_for_review", "closed",
)
# End of fixed values.


def visible(runs: DataFrame, installation, repos: list) -> DataFrame:
    """Rows of one installation in the visible repositories; no repository, no rows."""
    return runs.where((F.col("installation") == F.lit(installation)) & F.col("repo").isin(*repos)) if repos else runs.limit(0)


def lookup(asked: DataFrame, runs: DataFrame, grants: DataFrame) -> DataFrame:
    """`asked` (ask, installation, run_id) with the run each may see, if any: of its installation, in a granted repository (installation, repo).

    The scope is part of the join, so a foreign run is as absent as a missing one.
    """
    g = grants.select("installation", "repo").distinct()
    return asked.join(runs.join(g, ["installation", "repo"], "left_semi"), ["installation", "run_id"])


def newest(runs: DataFrame, n: int = 100) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id").limit(n)


def oldest_unfinished(runs: DataFrame, before: Column, n: int = SWEEP_LIMIT) -> DataFrame:
    return runs.where(F.col("finished_at").isNull() & (F.col("started_at") < before)).orderBy("started_at", "run_id").limit(n)


def weekly(runs: DataFrame, by: list[str], last: Column, weeks: int = WEEKS) -> DataFrame:
    """Scans and findings per UTC week (Monday), exactly `weeks` rows per group up to the week of `last`, zeros where nothing ran."""
    end = F.date_trunc("week", last)
    start = end - F.expr(f"make_interval(0, 0, {weeks - 1})")
    week = F.date_trunc("week", F.col("started_at"))
    found = runs.where((week >= start) & (week <= end)).groupBy(*by, week.alias("week")).agg(F.count("*").alias("scans"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))
    grid = runs.select(*by).distinct().withColumn("week", F.explode(F.sequence(start, end, F.expr("interval 7 days"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.join(found, [*by, "week"], "left").select(*by, "week", zero("scans"), zero("findings"))


def spend_since(ledger: DataFrame, by: list[str], now: Column) -> DataFrame:
    """Month-to-date and day-to-date spend at `now`, UTC boundaries."""
    month, day = F.date_trunc("month", now), F.date_trunc("day", now)
    within = lambda start: F.coalesce(F.sum(F.when((F.col("recorded_at") >= start) & (F.col("recorded_at") <= now), F.col("cost_usd"))), F.lit(0))
    return ledger.groupBy(*by).agg(within(month).alias("month_usd"), within(day).alias("day_usd"))


def priced_rows(ledger: DataFrame) -> DataFrame:
    """Ledger rows worth recording: a finite cost above zero."""
    return ledger.where(~F.isnan(F.col("cost_usd").cast("double")) & (F.col("cost_usd") > 0) & (F.col("cost_usd").cast("double") < float("inf")))


def org_summary(orgs: DataFrame, ledger: DataFrame, since: Column) -> DataFrame:
    """Every org with its spend since a time and in all, 0 without rows. The ledger is summed before the join."""
    sums = ledger.groupBy("org_id").agg(F.sum(F.when(F.col("recorded_at") >= since, F.col("cost_usd"))).alias("recent"), F.sum("cost_usd").alias("total"), F.count("*").alias("rows"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return orgs.join(sums, "org_id", "left").withColumns({"recent": zero("recent"), "total": zero("total"), "rows": zero("rows")})


def ordered_lookup(ids: DataFrame, orgs: DataFrame) -> DataFrame:
    """The given ids (ord, org_id) in their order, with defaults where an org is unknown."""
    o = orgs.select("org_id", "plan", "cap_usd", "spent_usd")
    joined = ids.join(o, "org_id", "left")
    return joined.select("ord", "org_id", F.coalesce("plan", F.lit("free")).alias("plan"), F.coalesce("cap_usd", F.lit(5.0)).alias("cap_usd"), F.coalesce("spent_usd", F.lit(0.0)).alias("spent_usd"))


def budget_state(spent: Column, cap: Column) -> Column:
    ratio = spent / cap
    return F.when(cap <= 0, "no_cap").when(ratio >= 1, "exceeded").when(ratio >= 0.8, "warning").otherwise("ok")


def running_spend(ledger: DataFrame, by: list[str], tie: str) -> DataFrame:
    """Cumulative spend within each group's month, in time order."""
    w = Window.partitionBy(*by, F.date_trunc("month", "recorded_at")).orderBy("recorded_at", tie).rowsBetween(Window.unboundedPreceding, 0)
    return ledger.withColumn("running_usd", F.sum("cost_usd").over(w))


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """`calls` with cost_usd from `prices` (model, input_usd, output_usd per million tokens); unknown models cost 0."""
    p = prices.select("model", "input_usd", "output_usd")
    p = small_side(p, p.count())  # calls are not dealt by their few models
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cost = (zero("input_tokens") + zero("cache_write_tokens") * CACHE_WRITE + zero("cache_read_tokens") * CACHE_READ) * F.col("input_usd") + zero("output_tokens") * F.col("output_usd")
    return calls.join(p, "model", "left").withColumn("cost_usd", F.coalesce(cost / 1_000_000, F.lit(0.0))).drop("input_usd", "output_usd")


def scan_estimate(files: Column, route_files: Column, detectors: int = 6) -> tuple[Column, Column, Column]:
    """(expected, worst) cost in dollars, and seconds, of scanning so many files."""
    expected = route_files * ROUTE_CALLS * CALL_USD
    return expected, expected + files * ROUTE_CALLS * CALL_USD, files * (FILE_SECONDS + detectors * CALL_SECONDS)


def newer_run(runs: DataFrame, by: list[str]) -> DataFrame:
    """`runs` with `superseded`: whether a run of the same group (installation, repository and pull request) started later.

    Latest starts are combined before they are joined back; no task holds a group's runs.
    """
    latest = runs.groupBy(*by).agg(F.max("started_at").alias("_latest"))
    return runs.join(latest, by).withColumn("superseded", F.col("_latest") > F.col("started_at")).drop("_latest")


def sweep(runs: DataFrame, now: Column, by: list[str], limit: int | None = SWEEP_LIMIT) -> DataFrame:
    """Decisions for the oldest unfinished runs that are stale: superseded, abandoned or retry."""
    latest = runs.groupBy(*by).agg(F.max("started_at").alias("_latest"))
    stale = runs.where(F.col("finished_at").isNull() & F.col("status").isin(*PENDING) & (F.col("started_at") < now - F.expr(f"interval {STALE_MINUTES} minutes")))
    listed = stale.orderBy("started_at", "run_id").limit(limit) if limit else stale
    joined = listed.join(latest, by)
    return joined.withColumn("decision", F.when(F.col("_latest") > F.col("started_at"), "superseded").when(F.col("status") == "retrying", "abandoned").otherwise("retry")).drop("_latest")


def fold_states(events: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """Final state of each run from its ordered events (state): only legal transitions count.

    The first event opens a run as pending; running needs pending; retrying needs pending or
    running; a final state needs an unfinished run, and nothing follows it. What precedes the first
    final event decides: running counts before any retrying only, so each is a minimum of an order.
    """
    final = ~F.col("state").isin(*PENDING)
    at = lambda cond: F.min(F.when(cond, F.col(order)))
    g = events.groupBy(run).agg(at(final).alias("_final"), F.min_by(F.when(final, F.col("state")), F.when(final, F.col(order))).alias("_state"), at(F.col("state") == "running").alias("_run"), at(F.col("state") == "retrying").alias("_retry"), F.count("*").alias("events"))
    state = F.when(F.col("_final").isNotNull(), F.col("_state")).when(F.col("_retry").isNotNull(), "retrying").when(F.col("_run").isNotNull(), "running").otherwise("pending")
    return g.select(run, state.alias("state"), "events")


def outcome(status: Column, covered: Column, input_degraded: Column, calls_failed: Column, detectors_failed: Column) -> tuple[Column, Column]:
    """(status, code) of a run from its workflow: refusals, then failure before detection, then coverage."""
    refused = status.isin("budget_exceeded", "budget_unverifiable", "spend_unrecordable")
    dead = ~covered & (status == "failed")
    degraded = input_degraded | (calls_failed > 0) | (detectors_failed > 0)
    return F.when(refused, "skipped").when(dead, "failed").when(degraded, "incomplete").otherwise("completed"), F.when(refused, status).when(dead, "scan_failed").when(degraded, "coverage_degraded")


def first_deliveries(deliveries: DataFrame, key: str = "delivery_id", order: list[str] | None = None) -> DataFrame:
    """One row per delivery id, the first; rows without an id never collide."""
    known = first_wins(deliveries.where(F.col(key).isNotNull()), [key], order or ["ts"])
    return known.unionByName(deliveries.where(F.col(key).isNull()))


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of `incoming` whose key is not there yet, of several with one key the first: an insert that ignores conflicts."""
    return first_wins(incoming, [key], order).join(existing.select(key).distinct(), key, "left_anti")


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: str, seen: str) -> DataFrame:
    """One row per key, with the latest `seen`: what a merge leaves."""
    both = existing.unionByName(incoming)
    return both.groupBy(key).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def once_per_month(events: DataFrame, by: list[str], ts: str, tie: str) -> DataFrame:
    """The first event of each group and UTC month: claims that are made once."""
    month = F.date_trunc("month", ts)
    first = events.groupBy(*by, month.alias("month")).agg(F.min(F.struct(ts, tie)).alias("f"))
    return first.select(*by, "month", F.col(f"f.{ts}").alias(ts), F.col(f"f.{tie}").alias(tie))


def action_decision(payload: Column) -> tuple[Column, Column]:
    """(scan, reason) for an event payload (JSON): which actions are scanned, and why others are not."""
    action = F.get_json_object(payload, "$.action")
    base = F.get_json_object(payload, "$.changes.base").startswith("{")
    edited = action == "edited"
    scan = F.coalesce(action.isin(*SCANNED_ACTIONS) | (edited & F.coalesce(base, F.lit(False))), F.lit(False))
    reason = F.when(scan, None).when(action.isNull(), "action_missing").when(edited, "edited_without_base_change").when(action.isin(*NON_CODE_ACTIONS), "action_not_scanned").otherwise("action_unrecognized")
    return scan, reason


def verify_tokens(presented: DataFrame, tokens: DataFrame) -> DataFrame:
    """`presented` (token) with `accepted`: its SHA-256 is stored and not revoked."""
    good = tokens.where("revoked_at IS NULL").select("token_hash").distinct().withColumn("_ok", F.lit(True))
    hashed = presented.withColumn("token_hash", F.sha2("token", 256))
    return hashed.join(good, "token_hash", "left").withColumn("accepted", F.coalesce("_ok", F.lit(False))).drop("_ok")


def ledger_rows(nested: DataFrame) -> DataFrame:
    """installation, recorded_at (noon UTC), cost_usd from a map installation -> (day -> amount); bad days and amounts go."""
    days = nested.select(F.explode("ledger").alias("installation", "days")).select("installation", F.explode("days").alias("day", "amount"))
    at = F.try_to_timestamp(F.concat(F.col("day"), F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss"))
    cost = F.expr("try_cast(amount AS double)")
    return days.select("installation", at.alias("recorded_at"), cost.alias("cost_usd")).where("recorded_at IS NOT NULL AND cost_usd > 0 AND NOT isnan(cost_usd) AND cost_usd < double('infinity')")
