"""Statistics of repeated and paired scan experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import wilson
from gristmill.operators.findings import first_wins

# Fixed values.
CLASSES = tuple(f"{a}-{c}" for a in ("vulnerable", "safe") for c in ("high", "medium", "low"))
PAIR_HIT, PAIR_FAIL, NOISE = 4, 1, 3
GATE_RUNS, GATE_ACCEPTED, GATE_HITS, CLEAN_TENTHS = 5, 8, 4, 3
MOST_FIX_HITS, CLEAN_RUNS = 1, 4
WINDOW_SLACK = 20
# End of fixed values.


def verdict_bucket() -> Column:
    """Class of a run (reason, is_vulnerable, confidence, judged): pre-filtered, no-verdict, unclassified or one of six."""
    confidence = F.lower("confidence")
    known = F.col("is_vulnerable").isNotNull() & confidence.isin("high", "medium", "low")
    side = F.when(F.col("is_vulnerable"), "vulnerable").otherwise("safe")
    return F.when(F.col("reason").isNotNull(), "pre-filtered").when(~F.col("judged"), "no-verdict").when(F.coalesce(known, F.lit(False)), F.concat_ws("-", side, confidence)).otherwise("unclassified")


def census(runs: DataFrame) -> DataFrame:
    """bucket, runs, not_emitted: every run counted once; asserted runs that were not flagged."""
    asserted = F.coalesce(F.col("is_vulnerable"), F.lit(False)) & ~F.col("flagged")
    return runs.withColumn("bucket", verdict_bucket()).groupBy("bucket").agg(F.count("*").alias("runs"), F.count_if(asserted & F.col("judged")).alias("not_emitted"))


def masked_negatives(runs: DataFrame) -> DataFrame:
    """Negative fixtures that some run asserted: how often, in which classes, and how often that was not emitted."""
    asserted = F.coalesce(F.col("is_vulnerable"), F.lit(False)) & F.col("judged")
    g = runs.where(~F.col("is_positive")).withColumn("bucket", verdict_bucket()).groupBy("fixture").agg(F.count_if(asserted).alias("asserted_runs"), F.count("*").alias("total_runs"), F.array_join(F.array_sort(F.collect_set(F.when(asserted, F.col("bucket")))), ",").alias("classes"), F.count_if(asserted & ~F.col("flagged")).alias("not_emitted"))
    return g.where("asserted_runs > 0")


def negative_score(runs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Per negative fixture clean, excused and violating runs, given the classes each may show (fixture, bucket)."""
    asserted = F.coalesce(F.col("is_vulnerable"), F.lit(False)) & F.col("judged")
    rows = runs.where(~F.col("is_positive")).withColumn("bucket", verdict_bucket()).withColumn("asserted", asserted)
    joined = rows.join(allowed.withColumn("_ok", F.lit(True)), ["fixture", "bucket"], "left")
    return joined.groupBy("fixture").agg(F.count_if(~F.col("asserted")).alias("clean"), F.count_if(F.col("asserted") & F.col("_ok").isNotNull()).alias("excused"), F.count_if(F.col("asserted") & F.col("_ok").isNull()).alias("violations"))


def stability(runs: DataFrame) -> DataFrame:
    """Per fixture K of N: a positive is stable if flagged in N - 1 runs at least, a negative if clean in all."""
    g = runs.groupBy("fixture", "is_positive").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged_runs"))
    ok = F.when(F.col("is_positive"), F.col("flagged_runs") >= F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.col("flagged_runs") == 0)
    return g.withColumn("stable", ok)


def need(n: Column) -> Column:
    """Four fifths, rounded up."""
    return F.ceil(n * 4 / 5)


def paired(runs: DataFrame) -> DataFrame:
    """Per (set, case, path) from runs (side, emitted, complete): hit if the parent is flagged often and the fix seldom."""
    side = lambda s, c: F.count_if((F.col("side") == s) & c)
    g = runs.groupBy("set", "case", "path").agg(side("parent", F.lit(True)).alias("parent_runs"), side("fix", F.lit(True)).alias("fix_runs"), side("parent", F.col("emitted")).alias("parent_emits"), side("fix", F.col("emitted")).alias("fix_emits"), F.bool_and("complete").alias("complete"))
    hit = F.col("complete") & (F.col("parent_runs") > 0) & (F.col("fix_runs") > 0) & (F.col("parent_emits") >= need(F.col("parent_runs"))) & (F.col("fix_emits") <= F.col("fix_runs") - need(F.col("fix_runs")))
    return g.withColumn("hit", hit)


def paired_label(pairs: DataFrame, clean_flags: Column) -> DataFrame:
    """Per set: cases hit (any path), and PASS, FAIL or INCONCLUSIVE; noise above a few clean flags."""
    cases = pairs.groupBy("set", "case").agg(F.max("hit").alias("hit"))
    g = cases.groupBy("set").agg(F.count("*").alias("cases"), F.count_if("hit").alias("hits"))
    return g.withColumn("label", F.when(F.col("hits") >= PAIR_HIT, "PASS").when(F.col("hits") <= PAIR_FAIL, "FAIL").otherwise("INCONCLUSIVE")).withColumn("noisy", clean_flags > NOISE)


def planned_scores(targets: DataFrame, verdicts: DataFrame, n: int, by: list[str]) -> DataFrame:
    """Per series (`by`) the scores of `targets` (by, set, case, side, path) that were to be judged `n` times each, from `verdicts` (the same, run, emitted).

    A target counts by the runs that were planned, not by those that came: a parent with its fix is a hit only
    if both have all of theirs. A series in which a target lacks runs, or has too many, is INCOMPLETE.
    """
    enough = -(-4 * n // 5)
    place = [*by, "set", "case", "path"]
    got = verdicts.groupBy(*place, "side").agg(F.count("*").alias("_runs"), F.count_if("emitted").alias("_emits"))
    per = targets.select(*place, "side").join(got, [*place, "side"], "left").fillna(0, ["_runs", "_emits"])
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    flagged = lambda c: F.count_if(c & (F.col("_emits") >= enough))
    files = per.groupBy(*place).agg(
        side("parent", "_runs").alias("_parent"), side("parent", "_emits").alias("_hits"), side("fix", "_runs").alias("_fix"), side("fix", "_emits").alias("_again"),
        F.bool_and(F.col("_runs") == n).alias("_whole"), flagged(F.col("set") == "clean").alias("_clean"), flagged(F.col("side") == "fix").alias("_fixed"),
    )
    hit = F.coalesce((F.col("_parent") == n) & (F.col("_fix") == n) & (F.col("_hits") >= enough) & (F.col("_again") <= n - enough), F.lit(False))
    held = (F.col("set") == "held-out") & F.col("_parent").isNotNull()
    cases = files.groupBy(*by, "set", "case").agg(F.bool_or(held).alias("_held"), F.bool_or(held & hit).alias("_hit"), F.bool_and("_whole").alias("_whole"), F.sum("_clean").alias("_clean"), F.sum("_fixed").alias("_fixed"))
    g = cases.groupBy(*by).agg(F.bool_and("_whole").alias("complete"), F.count_if("_held").alias("cases"), F.count_if("_hit").alias("hits"), F.sum("_clean").alias("clean_flags"), F.sum("_fixed").alias("fix_flags"))
    recall = F.when(~F.col("complete"), "INCOMPLETE").when(F.col("hits") >= PAIR_HIT, "PASS").when(F.col("hits") <= PAIR_FAIL, "FAIL").otherwise("INCONCLUSIVE")
    noise = F.when(~F.col("complete"), "INCOMPLETE").when(F.col("clean_flags") > NOISE, "TOO NOISY").otherwise("ok")
    return g.withColumns({"recall": recall, "noise": noise})


def case_scores(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """`cases` (set, case, accepted, has_fix) with their runs (set, case, state, hit, voided, unreviewable) scored.

    Five runs a state make a case complete. It is hit if it was accepted, is complete, has a fix side,
    and at least four vulnerable and at most one fix run hit; voided runs never hit.
    """
    of = lambda state, cond: F.count_if((F.col("state") == state) & cond)
    live = F.col("hit") & ~F.col("voided")
    g = runs.groupBy("set", "case").agg(
        of("vulnerable", F.lit(True)).alias("vulnerable_runs"), of("fix", F.lit(True)).alias("fix_runs"), of("vulnerable", live).alias("vulnerable_hits"), of("fix", live).alias("fix_hits"),
        F.count_if(F.col("voided") & F.col("state").isin("vulnerable", "fix")).alias("voided"), F.count_if(F.col("unreviewable") & F.col("state").isin("vulnerable", "fix")).alias("unreviewable"),
    )
    counted = ["vulnerable_runs", "fix_runs", "vulnerable_hits", "fix_hits", "voided", "unreviewable"]
    joined = cases.join(g, ["set", "case"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counted})
    complete = (F.col("vulnerable_runs") == GATE_RUNS) & (~F.col("has_fix") | (F.col("fix_runs") == GATE_RUNS))
    hit = F.col("accepted") & complete & F.col("has_fix") & (F.col("vulnerable_hits") >= PAIR_HIT) & (F.col("fix_hits") <= MOST_FIX_HITS)
    return joined.withColumns({"complete": complete, "hit": hit})


def clean_scores(planned: DataFrame, runs: DataFrame) -> DataFrame:
    """`planned` clean changes (case) with runs (case, any_finding, voided, unreviewable): flagged if four of exactly five runs found something."""
    g = runs.groupBy("case").agg(F.count("*").alias("runs"), F.count_if(F.col("any_finding") & ~F.col("voided")).alias("flagged_runs"), F.count_if("unreviewable").alias("unreviewable"))
    joined = planned.join(g, "case", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("runs", "flagged_runs", "unreviewable")})
    return joined.withColumn("flagged", (F.col("runs") == GATE_RUNS) & (F.col("flagged_runs") >= CLEAN_RUNS))


def gate_label(accepted: Column, hits: Column, clean_flags: Column, planned_clean: Column, voided: Column, complete: Column) -> Column:
    """Label of a series: precondition, then a voided series, then missing runs, then hits and at most three tenths of the clean changes flagged."""
    passed = (hits >= GATE_HITS) & (clean_flags <= F.floor(planned_clean * CLEAN_TENTHS / 10))
    return (
        F.when(accepted < GATE_ACCEPTED, "AGENTIC-PRECONDITION-FAILED")
        .when(voided, "AGENTIC-STOP")
        .when(~complete, "AGENTIC-INCOMPLETE")
        .when(passed, "AGENTIC-CONTINUE")
        .otherwise("AGENTIC-STOP")
    )


def proxy_label(complete: Column, passes: Column, hits: Column) -> Column:
    """Label of a proxy series from its recall: only five passes are labelled; fewer complete ones are preliminary."""
    return (
        F.when(~complete, "PROXY-INCOMPLETE").when(passes != GATE_RUNS, "PROXY-PRELIMINARY").when(hits >= PAIR_HIT, "PROXY-PASS").when(hits <= PAIR_FAIL, "PROXY-FAIL").otherwise("PROXY-INCONCLUSIVE")
    )


def window_scores(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Per case from findings (case, side, path, line, family) and hunks (case, side, path, first, last, family):
    registered if the parent has a finding of the family within one of the parent's hunks or 20 lines of it;
    discriminating if the fix has none within the fix's own hunks. Repeated findings are combined before the join."""
    once = findings.select("case", "side", "path", "line", "family").distinct()
    near = once.join(hunks, ["case", "side", "path", "family"]).where(F.col("line").between(F.col("first") - WINDOW_SLACK, F.col("last") + WINDOW_SLACK))
    hit = near.groupBy("case").agg(F.bool_or(F.col("side") == "parent").alias("p"), F.bool_or(F.col("side") == "fix").alias("x"))
    every = hunks.select("case").distinct()
    false = lambda c: F.coalesce(c, F.lit(False))
    return every.join(hit, "case", "left").select("case", false("p").alias("registered"), (false("p") & ~false("x")).alias("discriminating"))


def precision_recall(rows: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    """Counts, precision, recall and their Wilson bounds."""
    g = rows.groupBy(*by).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    tp, flagged, real = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    bound = lambda n, upper: F.round(wilson(tp, n, upper), 6)
    return g.withColumns({"precision": ratio(tp, flagged), "recall": ratio(tp, real), "precision_low": bound(flagged, False), "precision_high": bound(flagged, True)})


def specificity(hits: DataFrame, marker: Column) -> DataFrame:
    """Per pattern: files and hits, and the share of both in files without the marker."""
    g = hits.groupBy("pattern_id").agg(F.countDistinct("path").alias("files"), F.countDistinct(F.when(~marker, F.col("path"))).alias("spurious_files"), F.count("*").alias("hits"), F.count_if(~marker).alias("spurious_hits"))
    return g.withColumn("spurious_share", F.round(F.col("spurious_files") / F.col("files"), 6))


def reach(repos: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: repositories and files, those with at least one pair, and the Wilson interval of the repository share."""
    hit = pairs.select("repo", "path").distinct().withColumn("_hit", F.lit(True))
    files = repos.join(hit, ["repo", "path"], "left").groupBy("repo").agg(F.count("*").alias("files"), F.count("_hit").alias("hit_files"))
    g = files.agg(F.count("*").alias("repos"), F.sum("files").alias("files"), F.count_if(F.col("hit_files") > 0).alias("hit_repos"), F.sum("hit_files").alias("hit_files"))
    return g.withColumn("low", F.round(wilson(F.col("hit_repos"), F.col("repos"), False), 6)).withColumn("high", F.round(wilson(F.col("hit_repos"), F.col("repos"), True), 6))


def neighbours(hits: DataFrame, near: int) -> DataFrame:
    """path and whether one of its sources lies within `near` lines of a sink. The closest two are next to each other among the lines that have either."""
    role = lambda r: F.bool_or(F.col("role") == r)
    lines = hits.groupBy("path", "line").agg(role("source").alias("source"), role("sink").alias("sink"))
    after = lambda c: F.lead(c).over(Window.partitionBy("path").orderBy("line"))
    beside = (after("line") - F.col("line") <= near) & ((F.col("source") & after("sink")) | (F.col("sink") & after("source")))
    met = lines.select("path", (F.col("source") & F.col("sink")).alias("both"), F.coalesce(beside, F.lit(False)).alias("beside"))
    return met.groupBy("path").agg(F.bool_or(F.col("both") | F.col("beside")).alias("predicted"))


def reach_outcomes(files: DataFrame, hits: DataFrame, pairs: DataFrame, near: int) -> DataFrame:
    """Every file of `files` (repo, path, error) with its outcome: failed, both, predicted only, real only or none; and the source of its first pair.

    Real are the engine's `pairs`; predicted is a second reading of `hits` that shares no step with them
    (`neighbours`). A file that could not be read is named as failed: it is no file without findings.
    """
    real = pairs.groupBy("path").agg(F.min_by("source_id", "pair_index").alias("source_id"))
    seen = real.join(neighbours(hits, near), "path", "full")
    predicted, found = F.coalesce("predicted", F.lit(False)), F.col("source_id").isNotNull()
    outcome = F.when(F.col("error").isNotNull(), "failed").when(predicted & found, "both").when(predicted, "predicted only").when(found, "real only").otherwise("none")
    return files.join(seen, "path", "left").select("repo", "path", "error", outcome.alias("outcome"), "source_id")


def reach_totals(outcomes: DataFrame) -> DataFrame:
    """One row of `reach_outcomes`: repositories and files, those reached, read failures, disagreements, the Wilson interval of the repository share, and whether the number may be trusted."""
    hit, odd = F.col("outcome").isin("both", "real only"), F.col("outcome").isin("predicted only", "real only")
    repos = outcomes.groupBy("repo").agg(F.count("*").alias("files"), F.count_if(hit).alias("hit"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(odd).alias("odd"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    g = repos.agg(F.count("*").alias("repos"), zero("files").alias("files"), F.count_if(F.col("hit") > 0).alias("hit_repos"), zero("hit").alias("hit_files"), zero("failed").alias("failed"), zero("odd").alias("disagreements"))
    bound = lambda upper: F.round(wilson(F.col("hit_repos"), F.col("repos"), upper), 6)
    return g.withColumns({"low": bound(False), "high": bound(True), "agreed": F.col("disagreements") == 0})


def draw(rows: DataFrame, seed: str, key: Column, by: list[str], n: int) -> DataFrame:
    """The first `n` of each group in the order of SHA-256(seed and key): the same draw everywhere."""
    keyed = rows.withColumn("draw_key", F.sha2(F.concat(F.lit(seed), key), 256))
    return keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("draw_key"))).where(F.col("rank") <= n)


def stratified(rows: DataFrame, key: str, strata: list[str], n: int) -> DataFrame:
    """At most `n` of each stratum in the order of `key`, interleaved: first ones of all strata, then second ones; a key counts in its first stratum.

    `position` keeps that order in the rows: a rank's rows are numbered apart (one a stratum) and shifted by the counts of earlier ranks (`n` rows).
    """
    once = first_wins(rows, [key], strata)
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(*strata).orderBy(key))).where(F.col("rank") <= n)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = ranked.groupBy("rank").agg(F.count("*").alias("_n")).select("rank", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("rank").orderBy(*strata))
    return ranked.withColumn("_in", inside).join(F.broadcast(earlier), "rank").withColumn("position", F.col("_before") + F.col("_in")).drop("_before", "_in").orderBy("position")


def selection_tally(rows: DataFrame, key: str, strata: list[str], n: int, reason: Column) -> DataFrame:
    """Per stratum how many `rows` were kept by `stratified`, and how many were not and why: their `reason` (null for none), repeated keys, or more than `n`."""
    named = rows.withColumn("outcome", reason)
    refused = named.where("outcome IS NOT NULL").groupBy(*strata, "outcome").agg(F.count("*").alias("n"))
    fit = named.where("outcome IS NULL").drop("outcome")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in strata]
    once = first_wins(fit, [key], strata).groupBy(*strata).agg(F.count("*").alias("_once"))
    counts = fit.groupBy(*strata).agg(F.count("*").alias("_all")).alias("a").join(once.alias("b"), same, "left").select(*(f"a.{c}" for c in strata), "_all", F.coalesce("_once", F.lit(0)).alias("_once"))
    fates = {"kept": F.least("_once", F.lit(n)), "repeated": F.col("_all") - F.col("_once"), "surplus": F.greatest(F.col("_once") - n, F.lit(0))}
    told = counts.select(*strata, F.explode(F.array(*(F.struct(F.lit(k).alias("outcome"), v.cast("long").alias("n")) for k, v in fates.items()))).alias("x")).select(*strata, "x.outcome", "x.n")
    return told.where("n > 0").unionByName(refused)


def ablation(files: DataFrame, segments: list[str]) -> DataFrame:
    """Per path segment over (commit, path): commits that touch it, that it removes whole, and that only it removes.

    Each file is a bit mask of the segments in its path; a commit is removed if every file has a bit.
    """
    parts = F.split("path", "/")
    mask = F.lit(0)
    for i, s in enumerate(segments):
        mask = mask.bitwiseOR(F.when(F.array_contains(parts, s), F.lit(1 << i)).otherwise(F.lit(0)))
    commits = files.withColumn("mask", mask).groupBy("commit").agg(F.bit_or("mask").alias("any"), F.bit_and("mask").alias("all"), F.bool_and(F.col("mask") != 0).alias("removed"), F.collect_set("mask").alias("masks"))
    bit = lambda c, i: c.bitwiseAND(F.lit(1 << i)) != 0
    rows = [F.struct(F.lit(s).alias("segment"), bit(F.col("any"), i).alias("touches"), bit(F.col("all"), i).alias("alone"), (F.col("removed") & F.array_contains("masks", 1 << i)).alias("unique")) for i, s in enumerate(segments)]
    s = commits.select(F.explode(F.array(*rows)).alias("s"))
    return s.groupBy("s.segment").agg(F.count_if("s.touches").alias("touches"), F.count_if("s.alone").alias("removes_alone"), F.count_if("s.unique").alias("unique_removals"))


def drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places at which two ordered lists (ord, value) differ."""
    joined = left.select("ord", F.col("value").alias("left_value")).join(right.select("ord", F.col("value").alias("right_value")), "ord", "full")
    return joined.where(~F.col("left_value").eqNullSafe(F.col("right_value")))
