"""Study corpora from commit logs and recorded sessions: populations, candidates, pairs, tool calls and volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
CODE = r"(?i)\.(js|jsx|ts|tsx|py|go|rb|java|kt)$"
SKIP = r"(?i)(^|/)(test|tests|__tests__|spec|fixtures|examples?|scripts|dev-tools|migrations?|seed|seeds|demo)(/|$)"
GENERATED = r"(?i)(^|/)(generated|locales?|i18n|translations?|vendor|node_modules|dist|build)(/|$)"
SHA = "^[0-9a-f]{40}$"
TOOLS = ("Read", "Glob", "Grep", "Agent", "Bash")
COMMANDS = ("git diff", "git status", "git log", "git show", "git remote show")
CHARS_PER_TOKEN = 3.5
COMMAND_SEPARATORS = r"\s*(?:&&|\|\||;|\|)\s*"
OUTSIDE_OPTION = r"(^|\s)--no-index(\s|$)"
OPTION_NAME = r"^--?[\w-]+="
OUTER_QUOTES = "^[\"']+|[\"']+$"
ABSOLUTE_PATH = r"^(?:~|/|\\|[A-Za-z]:)"
SIZE_REFUSAL = r"(?i)prompt is too long|input is too long for requested model"
SIZE_REFUSAL_ERRORS = ("long_context_credits_required",)
REFUSAL_CHARS = 120
# End of fixed values.
STREAM = (
    "type string, subtype string, tools array<string>, is_error boolean, result string, num_turns int, total_cost_usd double, parent_tool_use_id string, modelUsage map<string,string>, is_api_error_message boolean, api_error string, "
    "usage struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>, "
    "message struct<is_api_error_message:boolean,api_error:string,content:array<struct<type:string,name:string,text:string,input:struct<command:string,file_path:string,path:string,notebook_path:string,pattern:string,glob:string>>>>"
)


def admitted(path: Column, prefix: Column | None = None) -> Column:
    """Whether a changed file counts: source code, of the prefix if there is one, not below a skipped folder."""
    ok = path.rlike(CODE) & ~path.rlike(SKIP)
    return ok if prefix is None else ok & path.startswith(prefix)


def population(files: DataFrame, prefix: Column | None = None) -> DataFrame:
    """Per commit of changed files (commit, path) whether it is malformed, in the population, and in it without generated files.

    Two readings of the last: `kept` if any admitted file is not generated, `strict` if none is.
    """
    ok = admitted(F.col("path"), prefix)
    made = F.col("path").rlike(GENERATED)
    g = files.groupBy("commit").agg(F.count_if(ok).alias("admitted"), F.count_if(ok & ~made).alias("written"), F.count_if(F.col("path").startswith('"')).alias("quoted"))
    well = F.col("commit").rlike(SHA)
    return g.select("commit", (~well).alias("malformed"), (well & (F.col("admitted") > 0)).alias("population"), (well & (F.col("written") > 0)).alias("kept"), (well & (F.col("admitted") > 0) & (F.col("written") == F.col("admitted"))).alias("strict"), "quoted")


def candidates(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Per commit of `files` (commit, path) all and admitted files, and the changed lines and bytes of the admitted ones' diff `lines` (commit, path, line)."""
    counts = files.groupBy("commit").agg(F.count("*").alias("all_files"), F.count_if(admitted(F.col("path"))).alias("files"))
    changed = F.col("line").rlike(r"^[+-]") & ~F.col("line").rlike(r"^(?:\+\+\+|---)")
    size = lines.where(admitted(F.col("path"))).groupBy("commit").agg(F.count_if(changed).alias("changed_lines"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    return counts.join(size, "commit", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("changed_lines", "bytes")})


def assembled(pairs: DataFrame, second: DataFrame) -> DataFrame:
    """`pairs` (commit, path, class, first, last, primary) with the second reader's class (commit prefix of 12, class), whether they differ, and how many other files the commit pairs."""
    read = second.select(F.col("short").alias("_short"), F.col("class").alias("second_class"))
    siblings = pairs.groupBy("commit").agg(F.count("*").alias("_n"))
    joined = pairs.join(read, F.substring("commit", 1, 12) == F.col("_short"), "left").join(siblings, "commit")
    return joined.select(*pairs.columns, "second_class", (~F.col("class").eqNullSafe(F.col("second_class"))).alias("contested"), (F.col("_n") - 1).alias("siblings"))


def events_of(lines: DataFrame) -> DataFrame:
    """Recorded stream `lines` (run, pos, line) that hold a JSON object, parsed as `e`."""
    return lines.where(F.trim("line").startswith("{")).withColumn("e", F.from_json(F.trim("line"), STREAM)).where("e.type IS NOT NULL").drop("line")


def tool_calls(lines: DataFrame) -> DataFrame:
    """run, pos, place, name, command, parent, paths of every tool call in the streams."""
    said = events_of(lines).where("e.type = 'assistant'").select("run", "pos", F.col("e.parent_tool_use_id").isNull().alias("parent"), F.posexplode("e.message.content").alias("place", "b")).where("b.type = 'tool_use'")
    paths = F.array_compact(F.array(*(F.col(f"b.input.{n}") for n in ("file_path", "path", "notebook_path", "pattern", "glob"))))
    return said.select("run", "pos", "place", F.col("b.name").alias("name"), F.col("b.input.command").alias("command"), "parent", paths.alias("paths"))


def leaves_root(path: Column) -> Column:
    """Whether a path may reach outside the run's folder: from a root or home, or up more levels than it goes down before its first wildcard."""
    s = F.regexp_replace(F.trim(path), OUTER_QUOTES, "")
    parts = F.filter(F.split(F.regexp_extract(s, r"^([^*?\[{]*)", 1), r"[/\\]"), lambda x: ~x.isin("", "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda acc, x: F.struct((acc["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(acc["least"], acc["at"] + F.when(x == "..", -1).otherwise(1)).alias("least")))
    return s.rlike(ABSOLUTE_PATH) | (depth["least"] < 0)


def steps(command: Column) -> Column:
    """The single commands of a shell line, without empty ones."""
    return F.filter(F.split(F.trim(F.coalesce(command, F.lit(""))), COMMAND_SEPARATORS), lambda x: F.trim(x) != "")


def unknown_tool(tool: Column, paths: Column, command: Column) -> Column:
    """A tool that runs may not use."""
    return ~F.coalesce(tool.isin(*TOOLS), F.lit(False))


def stray_path(tool: Column, paths: Column, command: Column) -> Column:
    """A path outside the run's folder."""
    return F.exists(paths, leaves_root)


def unlisted_command(tool: Column, paths: Column, command: Column) -> Column:
    """A shell line with a command that isn't one of the reading ones, or with none."""
    listed = "^(?:" + "|".join(COMMANDS) + ")(?: |$)"
    return (tool == "Bash") & ((F.size(steps(command)) == 0) | F.exists(steps(command), lambda x: ~F.trim(x).rlike(listed)))


def stray_argument(tool: Column, paths: Column, command: Column) -> Column:
    """An argument of a shell command that leads outside the run's folder, or the option that lets it."""
    words = F.flatten(F.transform(steps(command), lambda x: F.slice(F.split(F.trim(x), r"\s+"), 3, 1 << 30)))
    bare = F.transform(words, lambda w: F.regexp_replace(w, OPTION_NAME, ""))
    return (tool == "Bash") & (F.exists(bare, leaves_root) | F.exists(steps(command), lambda x: x.rlike(OUTSIDE_OPTION)))


#: What voids a run, by name.
VOIDING = {"tool": unknown_tool, "path": stray_path, "command": unlisted_command, "argument": stray_argument}


def voiding(calls: DataFrame) -> DataFrame:
    """The `calls` of `tool_calls` that void a run, and `why`: the names in `VOIDING` that hold for the call."""
    holds = [F.when(F.coalesce(rule(F.col("name"), F.col("paths"), F.col("command")), F.lit(False)), F.lit(name)) for name, rule in VOIDING.items()]
    return calls.withColumn("why", F.array_compact(F.array(*holds))).where(F.size("why") > 0)


def size_refusal(e: Column) -> Column:
    """What an event marked as the interface's error says, if that refuses a request for its size; a model's own words never count."""
    marked = F.coalesce(e["is_api_error_message"], F.lit(False)) | F.coalesce(e["message"]["is_api_error_message"], F.lit(False))
    error = F.coalesce(e["api_error"], e["message"]["api_error"], F.lit(""))
    said = F.array_join(F.transform(F.filter(e["message"]["content"], lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    refuses = error.isin(*SIZE_REFUSAL_ERRORS) | F.coalesce(said.rlike(SIZE_REFUSAL), F.lit(False))
    return F.when((e["type"] == "assistant") & marked & refuses, F.coalesce(F.nullif(error, F.lit("")), F.left(said, F.lit(REFUSAL_CHARS))))


def run_results(lines: DataFrame) -> DataFrame:
    """Per run of stream `lines` whether it ended well (ok, reason), its turns, cost, models, tokens, offered tools, compactions, and the refusal for size of a failed run. The last result counts."""
    ev = events_of(lines).withColumn("refused", size_refusal(F.col("e")))
    system = lambda kind: (F.col("e.type") == "system") & (F.col("e.subtype") == kind)
    newest = lambda value, where: F.max_by(F.when(where, value), F.when(where, F.col("pos")))
    g = ev.groupBy("run").agg(
        newest(F.col("e"), F.col("e.type") == "result").alias("r"), F.count_if(system("compact_boundary")).alias("compactions"),
        newest(F.col("e.tools"), system("init") & F.col("e.tools").isNotNull()).alias("tools"), newest(F.col("refused"), F.col("refused").isNotNull()).alias("refused"),
    )
    bad = F.coalesce(F.col("r.is_error"), F.lit(False)) | (F.coalesce(F.col("r.subtype"), F.lit("success")) != "success")
    models = F.coalesce(F.array_sort(F.map_keys("r.modelUsage")), F.array().cast("array<string>"))
    reason = F.when(F.col("r").isNull(), "no result event in the stream").when(bad, F.concat(F.lit("result subtype "), F.coalesce("r.subtype", F.lit("undefined")))).when(F.size(models) == 0, "the result reports no modelUsage")
    ending = F.when(F.col("r.result").rlike(SIZE_REFUSAL), F.left("r.result", F.lit(REFUSAL_CHARS)))
    tokens = {"input": "input_tokens", "output": "output_tokens", "cache_write": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens"}
    return g.select(
        "run", reason.isNull().alias("ok"), reason.alias("reason"), F.col("r.num_turns").alias("turns"), F.col("r.total_cost_usd").alias("cost_usd"), F.array_join(models, ",").alias("models"), "compactions",
        F.when(F.col("r").isNotNull() & bad, F.coalesce("refused", ending)).alias("size_refusal"), F.array_join("tools", ",").alias("tools"),
        *(F.when(reason.isNull(), F.coalesce(f"r.usage.{c}", F.lit(0))).alias(f"{n}_tokens") for n, c in tokens.items()),
    )


def volume(requests: DataFrame, by: list[str]) -> DataFrame:
    """Requests (system, user), their characters, and the tokens that these are estimated to be."""
    g = requests.groupBy(*by).agg(F.count("*").alias("requests"), F.sum(F.length("system")).alias("system_chars"), F.sum(F.length("user")).alias("user_chars"), F.max(F.length("system") + F.length("user")).alias("longest"))
    total = F.col("system_chars") + F.col("user_chars")
    return g.withColumns({"total_chars": total, "estimated_tokens": F.floor(total / F.lit(CHARS_PER_TOKEN) + F.lit(0.5))})
