"""Reading reviews and experiments: anchors, windows, reported findings, recordings, settings and hashes."""

from __future__ import annotations

import bisect
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.text import context, lines_of, normal_path
from gristmill.operators.files import WHOLE_FILE_BYTES
from gristmill.runtime import ship

ship(__name__)

# Fixed values.
ROUTE_LINE = r"(?i)[\w$.]*\.(get|post|put|delete|patch|head|options|api_route|route|all)\s*\(\s*[\"'`]([^\"'`]*)[\"'`]"
EXACT = 10_000
IMPORT_LINE = r"^(?:import|from\s+\S+\s+import|require\s*\(|const\s+\S+\s*=\s*require|package\s+\w+|@app\.|use\s+strict|\"use\s+\w+\")|^[A-Z_].* = require\(|^require(?:_relative)?\s+"
CODE_LINE = r"(?i)^[a-z_$]"
IMPORT_LINES = 40
BLOCK_HEAD = re.compile(
    r"\b(function|=>|async|constructor|get|post|put|patch|delete|all|use|route|handler|resolver|procedure|mutation|query)\b"
    r"|\)\s*(:\s*[\w<>\[\]|&, ]+)?\s*\{\s*\Z"
    r"|\A\s*(public|private|protected|static|async|override)?\s*[\w$]+\s*\([^)]*\)\s*(:\s*[^{]+)?\{\s*\Z"
)
BLOCK_PAD, LINE_PAD = 3, 10
VULN = r"(?i)^#+\s*Vuln\s*(\d+)\s*:\s*(.+?)\s*:\s*`?([^`\s:]+)(?::(\d+))?`?\s*$"
GUARD_AUTH = r"(?i)auth|authent|login|session|jwt|passport|bearer|token|requireUser|isLoggedIn|protected"
GUARD_ROLE = r"(?i)admin|role|permission|authori[sz]|policy|ability|rbac|scope|owner|member"
GUARD_CAN = r"can[A-Z]"
DATA_ROOTS = ("prisma", "db", "knex", "sequelize", "mongoose", "typeorm", "drizzle", "kysely", "pool", "client", "conn", "connection", "dataSource", "datasource", "em", "entityManager", "sql")
PRESCREEN = {
    "auth-bypass": ("+", r"(?i)guard|authenticat|isAuthenticated|currentUser|req\.user|session\.user|unauthorized|\b401\b|AuthGuard"),
    "admin-check": ("+", r"(?i)\badmin|\brole\b|permission|forbidden|\b403\b|superuser"),
    "idor": ("+", r"(?i)workspaceId|userId|ownerId|memberId|belongsTo|canAccess|where\s*[:(]\s*\{[^}]*\bid\b"),
    "env-exposure": ("-", r"(?i)(?:process\.env|os\.environ).*(?:res\.|json\(|log|stringify)|(?:res\.|json\(|log|stringify).*(?:process\.env|os\.environ)"),
    "secrets-exposure": ("-", r"(?i)(?:key|secret|token|password)\w*\s*[:=]\s*[\"'][^\"']{16,}[\"']"),
    "webhook-unverified": ("+", r"(?i)signature|hmac|timingSafeEqual|\bverify|constructEvent"),
}
PRESCREEN_LINES = 600
MOST_GLOBS, GLOB_LENGTH = 50, 200
SEVERITIES = ("low", "medium", "high", "critical")
# End of fixed values.


def bare_path(path: Column) -> Column:
    """A route path without query, fragment and trailing slashes."""
    cut = F.regexp_replace(path, "[?#].*$", "")
    return F.when(F.length(cut) > 1, F.regexp_replace(cut, "/+$", "")).otherwise(cut)


def route_anchor(asked: DataFrame) -> DataFrame:
    """`asked` (id, content, route, fallback) with `line`: the route definition that fits "METHOD /path" best.

    An exact path scores 10,000, a suffix either way its length; the best score wins, then the first
    line. Each content is cut into lines once and its scores reduced to one row.
    """
    want = F.trim("route")
    method = F.lower(F.regexp_extract(want, r"^([A-Za-z]+)\s+(/\S*)$", 1))
    path = bare_path(F.when(method != "", F.regexp_extract(want, r"^([A-Za-z]+)\s+(/\S*)$", 2)).when(want.startswith("/"), F.regexp_extract(want, r"^(\S+)", 1)))
    rows = asked.withColumn("_m", method).withColumn("_p", path).select("id", "_m", "_p", F.posexplode(lines_of(F.col("content"))).alias("_i", "_l")).where(F.col("_p").isNotNull() & F.col("_l").rlike(ROUTE_LINE))
    verb, own = F.lower(F.regexp_extract("_l", ROUTE_LINE, 1)), bare_path(F.regexp_extract("_l", ROUTE_LINE, 2))
    fits = ((own == "") | own.startswith("/")) & ((F.col("_m") == "") | verb.isin("route", "all") | (verb == F.col("_m")))
    score = F.when(own == F.col("_p"), EXACT).when((own != "") & F.col("_p").endswith(own), F.length(own)).when((own != "") & own.endswith(F.col("_p")), F.length("_p"))
    best = rows.where(fits & score.isNotNull()).groupBy("id").agg(F.max_by(F.col("_i") + 1, F.struct(score, -F.col("_i"))).alias("_line"))
    return asked.join(best, "id", "left").withColumn("line", F.coalesce("_line", "fallback")).drop("_line")


def payload(content: Column, line: Column, route_trigger: Column) -> Column:
    """What a verdict is asked on: the whole file for a route definition within the cap, else the lines around."""
    return F.when(route_trigger & (F.octet_length(content) <= WHOLE_FILE_BYTES), content).otherwise(context(content, line))


def import_block(content: Column, most: int = IMPORT_LINES) -> Column:
    """Import-looking lines among the first ones, up to the first line of code after them."""
    lines = F.slice(lines_of(content), 1, most)
    kept = F.filter(F.transform(lines, lambda x: F.struct(x.alias("line"), F.trim(x).rlike(IMPORT_LINE).alias("is"), F.trim(x).rlike(CODE_LINE).alias("code"))), lambda x: x["is"] | x["code"])
    first = F.array_position(F.transform(kept, lambda x: x["is"]), True)
    tail = F.slice(kept, F.greatest(first, F.lit(1)).cast("int"), F.size(kept))
    stop = F.array_position(F.transform(tail, lambda x: x["is"]), False)
    block = F.when(stop > 0, F.slice(tail, F.lit(1), (stop - 1).cast("int"))).otherwise(tail)
    return F.when(first > 0, F.array_join(F.transform(block, lambda x: x["line"]), "\n")).otherwise("")


#: Comments and strings, which hide braces, then braces. A string ends with its line at the latest.
BRACES = re.compile(r"""/\*.*?(?:\*/|\Z)|//[^\r\n]*|(["'`])(?:\\[^\r\n]|(?!\1)[^\\\r\n])*(?:\1|\\?(?=[\r\n]|\Z))|[{}]""", re.S)


def blocks_of(text: str) -> list[tuple[int, int]]:
    """(first, last) lines of brace blocks, outside strings and comments, in the order in which they close."""
    breaks = [m.end() for m in re.finditer("\n", text)]
    braces = [(m[0], bisect.bisect_right(breaks, m.start()) + 1) for m in BRACES.finditer(text) if m[0] in "{}"]
    open_lines: list[int] = []
    closed = []
    for brace, line in braces:
        if brace == "{":
            open_lines.append(line)
        elif open_lines:
            closed.append((open_lines.pop(), line))
    return closed


def window_around(text: str, anchor: int) -> tuple[int, int]:
    """The innermost block around a line that a function head opens, padded; else the lines around."""
    lines = re.split(r"\r?\n", text)
    at = min(max(anchor, 1), len(lines))
    heads = lambda first: BLOCK_HEAD.search("\n".join(lines[max(0, first - 2) : first]))
    around = (b for b in blocks_of(text) if b[0] <= at <= b[1] and heads(b[0]))  # inner blocks close first
    first, last, pad = next(((*b, BLOCK_PAD) for b in around), (at, at, LINE_PAD))
    return max(1, first - pad), min(len(lines), last + pad)


@F.pandas_udf(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
def defect_window(text: pd.Series, anchor: pd.Series) -> pd.DataFrame:
    """(first, last) lines of the window around an anchor."""
    return pd.DataFrame([window_around(t or "", int(a)) for t, a in zip(text, anchor)], columns=["first", "last"])


def reported(reviews: DataFrame) -> DataFrame:
    """Findings of markdown reviews (review, markdown): index, category, path, line, severity, description.

    A heading opens a finding; its bullets are those up to the next heading.
    """
    lines = reviews.select("review", F.posexplode(lines_of(F.col("markdown"))).alias("pos", "line"))
    own = Window.partitionBy("review").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("line").rlike(VULN)
    rows = lines.withColumn("n", F.sum(F.col("line").rlike(r"(?i)^#+\s*Vuln").cast("int")).over(own))
    part = lambda i: F.max(F.when(head, F.regexp_extract("line", VULN, i)))
    sev, desc = F.regexp_extract("line", r"(?i)^\s*[-*]\s*Severity\s*:\s*(\w+)", 1), r"(?i)^\s*[-*]\s*Description\s*:\s*(.*)$"
    texts = F.sort_array(F.collect_list(F.when(F.col("line").rlike(desc), F.struct("pos", F.regexp_extract("line", desc, 1).alias("t")))))
    g = rows.where("n > 0").groupBy("review", "n").agg(part(1).alias("index"), F.trim(part(2)).alias("category"), F.regexp_replace(part(3), r"^\./", "").alias("path"), part(4).alias("at"), F.max_by(F.when(sev != "", sev), F.when(sev != "", F.col("pos"))).alias("severity"), F.array_join(F.transform(texts, lambda x: x["t"]), " ").alias("description"))
    return g.where("index IS NOT NULL").select("review", F.col("index").cast("int").alias("index"), "category", "path", F.expr("try_cast(at AS int)").alias("line"), "severity", "description")


def suffix_match(a: Column, b: Column) -> Column:
    """Whether one path is the other or ends in it after a slash."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def window_hits(found: DataFrame, windows: DataFrame, category: str) -> DataFrame:
    """Reported findings (review, path, line, category, description) inside a defect window (path, first, last) of a fitting path.

    Paths that end alike share their file name, so that is the join key and the suffix test runs on its matches only.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    f = found.where(F.col("category").rlike(category) | F.col("description").rlike(category)).withColumn("_name", name("path"))
    w = windows.select(F.col("path").alias("_path"), "first", "last").withColumn("_name", name("_path"))
    return f.join(w, "_name").where(suffix_match(F.col("path"), F.col("_path")) & F.col("line").between(F.col("first"), F.col("last"))).select(*found.columns).distinct()


def hotspots(found: DataFrame, truth: DataFrame) -> DataFrame:
    """`found` (case, path, line) with `real`: a vulnerable spot of its case lies on that line of that path or of a shorter one."""
    name = lambda c: F.regexp_extract(normal_path(F.col(c)), r"([^/]*)$", 1)
    t = truth.where("vulnerable").select("case", "line", normal_path(F.col("path")).alias("_path"), name("path").alias("_name"))
    f = found.withColumn("_name", name("path"))
    hit = f.join(t, ["case", "line", "_name"]).where((normal_path(F.col("path")) == F.col("_path")) | normal_path(F.col("path")).endswith(F.concat(F.lit("/"), "_path"))).select("case", "path", "line").distinct().withColumn("_real", F.lit(True))
    return found.join(hit, ["case", "path", "line"], "left").withColumn("real", F.coalesce("_real", F.lit(False))).drop("_real")


def guard_kind(name: Column) -> Column:
    return F.when(name.rlike(GUARD_AUTH), "auth").when(name.rlike(GUARD_ROLE) | name.rlike(GUARD_CAN), "role").otherwise("other")


def data_access(symbol: Column) -> Column:
    """Whether a dotted symbol starts at a data-access root."""
    return F.get(F.split(symbol, r"\."), F.lit(0)).isin(*DATA_ROOTS)


def path_category(path: Column) -> Column:
    p = F.lower(normal_path(path))
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    return (
        F.when(p.rlike(r"(?:^|/)(?:docs?|documentation)/") | name.rlike(r"\b(?:readme|changelog)\b"), "docs")
        .when(p.rlike(r"(?:^|/)(?:test|tests|__tests__|spec|specs|e2e)/") | p.rlike(r"\.(?:test|spec)\.[a-z]+$"), "tests")
        .when(p.rlike(r"(?:^|/)(?:examples?|samples?|demo|demos|fixtures?)/") | name.rlike(r"\b(?:example|sample)\.[a-z]+$"), "examples")
        .when(p.rlike(r"\.(?:env|env\.example|env\.sample)$") | p.rlike(r"\b(?:\.env|env)\.(?:example|sample|template)"), "config-samples")
        .otherwise("source")
    )


@F.pandas_udf(T.StringType())
def request_key(request: pd.Series) -> pd.Series:
    """SHA-256 of a JSON request with sorted keys: what recordings are looked up by."""
    return request.map(lambda r: None if r is None else hashlib.sha256(json.dumps(json.loads(r), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest())


def blob_hash(content: Column) -> Column:
    """The git object hash of a file."""
    data = F.encode(content, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), data))


def latest_marked(comments: DataFrame, marker: str, author: Column) -> DataFrame:
    """Per thread the last comment (thread, id, body) that holds the marker and is by the author."""
    return comments.where(F.col("body").contains(marker) & author).groupBy("thread").agg(F.max("id").alias("id"))


def medium_census(recorded: DataFrame) -> DataFrame:
    """Per corpus of recordings (corpus, file, input): recordings, unparseable ones, verdicts, and medium ones that assert or deny."""
    one = "struct<isVulnerable:boolean,confidence:string>"
    many = F.from_json(F.get_json_object("input", "$.verdicts"), f"array<{one}>")
    flat = F.array(F.from_json("input", one))
    ok = F.filter(F.coalesce(many, flat), lambda v: v["isVulnerable"].isNotNull() & v["confidence"].isNotNull())
    rows = recorded.withColumn("v", F.coalesce(ok, F.array().cast(f"array<{one}>")))
    n = lambda *conds: F.sum(F.size(F.filter("v", lambda v: F.lit(True) if not conds else conds[0](v))))
    medium = lambda yes: (lambda v: (F.lower(v["confidence"]) == "medium") & (v["isVulnerable"] == yes))
    return rows.groupBy("corpus").agg(F.count("*").alias("recordings"), F.count_if(F.size("v") == 0).alias("unparseable"), n().alias("verdicts"), n(medium(True)).alias("medium_yes"), n(medium(False)).alias("medium_no"))


def settings_errors(settings: DataFrame, detectors: list[str]) -> DataFrame:
    """Tenant settings (tenant, severity, globs, enabled) with trimmed globs, distinct detectors, and what is wrong with them."""
    globs = F.filter(F.transform("globs", F.trim), lambda g: g != "")
    unknown = F.filter("enabled", lambda d: ~d.isin(*detectors))
    notes = [
        F.when(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "severity"),
        F.when(F.size("globs") > MOST_GLOBS, "too many globs"),
        F.when(F.exists(globs, lambda g: F.length(g) > GLOB_LENGTH), "glob too long"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown detector id: "), F.get(unknown, F.lit(0)))),
    ]
    return settings.select("tenant", "severity", globs.alias("globs"), F.array_distinct("enabled").alias("enabled"), F.array_join(F.filter(F.array(*notes), lambda x: x.isNotNull()), "; ").alias("errors"))


def prescreen(lines: DataFrame) -> DataFrame:
    """Per commit of changed lines (commit, line): size, and for each class its matching lines of the right sign; none for large diffs."""
    changed = lines.where(F.col("line").rlike(r"^[+-]") & ~F.col("line").rlike(r"^(?:\+\+\+|---)"))
    counts = [F.count_if(F.col("line").startswith(sign) & F.col("line").rlike(rx)).alias(name) for name, (sign, rx) in PRESCREEN.items()]
    g = changed.groupBy("commit").agg(F.count("*").alias("changed"), *counts)
    large = F.col("changed") > PRESCREEN_LINES
    return g.select("commit", "changed", large.alias("too_large"), *(F.when(~large, F.col(f"`{n}`")).otherwise(0).alias(n.replace("-", "_")) for n in PRESCREEN))
