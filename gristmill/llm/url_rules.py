"""URL filters: listed host and path rules, then association rules mined by FP-growth.

A page's URL is cut into tokens (scheme, host with its position-free labels, path words, query
keys; digits become #). Labelled pages (the document number in the path joined to `labels`) are the
examples. A rule is a set of tokens; it holds on the pages that have all of them.

Mining: tokens that lie on the same bad pages become one item, as only together they say the most
about these pages (one host with its labels and its fixed path is one item, however many words it
has). FP-growth finds the combinations of items that at least `MIN_BAD` bad pages share, a count that
is the same at every size. Each is then held against all labelled pages by an inverted index on its
rarest token. It becomes a rule if the odds of a bad page under it are at least `MIN_ODDS` times those
of all labelled pages and the lower Wilson bound of its confidence, four standard errors wide as many
combinations are tried, lies above their share; so the bar follows the base rate. A rule that contains another one's items is pruned: it blocks nothing more.
What is mined grows with the combinations of items that are not nested; d items of which each lies
on a part of the pages of the one before still cost 2^d combinations.

A URL is blocked if it holds all tokens of a rule, found by the same inverted index (rarest token ->
rule, then a containment test), once per distinct token set.

DataFrame functions and the JVM's FP-growth only.

Edge cases: a null URL or one without `://` has an empty host and path, no tokens and is allowed;
repeated pages get the same verdict; without labels nothing is mined and the verdict is allow
unless a listed rule blocks; null or non-numeric labels count as not bad; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.runtime import cut, small_side

#: Listed rules: (verdict, host and path).
LISTED = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Bad pages that a rule must hold on, whatever their share.
MIN_BAD = 5
#: Times the odds of a bad page among all labelled ones.
MIN_ODDS = 4.0
#: Rows and bytes of tokens up to which a side is broadcast.
INDEX_ROWS, INDEX_BYTES = 100_000, 16_000_000
#: Standard errors of the Wilson bound: of 30,000 combinations of chance about one passes.
Z = 4.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest ends up outermost
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, sorted."""
    digits = lambda x: F.regexp_replace(x, "[0-9]+", "#")
    tag = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    parts = F.concat(tag("scheme", F.array(F.lower(scheme))), tag("host", F.array(host)), tag("label", F.split(digits(host), r"\.")), tag("path", F.split(digits(path), "[/._-]")), tag("key", keys))
    return F.array_sort(F.array_distinct(F.when(F.coalesce(url, F.lit("")).contains("://"), parts).otherwise(F.array().cast("array<string>"))))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of pages whose path ends in the number of a labelled document."""
    number = F.regexp_extract("path", "/([0-9]{1,18})(?:/|\\.html)?$", 1)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    numbered = pages.where(number != "").select("tokens", number.cast("long").alias("doc_id"))
    return numbered.join(known, "doc_id").select("tokens", "bad")


def _low(k: Column, n: Column) -> Column:
    """Lower Wilson bound of k in n, `Z` standard errors wide."""
    p, z2 = k / n, F.lit(Z * Z)
    return (p + z2 / (2 * n) - F.lit(Z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def _set_id(tokens: Column) -> list[Column]:
    """Two hashes (128 bits) that stand for a token set in joins."""
    return [F.xxhash64(tokens).alias("s1"), F.xxhash64(F.lit("other"), tokens).alias("s2")]


def _small(side: DataFrame, text: Column) -> DataFrame:
    """`side` as a broadcast side if its rows and the bytes of `text` are few; else left to the planner."""
    n = side.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(side) if n["rows"] <= INDEX_ROWS and n["bytes"] <= INDEX_BYTES else side


def bad_items(sets: DataFrame) -> DataFrame:
    """(token, item): tokens of the bad sets of `sets` (tokens, pages, bad) on `MIN_BAD` bad pages, under the least token on the same ones."""
    held = sets.where("bad > 0").select(F.explode("tokens").alias("token"), "bad", *_set_id(F.col("tokens")))
    where = held.groupBy("token").agg(F.sum("bad").alias("n"), F.bit_xor("s1").alias("x1"), F.bit_xor("s2").alias("x2")).where(F.col("n") >= MIN_BAD)
    least = where.groupBy("n", "x1", "x2").agg(F.min("token").alias("item"))
    return where.join(least, ["n", "x1", "x2"]).select("token", "item")


def mine(examples: DataFrame) -> DataFrame:
    """(rule, needed, rare, pages, bad) of the association rules kept, from examples (tokens, bad).

    `needed` are a rule's tokens and `rare` the one of them on the fewest labelled pages; `pages` and
    `bad` count the labelled pages that hold them all.
    """
    spark = examples.sparkSession
    sets = cut(examples.where(F.size("tokens") > 0).groupBy("tokens").agg(F.count("*").alias("pages"), F.count_if("bad").alias("bad")))
    n = sets.agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad")).first()
    schema = "rule long, needed array<string>, rare string, pages long, bad long"
    if not n["bad"]:
        return spark.createDataFrame([], schema)
    items = cut(bad_items(sets))
    held = sets.where("bad > 0").select("bad", *_set_id(F.col("tokens")), F.explode("tokens").alias("token")).join(_small(items, F.concat("token", "item")), "token")
    baskets = held.groupBy("s1", "s2").agg(F.first("bad").alias("bad"), F.collect_set("item").alias("items"))
    baskets = cut(baskets.select("items", F.explode(F.sequence(F.lit(1), F.col("bad"))).alias("_page")).drop("_page"))  # a basket a page
    in_all = baskets.count()
    if in_all < MIN_BAD:
        return spark.createDataFrame([], schema)
    frequent = FPGrowth(itemsCol="items", minSupport=(MIN_BAD - 0.5) / in_all).fit(baskets).freqItemsets
    found = cut(frequent.where(F.col("freq") >= MIN_BAD).select(F.xxhash64(F.array_sort("items")).alias("rule"), F.array_sort("items").alias("items"), F.col("freq").alias("bad")))
    spread = sets.select("pages", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("pages").alias("spread"))
    tokens_of = items.join(spread, "token")
    parts = found.select("rule", F.explode("items").alias("item")).join(tokens_of, "item")
    needed = parts.groupBy("rule").agg(F.array_sort(F.collect_list("token")).alias("needed"), F.min(F.struct("spread", "token"))["token"].alias("rare"))
    rules = cut(found.join(needed, "rule"))
    hits = contained(sets.select("pages", "tokens"), rules.select("rule", "needed", "rare"))
    counted = rules.join(hits.groupBy("rule").agg(F.sum("pages").alias("pages")), "rule")
    base = n["bad"] / n["pages"]
    odds = F.col("bad") * (1 - base) >= MIN_ODDS * base * (F.col("pages") - F.col("bad"))
    sure = cut(counted.where(odds & (_low(F.col("bad"), F.col("pages")) > base)))
    # a rule whose items another rule has all, and less: looked up by that rule's least item
    heads = sure.select(F.element_at("items", 1).alias("item"), F.col("items").alias("part"))
    wider = sure.select("rule", "items", F.explode("items").alias("item")).join(heads, "item").where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0))
    return cut(sure.join(wider.select("rule").distinct(), "rule", "left_anti").select("rule", "needed", "rare", "pages", "bad"))


def contained(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """`sets` (tokens, ...) once for each rule of `rules` (rule, needed, rare) whose tokens they hold: looked up by its rarest token."""
    met = sets.select("*", F.explode("tokens").alias("rare")).join(_small(rules, F.array_join("needed", "")), "rare")
    return met.where(F.forall("needed", lambda t: F.array_contains("tokens", t))).drop("rare", "needed")


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(s1, s2) of the token sets (`tokens`) that hold every token of some rule."""
    return contained(sets.select("tokens", *_set_id(F.col("tokens"))), rules.select("rule", "needed", "rare")).select("s1", "s2").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules=LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict and blocked_by (listed, mined or null) for all rows of `pages` (page_id, url)."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, says = listed_rule(F.col("host"), F.col("path"), rules)
    known = cut(parts.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens")).withColumns(dict(zip(("s1", "s2"), _set_id(F.col("tokens"))))))
    mined = mine(labelled(known, labels))
    caught = cut(matched(known.where("rule IS NULL").select("tokens").distinct(), mined).withColumn("mined", F.lit(True)))
    joined = known.join(small_side(caught, caught.count()), ["s1", "s2"], "left")  # two longs a row
    verdict = F.coalesce("says", F.when(F.col("mined"), "block").otherwise("allow"))
    by = F.when(F.col("says") == "block", "listed").when(F.col("says").isNull() & F.col("mined"), "mined")
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by.alias("blocked_by"))
