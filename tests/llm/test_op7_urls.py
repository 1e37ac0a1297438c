import random
from itertools import combinations

import pytest

from gristmill.llm import url_rules as U

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    return lambda urls: spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_listed_rules(pages, no_labels):
    cases = {
        "http://A.Example.COM/en/7?x": ("a.example.com", "/en/7", "example.com/en/7", "allow"), "https://x.com/en/1": ("x.com", "/en/1", "com/en/", "block"), "https://com/en/": ("com", "/en/", "com/en/", "block"),
        "http://notcom/en/1": ("notcom", "/en/1", None, "allow"), "http://example.net/de/8#f": ("example.net", "/de/8", "example.net/de/8", "block"), "http://example.net/de/9": ("example.net", "/de/9", "net/de/", "allow"),
        "http://q.org/es/x/y": ("q.org", "/es/x/y", "org/es/", "block"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"), "http://h?q/en/": ("h", "", None, "allow"), "http://ÄB.com/en/": ("Äb.com", "/en/", "com/en/", "block"),
    }
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages(list(cases)), no_labels).collect()}
    assert got == dict(enumerate(cases.values()))


def enumerated(rows):
    """Rules from (tokens, bad) by trying every combination of items of any size: the sets of tokens they need."""
    bad = [t for t, is_bad in rows if is_bad]
    where = {}
    for t in sorted(set().union(*bad)):
        where.setdefault(tuple(t in b for b in bad), []).append(t)
    items = [(set(ts), pages) for pages, ts in where.items() if sum(pages) >= U.MIN_BAD]
    base = len(bad) / len(rows)
    sure = []
    for size in range(1, len(items) + 1):
        for c in combinations(items, size):
            need = set().union(*(ts for ts, _ in c))
            holds = [is_bad for t, is_bad in rows if need <= t]
            k, n = sum(holds), len(holds)
            if k < U.MIN_BAD or any(s < need for s in sure):
                continue
            p, z2 = k / n, U.Z**2
            low = (p + z2 / (2 * n) - U.Z * (p * (1 - p) / n + z2 / (4 * n * n)) ** 0.5) / (1 + z2 / n)
            if k * (1 - base) >= U.MIN_ODDS * base * (n - k) and low > base:
                sure.append(need)
    return sure


def test_mined_rules_equal_enumeration(spark, pages):
    words = ["buy", "now", "read", "cheap"]
    urls, flags = [], []
    r = random.Random(4)
    for i in range(300):
        host = r.choice(["spam0", "spam1", "fine0", "fine1"])
        path = [w for w in words if r.random() < 0.5]
        flags.append((host == "spam0" and r.random() < 0.9) or ("buy" in path and "now" in path and r.random() < 0.9) or r.random() < 0.03)
        urls.append(f"http://{host}.test/{'/'.join([*path, str(i)])}")
    table = pages(urls)
    labels = spark.createDataFrame([(i, 0 if f else 1, 0) for i, f in enumerate(flags)], "doc_id long, quality int, toxic int")
    host, path = U.host_of(table["url"]), U.path_of(table["url"])
    known = table.select(U.tokens(table["url"], host, path).alias("tokens"), path.alias("path"), "page_id")
    rows = [(set(x.tokens), x.bad) for x in U.labelled(known, labels).collect()]
    got = U.mine(U.labelled(known, labels)).collect()
    want = enumerated(rows)
    assert len(want) > 1 and sorted(map(sorted, want)) == sorted(list(x.needed) for x in got)
    for x in got:
        holds = [is_bad for t, is_bad in rows if set(x.needed) <= t]
        assert (x.pages, x.bad) == (len(holds), sum(holds))
    verdicts = {x.page_id: x.blocked_by for x in U.judge(table, labels).collect()}
    for x in known.collect():
        assert verdicts[x.page_id] == ("mined" if any(need <= set(x.tokens) for need in want) else None)


def test_long_shared_paths_are_one_item(spark, pages):
    words = "/".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    table = pages([f"http://deep.test/{words}/{i}" for i in range(40)] + [f"http://fine.test/wba/wcb/{i}" for i in range(40, 400)])
    labels = spark.createDataFrame([(i, int(i >= 40), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {x.page_id: x.verdict for x in U.judge(table, labels).collect()}
    assert got == {i: "block" if i < 40 else "allow" for i in range(400)}


def test_few_labels_and_one_kind_of_label(spark, pages):
    table = pages([f"http://{'bad' if i < 6 else 'fine'}.test/{i}" for i in range(60)])
    labels = lambda bad: spark.createDataFrame([(i, int(i not in bad), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert {x.page_id for x in U.judge(table, labels(range(6))).where("verdict = 'block'").collect()} == set(range(6))
    assert U.judge(table, labels(range(4))).where("verdict = 'block'").count() == 0  # too few bad pages for any rule
    assert U.judge(table, labels(range(60))).where("verdict = 'block'").count() == 0  # nothing stands out


def test_edges(spark, pages, no_labels):
    assert U.judge(pages([]), no_labels).count() == 0
    odd = spark.createDataFrame([(None, None, 1, "x"), (1, "http://a.com/en/1", 2, "y"), (1, "http://a.com/en/1", 2, "y")], "page_id long, url string, verdict int, host string")
    got = [(r.page_id, r.verdict) for r in U.judge(odd, no_labels).collect()]
    assert sorted(got, key=repr) == [(1, "block"), (1, "block"), (None, "allow")]
    long = U.judge(pages(["http://" + "a." * 5000 + "com/en/"]), no_labels).first()
    assert long.verdict == "block"


def test_plan_has_no_python(spark, sf):
    from gristmill.llm.queries import QUERIES

    plan = QUERIES["op7_fp_growth_urls"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
