from pyspark.sql import functions as F

from gristmill.llm import url_rules as U


def test_support_does_not_grow_with_the_input(spark):
    for n in (2_000, 30_000):  # 0.2 % of 30,000 are 60 pages
        spam = F.col("id") < 40
        examples = spark.range(n).select(F.array(F.when(spam, "host:spam.test").otherwise("host:fine.test")).alias("tokens"), spam.alias("bad"))
        assert [(r.needed, r.pages, r.bad) for r in U.mine(examples).collect()] == [(["host:spam.test"], 40, 40)]
