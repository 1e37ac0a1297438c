"""Windows, imports and keys of the review operators."""

import hashlib
import subprocess

import pytest
from pyspark.sql import functions as F

from gristmill.operators import review as R

TEXT = "import a\n// }\nfunction f() {\n  x = '{';\n  /* { */\n  if (a) {\n    y(\"}\");\n  }\n}\n" + "z\n" * 30


@pytest.mark.parametrize(("anchor", "want"), [(7, (3, 11)), (4, (1, 12)), (30, (20, 40)), (0, (1, 11)), (99, (30, 40))])
def test_defect_window(anchor, want):
    assert R.window_around(TEXT, anchor) == want and R.blocks_of(TEXT) == [(6, 8), (3, 9)]


def test_import_block(spark):
    cases = {"import a\n\n# note\nfrom b import c\nx = 1\nimport late\n": "import a\nfrom b import c", "x = 1\ny\n": "", "first\nimport a\n": "import a", "": "", "package main\n": "package main"}
    rows = spark.createDataFrame([(c,) for c in cases], "content string").select("content", R.import_block(F.col("content")).alias("b")).collect()
    assert {r.content: r.b for r in rows} == cases


def test_keys_do_not_depend_on_order(spark):
    df = spark.createDataFrame([('{"b":1,"a":[{"d":2,"c":"é"}]}',), ('{"a":[{"c":"é","d":2}],"b":1}',)], "request string")
    keys = {r.k for r in df.select(R.request_key("request").alias("k")).collect()}
    assert keys == {hashlib.sha256('{"a":[{"c":"é","d":2}],"b":1}'.encode()).hexdigest()}


def test_blob_hash_is_gits(spark):
    text = "né\n\x01"
    want = subprocess.run(["git", "hash-object", "--stdin"], input=text.encode(), capture_output=True).stdout.decode().strip()
    assert spark.createDataFrame([(text,)], "c string").select(R.blob_hash(F.col("c")).alias("h")).first().h == want


def test_payload_and_symbols(spark):
    long = "l\n" * 40
    df = spark.createDataFrame([(long, True), (long, False), ("x" * 200_001, True)], "c string, t boolean").select(F.length(R.payload(F.col("c"), F.lit(20), F.col("t"))).alias("n"), R.data_access(F.lit("prisma.user.find")).alias("d")).collect()
    assert df[0].n == 80 and df[1].n == 49 and df[0].d
