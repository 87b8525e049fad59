"""The validation functions."""

import pytest
from pyspark.sql import functions as F

from leasewell.functions import validation as V

def said(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}").orderBy("k").select(column).collect()]


def test_formats(spark):
    names = [("a",), ("a.b_c-9",), ("x" * 128,), ("x" * 129,), ("",), ("a b",), ("é",), (None,), ("a\n",)]
    assert said(spark, names, "n string", V.queue_name_valid("n")) == [True, True, True, False, False, False, False, False, False]
    assert said(spark, [("k",), ("k k",), ("~" * 256,), ("~" * 257,), ("",)], "n string", V.key_valid("n")) == [True, False, True, False, False]
    good = "m1.3." + "0f" * 16
    assert said(spark, [(good, "m1", 3), (good, "m1", 4), (good, "m2", 3), ("m1.3.", "m1", 3), (None, "m1", 3)], "r string, m string, e bigint", V.receipt_valid("r", "m", "e")) == [True, False, False, False, False]


def test_reasons(spark):
    texts = ["  a \t", "　x ", "é" * 300, "a" + "é" * 300, "€" * 200, "ab" + "😀" * 200, "", None]
    cut = lambda t: None if t is None else t.strip().encode()[:512].decode("utf-8", "ignore")
    assert said(spark, [(t,) for t in texts], "t string", V.reason_trimmed("t")) == [cut(t) for t in texts]


def test_strict_json(spark):
    texts = ['{"a":1}', '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', '{"a":1} x', "null", "[1]", '{"a":"\\ud800"}', '{"b":1}', None, ""]
    assert said(spark, [(t,) for t in texts], "t string", V.strict_json("t", ("a",))) == [True] + [False] * 9


def test_cursors(spark):
    good = F.lit("0" * 32)
    text = V.cursor_text(good, F.lit(5), F.lit(4), F.lit(3), F.lit(2), F.lit(-1).cast("bigint"), F.lit(7))
    row = spark.range(1).select(text.alias("c")).select("c", V.cursor_fields("c").alias("f")).first()
    assert len(row.c) == 150 and row.f.second == -1 and int(row.f.sequence) == 3 and row.f.nano == 7
    assert said(spark, [("v3.x",), (row.c.replace("v3", "v2"),), (row.c[:-1],), (None,)], "c string", V.cursor_fields("c")) == [None] * 4


def test_results_and_limits(spark):
    rows = [("ack", '{"acked":true}'), ("ack", '{"acked":false}'), ("enqueue", '{"message":{"id":"m"}}'), ("enqueue", '{"message":{"id":""}}'), ("receive", "{}"), ("other", "{}"), ("receive", "{")]
    assert said(spark, rows, "o string, r string", V.result_shape_valid("o", "r")) == [True, False, True, False, True, False, False]
    assert V.page_limit(None) == 100 and V.page_limit(7) == 7
    with pytest.raises(ValueError):
        V.page_limit(1001)
