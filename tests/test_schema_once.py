"""A JSON text is parsed once for a row."""

from pyspark.sql import functions as F

from siltstone.functions import schema


def test_texts_are_parsed_once(spark):
    df = spark.createDataFrame([('{"a": {"b": 1, "c": "xx"}}',)], "t string")
    rules = {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "properties": {"b": {"type": "string"}, "c": {"maxLength": 1}, "d": {}}, "required": ["d"]}}}
    out = df.select(schema.violations(F.col("t"), rules).alias("e"))
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parse_json") + plan.count("parsejson") <= 2, plan
    assert out.first().e == ["$.a.b: type", "$.a.c: maxLength", "$.a.d: required"]
