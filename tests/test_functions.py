"""Scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from folium.functions import text as X


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_physical_index(spark):
    got = values(spark, X.parse_physical_index, ["<physical_index_5>", "physical_index_10", "physical_index_0", " 7 ", "invalid_format", "", None])
    assert got == [5, 10, 0, 7, None, None, None]


def test_to_int(spark):
    assert values(spark, lambda v: X.to_int(v, -1), ["3", " 4 ", "x", "", None, "99999999999"]) == [3, 4, -1, -1, -1, -1]


def test_strip_fence(spark):
    got = values(spark, X.strip_fence, ['```json\n{"a": 1}\n```', '  {"a": 1} ', "x ```json [1] ``` y ``` z", None, "```json open"])
    assert got == ['{"a": 1}', '{"a": 1}', "[1] ``` y", "", "```json open"]


@pytest.mark.parametrize("reply, path, want", [
    ('```json\n{"name": "test", "value": 42}\n```', "$.value", "42"), ('{"key": "value"}', "$.key", "value"), ('{"value": None}', "$.value", None), ("", "$.value", None), (None, "$.value", None),
    ('{"items": [1, 2, 3,], "data": {"a": 1,}}', "$.data.a", "1"), ('{"a": "line\none"}', "$.a", "line one"), ('{"a": "Nonesuch"}', "$.a", "Nonesuch"), ('{"a": None,}', "$.a", None), ("not json", "$.a", None),
])
def test_extract_json(spark, reply, path, want):
    got = values(spark, lambda v: F.try_variant_get(X.extract_json(v), path, "string"), [reply])
    assert got == [want]


def test_json_field_and_arrays(spark):
    assert values(spark, lambda v: X.json_field(X.extract_json(v), "answer", "no"), ['{"answer": "yes"}', "{}", "Error"]) == ["yes", "no", "no"]
    assert values(spark, X.string_array, ['["a", "b"]', "```json\n[]\n```", "no", None]) == [["a", "b"], [], [], []]


def test_text_functions(spark):
    assert values(spark, X.dot_leaders, ["Intro ........ 3", "A . . . . . . 7", "a...b"]) == ["Intro :  3", "A : 7", "a...b"]
    assert values(spark, X.heading_title, ["# A", "  ## B  ", "####### no", "#no", "# ", "text"]) == ["A", "B", None, None, None, None]
    assert values(spark, X.heading_level, ["# A", "  ## B", "###### f", "x"]) == [1, 0, 6, 0]
    assert values(spark, X.parent_code, ["1.2.3", "1", ".5", "1.2"]) == ["1.2", None, None, "1"]
    assert values(spark, X.doc_key, ["a.pdf", "b.md", "c.markdown", "d.PDF", "e.pdf.x"]) == ["a", "b", "c", "d.PDF", "e.pdf.x"]
    assert values(spark, lambda v: X.client_of(v, F.lit("1.2.3.4")), ["10.0.0.1, 9.9.9.9", "", None, "::1"]) == ["10_0_0_1", "1_2_3_4", "1_2_3_4", "__1"]
    assert values(spark, X.token_count, ["a  b\nc", "", None, "  "]) == [3, 0, 0, 0]
    assert values(spark, X.continued, ['[{"a":1},{"b"', "none"]) == ['[{"a":1},', ""]
    assert values(spark, X.strip, ["  a  "]) == ["a"]
    assert len(spark.range(1).select(X.job_id().alias("x")).head().x) == 10
    assert values(spark, lambda v: X.tagged(F.lit(3), v), ["t"]) == ["<physical_index_3>\nt\n<physical_index_3>\n\n"]
    assert values(spark, lambda v: X.node_id(v), [7, 12345], "int") == ["0007", "12345"]
