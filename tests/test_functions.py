import pytest
from pyspark.sql import functions as F

from quern.functions import json as js
from quern.functions import predicates
from quern.functions.expressions import ExpressionError, compile_expression, condition


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(21, "west", True, None, -9)], "score int, region string, active boolean, gone int, low int")


@pytest.mark.parametrize(
    "text, value",
    [
        ("score > 10", True),
        ("contains(region,'we')", True),
        ("contains(region, '')", True),
        ("len(region)", 4),
        ("len('é')", 2),
        ("len(score)", 0),
        ("2 + 3 * 4 - 1", 13),
        ("(2 + 3) * 4", 20),
        ("7 / 2", 3),
        ("low / 2", -4),
        ("score / 0", 0),
        ("score = 21", True),
        ("score = 'x'", False),
        ("gone = 1", False),
        ("gone + 1", None),
        ("region + 1", None),
        ("nowhere", None),
        ("slot.REGION", "west"),
        ("slot.Score", 21),
        ("between(score, 15)", True),
        ("between(score, 1, 2)", False),
        ("bucket(score)", 2),
        ("bucket(low, 4)", -2),
        ("bucket(score, 0)", 21),
        ("bucket(gone)", 0),
        ("nothing(1)", None),
        ("len(region, region)", None),
        (r"'it\'s'", "it's"),
        ("1 < 2 = true", True),
    ],
)
def test_expression(one, text, value):
    assert one.select(compile_expression(text, one.schema).column).first()[0] == value


@pytest.mark.parametrize("text, kept", [("", 1), ("score", 1), ("score - 21", 0), ("region", 1), ("''", 0), ("gone", 0), ("nowhere", 0), ("active", 1)])
def test_truth(one, text, kept):
    assert one.where(condition(text, one.schema)).count() == kept


@pytest.mark.parametrize("text", ["1 +", "(1", "f(1", "1 2", "?"])
def test_broken_expressions(one, text):
    with pytest.raises(ExpressionError):
        compile_expression(text, one.schema)


def test_predicate_text():
    assert predicates.parse_triple("age > 21") == ("age", ">", 21)
    assert predicates.parse_triple("name = Alice") == ("name", "=", "Alice")
    assert predicates.parse_triple("active = true") == ("active", "=", True)
    assert predicates.parse_compact("id>=3") == ("id", ">=", 3)
    with pytest.raises(ValueError):
        predicates.parse_triple("age >")


def test_json(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,2]},"n":3.7}',), ("{broken",), (None,)], "t string")
    v = js.parse(F.col("t"))
    found = df.select(js.get(v, "$.a.b[1]", "int"), js.get(v, "$.n", "int"), js.get(v, "$.x", "string")).collect()
    assert [tuple(r) for r in found] == [(2, 3, None), (None, None, None), (None, None, None)]
    deep = '{"k":' * 60 + "1" + "}" * 60
    assert spark.createDataFrame([(deep,)], "t string").select(js.get(js.parse(F.col("t")), "$" + ".k" * 60, "int")).first()[0] == 1


def test_json_schema(spark):
    rules = {
        "type": "object",
        "required": ["id", "tags"],
        "properties": {"id": {"type": "integer", "minimum": 0}, "name": {"type": "string", "minLength": 2}, "tags": {"type": "array", "items": {"type": "string"}}},
    }
    df = spark.createDataFrame([('{"id":1,"name":"ab","tags":["x"]}',), ('{"id":-1,"name":"a","tags":[1]}',), ("[]",)], "t string")
    found = [r[0] for r in df.select(js.violations(js.parse(F.col("t")), rules)).collect()]
    assert found[0] == []
    assert found[1] == ["$.id: minimum 0", "$.name: minLength 2", "$.tags[]: string expected"]
    assert found[2] == ["$: object expected"]


def test_json_files(spark, tmp_path):
    js.write_json(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "j"))
    assert js.read_json(spark, str(tmp_path / "j"), "a int, b string").first() == (1, "x")
