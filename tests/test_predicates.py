import pytest
from pyspark.sql import functions as F

from strandline.errors import ColumnNotFound, InvalidPredicate
from strandline.functions.predicates import Condition as C, Logical, all_of, any_of, build

AGE = '{"age": 25, "name": "Alice", "score": 80.0}'
DEEP = '{"user": {"profile": {"height": 1.75}, "tags": ["a", "b"]}}'


def evaluate(spark, text, tree, strict=False):
    df = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("value"))
    return df.select(F.coalesce(build(tree, "value", df.schema["value"].dataType, strict), F.lit(False)).alias("r")).first().r


@pytest.mark.parametrize(
    "text,tree,want",
    [
        ('"abc"', C("", "=", "abc"), True),
        ('"abc"', C("", "!=", "abd"), True),
        ('"12"', C("", "=", 12), False),
        ("10", C("", "=", 10), True),
        ("10", C("", ">", 9.5), True),
        ("10.5", C("", ">=", 10.5), True),
        ("10", C("", "<", 10), False),
        ("10", C("", "<=", 10), True),
        ("10", C("", "!=", 11), True),
        ("[1, 2]", C("", "=", [1, 2]), True),
        ("[1, 2]", C("", "!=", [2, 1]), True),
        (AGE, C("age", ">", 20), True),
        (AGE, C("score", "<", 80), False),
        (AGE, C("name", "=", "Alice"), True),
        (DEEP, C("user.profile.height", ">", 1.7), True),
        (DEEP, C("user.profile.weight", ">", 1.7), False),
        (DEEP, C("user.profile", "=", 1), False),
        ("50", C("any.path", ">", 40), True),
        (AGE, all_of(C("age", ">", 20), C("score", ">=", 80)), True),
        (AGE, all_of(C("age", ">", 30), C("score", ">=", 80)), False),
        (AGE, any_of(C("age", ">", 30), C("name", "=", "Alice")), True),
        (AGE, any_of(C("age", ">", 30), C("name", "=", "Bob")), False),
        (AGE, all_of(C("age", "=", 25), any_of(C("name", "=", "Bob"), C("score", ">", 70))), True),
        (AGE, None, True),
    ],
)
def test_truth(spark, text, tree, want):
    assert evaluate(spark, text, tree) is want
    if not (isinstance(tree, C) and tree.path.endswith("weight")):
        assert evaluate(spark, text, tree, strict=True) is want


@pytest.mark.parametrize(
    "tree",
    [C("", "~", 1), C("", ">", "a"), C("", "<", [1]), C("", "<=", {"a": 1}), C("", "=", None), C("", "=", object()),
     Logical("and", []), Logical("xor", [C("", "=", 1)]), Logical("or", [None]), "age > 3", all_of(C("", "=", 1), any_of())],
)
def test_bad_trees_are_refused_at_once(spark, tree):
    with pytest.raises(InvalidPredicate):
        build(tree, "value", spark.range(1).schema["id"].dataType)


def test_strict_missing_path(spark):
    missing, true, false = C("nothing", "=", 1), C("age", "=", 25), C("age", "=", 1)
    for tree in (missing, all_of(true, missing), any_of(false, missing), any_of(missing, true)):
        with pytest.raises(Exception, match="column not found: nothing"):
            evaluate(spark, AGE, tree, strict=True)
        evaluate(spark, AGE, tree)
    assert evaluate(spark, AGE, all_of(false, missing), strict=True) is False
    assert evaluate(spark, AGE, any_of(true, missing), strict=True) is True
    with pytest.raises(Exception, match="column not found"):
        evaluate(spark, AGE, C("", "=", 1), strict=True)
    struct = spark.createDataFrame([((1,),)], "value struct<a: long>")
    with pytest.raises(ColumnNotFound):
        build(C("b", "=", 1), "value", struct.schema["value"].dataType, strict=True)


def test_score_over_fifty(spark):
    df = spark.range(100).selectExpr("named_struct('score', id) value")
    for strict in (False, True):
        assert df.where(build(C("score", ">", 50), "value", df.schema["value"].dataType, strict)).count() == 49
