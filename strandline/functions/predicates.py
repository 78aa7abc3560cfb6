"""Predicate trees over values, compiled to Catalyst expressions.

A leaf compares a path into the value (empty: the value itself) with a constant; nodes are conjunctions and disjunctions. By
default a missing path or a kind that cannot be compared just doesn't match, so that plain comparisons reach the
Parquet scan. ``strict`` builds a left-to-right evaluation that raises where an error is met before the result is known.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from strandline.errors import ColumnNotFound, InvalidPredicate

#: The comparison operators, and those that strings and lists allow.
OPERATORS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}
EQUALITY = ("=", "!=")
LOGICAL = ("and", "or")


@dataclass(frozen=True)
class Condition:
    """``path`` (dotted; empty for a scalar value) ``op`` ``value``."""

    path: str
    op: str
    value: Any


@dataclass(frozen=True)
class Logical:
    """``and`` or ``or`` of conditions and further nodes, from left to right."""

    op: str
    items: Sequence[Any]


def all_of(*items: Any) -> Logical:
    return Logical("and", items)


def any_of(*items: Any) -> Logical:
    return Logical("or", items)


def validate(tree: Any) -> None:
    """Raises InvalidPredicate for anything that isn't a tree of known operators, before a row is read."""
    if tree is None:
        return
    if isinstance(tree, Condition):
        if tree.op not in OPERATORS:
            raise InvalidPredicate(f"unknown operator {tree.op!r}")
        if isinstance(tree.value, (str, list, tuple, dict)) and tree.op not in EQUALITY:
            raise InvalidPredicate(f"operator {tree.op!r} is not defined for {type(tree.value).__name__}")
        if tree.value is None or not isinstance(tree.value, (str, bool, int, float, list, tuple, dict)):
            raise InvalidPredicate(f"cannot compare with {type(tree.value).__name__}")
        return
    if isinstance(tree, Logical):
        if tree.op not in LOGICAL:
            raise InvalidPredicate(f"unknown logical operator {tree.op!r}")
        if not tree.items:
            raise InvalidPredicate("empty list of conditions")
        for item in tree.items:
            if item is None:
                raise InvalidPredicate("empty condition")
            validate(item)
        return
    raise InvalidPredicate(f"not a condition: {type(tree).__name__}")


def _literal(value: Any) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[_literal(v) for v in value])
    return F.lit(value)


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def _resolve(kind: T.DataType, path: str) -> tuple[str | None, T.DataType | None]:
    """(path as far as it goes, its type) within a struct type; a scalar met early is what gets compared, whatever is left of the path."""
    at: list[str] = []
    for part in path.split(".") if path else []:
        if not isinstance(kind, T.StructType):
            break
        if part not in kind.names:
            return None, None
        kind = kind[part].dataType
        at.append(part)
    return ".".join(at), kind


class _Leaf:
    """A comparison as two expressions: whether it is an error, and whether it holds (null counts as not)."""

    def __init__(self, condition: Condition, column: str, kind: T.DataType):
        self.missing: Column | None = None
        name = f"`{column}`"
        value = condition.value
        if isinstance(kind, T.VariantType):
            self._variant(condition, F.col(name))
            return
        path, at = _resolve(kind, condition.path)
        if path is None or (not condition.path and isinstance(at, T.StructType)):
            self.missing, self.holds = F.lit(True), F.lit(False)
            return
        if isinstance(at, (T.StructType, T.MapType)):
            self.holds = F.lit(False)
            return
        got = F.col(".".join([name, *(f"`{p}`" for p in path.split("."))]) if path else name)
        if isinstance(value, dict):
            self.holds = got.isNotNull() if condition.op == "!=" else F.lit(False)
            return
        self.holds = _compare(got, at, condition.op, value)

    def _variant(self, condition: Condition, column: Column) -> None:
        value, op = condition.value, condition.op
        kind = "string" if isinstance(value, str) else "boolean" if isinstance(value, bool) else "double"
        parts = condition.path.split(".") if condition.path else []
        paths = ["$"]
        for p in parts:
            paths.append(f"{paths[-1]}['{p}']")
        # the first scalar on the way is compared; deepest first, since a scalar has no members
        kinds = [F.schema_of_variant(F.try_variant_get(column, p, "variant")) for p in reversed(paths)]
        met = F.coalesce(*kinds)
        if isinstance(value, dict):
            got = F.lit(None).cast("double")
            self.holds = F.lit(False)
        elif isinstance(value, (list, tuple)):
            item = "string" if value and isinstance(value[0], str) else "double"
            got = F.try_variant_get(column, paths[-1], f"array<{item}>")
            self.holds = OPERATORS[op](got, _literal(list(value)).cast(f"array<{item}>"))
        else:
            got = F.coalesce(*[F.try_variant_get(column, p, kind) for p in reversed(paths)])
            # text that looks like a number is no number, and a number is no text
            got = F.when((met == "STRING") if kind == "string" else (met != "STRING"), got)
            self.missing = met.startswith("OBJECT") & (kinds[0].isNull() if parts else F.lit(True))
            self.holds = OPERATORS[op](got, F.lit(value))
        if op == "!=":  # of another kind: unequal, if it is there and no map
            self.holds = F.when(got.isNull(), met.isNotNull() & ~met.startswith("OBJECT") & (met != "VOID")).otherwise(self.holds)


def _compare(got: Column, kind: T.DataType, op: str, value: Any) -> Column:
    other = got.isNotNull() if op == "!=" else F.lit(False)  # of another kind: unequal, if it is there
    if isinstance(kind, T.StringType):
        if op not in EQUALITY:
            raise InvalidPredicate(f"operator {op!r} is not defined for strings")
        return OPERATORS[op](got, F.lit(value)) if isinstance(value, str) else other
    if isinstance(kind, T.ArrayType):
        if op not in EQUALITY:
            raise InvalidPredicate(f"operator {op!r} is not defined for lists")
        return OPERATORS[op](got, _literal(value).cast(kind)) if isinstance(value, (list, tuple)) else other
    if _numeric(kind):
        if not isinstance(value, (bool, int, float)):
            return other
        if isinstance(kind, T.BooleanType) != isinstance(value, bool):
            return OPERATORS[op](got.cast("double"), F.lit(float(value)))
        return OPERATORS[op](got, F.lit(value))
    raise InvalidPredicate(f"cannot compare {kind.simpleString()}")


def build(tree: Any, column: str, kind: T.DataType, strict: bool = False) -> Column:
    """The predicate over ``column`` of type ``kind`` as a boolean expression; None is always true.

    Lenient: a null or missing value doesn't match, whatever the operator; a value of another kind than the constant is unequal to it. Strict: missing paths raise when they are met, from left to right, so that a
    false before them in a conjunction, or a true in a disjunction, hides them. A path that a declared struct lacks
    raises ColumnNotFound at once in strict mode.
    """
    validate(tree)
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Condition):
        leaf = _Leaf(tree, column, kind)
        if not strict:
            return leaf.holds
        if leaf.missing is None:
            return F.coalesce(leaf.holds, F.lit(False))
        if not isinstance(kind, T.VariantType):
            raise ColumnNotFound(tree.path)
        error = F.raise_error(F.lit(f"column not found: {tree.path}")).cast("boolean")
        return F.when(leaf.missing, error).otherwise(F.coalesce(leaf.holds, F.lit(False)))
    parts = [build(x, column, kind, strict) for x in tree.items]
    if not strict:
        return reduce(lambda a, b: a & b if tree.op == "and" else a | b, parts)
    if tree.op == "and":
        return reduce(lambda rest, x: F.when(x, rest).otherwise(F.lit(False)), reversed(parts))
    return reduce(lambda rest, x: F.when(x, F.lit(True)).otherwise(rest), reversed(parts))
