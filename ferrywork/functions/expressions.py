"""Row expressions of ``compute`` and ``filter`` steps as Spark columns.

The configs hold Python expressions. Python's own ``ast`` module parses them
once on the driver; each node becomes built-in Column functions, so nothing is
evaluated per row in Python. NULL plays the part of a Python error: a NULL or
non-scalar column is an undefined name, division by zero or a failed
conversion has no value.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from ferrywork.functions import pytext

INT, FLOAT, STR, BOOL, LIST, UNDEFINED = "int", "float", "str", "bool", "list", "undefined"
SPARK_TYPE = {INT: T.LongType(), FLOAT: T.DoubleType(), STR: T.StringType(), BOOL: T.BooleanType()}
NUMERIC = (INT, FLOAT, BOOL)


class ExpressionError(ValueError):
    """The expression would fail on every row: it is no expression, or names what is not there."""


class UnsupportedExpression(ExpressionError):
    """The expression is sound Python but has no column equivalent here; running without it would change results."""


@dataclass(frozen=True)
class Value:
    col: Column
    kind: str
    # Names of the columns whose NULLs alone make this NULL; None if other causes exist.
    null_if: frozenset | None = frozenset()

    def is_null(self) -> Column:
        if self.null_if is None:
            return self.col.isNull()
        return _any_of([F.col(_quote(name)).isNull() for name in sorted(self.null_if)])

    @property
    def type(self) -> T.DataType:
        return SPARK_TYPE[self.kind]


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def _merged_nulls(*values: Value) -> frozenset | None:
    if any(v.null_if is None for v in values):
        return None
    return frozenset().union(*(v.null_if for v in values))


def _number(value: Value) -> Column:
    return value.col.cast("int").cast("bigint") if value.kind == BOOL else value.col


def _both_numeric(left: Value, right: Value) -> bool:
    return left.kind in NUMERIC and right.kind in NUMERIC


def _common_number(*values: Value) -> str:
    return FLOAT if any(v.kind == FLOAT for v in values) else INT


def _undefined(kind: str = UNDEFINED) -> Value:
    return Value(F.lit(None).cast("double" if kind == UNDEFINED else SPARK_TYPE[kind]), kind, None)


class Compiler(ast.NodeVisitor):
    """Turns one parsed expression into a :class:`Value` over ``schema``."""

    def __init__(self, schema: T.StructType):
        self.fields = {f.name: f.dataType for f in schema.fields}

    def compile(self, text: str) -> Value:
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as exc:
            raise ExpressionError(f"not an expression: {text!r}") from exc
        return self.visit(tree.body)

    def generic_visit(self, node):
        raise UnsupportedExpression(f"{type(node).__name__} is not supported in an expression")

    # -- leaves ---------------------------------------------------------

    def visit_Constant(self, node) -> Value:
        for kind, cls in ((BOOL, bool), (INT, int), (FLOAT, float), (STR, str)):
            if isinstance(node.value, cls):
                if kind == INT and abs(node.value) >= 2**63:
                    raise UnsupportedExpression("integer literal is wider than 64 bits")
                return Value(F.lit(node.value).cast(SPARK_TYPE[kind]), kind)
        raise UnsupportedExpression(f"literal {node.value!r} is not supported here")

    def visit_Name(self, node) -> Value:
        if node.id not in self.fields:
            raise ExpressionError(f"unknown name {node.id!r}")
        dtype, col, nulls = self.fields[node.id], F.col(_quote(node.id)), frozenset([node.id])
        if isinstance(dtype, T.IntegralType):
            return Value(col.cast("bigint"), INT, nulls)
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return Value(col.cast("double"), FLOAT, nulls)
        if isinstance(dtype, T.StringType):
            return Value(col, STR, nulls)
        if isinstance(dtype, T.BooleanType):
            return Value(col, BOOL, nulls)
        return _undefined()

    def visit_JoinedStr(self, node) -> Value:
        parts = []
        for piece in node.values:
            if isinstance(piece, ast.FormattedValue):
                if piece.format_spec is not None or piece.conversion not in (-1, 115):
                    raise UnsupportedExpression("format specifications are not supported")
                value = self.visit(piece.value)
                parts.append(Value(pytext.py_str(value.col, value.type), STR, value.null_if))
            else:
                parts.append(self.visit(piece))
        return Value(F.concat(F.lit(""), *[p.col for p in parts]), STR, _merged_nulls(*parts))

    # -- arithmetic -----------------------------------------------------

    def visit_UnaryOp(self, node) -> Value:
        if isinstance(node.op, ast.Not):
            inner = self.truth(node.operand)
            return Value(~inner.col, BOOL, inner.null_if)
        value = self.visit(node.operand)
        if value.kind not in NUMERIC:
            return _undefined(INT)
        kind = _common_number(value)
        if isinstance(node.op, ast.USub):
            return Value(F.try_subtract(F.lit(0).cast(SPARK_TYPE[kind]), _number(value)), kind, None)
        if isinstance(node.op, ast.UAdd):
            return Value(_number(value), kind, value.null_if)
        return self.generic_visit(node.op)

    def visit_BinOp(self, node) -> Value:
        left, right = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Pow) and left.kind in (INT, BOOL) and right.kind in (INT, BOOL):
            # A whole power of an integer is an exact integer, not a double.
            try:
                exponent = ast.literal_eval(node.right)
            except ValueError:
                return Value(_whole_power(_number(left), _number(right)), INT, None)
            if 1 <= exponent <= 8:
                return Value(reduce(F.try_multiply, [_number(left)] * exponent), INT, None)
            if exponent >= 0:
                return Value(_whole_power(_number(left), F.lit(int(exponent)).cast("bigint")), INT, None)
        return self.arithmetic(node.op, left, right)

    def arithmetic(self, op, left: Value, right: Value) -> Value:
        if isinstance(op, ast.Add) and left.kind == right.kind == STR:
            return Value(F.concat(left.col, right.col), STR, _merged_nulls(left, right))
        if isinstance(op, ast.Mult) and {left.kind, right.kind} == {STR, INT}:
            text, times = (left, right) if left.kind == STR else (right, left)
            return Value(F.call_function("repeat", text.col, times.col.try_cast("int")), STR, None)
        if not _both_numeric(left, right):
            return _undefined(STR if STR in (left.kind, right.kind) else FLOAT)
        a, b = _number(left), _number(right)
        kind = _common_number(left, right)
        if isinstance(op, ast.Add):
            return Value(F.try_add(a, b), kind, None)
        if isinstance(op, ast.Sub):
            return Value(F.try_subtract(a, b), kind, None)
        if isinstance(op, ast.Mult):
            return Value(F.try_multiply(a, b), kind, None)
        if isinstance(op, ast.Div):
            return Value(F.try_divide(a.cast("double"), b.cast("double")), FLOAT, None)
        if isinstance(op, ast.Mod):
            return Value(_floor_mod(a, b, kind), kind, None)
        if isinstance(op, ast.FloorDiv):
            return Value(_floor_div(a, b, kind), kind, None)
        if kind == INT and isinstance(op, (ast.BitAnd, ast.BitOr, ast.BitXor)):
            bits = {ast.BitAnd: a.bitwiseAND(b), ast.BitOr: a.bitwiseOR(b), ast.BitXor: a.bitwiseXOR(b)}[type(op)]
            both = left.kind == right.kind == BOOL
            return Value(bits != 0 if both else bits, BOOL if both else INT, _merged_nulls(left, right))
        if isinstance(op, ast.Pow):
            power = F.pow(a.cast("double"), b.cast("double"))
            power = F.when(~F.isnan(power) & (F.abs(power) != float("inf")), power)
            return Value(power, FLOAT, None)
        return self.generic_visit(op)

    # -- comparison and logic -------------------------------------------

    def visit_Compare(self, node) -> Value:
        left, result = node.left, None
        for op, right in zip(node.ops, node.comparators):
            step = self.comparison(op, left, right)
            result = step if result is None else _logical_and(result, step)
            left = right
        return result

    def comparison(self, op, left_node, right_node) -> Value:
        if isinstance(op, (ast.In, ast.NotIn)):
            found = self.membership(self.visit(left_node), right_node)
            return Value(~found.col, BOOL, found.null_if) if isinstance(op, ast.NotIn) else found
        for one, other in ((left_node, right_node), (right_node, left_node)):
            if isinstance(other, ast.Constant) and other.value is None:
                return self.compared_with_none(op, self.visit(one))
        left, right = self.visit(left_node), self.visit(right_node)
        nulls = _merged_nulls(left, right)
        if left.kind == right.kind == STR or left.kind == right.kind == BOOL:
            a, b = left.col, right.col
        elif _both_numeric(left, right):
            a, b = _number(left), _number(right)
        elif isinstance(op, (ast.Eq, ast.NotEq)) and UNDEFINED not in (left.kind, right.kind):
            answer = F.when(left.is_null() | right.is_null(), None).otherwise(isinstance(op, ast.NotEq))
            return Value(answer, BOOL, nulls)
        else:
            return _undefined(BOOL)
        # NaN is the greatest double in Spark but compares as false in Python.
        # An upper bound keeps it out and, unlike isnan, can be pushed down.
        loose = [
            v.col <= float("inf")
            for v, node in ((left, left_node), (right, right_node))
            if v.kind == FLOAT and not isinstance(node, ast.Constant)
        ]
        guard = reduce(lambda x, y: x & y, loose) if loose else None

        literal = isinstance(left_node, ast.Constant) or isinstance(right_node, ast.Constant)

        def unless_nan(condition, needed=True):
            if guard is None or not needed:
                return condition
            # Beside a literal both sides are NULL together; else NULL must win.
            return condition & guard if literal else F.when(condition.isNotNull(), condition & guard)

        if isinstance(op, (ast.Eq, ast.NotEq)):
            equal = unless_nan(a == b, len(loose) == 2)
            return Value(equal if isinstance(op, ast.Eq) else ~equal if len(loose) == 2 else a != b, BOOL, nulls)
        for cls, condition, may_let_nan_in in (
            (ast.Lt, a < b, right.kind == FLOAT),
            (ast.LtE, a <= b, right.kind == FLOAT),
            (ast.Gt, a > b, left.kind == FLOAT),
            (ast.GtE, a >= b, left.kind == FLOAT),
        ):
            if isinstance(op, cls):
                return Value(unless_nan(condition, may_let_nan_in), BOOL, nulls)
        return self.generic_visit(op)

    def compared_with_none(self, op, value: Value) -> Value:
        # A NULL column is an undefined name, so a visible value is never None.
        if not isinstance(op, (ast.Is, ast.IsNot, ast.Eq, ast.NotEq)):
            return _undefined(BOOL)
        answer = F.lit(isinstance(op, (ast.IsNot, ast.NotEq)))
        return Value(F.when(~value.is_null(), answer), BOOL, value.null_if)

    def membership(self, needle: Value, container) -> Value:
        if not isinstance(container, (ast.Tuple, ast.List, ast.Set)):
            haystack = self.visit(container)
            if needle.kind == haystack.kind == STR:
                return Value(F.contains(haystack.col, needle.col), BOOL, _merged_nulls(needle, haystack))
            return _undefined(BOOL)
        items = [self.visit(e) for e in container.elts]
        alike = [v for v in items if v.kind == needle.kind or _both_numeric(v, needle)]
        hits = [_number(needle) == _number(v) for v in alike]
        if all(isinstance(e, ast.Constant) for e in container.elts) and alike:
            return Value(_number(needle).isin(*[_number(v) for v in alike]), BOOL, needle.null_if)
        nulls = _merged_nulls(needle, *items)
        missing = _any_of([v.is_null() for v in (needle, *items)])
        return Value(F.when(missing, None).otherwise(_any_of(hits)), BOOL, nulls)

    def visit_BoolOp(self, node) -> Value:
        values = [self.visit(v) for v in node.values]
        kinds = {v.kind for v in values}
        if len(kinds) > 1 and kinds <= set(NUMERIC):
            kind = _common_number(*values)
            values = [Value(_number(v).cast(SPARK_TYPE[kind]), kind, v.null_if) for v in values]
        elif len(kinds) > 1:
            raise UnsupportedExpression("operands of and/or give values of different types")
        result = values[-1]
        for value in reversed(values[:-1]):
            holds = pytext.py_bool(value.col, value.type)
            go_on = holds if isinstance(node.op, ast.And) else ~holds
            chosen = F.when(value.is_null(), None).when(go_on, result.col).otherwise(value.col)
            result = Value(chosen, value.kind, None)
        return result

    def visit_IfExp(self, node) -> Value:
        test, yes, no = self.truth(node.test), self.visit(node.body), self.visit(node.orelse)
        kind = yes.kind
        if yes.kind != no.kind:
            if not _both_numeric(yes, no):
                raise UnsupportedExpression("both branches of a conditional must have one type")
            kind = _common_number(yes, no)
            yes = Value(_number(yes).cast(SPARK_TYPE[kind]), kind, yes.null_if)
            no = Value(_number(no).cast(SPARK_TYPE[kind]), kind, no.null_if)
        return Value(F.when(test.is_null(), None).when(test.col, yes.col).otherwise(no.col), kind, None)

    def truth(self, node) -> Value:
        """``bool(node)``, with and/or evaluated left to right and stopped early."""
        if isinstance(node, ast.BoolOp):
            parts = [self.truth(v) for v in node.values]
            join = _logical_and if isinstance(node.op, ast.And) else _logical_or
            return reduce(lambda rest, first: join(first, rest), reversed(parts[:-1]), parts[-1])
        value = self.visit(node)
        if value.kind == UNDEFINED:
            return _undefined(BOOL)
        if value.kind == LIST:
            return Value(F.size(value.col) > 0, BOOL, value.null_if)
        return Value(pytext.py_bool(value.col, value.type), BOOL, value.null_if)

    def keeps(self, node) -> Column:
        """Whether a filter keeps the row: true or in error.

        Written with OR and IS NULL around plain comparisons, which the reader
        can push down, rather than with ``coalesce``.
        """
        if isinstance(node, ast.BoolOp):
            first, *rest = node.values
            rest = rest[0] if len(rest) == 1 else ast.BoolOp(op=node.op, values=rest)
            head, tail = self.truth(first), self.keeps(rest)
            if isinstance(node.op, ast.And):
                return head.is_null() | (head.col & tail)
            return head.is_null() | head.col | tail
        value = self.truth(node)
        return value.is_null() | value.col

    # -- calls, methods, subscripts --------------------------------------

    def visit_Call(self, node) -> Value:
        if getattr(node.func, "id", None) == "round" and [k.arg for k in node.keywords] == ["ndigits"] and len(node.args) == 1:
            node = ast.Call(func=node.func, args=[*node.args, node.keywords[0].value], keywords=[])
        if node.keywords:
            raise UnsupportedExpression("keyword arguments are not supported")
        if isinstance(node.func, ast.Attribute):
            return self.method(node.func.attr, self.visit(node.func.value), node.args)
        name = getattr(node.func, "id", None)
        if name not in ("abs", "float", "int", "str", "round", "max", "min", "len", "sum", "bool"):
            raise ExpressionError(f"unknown function {name!r}")
        return getattr(self, f"call_{name}")(node.args)

    def one(self, args) -> Value:
        if len(args) != 1:
            raise UnsupportedExpression("one argument expected")
        return self.visit(args[0])

    def call_abs(self, args) -> Value:
        value = self.one(args)
        if value.kind not in NUMERIC:
            return _undefined(INT)
        number = _number(value)
        kind = _common_number(value)
        negated = F.try_subtract(F.lit(0).cast(SPARK_TYPE[kind]), number)
        return Value(F.when(number < 0, negated).otherwise(F.abs(number) if kind == FLOAT else number), kind, None)

    def call_bool(self, args) -> Value:
        return self.truth(args[0]) if len(args) == 1 else self.generic_visit(ast.Call)

    def call_str(self, args) -> Value:
        value = self.one(args)
        if value.kind == UNDEFINED:
            return _undefined(STR)
        return Value(pytext.py_str(value.col, value.type), STR, value.null_if)

    def call_int(self, args) -> Value:
        value = self.one(args)
        return _undefined(INT) if value.kind == UNDEFINED else Value(pytext.py_int(value.col, value.type), INT, None)

    def call_float(self, args) -> Value:
        value = self.one(args)
        if value.kind == UNDEFINED:
            return _undefined(FLOAT)
        return Value(pytext.py_float(value.col, value.type), FLOAT, None)

    def call_round(self, args) -> Value:
        value, digits = self.visit(args[0]), 0
        if len(args) > 1:
            digits = self.literal_int(args[1])
        if value.kind not in NUMERIC:
            return _undefined(INT)
        if value.kind != FLOAT:
            if digits < 0:
                return Value(F.bround(_number(value), digits), INT, None)
            return Value(_number(value), INT, value.null_if)
        rounded = pytext.round_half_even(value.col, digits)
        return Value(rounded.try_cast("bigint"), INT, None) if len(args) == 1 else Value(rounded, FLOAT, None)

    def call_len(self, args) -> Value:
        value = self.one(args)
        if value.kind == LIST:
            return Value(F.size(value.col).cast("bigint"), INT, None)
        if value.kind != STR:
            return _undefined(INT)
        return Value(F.length(value.col).cast("bigint"), INT, value.null_if)

    def items(self, args) -> list[Value]:
        if len(args) == 1 and isinstance(args[0], (ast.Tuple, ast.List)):
            args = args[0].elts
        if not args:
            raise UnsupportedExpression("at least one value expected")
        return [self.visit(a) for a in args]

    def extreme(self, args, pick) -> Value:
        values = self.items(args)
        if all(v.kind == STR for v in values):
            kind, cols = STR, [v.col for v in values]
        elif all(v.kind in NUMERIC for v in values):
            kind = _common_number(*values)
            cols = [_number(v).cast(SPARK_TYPE[kind]) for v in values]
        else:
            return _undefined(FLOAT)
        if len(cols) == 1:
            return Value(cols[0], kind, values[0].null_if)
        missing = _any_of([v.is_null() for v in values])
        return Value(F.when(~missing, pick(*cols)), kind, _merged_nulls(*values))

    def call_max(self, args) -> Value:
        return self.extreme(args, F.greatest)

    def call_min(self, args) -> Value:
        return self.extreme(args, F.least)

    def call_sum(self, args) -> Value:
        return reduce(lambda a, b: self.arithmetic(ast.Add(), a, b), self.items(args))

    def method(self, name: str, target: Value, arg_nodes) -> Value:
        if target.kind != STR:
            owner = {INT: int, FLOAT: float, BOOL: bool, LIST: list}.get(target.kind)
            kind = UnsupportedExpression if owner and hasattr(owner, name) else ExpressionError
            raise kind(f"method {name!r} needs text")
        if name == "join" and len(arg_nodes) == 1 and isinstance(arg_nodes[0], (ast.Tuple, ast.List)):
            parts = [self.visit(e) for e in arg_nodes[0].elts]
            if any(p.kind != STR for p in parts):
                return _undefined(STR)
            missing = _any_of([v.is_null() for v in (target, *parts)])
            return Value(F.when(~missing, F.concat_ws("", *_between(parts, target.col))), STR, _merged_nulls(target, *parts))
        if name == "zfill" and len(arg_nodes) == 1:
            return self.zero_filled(target, self.literal_int(arg_nodes[0]))
        args = [self.visit(a) for a in arg_nodes]
        if any(a.kind != STR for a in args):
            return _undefined(STR)
        text, nulls = target.col, _merged_nulls(target, *args)
        literals = [a.value for a in arg_nodes if isinstance(a, ast.Constant)]
        if name in ("strip", "lstrip", "rstrip") and len(args) == len(literals) <= 1:
            return Value(self.stripped(name, text, *literals), STR, nulls)
        if not args and name in ("lower", "upper"):
            return Value(F.lower(text) if name == "lower" else F.upper(text), STR, nulls)
        if not args and name == "capitalize":
            return Value(F.concat(F.upper(F.left(text, F.lit(1))), F.lower(text.substr(F.lit(2), F.length(text)))), STR, nulls)
        if name == "replace" and len(args) == 2:
            return Value(F.replace(text, args[0].col, args[1].col), STR, nulls)
        if name == "startswith" and len(args) == 1:
            return Value(F.startswith(text, args[0].col), BOOL, nulls)
        if name == "endswith" and len(args) == 1:
            return Value(F.endswith(text, args[0].col), BOOL, nulls)
        if name == "removeprefix" and len(args) == 1:
            rest = text.substr(F.length(args[0].col) + 1, F.length(text))
            found = F.startswith(text, args[0].col)
            return Value(F.when(found, rest).when(~found, text), STR, nulls)
        if name == "removesuffix" and len(args) == 1:
            rest = text.substr(F.lit(1), F.length(text) - F.length(args[0].col))
            found = F.endswith(text, args[0].col)
            return Value(F.when(found, rest).when(~found, text), STR, nulls)
        if name == "find" and len(args) == 1:
            return Value((F.call_function("instr", text, args[0].col) - 1).cast("bigint"), INT, nulls)
        if name == "count" and len(args) == len(literals) == 1 and literals[0]:
            removed = F.length(text) - F.length(F.replace(text, args[0].col, F.lit("")))
            return Value((removed / len(literals[0])).cast("bigint"), INT, nulls)
        if name == "split":
            if not args:
                words = F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0)
                return Value(words, LIST, nulls)
            if len(args) == len(literals) == 1 and literals[0]:
                return Value(F.split(text, re.escape(literals[0])), LIST, nulls)
        if not hasattr(str, name):
            raise ExpressionError(f"text has no method {name!r}")
        raise UnsupportedExpression(f"method {name!r} with {len(args)} arguments is not supported")

    def stripped(self, name: str, text: Column, chars: str | None = None) -> Column:
        unit = r"\s" if chars is None else "[" + "".join("\\" + c if not c.isalnum() else c for c in chars) + "]"
        edges = {"strip": f"^{unit}+|{unit}+$", "lstrip": f"^{unit}+", "rstrip": f"{unit}+$"}
        return text if chars == "" else F.regexp_replace(text, "(?U)" + edges[name], "")

    def zero_filled(self, target: Value, width: int) -> Value:
        text = target.col
        sign = F.when(F.left(text, F.lit(1)).isin("+", "-"), F.left(text, F.lit(1))).otherwise("")
        digits = text.substr(F.length(sign) + 1, F.length(text))
        filled = F.concat(sign, F.lpad(digits, F.lit(width) - F.length(sign), "0"))
        return Value(F.when(F.length(text) >= width, text).otherwise(filled), STR, target.null_if)

    def literal_int(self, node) -> int:
        try:
            value = ast.literal_eval(node)
        except ValueError:
            value = None
        if not isinstance(value, int):
            raise UnsupportedExpression("a literal integer is needed here")
        return value

    def visit_Subscript(self, node) -> Value:
        target = self.visit(node.value)
        if target.kind not in (STR, LIST):
            raise UnsupportedExpression("only text and split results can be indexed")
        if isinstance(node.slice, ast.Slice):
            if node.slice.step is not None or target.kind == LIST:
                raise UnsupportedExpression("this slice is not supported")
            size = F.length(target.col)
            ends = [None if e is None else self.literal_int(e) for e in (node.slice.lower, node.slice.upper)]
            start, stop = (
                default if e is None else F.lit(e) if e >= 0 else F.greatest(size + e, F.lit(0))
                for e, default in zip(ends, (F.lit(0), size))
            )
            piece = target.col.substr(start + 1, F.greatest(stop - start, F.lit(0)))
            return Value(piece, STR, target.null_if)
        at = self.literal_int(node.slice)
        if target.kind == LIST:
            return Value(F.try_element_at(target.col, F.lit(at + 1 if at >= 0 else at)), STR, None)
        size = F.length(target.col)
        inside = size > at if at >= 0 else size >= -at
        position = F.lit(at + 1) if at >= 0 else size + (at + 1)
        return Value(F.when(inside, target.col.substr(position, F.lit(1))), STR, None)


def _between(parts: list[Value], separator: Column) -> list[Column]:
    out = []
    for part in parts:
        out += [separator, part.col] if out else [part.col]
    return out


def _floor_mod(a: Column, b: Column, kind: str) -> Column:
    rest = F.try_mod(a, b)
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


def _floor_div(a: Column, b: Column, kind: str) -> Column:
    divisor = F.nullif(b, F.lit(0).cast(SPARK_TYPE[kind]))
    if kind == FLOAT:
        a, divisor = a.cast("double"), divisor.cast("double")
        return F.rint((a - _floor_mod(a, divisor, kind)) / divisor)
    quotient = F.call_function("div", a, divisor)
    inexact = F.try_mod(a, divisor) != 0
    return F.when(inexact & ((a < 0) != (divisor < 0)), quotient - 1).otherwise(quotient)


def _whole_power(base: Column, exponent: Column) -> Column:
    """Integer power by squaring; NULL beyond 64 bits and, but for bases 1 and -1, for a negative exponent, whose result is no integer.

    From the 63rd power on only -1, 0 and 1 do not overflow, so six squarings are enough.
    """
    odd = F.pmod(exponent, F.lit(2).cast("bigint")) == 1

    def step(state, k):
        taken = F.call_function("shiftright", exponent, k).bitwiseAND(F.lit(1).cast("bigint")) == 1
        more = F.call_function("shiftright", exponent, k + 1) > 0
        return F.struct(
            F.when(taken, F.try_multiply(state["power"], state["square"])).otherwise(state["power"]).alias("power"),
            F.when(more, F.try_multiply(state["square"], state["square"])).otherwise(state["square"]).alias("square"),
        )

    start = F.struct(F.lit(1).cast("bigint").alias("power"), base.alias("square"))
    squared = F.aggregate(F.array(*[F.lit(k) for k in range(6)]), start, step, lambda state: state["power"])
    return (
        F.when(base.isNull() | exponent.isNull(), None)
        .when((base == 1) | (exponent == 0), F.lit(1).cast("bigint"))
        .when(base == -1, F.when(odd, F.lit(-1)).otherwise(F.lit(1)).cast("bigint"))
        .when(exponent < 0, None)
        .when(base == 0, F.lit(0).cast("bigint"))
        .when(exponent < 64, squared)
    )


def _logical_and(left: Value, right: Value) -> Value:
    combined = F.when(left.is_null(), None).when(~left.col, False).otherwise(right.col)
    return Value(combined, BOOL, None)


def _logical_or(left: Value, right: Value) -> Value:
    combined = F.when(left.is_null(), None).when(left.col, True).otherwise(right.col)
    return Value(combined, BOOL, None)


def value_of(text: str, schema: T.StructType) -> Column:
    """Column of the expression's values, NULL where Python would raise."""
    value = Compiler(schema).compile(text)
    if value.kind == LIST:
        raise UnsupportedExpression("the expression gives a list")
    return value.col


def kept_by(text: str, schema: T.StructType) -> Column:
    """Filter condition: true where the expression is true or would raise."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as exc:
        raise ExpressionError(f"not an expression: {text!r}") from exc
    return Compiler(schema).keeps(tree.body)
