"""Values in object queries: what differs from SQL, as functions on Columns.

Equality is null-safe and false between kinds; NaN equals nothing; `/` is always floating; integer
overflow wraps; LIKE is a whole-match regular expression; NOT LIKE and NOT IN of null are false.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_INT_BITS = {"byte": 8, "short": 16, "int": 32, "long": 64}


def smart_fix(pattern: str, anywhere: bool = False) -> str:
    """A pattern as people type it: `$` inside names and `[]` are literal; anywhere: match inside."""
    fixed = re.sub(r"(?<!\\)\$(?!$)", r"\\$", pattern).replace("[]", r"\[\]")
    if anywhere and not any(x in fixed for x in (".*", "^")) and not fixed.endswith("$"):
        fixed = f".*{fixed}.*"
    return fixed


def whole(pattern: str) -> str:
    """The pattern over all of a text: unlike `$`, the end is not before a last line break."""
    return rf"\A(?:{pattern})\z"


def truthy(x: Column, kind: str) -> Column:
    """Operand of AND / OR: number other than 0 and NaN, non-empty string, true; null is false."""
    if kind == "boolean":
        held = x
    elif kind == "string":
        held = x != ""
    elif kind in ("float", "double"):
        held = (x != 0) & ~F.isnan(x)
    elif kind in _INT_BITS:
        held = x != 0
    else:
        held = F.lit(True)
    return F.coalesce(held & x.isNotNull(), F.lit(False))


def where(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def eq(a: Column, b: Column, same_kind: bool = True) -> Column:
    """Null-safe equality; values of different kinds are never equal unless both are null."""
    if not same_kind:
        return a.isNull() & b.isNull()
    return a.eqNullSafe(b)


def eq_double(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b) & ~F.coalesce(F.isnan(a), F.lit(False))


def ne(a: Column, b: Column, same_kind: bool = True) -> Column:
    return ~eq(a, b, same_kind)


def compare(a: Column, op: str, b: Column, floating: bool = False, strict: bool = False) -> Column:
    """<, >, <=, >=: NaN compares false; null is false, or an error where strict."""
    out = {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]
    if floating:
        out = out & ~F.isnan(a) & ~F.isnan(b)
    if strict:
        return F.when(a.isNull() | b.isNull(), F.raise_error(F.lit("comparison with null"))).otherwise(out)
    return F.coalesce(out, F.lit(False))


def like(x: Column, pattern: str) -> Column:
    return F.coalesce(x.cast("string").rlike(whole(smart_fix(pattern))), F.lit(False))


def not_like(x: Column, pattern: str) -> Column:
    return F.coalesce(~x.cast("string").rlike(whole(smart_fix(pattern))), F.lit(False))


def in_array(x: Column, items: Column) -> Column:
    return F.coalesce(F.array_contains(items, x), F.lit(False)) & x.isNotNull()


def not_in_array(x: Column, items: Column) -> Column:
    return x.isNotNull() & items.isNotNull() & ~F.coalesce(F.array_contains(items, x), F.lit(False))


def wrap(x: Column, kind: str = "int") -> Column:
    """A decimal or wide integer result brought back to kind's range as Java arithmetic does."""
    bits = _INT_BITS[kind]
    wide = x.cast("decimal(38,0)")
    half, full = F.lit(str(2 ** (bits - 1))).cast("decimal(38,0)"), F.lit(str(2**bits)).cast("decimal(38,0)")
    return (F.pmod(wide + half, full) - half).cast("bigint" if kind == "long" else kind)


def _wide(x: Column) -> Column:
    return x.cast("decimal(19,0)")


def add(a: Column, b: Column, kind: str = "int") -> Column:
    return wrap(_wide(a) + _wide(b), kind)


def subtract(a: Column, b: Column, kind: str = "int") -> Column:
    return wrap(_wide(a) - _wide(b), kind)


def multiply(a: Column, b: Column, kind: str = "int") -> Column:
    """Wrapping product; long operands are multiplied by halves of the left one to stay in range."""
    if kind != "long":
        return wrap(_wide(a) * _wide(b), kind)
    high, low = F.floor(_wide(a) / F.lit(2**32)), F.pmod(_wide(a), F.lit(2**32).cast("decimal(19,0)"))
    upper = F.pmod(wrap(high.cast("decimal(19,0)") * _wide(b), "long").cast("decimal(19,0)"), F.lit(2**32).cast("decimal(19,0)"))
    lower = wrap(low.cast("decimal(11,0)") * b.cast("decimal(20,0)"), "long")
    return wrap(wrap(upper.cast("decimal(11,0)") * F.lit(2**32).cast("decimal(11,0)"), "long").cast("decimal(20,0)") + lower, "long")


def divide(a: Column, b: Column) -> Column:
    """Floating division as in Java: x/0 is an infinity, 0/0 and NaN operands NaN."""
    a, b = a.cast("double"), b.cast("double")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    minus = b.cast("string").startswith("-")  # -0.0 turns the sign
    by_zero = F.when((a == 0) | F.isnan(a), nan).when((a > 0) != minus, inf).otherwise(-inf)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))


def concat(text: Column, x: Column) -> Column:
    """text + x: null reads "null"."""
    return F.concat(text, F.coalesce(x.cast("string"), F.lit("null")))


def to_hex(x: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(x)))


def to_string(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("null"))


def item(array: Column, i: Column | int) -> Column:
    """array[i]: null outside, also for a negative index."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when(i >= 0, F.get(array, i))


def part(array: Column, first: int, last: int) -> Column:
    """array[first:last], both inclusive; negative counts from the end; clamped."""
    n = F.size(array)
    at = lambda i: F.lit(i) if i >= 0 else n + F.lit(i)
    low, high = F.greatest(at(first), F.lit(0)), F.least(at(last), n - 1)
    return F.when(array.isNotNull(), F.slice(array, low + 1, F.greatest(high - low + 1, F.lit(0))))


def _hash_step(h: Column, point: Column) -> Column:
    """31 * h + each UTF-16 unit of a code point, wrapping at 32 bits as a text's hash does."""
    over = (point - 0x10000).cast("long")
    one = lambda h, unit: F.pmod(h * 31 + unit + 2**31, F.lit(2**32)) - 2**31
    high, low = F.lit(0xD800) + F.floor(over / 1024), F.lit(0xDC00) + F.pmod(over, F.lit(1024))
    return F.when(point < 0x10000, one(h, point.cast("long"))).otherwise(one(one(h, high), low)).cast("long")


#: Methods that queries may call on values; Java's indexes count from 0.
METHODS = {
    "length": F.length,
    "startsWith": lambda s, x: s.startswith(x),
    "endsWith": lambda s, x: s.endswith(x),
    "contains": lambda s, x: s.contains(x),
    "indexOf": lambda s, x: F.instr(s, x) - 1,
    "substring": lambda s, a, b=None: F.substring(s, a + 1, 2**31 - 1) if b is None else F.substring(s, a + 1, b - a),
    "toUpperCase": F.upper,
    "toLowerCase": F.lower,
    "trim": lambda s: F.regexp_replace(s, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""),
    "replaceAll": lambda s, r, x: F.regexp_replace(s, r, x),
    "matches": lambda s, r: s.rlike(whole(r)),
    "equals": lambda a, b: a.eqNullSafe(b),
    "get": lambda a, i: F.get(a, F.lit(i)),
    "size": F.size,
    "subList": lambda a, i, j: F.slice(a, i + 1, j - i),
    "intValue": lambda x: x.cast("int"),
    "longValue": lambda x: x.cast("long"),
    "floatValue": lambda x: x.cast("float"),
    "doubleValue": lambda x: x.cast("double"),
    "compareTo": lambda a, b: F.when(a < b, -1).when(a > b, 1).when(a == b, 0),
    "hashCode": lambda s: F.when(s.isNotNull(), F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: _hash_step(h, F.ascii(c))).cast("int")),
    "toArray": lambda a: a,
    "getKey": lambda e: e["key"],
    "getValue": lambda e: e["value"],
}


def call(method: str, x: Column, *args) -> Column:
    if method not in METHODS:
        raise ValueError(f"{method} is not a method that queries may call")
    return METHODS[method](x, *args)
