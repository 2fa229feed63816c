"""Scalar functions of the language: each name builds a Column, so Catalyst sees built-in expressions only.

NULL in gives NULL out unless a function exists to handle NULL. Strings count characters; ``substring`` and ``insert``
positions start at 0 and ``position`` at 1.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]
REGISTRY: dict[str, Builder] = {}
#: User functions, looked up after the built-in ones.
CUSTOM: dict[str, Builder] = {}


def scalar(*names: str) -> Callable[[Builder], Builder]:
    def keep(fn: Builder) -> Builder:
        for n in names or (fn.__name__.rstrip("_"),):
            REGISTRY[n] = fn
        return fn

    return keep


def register(name: str, fn: Builder) -> None:
    """Make a function of Columns (a built-in composition, a UDF or a pandas UDF) callable from query text."""
    CUSTOM[name.lower()] = fn


def unregister(name: str) -> None:
    CUSTOM.pop(name.lower(), None)


def literal(x: Any) -> Any:
    """The Python value of a constant argument, else an error: some functions need one at planning time."""
    value = getattr(x, "_weft_literal", x)
    if isinstance(value, Column):
        raise ValueError("this argument has to be a constant")
    return value


def lit(value: Any) -> Column:
    out = F.lit(value)
    out._weft_literal = value
    return out


for name, fn in {
    "upper": F.upper, "lower": F.lower, "levenshtein": F.levenshtein, "initcap": F.initcap, "abs": F.abs, "sqrt": F.sqrt, "pow": F.pow,
    "log10": F.log10, "log2": F.log2, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "cbrt": F.cbrt, "hypot": F.hypot,
    "sign": F.signum, "radians": F.radians, "degrees": F.degrees, "atan2": F.atan2, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "ln": F.ln,
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "current_date": F.current_date,
    "coalesce": F.coalesce, "ifnull": F.coalesce, "nullif": F.nullif, "greatest": F.greatest, "least": F.least, "typeof": F.typeof, "version": F.version, "hash": F.xxhash64,
    "current_user": F.current_user, "current_database": F.current_database, "gen_random_uuid": F.uuid, "toset": F.array_distinct, "list_distinct": F.array_distinct,
    "list_unique": F.array_distinct, "list_contains": F.array_contains, "list_append": F.array_append, "list_prepend": F.array_prepend, "list_sort": F.sort_array, "exp2": lambda x: F.pow(F.lit(2.0), x),
    "e": F.e, "pi": F.pi, "left": F.left, "right": F.right, "repeat": F.repeat, "concat": F.concat,
}.items():
    REGISTRY[name] = fn


# -- strings
@scalar("length", "char_length")
def length(s: Column) -> Column:
    return F.char_length(s)


@scalar()
def trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


@scalar()
def substring(s: Column, start: Column, n: Column | None = None) -> Column:
    return F.substring(s, F.lit(1) + start, n if n is not None else F.lit(2**31 - 1))


@scalar()
def replace(s: Column, old: Column, new: Column | None = None) -> Column:
    return F.replace(s, old, new if new is not None else F.lit(""))


@scalar()
def contains(s: Column, sub: Column) -> Column:
    return F.contains(s, sub)


@scalar("starts_with")
def starts_with(s: Column, sub: Column) -> Column:
    return F.startswith(s, sub)


@scalar("ends_with")
def ends_with(s: Column, sub: Column) -> Column:
    return F.endswith(s, sub)


@scalar("split", "string_split")
def split(s: Column, sep: Column) -> Column:
    return F.split(s, re.escape(literal(sep)))


@scalar()
def lpad(s: Column, n: Column, pad: Column) -> Column:
    return F.lpad(s, n, pad)


@scalar()
def rpad(s: Column, n: Column, pad: Column) -> Column:
    return F.rpad(s, n, pad)


@scalar()
def concat_ws(sep: Column, *parts: Column) -> Column:
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    return F.when(~missing, F.concat_ws(literal(sep), *parts))


@scalar()
def strcasecmp(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


@scalar()
def split_part(s: Column, sep: Column, n: Column) -> Column:
    return F.split_part(s, sep, n)


@scalar()
def position(s: Column, sub: Column) -> Column:
    return F.locate(literal(sub), s) if not isinstance(getattr(sub, "_weft_literal", sub), Column) else F.position(sub, s)


@scalar()
def insert(s: Column, at: Column, n: Column, new: Column) -> Column:
    return F.overlay(s, new, at + 1, n)


@scalar()
def translate(s: Column, old: Column, new: Column) -> Column:
    return F.translate(s, literal(old), literal(new))


@scalar()
def format(pattern: Column, *args: Column) -> Column:
    out = pattern
    for i, a in enumerate(args):
        out = F.replace(out, F.lit("{%d}" % i), F.coalesce(a.cast("string"), F.lit("NULL")))
    return out


# -- numbers
@scalar()
def log(base: Column, x: Column | None = None) -> Column:
    return F.ln(base) if x is None else F.ln(x) / F.ln(base)


@scalar()
def round_(x: Column, digits: Column | None = None) -> Column:
    return F.round(x, literal(digits) if digits is not None else 0)


@scalar("ceil", "ceiling")
def ceil(x: Column) -> Column:
    return F.ceil(x)


@scalar()
def floor(x: Column) -> Column:
    return F.floor(x)


@scalar()
def rand(seed: Column | None = None) -> Column:
    return F.rand(literal(seed)) if seed is not None else F.rand()


@scalar("rand32")
def rand32(low: Column | None = None, high: Column | None = None) -> Column:
    a = low if high is not None else F.lit(0)
    b = high if high is not None else low if low is not None else F.lit(2**31 - 1)
    return (a + F.floor(F.rand() * (b - a))).cast("int")


@scalar("rand64")
def rand64(low: Column | None = None, high: Column | None = None) -> Column:
    a = low if high is not None else F.lit(0)
    b = high if high is not None else low if low is not None else F.lit(2**62)
    return (a + F.floor(F.rand() * (b - a))).cast("long")


@scalar("bit_and")
def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


@scalar("bit_or")
def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


@scalar("bit_xor")
def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


@scalar()
def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a fold: 64-bit numbers take at most 93 steps."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))

    def step(s: Column, _: Column) -> Column:
        x, y = s["x"], s["y"]
        return F.struct(F.when(y == 0, x).otherwise(y).alias("x"), F.when(y == 0, F.lit(0).cast("long")).otherwise(x % F.nullif(y, F.lit(0))).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


@scalar()
def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(F.abs(a * (b / F.nullif(g, F.lit(0))).cast("long")))


# -- dates and times
@scalar("now", "current_timestamp")
def now() -> Column:
    return F.unix_millis(F.current_timestamp())


@scalar()
def date(s: Column | None = None) -> Column:
    return F.current_date() if s is None else F.to_date(s)


@scalar()
def time(s: Column) -> Column:
    """Microseconds of the day of HH:MM:SS[.f]."""
    parts = F.split(s, ":")
    seconds = F.element_at(parts, 3).cast("decimal(12,6)")
    return ((F.element_at(parts, 1).cast("long") * 3600 + F.element_at(parts, 2).cast("long") * 60) * 1_000_000 + (seconds * 1_000_000).cast("long")).cast("long")


@scalar()
def datetime(s: Column | None = None) -> Column:
    return F.current_timestamp() if s is None else F.to_timestamp(s)


@scalar()
def timestamp(s: Column | None = None) -> Column:
    return F.unix_millis(F.current_timestamp() if s is None else s.cast("timestamp"))


@scalar("date_add")
def date_add(d: Column, n: Column) -> Column:
    return _shift(d, n)


@scalar("date_sub")
def date_sub(d: Column, n: Column) -> Column:
    return _shift(d, -n)


def _shift(d: Column, n: Column) -> Column:
    """Days later, a date staying a date and a time keeping its time of day."""
    return d + F.make_dt_interval(n.cast("int"))


@scalar("date_diff")
def date_diff(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


@scalar("date_trunc")
def date_trunc(value: Column, unit: Column) -> Column:
    return F.date_trunc(literal(unit), value)


#: strftime letters and their date_format patterns.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "j": "DDD", "B": "MMMM", "b": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "I": "hh", "f": "SSSSSS"}


@scalar("to_char")
def to_char(value: Column, pattern: Column) -> Column:
    p = re.sub(r"%([A-Za-z])", lambda m: f"\0{STRFTIME.get(m[1], m[1])}\0", literal(pattern))
    pieces = p.split("\0")
    java = "".join(x if i % 2 else re.sub(r"[A-Za-z]+", r"'\g<0>'", x) for i, x in enumerate(pieces))
    return F.date_format(value, java)


@scalar("to_date")
def to_date(s: Column, pattern: Column | None = None) -> Column:
    if pattern is not None:
        return F.try_to_date(s, literal(pattern)) if hasattr(F, "try_to_date") else F.to_date(s, literal(pattern))
    formats = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "M-d-yyyy", "yyyyMMdd")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in formats])


@scalar()
def age(d: Column) -> Column:
    return F.datediff(F.current_date(), d)


@scalar("last_day")
def last_day(d: Column) -> Column:
    return F.last_day(d)


@scalar("generate_series", "range")
def generate_series(start: Column, end: Column, step: Column | None = None) -> Column:
    """Inclusive at both ends; empty if the step leads away from the end."""
    step = step if step is not None else F.lit(1)
    away = ((step > 0) & (start > end)) | ((step < 0) & (start < end))
    return F.when(away, F.filter(F.array(start), lambda x: F.lit(False))).otherwise(F.sequence(start, end, F.when(away, F.when(start > end, -1).otherwise(1)).otherwise(step)))


# -- regular expressions and conversions
@scalar("regex_match")
def regex_match(s: Column, pattern: Column) -> Column:
    return F.regexp_like(s, pattern)


@scalar("regex_replace")
def regex_replace(s: Column, pattern: Column, new: Column) -> Column:
    return F.regexp_replace(s, pattern, new)


@scalar("regex_find")
def regex_find(s: Column, pattern: Column) -> Column:
    return F.regexp_substr(s, pattern)


@scalar("to_string", "tostring")
def to_string(x: Column) -> Column:
    return x.cast("string")


@scalar("to_int", "tointeger")
def to_int(x: Column) -> Column:
    return x.try_cast("bigint")


@scalar("to_float", "tofloat")
def to_float(x: Column) -> Column:
    return x.try_cast("double")


@scalar("to_bool", "toboolean")
def to_bool(x: Column) -> Column:
    return x.try_cast("boolean")


# -- lists and maps
@scalar()
def head(x: Column) -> Column:
    return F.get(x, F.lit(0))


@scalar()
def last(x: Column) -> Column:
    return F.get(x, F.size(x) - 1)


@scalar()
def tail(x: Column) -> Column:
    return F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))


@scalar()
def size(x: Column) -> Column:
    """Elements of a list or map; characters of a string are ``length``."""
    return F.size(x)


@scalar()
def keys(x: Column) -> Column:
    return F.array_sort(F.map_keys(x))


@scalar()
def reverse(x: Column) -> Column:
    return F.reverse(x)


@scalar("list_filter")
def list_filter(x: Column, mask: Column) -> Column:
    n = F.least(F.size(x), F.size(mask))
    kept = F.filter(F.arrays_zip(F.slice(x, F.lit(1), n).alias("v"), F.slice(mask, F.lit(1), n).alias("m")), lambda s: s["m"])
    return F.transform(kept, lambda s: s["v"])


@scalar("list_transform")
def list_transform(x: Column, new: Column) -> Column:
    return F.zip_with(x, new, lambda a, b: F.coalesce(b, a))


@scalar("list_concat")
def list_concat(*x: Column) -> Column:
    return F.concat(*x)


@scalar("list_slice")
def list_slice(x: Column, start: Column, end: Column | None = None) -> Column:
    """[start, end), from 0; negative positions count from the end."""
    n = F.size(x)
    a = F.greatest(F.when(start < 0, n + start).otherwise(start), F.lit(0))
    b = n if end is None else F.least(F.when(end < 0, n + end).otherwise(end), n)
    return F.slice(x, a + 1, F.greatest(b - a, F.lit(0)))


@scalar("list_to_string")
def list_to_string(x: Column, sep: Column | None = None) -> Column:
    return F.array_join(x.cast("array<string>"), literal(sep) if sep is not None else ",")


@scalar("list_extract")
def list_extract(x: Column, i: Column) -> Column:
    return F.get(x, F.when(i < 0, F.size(x) + i).otherwise(i))


# -- JSON
@scalar("json_extract")
def json_extract(s: Column, path: Column) -> Column:
    p = literal(path)
    return F.get_json_object(s, p if p.startswith("$") else "$." + p)


@scalar("json_build_object")
def json_build_object(*pairs: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(str(literal(k))) for k, v in zip(pairs[::2], pairs[1::2], strict=True)]), {"ignoreNullFields": "false"})


@scalar("json_build_array")
def json_build_array(*items: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(F.regexp_replace(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}), r"^\{\"v\":|\}$", ""), F.lit("null")) for x in items]), F.lit("]"))


@scalar("json_object_keys")
def json_object_keys(s: Column) -> Column:
    return F.json_object_keys(s)


@scalar("json_each")
def json_each(s: Column) -> Column:
    return F.map_entries(F.from_json(s, "map<string,string>"))


@scalar("json_typeof")
def json_typeof(s: Column) -> Column:
    t = F.regexp_replace(s, r"^\s+", "")
    first = F.substring(t, 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").when(F.regexp_like(first, F.lit("[-0-9]")), "number")


@scalar("json_strip_nulls")
def json_strip_nulls(s: Column) -> Column:
    return F.to_json(F.map_filter(F.from_json(s, "map<string,string>"), lambda k, v: v.isNotNull()))


# -- statistics over two lists
def _pairs(a: Column, b: Column) -> tuple[Column, ...]:
    z = F.arrays_zip(F.transform(a, lambda v: v.cast("double")).alias("x"), F.transform(b, lambda v: v.cast("double")).alias("y"))
    z = F.filter(z, lambda s: s["x"].isNotNull() & s["y"].isNotNull())
    n = F.size(z).cast("double")

    def total(f: Callable[[Column], Column]) -> Column:
        return F.aggregate(z, F.lit(0.0), lambda acc, s: acc + f(s))

    return n, total(lambda s: s["x"]), total(lambda s: s["y"]), total(lambda s: s["x"] * s["y"]), total(lambda s: s["x"] * s["x"]), total(lambda s: s["y"] * s["y"])


@scalar("corr")
def corr(a: Column, b: Column) -> Column:
    n, x, y, xy, xx, yy = _pairs(a, b)
    return (n * xy - x * y) / F.nullif(F.sqrt((n * xx - x * x) * (n * yy - y * y)), F.lit(0.0))


@scalar("covar_pop")
def covar_pop(a: Column, b: Column) -> Column:
    n, x, y, xy, _, _ = _pairs(a, b)
    return F.when(n > 0, (xy - x * y / F.nullif(n, F.lit(0.0))) / F.nullif(n, F.lit(0.0)))


@scalar("covar_samp")
def covar_samp(a: Column, b: Column) -> Column:
    n, x, y, xy, _, _ = _pairs(a, b)
    return F.when(n > 1, (xy - x * y / F.nullif(n, F.lit(0.0))) / F.nullif(n - 1, F.lit(0.0)))
