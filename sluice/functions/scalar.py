"""Scalar functions of the dialect, each a builder of a Spark column.

Times are epoch milliseconds in UTC unless a name says otherwise. Semantics are ANSI where the dialect is silent.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Builder = Callable[..., Column]

#: Strftime letters and the matching letters of Spark's date patterns.
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "f": "SSSSSS", "z": "xx", "Z": "z", "%": "%"}


def _lit(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def strftime_pattern(pattern: str) -> str:
    """A Spark date pattern for a strftime one; other text is quoted. Raises ValueError on unknown letters."""
    out, i, quoted = [], 0, []

    def flush() -> None:
        if quoted:
            text = "".join(quoted).replace("'", "''")
            out.append(f"'{text}'" if any(c.isalpha() or c == "'" for c in text) else text)
            quoted.clear()

    while i < len(pattern):
        if pattern[i] == "%" and i + 1 < len(pattern):
            letter = pattern[i + 1]
            if letter not in STRFTIME:
                raise ValueError(f"unknown date letter %{letter}")
            if letter == "%":
                quoted.append("%")
            else:
                flush()
                out.append(STRFTIME[letter])
            i += 2
        else:
            quoted.append(pattern[i])
            i += 1
    flush()
    return "".join(out)


def ts(millis: Column) -> Column:
    return F.timestamp_millis(millis.cast("long"))


def extract(part: str, millis: Column) -> Column:
    """A calendar field of epoch milliseconds; DOW counts from Sunday as 0, WEEK is the ISO week."""
    t, p = ts(millis), part.upper()
    simple = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DOY": F.dayofyear, "WEEK": F.weekofyear, "QUARTER": F.quarter}
    if p in simple:
        return simple[p](t).cast("long")
    if p == "DOW":
        return (F.dayofweek(t) - 1).cast("long")
    if p == "EPOCH":
        return F.unix_seconds(t)
    below = {"MILLISECOND": 1, "MICROSECOND": 1000, "NANOSECOND": 1_000_000}
    if p in below:
        return F.pmod(millis.cast("long"), F.lit(1000)) * below[p]
    raise ValueError(f"unknown part {part}")


def datediff(unit: str, start: Column, end: Column) -> Column:
    """Boundaries of calendar units between two times; hours and smaller count whole units."""
    a, b, u = ts(start), ts(end), unit.lower().rstrip("s")
    years = F.year(b) - F.year(a)
    if u == "year":
        return years.cast("long")
    if u == "quarter":
        return (years * 4 + F.quarter(b) - F.quarter(a)).cast("long")
    if u == "month":
        return (years * 12 + F.month(b) - F.month(a)).cast("long")
    if u == "week":
        return (F.datediff(F.date_trunc("week", b), F.date_trunc("week", a)) / 7).cast("long")
    if u == "day":
        return F.datediff(b, a).cast("long")
    size = {"hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}
    if u in size:
        return F.floor((end.cast("long") - start.cast("long")) / size[u])
    raise ValueError(f"unknown unit {unit}")


def first_match(pattern: str, replacement: str | None) -> tuple[str, str | None]:
    """A pattern that takes all up to the end of the first match, and a replacement that puts back what stood before
    it. The match sees the whole text, so that it may look around; references to groups move up by two."""
    moved = re.sub(r"(?<!\\)((?:\\\\)*)\\([1-9])", lambda m: f"{m[1]}\\{int(m[2]) + 2}", pattern)
    back = None if replacement is None else "$1" + re.sub(r"(?<!\\)\$([0-9])", lambda m: f"${int(m[1]) + 2}", replacement)
    return rf"\A((?s:.*?))({moved})", back


def regexp_replace_first(text: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match replaced, or all with flag g; flag i ignores case."""
    p = f"(?i){pattern}" if "i" in flags else pattern
    if "g" in flags:
        return F.regexp_replace(text, p, replacement)
    first, back = first_match(p, replacement)
    return F.regexp_replace(text, first, back)


def json_path(path: str) -> str:
    """`$.a.0.b` and `a.0.b` as `$.a[0].b`."""
    parts = [p for p in path.removeprefix("$").split(".") if p]
    return "$" + "".join(f"[{p}]" if p.isdigit() else p if p.startswith("[") else f".{p}" for p in parts)


def json_exists(text: Column, path: str) -> Column:
    """Whether the path is there; JSON null is, bad JSON has nothing."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(text), json_path(path), "variant").isNotNull(), F.lit(False))


def json_query(text: Column, path: str) -> Column:
    """Objects and arrays as JSON text; null for scalars."""
    found = F.get_json_object(text, json_path(path))
    return F.when(F.regexp_like(found, F.lit(r"^\s*[\[{]")), found)


def split_part(text: Column, sep: Column, n: Column) -> Column:
    return F.when(_lit(n) < 1, F.lit("")).otherwise(F.split_part(text, _lit(sep), F.greatest(_lit(n), F.lit(1))))


def sqrt_strict(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("SQRT of a negative number"))).otherwise(F.sqrt(x))


def concat(*parts: Column) -> Column:
    """Nulls are skipped; numbers are rendered."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def struct_of(*args: Column | str) -> Column:
    """Name and value pairs; an odd number of values is named field0, field1 and so on."""
    if len(args) % 2 == 0:
        return F.struct(*[_lit(v).alias(str(k)) for k, v in zip(args[::2], args[1::2], strict=True)])
    return F.struct(*[_lit(v).alias(f"field{i}") for i, v in enumerate(args)])


SCALARS: dict[str, Builder] = {
    # math
    "ABS": F.abs,
    "ROUND": lambda x, n=0: F.round(x, n),
    "CEIL": lambda x: F.ceil(x).cast("long"),
    "FLOOR": lambda x: F.floor(x).cast("long"),
    "SQRT": sqrt_strict,
    "POWER": lambda x, y: F.pow(x, _lit(y)),
    "MOD": lambda x, y: x % _lit(y),
    "LEAST": lambda *c: F.least(*map(_lit, c)),
    "GREATEST": lambda *c: F.greatest(*map(_lit, c)),
    # strings
    "UPPER": F.upper,
    "LOWER": F.lower,
    "SUBSTRING": lambda s, a, n=None: F.substring(s, F.greatest(_lit(a), F.lit(1)), _lit(n) if n is not None else F.length(s)),
    "REPLACE": lambda s, a, b: F.replace(s, _lit(a), _lit(b)),
    "TRIM": lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""),
    "LTRIM": lambda s: F.regexp_replace(s, r"(?U)^\s+", ""),
    "RTRIM": lambda s: F.regexp_replace(s, r"(?U)\s+$", ""),
    "LENGTH": F.length,
    "OCTET_LENGTH": F.octet_length,
    "CONCAT": concat,
    "SPLIT": lambda s, d: F.split_part(s, _lit(d), F.lit(1)),
    "JOIN": lambda d, *p: F.concat_ws(d, *[x.cast("string") for x in p]),
    "LEFT": lambda s, n: F.left(s, _lit(n)),
    "RIGHT": lambda s, n: F.right(s, _lit(n)),
    "POSITION": lambda sub, s, start=1: F.locate(sub, s, start) if isinstance(sub, str) else F.position(sub, s, _lit(start)),
    "REGEXP": lambda s, p: F.regexp_like(s, _lit(p)),
    "REGEXP_REPLACE": regexp_replace_first,
    "SPLIT_PART": split_part,
    # dates
    "NOW": lambda: F.unix_millis(F.current_timestamp()),
    "CURRENT_TIMESTAMP": lambda: F.unix_millis(F.current_timestamp()),
    "TIMESTAMP": lambda: F.unix_millis(F.col("_timestamp")),
    "EXTRACT": extract,
    "DATE_FORMAT": lambda ms, p: F.date_format(ts(ms), strftime_pattern(p)),
    "DATEDIFF": datediff,
    "TUMBLE_START": lambda w="window": F.unix_millis(F.col(f"{w}.start").cast("timestamp")),
    "TUMBLE_END": lambda w="window": F.unix_millis(F.col(f"{w}.end").cast("timestamp")),
    "FROM_UNIXTIME": F.timestamp_seconds,
    "UNIX_TIMESTAMP": lambda t=None: F.unix_seconds(F.current_timestamp() if t is None else t.cast("timestamp")),
    # conditions and casts
    "COALESCE": lambda *c: F.coalesce(*map(_lit, c)),
    "NULLIF": lambda a, b: F.nullif(a, _lit(b)),
    "CAST": lambda c, t: c.cast(t),
    # JSON
    "JSON_EXTRACT": lambda j, p: F.get_json_object(j, json_path(p)),
    "JSON_VALUE": lambda j, p: F.get_json_object(j, json_path(p)),
    "JSON_EXISTS": json_exists,
    "JSON_QUERY": json_query,
    # arrays, maps, structs
    "ARRAY": lambda *c: F.array(*map(_lit, c)),
    "STRUCT": struct_of,
    "MAP": lambda *c: F.create_map(*map(_lit, c)),
    "ARRAY_LENGTH": F.array_size,
    "ARRAY_CONTAINS": lambda a, v: F.coalesce(F.array_contains(a, _lit(v)), F.lit(False)),
    "MAP_KEYS": F.map_keys,
    "MAP_VALUES": F.map_values,
    # message headers, a map of text in the column _headers
    "HEADER": lambda k: F.col("_headers")[k],
    "HEADER_KEYS": lambda: F.array_join(F.map_keys("_headers"), ","),
    "HAS_HEADER": lambda k: F.coalesce(F.map_contains_key("_headers", k), F.lit(False)),
    "SET_HEADER": lambda k, v: F.map_concat(F.map_filter("_headers", lambda key, _: key != k), F.create_map(F.lit(k), _lit(v).cast("string"))),
    "REMOVE_HEADER": lambda k: F.map_filter("_headers", lambda key, _: key != k),
}

ALIASES = {"CEILING": "CEIL", "POW": "POWER", "LEN": "LENGTH", "SUBSTR": "SUBSTRING"}


def scalar(name: str, *args: object) -> Column:
    """A function by name, in any case."""
    key = ALIASES.get(name.upper(), name.upper())
    if key not in SCALARS:
        raise KeyError(f"no function {name}")
    return SCALARS[key](*args)


def divide_or_one(a: Column, b: Column) -> Column:
    """Opt-in: division by zero gives 1."""
    return F.when(b == 0, F.lit(1.0)).otherwise(a.cast("double") / F.when(b != 0, b))


def null_safe_equal(a: Column, b: Column) -> Column:
    """Opt-in: null equals null."""
    return a.eqNullSafe(b)
