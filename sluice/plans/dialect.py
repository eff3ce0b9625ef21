"""The streaming SQL dialect, rewritten to Spark SQL so that Catalyst plans it.

Only what Spark lacks is rewritten: WINDOW and EMIT clauses, row buffers, joins WITHIN a span, ANY and ALL, and calls of
functions that differ. Everything else passes through as it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from sluice.functions.scalar import first_match, json_path, strftime_pattern

_TOKEN = re.compile(r"(?P<space>\s+)|(?P<note>--[^\n]*)|(?P<text>'(?:[^']|'')*')|(?P<name>`[^`]+`|\x22[^\x22]+\x22|[A-Za-z_][A-Za-z0-9_]*)|(?P<param>\$[0-9]+)|(?P<number>[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?[A-Za-z]*)|(?P<sign><=>|<>|!=|<=|>=|\|\||.)", re.S)
#: Suffixes of durations.
UNITS = {"ns": ("microsecond", 0.001), "us": ("microsecond", 1), "ms": ("millisecond", 1), "s": ("second", 1), "m": ("minute", 1), "h": ("hour", 1), "d": ("day", 1), "w": ("week", 1)}
_CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP BY", "WINDOW", "HAVING", "ORDER BY", "LIMIT", "EMIT", "WITH")
#: Window functions that take no frame.
_FRAMELESS = {"LAG", "LEAD", "ROW_NUMBER", "RANK", "DENSE_RANK", "PERCENT_RANK", "CUME_DIST", "NTILE"}


class DialectError(ValueError):
    """A text that the dialect doesn't allow."""


@dataclass
class Query:
    """A rewritten query and what isn't part of a relational plan."""

    sql: str
    emit: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    window: str | None = None
    notes: dict[str, str] = field(default_factory=dict)
    #: Length of the time window as an interval, for the watermark that a stream gets by default.
    size: str | None = None


def tokens(text: str) -> list[str]:
    found = [m.group() for m in _TOKEN.finditer(text) if m.lastgroup not in ("space", "note")]
    return [f"`{t[1:-1]}`" if t[:1] == '"' and len(t) > 1 else t for t in found]


def bound(text: str, params: Sequence[object]) -> str:
    """The text with `$1`, `$2` and so on replaced by literals of the parameters; not within quotes."""

    def literal(v: object) -> str:
        if v is None or isinstance(v, bool):
            return {None: "NULL", True: "TRUE", False: "FALSE"}[v]
        return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    def one(m: re.Match) -> str:
        if m.lastgroup != "param":
            return m.group()
        if not 0 < int(m.group()[1:]) <= len(params):
            raise DialectError(f"no parameter {m.group()}")
        return literal(params[int(m.group()[1:]) - 1])

    return _TOKEN.sub(one, text)


def annotations(text: str) -> dict[str, str]:
    """`-- @name: value` lines."""
    return {m[1]: m[2].strip() for m in re.finditer(r"--\s*@(\w+)\s*:?([^\n]*)", text)}


def duration(tokens_: list[str]) -> str:
    """`5m`, `90`, `INTERVAL '5' MINUTE` as a Spark interval text; bare numbers are seconds."""
    joined = " ".join(tokens_)
    if m := re.fullmatch(r"INTERVAL '(\d+)' (\w+)", joined, re.I):
        return f"{m[1]} {m[2].lower().rstrip('s')}"
    if m := re.fullmatch(r"(\d+)\s*([a-z]*)", joined, re.I):
        unit, scale = UNITS.get(m[2].lower() or "s", (None, 0))
        if unit:
            return f"{max(1, int(int(m[1]) * scale))} {unit}"
    raise DialectError(f"not a duration: {joined}")


def _close(ts: list[str], at: int) -> int:
    """Index of the bracket that closes the one at `at`."""
    depth = 0
    for i in range(at, len(ts)):
        depth += (ts[i] == "(") - (ts[i] == ")")
        if not depth:
            return i
    raise DialectError("a bracket isn't closed")


def _arguments(ts: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in ts:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [] if out == [[]] else out


def _unquote(text: str) -> str:
    return text[1:-1].replace("''", "'") if text[:1] == "'" else text


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _datediff(a: list[str]) -> str:
    unit, s, e = _unquote(a[0]).lower().rstrip("s"), f"timestamp_millis({a[1]})", f"timestamp_millis({a[2]})"
    years = f"(year({e}) - year({s}))"
    texts = {
        "year": years,
        "quarter": f"({years} * 4 + quarter({e}) - quarter({s}))",
        "month": f"({years} * 12 + month({e}) - month({s}))",
        "week": f"cast(date_diff(date_trunc('week', {e}), date_trunc('week', {s})) / 7 as bigint)",
        "day": f"date_diff({e}, {s})",
    }
    size = {"hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}
    if unit in size:
        return f"floor(({a[2]} - {a[1]}) / {size[unit]})"
    if unit not in texts:
        raise DialectError(f"unknown unit {unit}")
    return texts[unit]


def _extract(a: list[str]) -> str:
    if len(a) == 1:
        part, _, rest = a[0].partition(" FROM ")
    else:
        part, rest = _unquote(a[0]), a[1]
    p, t = part.strip().upper(), f"timestamp_millis({rest})"
    special = {"DOW": f"(dayofweek({t}) - 1)", "EPOCH": f"unix_seconds({t})", "MILLISECOND": f"pmod({rest}, 1000)", "MICROSECOND": f"pmod({rest}, 1000) * 1000", "NANOSECOND": f"pmod({rest}, 1000) * 1000000", "WEEK": f"weekofyear({t})", "SECOND": f"second({t})"}
    return special.get(p, f"extract({p} FROM {t})")


def _literal(text: str) -> str:
    """A quoted literal with Spark's escapes; anything else as it is."""
    return _quote(_unquote(text)) if text[:1] == "'" else text


def _regexp_replace(a: list[str]) -> str:
    flags = _unquote(a[3]) if len(a) > 3 else ""
    p = ("(?i)" if "i" in flags else "") + _unquote(a[1])
    if "g" in flags:
        return f"regexp_replace({a[0]}, {_quote(p)}, {_literal(a[2])})"
    first, back = first_match(p, _unquote(a[2]) if a[2][:1] == "'" else None)
    return f"regexp_replace({a[0]}, {_quote(first)}, {_quote(back) if back is not None else f'concat({_quote(chr(36) + str(1))}, {a[2]})'})"


def _trim(pattern: str) -> Callable[[list[str]], str]:
    return lambda a: f"regexp_replace({a[0]}, {_quote(pattern)}, '')"


def _struct(a: list[str]) -> str:
    return f"named_struct({', '.join(a)})" if a and len(a) % 2 == 0 and all(x[:1] == "'" for x in a[::2]) else f"struct({', '.join(a)})"


def _percentile(kind: str) -> Callable[[list[str]], str]:
    """With two arguments, the value and the share; with one, the call before WITHIN GROUP."""
    return lambda a: f"percentile_{kind}({a[1]}) WITHIN GROUP (ORDER BY {a[0]})" if len(a) > 1 else f"percentile_{kind}({a[0]})"


def _json(a: list[str]) -> str:
    return f"get_json_object({a[0]}, {_quote(json_path(_unquote(a[1])))})"


#: Calls that differ from Spark's function of that name, or that Spark doesn't have.
CALLS: dict[str, Callable[[list[str]], str]] = {
    "LEN": lambda a: f"length({a[0]})",
    "CONCAT": lambda a: f"concat_ws('', {', '.join(a)})",
    "SPLIT": lambda a: f"split_part({a[0]}, {a[1]}, 1)",
    "JOIN": lambda a: f"concat_ws({', '.join(a)})",
    "SUBSTRING": lambda a: f"substring({a[0]}, greatest({a[1]}, 1){''.join(', ' + x for x in a[2:])})",
    "SPLIT_PART": lambda a: f"CASE WHEN {a[2]} < 1 THEN '' ELSE split_part({a[0]}, {a[1]}, greatest({a[2]}, 1)) END",
    "REGEXP": lambda a: f"regexp_like({a[0]}, {_literal(a[1])})",
    "TRIM": _trim(r"(?U)^\s+|\s+$"),
    "LTRIM": _trim(r"(?U)^\s+"),
    "RTRIM": _trim(r"(?U)\s+$"),
    "SQRT": lambda a: f"CASE WHEN {a[0]} < 0 THEN raise_error('SQRT of a negative number') ELSE sqrt({a[0]}) END",
    "STRUCT": _struct,
    "PERCENTILE_CONT": _percentile("cont"),
    "PERCENTILE_DISC": _percentile("disc"),
    "CURRENT_TIMESTAMP": lambda a: "unix_millis(current_timestamp())",
    "TIMESTAMP": lambda a: f"cast({a[0]} AS timestamp)" if a else "unix_millis(cast(_timestamp AS timestamp))",
    "SET_HEADER": lambda a: f"map_concat(map_filter(_headers, (k, v) -> k <> {a[0]}), map({a[0]}, cast({a[1]} AS string)))",
    "REMOVE_HEADER": lambda a: f"map_filter(_headers, (k, v) -> k <> {a[0]})",
    "REGEXP_REPLACE": _regexp_replace,
    "NOW": lambda a: "unix_millis(current_timestamp())",
    "EXTRACT": _extract,
    "DATE_FORMAT": lambda a: f"date_format(timestamp_millis({a[0]}), {_quote(strftime_pattern(_unquote(a[1])))})",
    "DATEDIFF": _datediff,
    "TUMBLE_START": lambda a: "unix_millis(cast(window.start AS timestamp))",
    "TUMBLE_END": lambda a: "unix_millis(cast(window.end AS timestamp))",
    "FROM_UNIXTIME": lambda a: f"timestamp_seconds({a[0]})",
    "UNIX_TIMESTAMP": lambda a: f"unix_seconds(cast({a[0]} AS timestamp))" if a else "unix_seconds(current_timestamp())",
    "JSON_EXTRACT": _json,
    "JSON_VALUE": _json,
    "JSON_QUERY": lambda a: f"CASE WHEN regexp_like({_json(a)}, '^[\\\\[{{]') THEN {_json(a)} END",
    "JSON_EXISTS": lambda a: f"(try_variant_get(try_parse_json({a[0]}), {_quote(json_path(_unquote(a[1])))}, 'variant') IS NOT NULL)",
    "ARRAY_LENGTH": lambda a: f"array_size({a[0]})",
    "ARRAY_CONTAINS": lambda a: f"coalesce(array_contains({a[0]}, {a[1]}), false)",
    "COUNT_DISTINCT": lambda a: f"count(DISTINCT {a[0]})",
    "DELTA": lambda a: f"(max({a[0]}) - min({a[0]}))",
    "COLLECT": lambda a: f"listagg({a[0]}, {a[1] if len(a) > 1 else _quote(',')})",
    "GROUP_CONCAT": lambda a: f"listagg({a[0]}, {a[1] if len(a) > 1 else _quote(',')})",
    "HEADER": lambda a: f"_headers[{a[0]}]",
    "HEADER_KEYS": lambda a: "array_join(map_keys(_headers), ',')",
    "HAS_HEADER": lambda a: f"coalesce(map_contains_key(_headers, {a[0]}), false)",
}


def _calls(ts: list[str]) -> list[str]:
    """Calls in CALLS replaced, innermost first."""
    out: list[str] = []
    i = 0
    while i < len(ts):
        name = ts[i].upper()
        if i + 1 < len(ts) and ts[i + 1] == "(" and name in CALLS and not (name in ("LEFT", "RIGHT", "JOIN") and out[-1:] and out[-1].upper() in ("INNER", "OUTER", "LEFT", "RIGHT", "FULL")) and not (name == "JOIN" and ts[i + 2 : i + 3] and ts[i + 2].upper().startswith("SELECT")):
            end = _close(ts, i + 1)
            out.append(CALLS[name]([" ".join(_calls(a)) for a in _arguments(ts[i + 2 : end])]))
            i = end + 1
        else:
            out.append(ts[i])
            i += 1
    return out


@dataclass
class _Buffers:
    """What the row buffers of a SELECT ask of the rest of the query: filters (partition and order, rows) for full
    buffers, and islands (partition, order, span) after which they start anew."""

    full: list[tuple[str, int]] = field(default_factory=list)
    islands: list[tuple[str, str, str]] = field(default_factory=list)

    def translated(self, ts: list[str]) -> list[str]:
        """`OVER (ROWS WINDOW BUFFER n ROWS ...)` as frames of the last n rows."""
        out: list[str] = []
        i = 0
        while i < len(ts):
            if ts[i].upper() == "OVER" and [t.upper() for t in ts[i + 1 : i + 5]] == ["(", "ROWS", "WINDOW", "BUFFER"]:
                end = _close(ts, i + 1)
                out += ["OVER", "(", *self._frame(out, int(ts[i + 5]), ts[i + 7 : end]), ")"]
                i = end + 1
            else:
                out.append(ts[i])
                i += 1
        return out

    def _frame(self, out: list[str], n: int, rest: list[str]) -> list[str]:
        upper = [t.upper() for t in rest]
        at = min([upper.index(w) for w in ("EMIT", "EXPIRE") if w in upper], default=len(rest))
        clauses, rest, upper = upper[at:], rest[:at], upper[:at]
        raw = rest + [""]
        framed = min([k for k, t in enumerate(upper) if t in ("ROWS", "RANGE")], default=len(rest))
        body, frame = rest[:framed], rest[framed:]
        while clauses:
            if clauses[:3] == ["EMIT", "EVERY", "RECORD"]:
                clauses = clauses[3:]
            elif clauses[:4] == ["EMIT", "ON", "BUFFER", "FULL"]:
                self.full.append((body, n))
                clauses = clauses[4:]
            elif clauses[:3] == ["EXPIRE", "AFTER", "NEVER"]:
                clauses = clauses[3:]
            elif clauses[:2] == ["EXPIRE", "AFTER"] and "INACTIVITY" in clauses:
                till = clauses.index("INACTIVITY")
                order = [t.upper() for t in body].index("ORDER") if "ORDER" in [t.upper() for t in body] else len(body)
                if order == len(body):
                    raise DialectError("EXPIRE AFTER needs an ORDER BY")
                keys, by = body[:order], body[order + 2 :]
                if "," in by:
                    raise DialectError("EXPIRE AFTER needs an ORDER BY of one time column")
                island = (" ".join(keys), " ".join(by[:1]), duration(clauses[2:till]))
                if island not in self.islands:
                    self.islands.append(island)
                body = [*(keys + [","] if keys else ["PARTITION", "BY"]), f"_island{self.islands.index(island)}", *body[order:]]
                if self.full and self.full[-1][0] == raw[: len(self.full[-1][0])]:
                    self.full[-1] = (body, n)
                clauses = clauses[till + 1 :]
            else:
                raise DialectError(f"{' '.join(clauses)} isn't there for row buffers")
        k, depth = len(out) - 1, 0
        while k >= 0:  # back to the name of the function
            depth += (out[k] == ")") - (out[k] == "(")
            k -= 1
            if not depth:
                break
        if "BETWEEN" not in upper and out[k].upper() not in _FRAMELESS:
            return [*body, "ROWS", "BETWEEN", str(n - 1), "PRECEDING", "AND", "CURRENT", "ROW"]
        return [*body, *frame]

    def applied(self, parts: dict[str, str]) -> str:
        """The SQL of clauses with what the buffers ask for."""
        if self.islands:
            source = f"SELECT * FROM {parts['FROM']}" + (f" WHERE {parts.pop('WHERE')}" if "WHERE" in parts else "")
            alias = parts["FROM"].split()[-1]
            for k, (keys, order, span) in enumerate(self.islands):
                over = f"OVER ({keys} ORDER BY {order}"
                source = f"SELECT *, coalesce({order} > lag({order}) {over}) + INTERVAL {span}, false) AS _quiet{k} FROM ({source}) AS {alias}"
                source = f"SELECT *, sum(cast(_quiet{k} AS int)) {over} ROWS UNBOUNDED PRECEDING) AS _island{k} FROM ({source}) AS {alias}"
            parts["FROM"] = f"({source}) AS {alias}"
        if not self.full:
            return " ".join(f"{c} {parts[c]}" for c in _CLAUSES if c in parts)
        names = []
        for k, (body, n) in enumerate(self.full):
            names.append(f"_full{k} >= {n}")
            parts["SELECT"] += f", row_number() OVER ({' '.join(body)}) AS _full{k}"
        inner = " ".join(f"{c} {parts[c]}" for c in _CLAUSES if c in parts and c not in ("ORDER BY", "LIMIT"))
        outer = " ".join(f"{c} {parts[c]}" for c in ("ORDER BY", "LIMIT") if c in parts)
        hidden = ", ".join(f"_full{k}" for k in range(len(self.full)))
        return f"SELECT * EXCEPT ({hidden}) FROM ({inner}) WHERE {' AND '.join(names)} {outer}".strip()


def _split(ts: list[str]) -> dict[str, list[str]]:
    """Top-level clauses."""
    found: dict[str, list[str]] = {}
    depth, now, i = 0, None, 0
    while i < len(ts):
        depth += (ts[i] == "(") - (ts[i] == ")")
        two, one = " ".join(ts[i : i + 2]).upper(), ts[i].upper()
        clause = two if two in _CLAUSES else one if one in _CLAUSES and (one != "WITH" or now is not None) else None
        if depth == 0 and clause and not (one == "WINDOW" and out_of_place(ts, i)):
            if clause in found:
                raise DialectError(f"two {clause} clauses")
            if now and _CLAUSES.index(clause) < _CLAUSES.index(now):
                raise DialectError(f"{clause} can't come after {now}")
            now = clause
            found[now] = []
            i += len(clause.split())
        else:
            if now is None:
                raise DialectError(f"unexpected {ts[i]}")
            found[now].append(ts[i])
            i += 1
    return found


def out_of_place(ts: list[str], i: int) -> bool:
    """Whether WINDOW is a column here."""
    return i + 1 >= len(ts) or ts[i + 1].upper() not in ("TUMBLING", "SLIDING", "HOPPING", "SESSION", "ROWS")


def _window(ts: list[str], time: str) -> tuple[str, str, str, list[str]]:
    """Kind, call, length, and key (of a session) of a WINDOW clause."""
    kind = ts[0].upper()
    args = _arguments(ts[2 : _close(ts, 1)])
    named = args and re.fullmatch(r"(?:[A-Za-z_]\w*|`[^`]+`)(?:\.(?:[A-Za-z_]\w*|`[^`]+`))?", "".join(args[0])) is not None
    col = "".join(args.pop(0)) if named else time
    size = duration(args[0]) if args else ""
    if kind == "TUMBLING" and len(args) == 1:
        return kind, f"window({col}, '{size}')", size, []
    if kind in ("SLIDING", "HOPPING") and len(args) == 2:
        return kind, f"window({col}, '{size}', '{duration(args[1])}')", size, []
    if kind == "SESSION" and len(args) in (1, 2):
        return kind, f"session_window({col}, '{size}')", size, args[1] if len(args) > 1 else []
    raise DialectError(f"unknown window {' '.join(ts)}")


def _within(ts: list[str], time: str) -> list[str]:
    """`a JOIN b ON c WITHIN span` as a condition on the times of both."""
    out: list[str] = []
    i = 0
    while i < len(ts):
        if ts[i].upper() == "WITHIN":
            take = 3 if ts[i + 1].upper() == "INTERVAL" else 1
            span = duration(ts[i + 1 : i + 1 + take])
            names = [t for k, t in enumerate(ts) if k + 1 < len(ts) and ts[k + 1] == "."]
            sides = list(dict.fromkeys(names))
            if len(sides) < 2:
                raise DialectError("WITHIN needs conditions on both sides")
            out += ["AND", f"{sides[1]}.{time} BETWEEN {sides[0]}.{time} - INTERVAL {span} AND {sides[0]}.{time} + INTERVAL {span}"]
            i += 1 + take
        else:
            out.append(ts[i])
            i += 1
    return out


def _operand(out: list[str]) -> list[str]:
    """Takes the operand that ends a list of tokens: a call or brackets, a literal or a qualified name."""
    start = len(out) - 1
    if out[start] == ")":
        depth = 0
        while start >= 0:
            depth += (out[start] == ")") - (out[start] == "(")
            if not depth:
                break
            start -= 1
        if start and re.fullmatch(r"\w+", out[start - 1]) and out[start - 1].upper() not in ("AND", "OR", "NOT", "WHERE", "IN", "ON"):
            start -= 1
    while start > 1 and out[start - 1] == ".":
        start -= 2
    taken = out[start:]
    del out[start:]
    return taken


def _quantified(ts: list[str]) -> list[str]:
    """`x > ALL (SELECT y ...)` and ANY by the extremes and counts of y, with nulls as unknown."""
    out: list[str] = []
    i = 0
    while i < len(ts):
        if ts[i].upper() in ("ANY", "SOME", "ALL") and i and ts[i - 1] in ("<", ">", "<=", ">=", "=", "<>", "!=") and ts[i + 1 : i + 2] == ["("] and ts[i + 2].upper() == "SELECT":
            end = _close(ts, i + 1)
            body, every, op = _split(ts[i + 2 : end]), ts[i].upper() == "ALL", out.pop()
            left, col = " ".join(_operand(out)), " ".join(body["SELECT"])
            rest = " ".join(f"{c} {' '.join(t)}" for c, t in body.items() if c != "SELECT")
            if op in ("=", "<>", "!=") and every == (op != "="):
                out.append(f"{left} {'NOT IN' if every else 'IN'} (SELECT {col} {rest})")
            else:
                n, nulls = f"(SELECT count(*) {rest})", f"(SELECT count(*) - count({col}) {rest})"
                least, most = f"(SELECT min({col}) {rest})", f"(SELECT max({col}) {rest})"
                if op == "=":
                    holds = f"({left} = {least} AND {left} = {most})"
                elif op in ("<>", "!="):
                    holds = f"({left} <> {least} OR {left} <> {most})"
                else:
                    holds = f"{left} {op} {most if (op[0] == '>') == every else least}"
                sure = f"WHEN NOT ({holds}) THEN false" if every else f"WHEN {holds} THEN true"
                out.append(f"(CASE WHEN {n} = 0 THEN {str(every).lower()} {sure} WHEN {nulls} > 0 THEN NULL ELSE {holds} END)")
            i = end + 1
        else:
            out.append(ts[i])
            i += 1
    return out


def _subqueries(ts: list[str], time: str) -> list[str]:
    """Bracketed SELECTs translated by themselves, but those of ANY and ALL."""
    out: list[str] = []
    i = 0
    while i < len(ts):
        inner = ts[i] == "(" and ts[i + 1 : i + 2] and ts[i + 1].upper() == "SELECT" and not (out and out[-1].upper() in ("ANY", "SOME", "ALL"))
        if inner:
            end = _close(ts, i)
            out += ["(", translate(" ".join(ts[i + 1 : end]), time).sql, ")"]
            i = end + 1
        else:
            out.append(ts[i])
            i += 1
    return out


def _sampled(select: list[str], keys: list[str]) -> list[str]:
    """Plain columns of a grouped SELECT that aren't keys, as a value of the group."""
    known = {" ".join(k).lower() for k in _arguments(keys)}
    known |= {k.split(" . ")[-1] for k in known}
    items = []
    for item in _arguments(select):
        name = [t for t in item]
        alias = name[-1] if len(name) > 2 and name[-2].upper() == "AS" else None
        body = name[:-2] if alias else name
        plain = all(re.fullmatch(r"[A-Za-z_]\w*|`[^`]+`|\.", t) for t in body) and len(body) in (1, 3) and not body[0].upper().startswith("_WINDOW")
        if plain and body[0].upper() not in ("NULL", "TRUE", "FALSE") and " ".join(body).lower() not in known and body[-1].lower() not in known:
            items.append(["any_value", "(", *body, ")", "AS", alias or body[-1]])
        else:
            items.append(item)
    return [t for k, item in enumerate(items) for t in ([","] if k else []) + item]


def _options(ts: list[str]) -> dict[str, str]:
    """The pairs of `WITH ('name' = 'value', ...)`."""
    if not ts or ts[0] != "(":
        raise DialectError("WITH needs brackets")
    found = {}
    for pair in _arguments(ts[1 : _close(ts, 0)]):
        if "=" not in pair:
            raise DialectError("WITH needs pairs")
        at = pair.index("=")
        found[_unquote("".join(pair[:at]))] = _unquote("".join(pair[at + 1 :]))
    return found


def translate(text: str, time: str = "_timestamp") -> Query:
    """A SELECT of the dialect. `time` is the time column of windows and joins that name none."""
    ts = tokens(text.rstrip().rstrip(";"))
    if ts and ts[0].upper() == "WITH":  # common table expressions
        head, i = ["WITH"], 1
        while True:
            opening = next(k for k in range(i, len(ts)) if ts[k] == "(" and ts[k - 1].upper() == "AS")
            end = _close(ts, opening)
            recursive = "RECURSIVE" in [t.upper() for t in head + ts[i:opening]]
            body = " ".join(ts[opening + 1 : end]) if recursive else translate(" ".join(ts[opening + 1 : end]), time).sql
            head += [*ts[i:opening], "(", body, ")"]
            i = end + 1
            if ts[i : i + 1] != [","]:
                break
            head.append(",")
            i += 1
        main = translate(" ".join(ts[i:]), time)
        return Query(f"{' '.join(head)} {main.sql}", main.emit, main.options, main.window, annotations(text), main.size)
    depth, sets = 0, []
    for i, t in enumerate(ts):
        depth += (t == "(") - (t == ")")
        if not depth and t.upper() in ("UNION", "INTERSECT", "EXCEPT"):
            sets.append(i)
    if sets:
        cut = sets[-1]  # from the left
        word = ts[cut].upper()
        every = ts[cut + 1 : cut + 2] and ts[cut + 1].upper() == "ALL"
        left = translate(" ".join(ts[:cut]), time)
        right = translate(" ".join(ts[cut + 1 + bool(every) :]), time)
        return Query(f"{left.sql} {word} {'ALL ' if every else ''}{right.sql}", right.emit, right.options, None, annotations(text))
    parts = _split(ts)
    if "SELECT" not in parts:
        raise DialectError("only SELECT can be translated")
    emit = " ".join(parts.pop("EMIT", [])).upper() or None
    if emit not in (None, "CHANGES", "FINAL"):
        raise DialectError(f"unknown EMIT {emit}")
    options = _options(parts.pop("WITH")) if "WITH" in parts else {}
    kind = size = None
    parts = {c: _subqueries(t, time) for c, t in parts.items()}
    if "GROUP BY" in parts and not any(t.upper() in ("ROLLUP", "CUBE", "SETS", "ALL") for t in parts["GROUP BY"]):
        parts["SELECT"] = _sampled(parts["SELECT"], parts["GROUP BY"])
    if "WINDOW" in parts:
        kind, call, size, key = _window(parts.pop("WINDOW"), time)
        selected = [t.upper() for t in parts["SELECT"]]
        if "(" not in selected:
            raise DialectError("a windowed SELECT needs an aggregate")
        keys = parts.get("GROUP BY", [])
        if key and key not in _arguments(keys):
            keys = [*keys, *([","] if keys else []), *key]
        parts["GROUP BY"] = [*keys, *([","] if keys else []), call]
        if kind == "SESSION":
            for c in ("SELECT", "HAVING"):
                if c in parts:
                    parts[c] = [re.sub(r"\bwindow\.", "session_window.", t) for t in _calls(parts[c])]
    if "FROM" in parts:
        parts["FROM"] = _within(parts["FROM"], time)
    buffers, done = _Buffers(), {}
    for clause in _CLAUSES:
        if clause in parts:
            body = " ".join(_quantified(_calls(buffers.translated(parts[clause]))))
            name = "session_window" if kind == "SESSION" else "window"
            body = re.sub(r"\b_WINDOW_(START|END)\b", lambda m, b=name: f"unix_millis(cast({b}.{m[1].lower()} AS timestamp))", body, flags=re.I)
            done[clause] = _tight(body)
    return Query(buffers.applied(done), emit or (None if "GROUP BY" not in parts else "FINAL" if kind else "CHANGES"), options, kind, annotations(text), size)


def _tight(sql: str) -> str:
    """Names without blanks around their dots; what is quoted stays as it is."""
    cut = re.split(r"('(?:[^'\\]|\\.|'')*')", sql)
    return "".join(p if k % 2 else re.sub(r"(?<=[\w`)\]]) \. (?=[\w`*])", ".", p) for k, p in enumerate(cut))
