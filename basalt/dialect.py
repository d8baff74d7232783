"""From the PostgreSQL-flavoured dialect to Spark SQL.

The text is cut into tokens once; every rewrite works on tokens, so strings and
comments are never touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)|(?P<string>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<tick>`[^`]*`)|(?P<dollar>\$[A-Za-z_]*\$)
    |(?P<param>\$\d+)|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[A-Za-z_][\w]*)|(?P<op><>|!=|<=|>=|\|\||::|[-+*/%=<>(),.;:\[\]?@&|^~])""",
    re.VERBOSE,
)
UNITS = {"year": "month", "years": "month", "month": "month", "months": "month", "week": "day", "weeks": "day", "day": "day", "days": "day",
         "hour": "time", "hours": "time", "minute": "time", "minutes": "time", "second": "time", "seconds": "time"}


class Token:
    __slots__ = ("kind", "text")

    def __init__(self, kind: str, text: str):
        self.kind, self.text = kind, text

    def __repr__(self) -> str:
        return f"Token({self.kind}, {self.text!r})"

    def is_(self, *words: str) -> bool:
        return self.text.upper() in words if self.kind in ("word", "op") else False


def tokens(sql: str) -> list[Token]:
    """Tokens of a text without space and comments; dollar-quoted strings become strings."""
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise ValueError(f"cannot read {sql[at : at + 20]!r}")
        kind, text, at = m.lastgroup, m.group(), m.end()
        if kind == "dollar":
            end = sql.find(text, at)
            if end < 0:
                raise ValueError(f"no closing {text}")
            out.append(Token("string", "'" + sql[at:end].replace("'", "''") + "'"))
            at = end + len(text)
        elif kind != "space":
            out.append(Token(kind, text))
    while out and out[-1].text == ";":
        out.pop()
    return out


def unquote(t: Token) -> str:
    """Value of a string token, or name of a word or quoted identifier."""
    if t.kind == "string":
        return t.text[1:-1].replace("''", "'")
    if t.kind == "quoted":
        return t.text[1:-1].replace('""', '"')
    return t.text[1:-1] if t.kind == "tick" else t.text


def literal(text: str) -> str:
    """A Spark string literal; backslashes keep their plain meaning."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def interval_parts(text: str) -> list[str]:
    """Spark interval literals whose sum is the interval ``text``.

    Spark has no literal that mixes months with days, so each class of units
    gets one of its own; weeks become days, ``HH:MM[:SS]`` a time.
    """
    months = days = 0
    seconds = 0.0
    for n, unit in re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([A-Za-z]+)", re.sub(r"[+-]?\d+:\d+(:\d+(\.\d+)?)?", "", text)):
        low = unit.lower()
        if low not in UNITS:
            raise ValueError(f"unknown interval unit {unit}")
        v = float(n)
        if low.startswith("year"):
            months += int(v * 12)
        elif low.startswith("month"):
            months += int(v)
        elif low.startswith("week"):
            days += int(v * 7)
        elif low.startswith("day"):
            days += int(v)
        else:
            seconds += v * {"h": 3600, "m": 60, "s": 1}[low[0]]
    for sign, h, m, s in re.findall(r"([+-]?)(\d+):(\d+)(?::(\d+(?:\.\d+)?))?", text):
        seconds += (-1 if sign == "-" else 1) * (int(h) * 3600 + int(m) * 60 + float(s or 0))
    out = []
    if months:
        out.append(f"INTERVAL '{months}' MONTH")
    if days:
        out.append(f"INTERVAL '{days}' DAY")
    if seconds:
        out.append(f"INTERVAL '{seconds:f}' SECOND")
    return out or ["INTERVAL '0' DAY"]


def _match(ts: list[Token], at: int) -> int:
    """Place of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(ts)):
        depth += (ts[i].text == "(") - (ts[i].text == ")")
        if depth == 0:
            return i
    raise ValueError("brackets do not match")


def _operand_start(ts: list[Token], names=lambda t: not t.is_("AND", "OR", "WHERE", "ON", "NOT")) -> int:
    """Where the operand before an IN (or an operator) begins in the tokens so far."""
    i = len(ts) - 1
    if ts[i].is_("NOT"):
        i -= 1
    if ts[i].text == ")":
        depth = 0
        while True:
            depth += (ts[i].text == ")") - (ts[i].text == "(")
            if depth == 0:
                break
            i -= 1
        if i and ts[i - 1].kind == "word" and names(ts[i - 1]):
            i -= 1
    while i >= 2 and ts[i - 1].text == ".":
        i -= 2
    return i


def _names(t: Token) -> bool:
    """Whether a word before a bracket is a function's name."""
    return not t.is_("AND", "OR", "WHERE", "ON", "NOT", "SELECT", "WHEN", "THEN", "ELSE", "BY", "HAVING", "CASE", "IN")


def _operand_end(ts: list[Token], at: int) -> int:
    """Where the operand that begins at ``at`` ends: a sign, then a value, a
    name, a call or a bracket."""
    at += ts[at].text in ("+", "-")
    if ts[at].text != "(":
        at += 1
        while at + 1 < len(ts) and ts[at].text == ".":
            at += 2
    return _match(ts, at) + 1 if at < len(ts) and ts[at].text == "(" else at


#: Functions whose rules differ from Spark's: SQL text from the arguments' text.
FUNCTIONS = {
    "SQRT": lambda x: f"(CASE WHEN CAST({x} AS DOUBLE) < 0 THEN CAST(raise_error('SQRT of a negative number') AS DOUBLE) ELSE sqrt({x}) END)",
    "POWER": lambda x, y: f"(CASE WHEN isnan(pow({x}, {y})) OR abs(pow({x}, {y})) = double('Infinity') THEN CAST(raise_error('POWER has no finite result') AS DOUBLE) ELSE pow({x}, {y}) END)",
    "ROUND": lambda x, n="0": f"CAST(round({x}, {n}) AS DOUBLE)",
    "FLOOR": lambda x: f"CAST(floor({x}) AS DOUBLE)",
    "CEIL": lambda x: f"CAST(ceil({x}) AS DOUBLE)",
    "LENGTH": lambda x: f"CAST(length({x}) AS BIGINT)",
    "SUBSTRING": lambda x, at, n=None: f"substring({x}, " + (at if at.isdigit() and at != "0" else f"if(({at}) = 0, 1, {at})") + (f", greatest({n}, 0))" if n else ")"),
    "TRIM": lambda x: rf"regexp_replace({x}, '(?U)^\\s+|(?U)\\s+$', '')",
    "LTRIM": lambda x: rf"regexp_replace({x}, '^[ \\t\\n\\r]+', '')",
    "RTRIM": lambda x: rf"regexp_replace({x}, '[ \\t\\n\\r]+$', '')",
}
ALIASES = {"POW": "POWER", "CEILING": "CEIL", "LEN": "LENGTH", "SUBSTR": "SUBSTRING"}


def _call(name: str, inner: list[Token]) -> str | None:
    """Spark SQL for a call of a function of ``FUNCTIONS``; None for forms with
    keywords of their own (TRIM BOTH ..., SUBSTRING of another form)."""
    if name == "SUBSTRING" and (at := find(inner, "FROM")) < len(inner):
        end = find(inner, "FOR")
        args = [inner[:at], inner[at + 1 : end]] + ([inner[end + 1 :]] if end < len(inner) else [])
    elif any(t.is_("BOTH", "LEADING", "TRAILING", "FROM", "TO") for t in inner):
        return None
    else:
        args = split_at(inner)
    try:
        return FUNCTIONS[name](*[to_spark(a) for a in args])
    except TypeError:  # another number of arguments: Spark tells
        return None


def to_spark(sql: str | Iterable[Token]) -> str:
    """Spark SQL for a query text: quoted identifiers, ``$n`` parameters (as
    ``:pn``), ``IN ()``, mixed intervals, date literals in three layouts, STDDEV
    (population, as the dialect has it) and functions with rules of their own."""
    ts = tokens(sql) if isinstance(sql, str) else list(sql)
    out: list[Token] = []
    i = 0
    while i < len(ts):
        t = ts[i]
        nxt = ts[i + 1] if i + 1 < len(ts) else None
        if t.kind == "string":
            out.append(Token("string", literal(unquote(t))))
        elif t.kind == "quoted":
            out.append(Token("tick", f"`{unquote(t)}`"))
        elif t.kind == "param":
            out.append(Token("word", f":p{t.text[1:]}"))
        elif t.is_("STDDEV") and nxt and nxt.text == "(":
            out.append(Token("word", "stddev_pop"))
        elif t.is_("UCASE", "LCASE") and nxt and nxt.text == "(":
            out.append(Token("word", {"UCASE": "upper", "LCASE": "lower"}[t.text.upper()]))
        elif t.is_(*FUNCTIONS, *ALIASES) and nxt and nxt.text == "(" and (call := _call(ALIASES.get(t.text.upper(), t.text.upper()), ts[i + 2 : _match(ts, i + 1)])):
            out.append(Token("word", call))
            i = _match(ts, i + 1)
        elif t.is_("INTERVAL") and nxt and nxt.kind == "string":
            text = unquote(nxt)
            unit = ts[i + 2] if i + 2 < len(ts) and ts[i + 2].text.lower() in UNITS else None
            parts = interval_parts(f"{text} {unit.text}" if unit else text)
            i += 1 + bool(unit)
            if out and out[-1].text == "*":  # a factor holds for every part
                out.pop()
                start = _operand_start(out, _names)
                factor = render(out[start:])
                del out[start:]
                parts = [f"{factor} * {p}" for p in parts]
            while i + 2 < len(ts) and ts[i + 1].text in ("*", "/"):
                end = _operand_end(ts, i + 2)
                factor = to_spark(ts[i + 2 : end])
                parts = [f"{p} {ts[i + 1].text} {factor}" for p in parts]
                i = end - 1
            sign = out[-1].text if out and out[-1].text in "+-" else "+"
            out.append(Token("word", f" {sign} ".join(parts)))
        elif t.is_("DATE") and nxt and nxt.kind == "string":
            text = unquote(nxt)
            if m := re.fullmatch(r"(\d\d?)[/-](\d\d?)[/-](\d{4})", text):
                text = f"{m[3]}-{int(m[1]):02}-{int(m[2]):02}"
            out.append(Token("word", f"DATE '{text}'"))
            i += 1
        elif t.is_("TIMESTAMP") and nxt and nxt.kind == "string":
            out.append(Token("word", f"TIMESTAMP_NTZ {literal(unquote(nxt))}"))
            i += 1
        elif t.is_("IN") and nxt and nxt.text == "(" and i + 2 < len(ts) and ts[i + 2].text == ")":
            negated = out[-1].is_("NOT")
            del out[_operand_start(out) :]
            out.append(Token("word", "true" if negated else "false"))
            i += 2
        else:
            out.append(t)
        i += 1
    return render(out)


def render(ts: Iterable[Token]) -> str:
    text = ""
    for t in ts:
        glue = "" if not text or t.text in (".", ",", ")") or text[-1] in ".(" else " "
        text += glue + t.text
    return text


def split_at(ts: list[Token], comma: str = ",") -> list[list[Token]]:
    """Parts between commas that stand outside brackets."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in ts:
        depth += (t.text == "(") - (t.text == ")")
        if t.text == comma and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def find(ts: list[Token], *words: str, start: int = 0) -> int:
    """First place of a keyword outside brackets and CASE, or the end."""
    depth = 0
    for i in range(start, len(ts)):
        depth += (ts[i].text == "(") - (ts[i].text == ")") + ts[i].is_("CASE") - ts[i].is_("END")
        if depth == 0 and ts[i].is_(*words):
            return i
    return len(ts)
