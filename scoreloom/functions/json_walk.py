"""JSON of any depth: canonical form, form without banned keys, and the paths of these keys.

Texts are read by Python's own JSON reader (``read``), which costs a small part of a walk over tokens. What it refuses (no JSON, numbers
beyond its range, more depth than its recursion allows) is walked token by token (``walk``), and the walk alone decides; it keeps a stack
of open containers, no recursion, so depth is bounded by the text alone. Both give the same. Of keys that repeat in an object the last
value counts, in the first one's place. Keys are compared in lower case; what looks like a key inside a string is text.

Canonical form: keys in the order of their code points, no blanks, characters as they are (only quotes, backslashes and controls are
escaped), whole numbers as written, others by their shortest form that reads back the same. NaN and infinities are no JSON.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that a model must not see, and keys that prepared data must not hold.
HIDDEN_KEYS = ["gold_score", "gold_dimensions", "score1", "score2", "manual_label", "hidden_step_labels", "hidden_step_errors", "raw_total", "derived_total"]

_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)(?![0-9.])|(true|false|null)|([{}\[\],:]))')
_text = json.JSONEncoder(ensure_ascii=False).encode


class _Open:
    """A container that is being read: its members by key or index as (canonical, without banned keys, paths), each of them text or a
    list of such parts, so that nothing is copied again at every level."""

    def __init__(self, closes: str):
        self.closes, self.members = closes, {}
        self.key: str | None = None

    def step(self) -> str:
        return f".{self.key}" if self.closes == "}" else f"[{len(self.members)}]"

    def add(self, value: tuple, stack: list[_Open], banned: frozenset[str]) -> None:
        if self.closes == "]":
            self.members[len(self.members)] = value
            return
        hit = self.key.lower() in banned
        self.members[self.key] = (value[0], None if hit else value[1], ["$" + "".join(c.step() for c in stack), value[2]] if hit else value[2])
        self.key = None

    def done(self) -> tuple:
        parts: tuple[list, list] = ([], [])
        members = list(self.members.items()) if self.closes == "]" else sorted(self.members.items())
        for i, out in enumerate(parts):
            for k, m in members:
                if m[i] is not None:
                    out += [",", m[i]] if self.closes == "]" else [",", _text(k), ":", m[i]]
        whole, kept = (["{" if self.closes == "}" else "[", *out[1:], self.closes] for out in parts)
        return whole, kept, [m[2] for m in self.members.values() if m[2]]


def _flat(parts: str | list) -> list[str]:
    out, wait = [], [parts]
    while wait:
        part = wait.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            wait += reversed(part)
    return out


def walk(text: str, banned: frozenset[str] = frozenset()) -> tuple[str, str, list[str]] | None:
    """(canonical, without banned keys, paths of banned keys) of a JSON text; None if it is none."""
    stack: list[_Open] = []
    value, at, wait = None, 0, "value"  # what may come next: value, first (or the end), key, colon, more (comma or the end)
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        found = _TOKEN.match(text, at)
        if not found or (wait == "more" and not stack):
            return None
        at = found.end()
        string, number, word, sign = found.groups()
        top = stack[-1] if stack else None
        if sign and sign in "}]" and top and top.closes == sign and wait in ("first", "more"):
            stack.pop()
            value = top.done()
        elif wait == "more":
            if sign != ",":
                return None
            wait = "key" if top.closes == "}" else "value"
            continue
        elif wait == "colon":
            if sign != ":":
                return None
            wait = "value"
            continue
        elif wait == "key" or (wait == "first" and top.closes == "}"):
            if string is None:
                return None
            try:
                top.key = json.loads(string)
            except ValueError:
                return None
            wait = "colon"
            continue
        elif sign in ("{", "["):
            stack.append(_Open("}" if sign == "{" else "]"))
            wait = "first"
            continue
        elif sign:
            return None
        else:
            try:
                plain = _text(json.loads(string)) if string is not None else word or (number if number.lstrip("-").isdigit() else repr(float(number)))
            except ValueError:
                return None
            if plain in ("inf", "-inf"):
                return None
            value = ("0" if plain == "-0" else plain, "0" if plain == "-0" else plain, [])
        if stack:
            stack[-1].add(value, stack, banned)
        wait = "more"
    if stack or wait != "more":
        return None
    return "".join(_flat(value[0])), "".join(_flat(value[1])), _flat(value[2])


def _finite(number: str) -> float:
    value = float(number)
    if math.isinf(value):
        raise ValueError("no number of JSON")
    return value


def _refused(word: str) -> None:
    raise ValueError(f"{word} is no JSON")


_read = json.JSONDecoder(parse_float=_finite, parse_constant=_refused).decode
_canonical = json.JSONEncoder(ensure_ascii=False, check_circular=False, sort_keys=True, separators=(",", ":")).encode


def _banned_paths(value: dict | list, at: str, banned: frozenset[str], found: list[str]) -> None:
    for k, v in value.items() if type(value) is dict else enumerate(value):
        nested = type(v) in (dict, list)
        if type(k) is str:
            if hit := k.lower() in banned:
                found.append(f"{at}.{k}")
            if nested and v:
                _banned_paths(v, found[-1] if hit else f"{at}.{k}", banned, found)
        elif nested and v:
            _banned_paths(v, f"{at}[{k}]", banned, found)


def _drop_banned(value: dict | list, banned: frozenset[str]) -> None:
    if type(value) is dict:
        for k in [k for k in value if k.lower() in banned]:
            del value[k]
        value = value.values()
    for v in value:
        if type(v) in (dict, list):
            _drop_banned(v, banned)


#: What may be asked of a text, besides whether it is JSON.
PARTS = ("canonical", "stripped", "paths")


def read(text: str, banned: frozenset[str] = frozenset(), parts: tuple[str, ...] = PARTS) -> tuple | None:
    """What ``walk`` gives, with None for parts that are not asked for."""
    try:
        value = _read(text)
        open_ = type(value) in (dict, list)
        found: list[str] = []
        if open_ and banned and "paths" in parts:
            _banned_paths(value, "$", banned, found)
        whole = _canonical(value) if "canonical" in parts else None
        kept = None
        if "stripped" in parts:
            if open_ and banned:
                _drop_banned(value, banned)
            kept = _canonical(value)
    except (ValueError, RecursionError):
        seen = walk(text, banned)
        return seen and tuple(x if name in parts else None for name, x in zip(PARTS, seen, strict=True))
    return whole, kept, found if "paths" in parts else None


def json_walk(text: Column, banned: list[str] | None = None, parts: tuple[str, ...] = PARTS) -> Column:
    """A struct of a JSON text: valid, canonical, stripped (canonical, without banned keys at any depth) and paths (of these keys, in
    reading order: $.a.b[0].c). All but ``valid`` are null where the text is no JSON; a null text is no JSON. The struct has ``valid``
    and the ``parts`` asked for; others are not made."""
    keys = frozenset(k.lower() for k in banned or ())
    types = {"valid": T.BooleanType()} | {p: T.ArrayType(T.StringType()) if p == "paths" else T.StringType() for p in PARTS if p in parts}

    @F.arrow_udf(T.StructType([T.StructField(n, t) for n, t in types.items()]))
    def walked(texts: pa.Array) -> pa.Array:
        found = [None if t is None else read(t, keys, parts) for t in texts.to_pylist()]
        columns = [pa.array([r is not None for r in found], pa.bool_())]
        columns += [pa.array([r and r[i] for r in found], pa.list_(pa.string()) if p == "paths" else pa.string()) for i, p in enumerate(PARTS) if p in parts]
        return pa.StructArray.from_arrays(columns, names=list(types))

    return walked(text)
