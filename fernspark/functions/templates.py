"""A small renderer of ``{{ x }}``, ``{% for %}`` and ``{% if %}`` templates, on the driver or per row."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\})", re.DOTALL)
_FOR = re.compile(r"for\s+(\w+)\s+in\s+(.+)")


class TemplateError(ValueError):
    """A template that can't be parsed or names what its context lacks."""


def _lookup(name: str, context: dict[str, Any]) -> Any:
    name, _, rest = name.partition("|")
    name = name.strip()
    if re.fullmatch(r"'[^']*'|\"[^\"]*\"", name):
        value: Any = name[1:-1]
    elif re.fullmatch(r"-?\d+", name):
        value = int(name)
    else:
        value = context
        for part in name.split("."):
            if isinstance(value, dict) and part in value:
                value = value[part]
            elif isinstance(value, list | tuple) and part.isdigit() and int(part) < len(value):
                value = value[int(part)]
            else:
                raise TemplateError(f"{name} isn't in the context")
    for f in filter(None, (x.strip() for x in rest.split("|"))):
        if f == "upper":
            value = str(value).upper()
        elif f == "lower":
            value = str(value).lower()
        elif f == "trim":
            value = str(value).strip()
        elif f == "length":
            value = len(value)
        elif m := re.fullmatch(r"join\(sep=(['\"])(.*)\1\)", f):
            value = m[2].join(map(_shown, value))
        else:
            raise TemplateError(f"an unknown filter {f}")
    return value


def _shown(x: Any) -> str:
    return x if isinstance(x, str) else "true" if x is True else "false" if x is False else "" if x is None else json.dumps(x, ensure_ascii=False) if isinstance(x, dict | list) else str(x)


def _truth(test: str, context: dict[str, Any]) -> bool:
    test = test.strip()
    if " or " in test:
        return any(_truth(t, context) for t in test.split(" or "))
    if " and " in test:
        return all(_truth(t, context) for t in test.split(" and "))
    if test.startswith("not "):
        return not _truth(test[4:], context)
    for sign in ("==", "!="):
        if sign in test:
            a, b = (_lookup(x, context) for x in test.split(sign))
            return (a == b) == (sign == "==")
    try:
        return bool(_lookup(test, context))
    except TemplateError:
        return False


def _parse(tokens: list[str], at: int, ends: tuple[str, ...]) -> tuple[list, int, str]:
    out: list = []
    while at < len(tokens):
        t = tokens[at]
        if t.startswith("{{"):
            out.append(("value", t[2:-2].strip("-").strip()))
        elif t.startswith("{%"):
            words = t[2:-2].strip("-").strip()
            if words.split(" ")[0] in ends:
                return out, at, words
            if m := _FOR.fullmatch(words):
                body, at, _ = _parse(tokens, at + 1, ("endfor",))
                out.append(("for", m[1], m[2], body))
            elif words.startswith("if "):
                branches, other, end = [], [], words
                while True:
                    body, at, stop = _parse(tokens, at + 1, ("elif", "else", "endif"))
                    branches.append((end.split(" ", 1)[1], body)) if end != "else" else other.extend(body)
                    if stop == "endif":
                        break
                    end = stop
                out.append(("if", branches, other))
            else:
                raise TemplateError(f"an unknown tag {words}")
        elif t:
            out.append(("text", t))
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return out, at, ""


def _run(nodes: list, context: dict[str, Any]) -> Iterator[str]:
    for kind, *x in nodes:
        if kind == "text":
            yield x[0]
        elif kind == "value":
            yield _shown(_lookup(x[0], context))
        elif kind == "for":
            for item in _lookup(x[1], context):
                yield from _run(x[2], context | {x[0]: item})
        else:
            chosen = next((body for test, body in x[0] if _truth(test, context)), x[1])
            yield from _run(chosen, context)


def render(template: str, context: dict[str, Any] | None = None) -> str:
    """The template with its context; without a context it is returned as it is."""
    if context is None:
        return template
    return "".join(_run(_parse(_TAG.split(template), 0, ())[0], context))


def rendered(template: str, context: Column) -> Column:
    """The template for each row's ``context``, a JSON object as text."""

    @F.pandas_udf("string")
    def one(contexts: pd.Series) -> pd.Series:
        nodes = _parse(_TAG.split(template), 0, ())[0]
        return contexts.map(lambda c: "".join(_run(nodes, json.loads(c))), na_action="ignore")

    return one(context)
