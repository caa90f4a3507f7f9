"""Calls of tools that a model wrote as marked-up text: scanned once, in linear time, whatever the nesting."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks, once entities are decoded and full-width bars are bars.
MARK = r"\|\s*+\|\s*+DSML\s*+\|\s*+\|"
TAG = re.compile(rf"<\s*+(/?+)\s*+{MARK}\s*+(tool_calls|invoke|parameter)\b([^>]*+)>", re.IGNORECASE)
ATTRIBUTE = re.compile(r"(?<![\w.-])([A-Za-z_][\w.-]*+)\s*+=\s*+(['\"])(.*?)\2", re.DOTALL)
TRUE = {"1", "true", "yes", "on"}


def _attributes(text: str) -> dict[str, str]:
    cut = text[: max(text.rfind("'"), text.rfind('"')) + 1]
    return {k.casefold(): v for k, _, v in ATTRIBUTE.findall(cut)}


def _typed(raw: str, told: dict[str, str]) -> bool | int | float | str:
    says = lambda kind: told.get(kind, "").casefold() == "true"
    if says("boolean"):
        return raw.casefold() in TRUE
    for kind, make in (("integer", int), ("number", float)):
        if says(kind):
            try:
                return make(raw)
            except ValueError:
                return raw
    return raw


def scan(text: str | None) -> tuple[str, list[dict[str, str]]]:
    """(cleaned text, calls): a mark opens what the next closing mark of its kind closes; marks of its kind between don't count."""
    text = html.unescape(text or "").replace("｜", "|")
    calls, invokes, blocks, strays = [], [], [], []
    invoke = block = parameter = None
    given: dict = {}
    for tag in TAG.finditer(text, 0, text.rfind(">") + 1):
        closes, kind, rest = bool(tag[1]), tag[2].lower(), tag[3]
        if kind == "tool_calls":
            if rest.strip():
                continue
            strays.append(tag.span())
            if not closes and block is None:
                block = tag.start()
            elif closes and block is not None:
                blocks.append((block, tag.end()))
                block = None
        elif kind == "invoke":
            if not closes and invoke is None:
                invoke, given, parameter = (tag.start(), _attributes(rest)), {}, None
            elif closes and not rest.strip() and invoke is not None:
                invokes.append((invoke[0], tag.end()))
                if name := html.unescape(invoke[1].get("name", "")).strip():
                    calls.append({"id": f"textual-tool-{len(invokes)}", "name": name, "arguments": json.dumps(given, ensure_ascii=False)})
                invoke = None
        elif invoke is not None:
            if not closes and parameter is None:
                parameter = (tag.end(), _attributes(rest))
            elif closes and not rest.strip() and parameter is not None:
                if name := html.unescape(parameter[1].get("name", "")).strip():
                    given[name] = _typed(html.unescape(text[parameter[0] : tag.start()]).strip(), parameter[1])
                parameter = None
    gone = blocks or (sorted(invokes + strays) if calls else [])
    return _without(text, gone).strip(), calls


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in spans:  # in order of their begins; some may lie inside others
        kept.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join([*kept, text[at:]])


def tool_calls(text: Column) -> Column:
    """Struct of the text without its calls, and the calls in order: id, name, arguments as JSON.  A null text is an empty one."""

    @F.pandas_udf("struct<cleaned:string,calls:array<struct<id:string,name:string,arguments:string>>>")
    def scanned(texts: pd.Series) -> pd.DataFrame:
        found = [scan(t) for t in texts]
        return pd.DataFrame({"cleaned": [c for c, _ in found], "calls": [c for _, c in found]})

    return scanned(text)
