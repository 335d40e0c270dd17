"""JSON in the text that a model says: tool calls, answers, settings. Row-wise Arrow functions, where no expression can do it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_COMMA = re.compile(r",\s*([}\]])")
_FENCE = re.compile(r"```[a-zA-Z0-9_-]*\s*(.*?)\s*```", re.S)
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def _object(text: str) -> dict | None:
    """text as a JSON object; if need be without comments and commas before a closing bracket."""
    for tried in (text, _COMMA.sub(r"\1", _COMMENT.sub("", text))):
        try:
            found = json.loads(tried)
        except ValueError:
            continue
        return found if isinstance(found, dict) else None
    return None


def _balanced(text: str) -> str | None:
    """From the first brace to the one that closes it; braces in strings do not count."""
    start, depth = text.find("{"), 0
    if start < 0:
        return None
    for m in _QUOTED.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth and m[0] == "}":
            return text[start : m.end()]
    return None


def first_object(text: str | None) -> dict | None:
    """The JSON object that a text is, or that begins at its first brace, or that a fenced block of it holds."""
    text = (text or "").strip()
    for part in (text, *(m[1].strip() for m in _FENCE.finditer(text))):
        found = _object(part)
        if found is None and (inner := _balanced(part)) is not None:
            found = _object(inner)
        if found is not None:
            return found
    return None


def answer_of(text: str | None) -> tuple[bool, float] | None:
    """(yes, confidence) of the first JSON object that has an answer yes or no and a number for confidence."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", text or ""):
        try:
            said, _ = decoder.raw_decode(text, m.start())
        except ValueError:
            continue
        answer, sure = said.get("answer"), said.get("confidence")
        if isinstance(answer, str) and answer.strip().lower() in ("yes", "no") and isinstance(sure, (int, float)) and not isinstance(sure, bool):
            return answer.strip().lower() == "yes", float(sure)
    return None


def tool_json(text: Column) -> Column:
    """first_object() of each text, as JSON with sorted keys; null without one."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            found = values.map(first_object)
            yield found.map(lambda x: json.dumps(x, sort_keys=True, ensure_ascii=False) if isinstance(x, dict) else None)

    return run(text)


def equivalence_answer(text: Column) -> Column:
    """answer_of() of each text, as struct<yes boolean, confidence double>; null where there is none."""

    @F.pandas_udf("yes boolean, confidence double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            found = [answer_of(v) for v in values]
            yield pd.DataFrame({"yes": [f[0] if f else None for f in found], "confidence": [f[1] if f else None for f in found]})

    said = run(text)
    return F.when(said["yes"].isNotNull(), said)


def spec_of(registry: Mapping[str, Mapping], name: str) -> Mapping | None:
    """The tool's entry by its key, or else by its name or an alias, case aside."""
    if not name:
        return None
    if isinstance(registry.get(name), Mapping):
        return registry[name]
    wanted = name.lower()
    for spec in registry.values():
        if isinstance(spec, Mapping) and wanted in (str(spec.get("tool_name") or "").lower(), *(str(a).lower() for a in spec.get("aliases") or ())):
            return spec
    return None


def coerced_call(call: Mapping, registry: Mapping[str, Mapping]) -> dict:
    """A tool call with the arguments that its entry presets, and with numbers and flags that came as text."""
    name = str(call.get("tool_name") or "").strip()
    spec = spec_of(registry, name) or {}
    arguments = {**(spec.get("arguments") or {}), **(call.get("arguments") or {})}
    if "sources" in arguments and "ontologies" not in arguments:
        arguments["ontologies"] = arguments.pop("sources")
    most, exact = arguments.get("max_results"), arguments.get("exact")
    if isinstance(most, str) and re.fullmatch(r"\s*[+-]?\d+\s*", most):
        arguments["max_results"] = int(most)
    if isinstance(exact, str):
        arguments["exact"] = exact.strip().lower() in ("true", "1", "yes")
    return {"tool_name": name, "tool_type": str(call.get("tool_type") or spec.get("tool_type") or "module").lower(), "arguments": arguments}


def coerced_calls(call: Column, registry: Mapping[str, Mapping]) -> Column:
    """coerced_call() of each JSON call, as JSON with sorted keys; null where it is no JSON object."""
    known = {k: dict(v) for k, v in registry.items()}

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            found = values.map(first_object)
            yield found.map(lambda x: json.dumps(coerced_call(x, known), sort_keys=True) if isinstance(x, dict) else None)

    return run(call)


def flattened(value: Mapping, prefix: str = "") -> dict[str, str | int | float | bool | None]:
    """Nested settings or metrics by dotted keys; lists are left out."""
    out = {}
    for key in sorted(value):
        name, item = f"{prefix}.{key}" if prefix else str(key), value[key]
        if isinstance(item, Mapping):
            out |= flattened(item, name)
        elif item is None or isinstance(item, (str, int, float, bool)):
            out[name] = item
    return out


def metrics_of(column: Column) -> Column:
    """flattened() of each JSON object, as a map of dotted keys to text; null values are left out."""

    @F.pandas_udf("map<string,string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: {k: json.dumps(x) if not isinstance(x, str) else x for k, x in flattened(first_object(v) or {}).items() if x is not None})

    return run(column)
