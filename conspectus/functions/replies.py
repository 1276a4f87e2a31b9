"""Objects read from a model's replies that are almost JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A backslash that opens no legal escape, and a bare key.
BAD_ESCAPE = r"\\(?![\"\\/bfnrtu]|u[0-9a-fA-F]{4})"
BARE_KEY = r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)(\s*:)"
# Control characters that an eaten command leaves, in order.
EATEN = {"\b": "\\b...", "\f": "\\f...", "\t": "\\t...", "\r": "\\r..."}


def control_corruption(text: Column) -> Column:
    """Names of the escapes that have eaten the head of a command."""
    whole = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(F.contains(whole, F.lit(c)), F.lit(name)) for c, name in EATEN.items()]))


def strip_fences(text: Column) -> Column:
    """The reply without the code fence around it."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    inner = F.regexp_replace(body, r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.when(F.startswith(body, F.lit("```")), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(body)


def repair_escapes(text: Column) -> Column:
    return F.regexp_replace(text, BAD_ESCAPE, r"\\\\")


def repair_keys(text: Column) -> Column:
    return F.regexp_replace(text, BARE_KEY, '$1"$2"$3')


def _parsed(body: str):
    """(found, value) of the least repaired reading that parses."""
    escaped = re.sub(BAD_ESCAPE, r"\\\\", body)
    for attempt in (body, escaped, re.sub(BARE_KEY, r'\1"\2"\3', escaped)):
        try:
            return True, json.loads(attempt)
        except (ValueError, RecursionError):
            continue
    return False, None


def blocks(text: str) -> Iterator[str]:
    """Balanced outermost {...}; braces in strings do not count."""
    depth = begin = 0
    for m in re.finditer(r'"(?:[^"\\]|\\[\s\S])*(?:"|\\?\Z)|[{}]', text):
        if m[0] == "{":
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[begin : m.end()]


def first_object(body: str) -> dict | None:
    """The first object of a reply without fences: itself, the first in its list, or the first block that parses."""
    found, value = _parsed(body) if body else (True, None)
    if found:
        return next((x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)), None)
    parsed = (_parsed(block)[1] for block in blocks(body))
    return next((x for x in parsed if isinstance(x, dict)), None)


@F.pandas_udf(T.StringType())
def _objects(body: pd.Series) -> pd.Series:
    found = body.map(first_object)
    return found.map(lambda x: None if x is None else json.dumps(x, ensure_ascii=False))


def parse_reply(text: Column) -> Column:
    """JSON text of the first object in a reply, null if there is none."""
    return _objects(strip_fences(text))
