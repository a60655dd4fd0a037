"""JSON objects taken out of the text around them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a text that is one fenced block.
FENCE = r"(?s)^\s*```(?:json)?\s*\n(.*)\n\s*```\s*$"


def outermost(text: str | None) -> str | None:
    """The first object in a text that is JSON: from a brace to the one that closes it; braces in strings do not count.

    A brace that opens no object (it never closes, or what it holds is no JSON) is passed over.
    """
    at = text.find("{") if text else -1
    while at >= 0:
        depth, quoted, escaped = 0, False, False
        for i in range(at, len(text)):
            c = text[i]
            if quoted:
                escaped, quoted = c == "\\" and not escaped, c != '"' or escaped
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    break
        if not depth:
            try:
                json.loads(text[at : i + 1])
                return text[at : i + 1]
            except ValueError:
                pass
        at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def outermost_object(texts: pd.Series) -> pd.Series:
    return texts.map(outermost, na_action="ignore")


def salvaged(text: Column) -> Column:
    """The JSON in a text, as a string: the whole (a fence around it goes), else what stands from its first brace to its last,
    else the first object that is closed; null if there is none. Only texts that the first two leave take the slow way."""
    inner = F.when(text.rlike(FENCE), F.regexp_extract(text, FENCE, 1)).otherwise(text)
    first, last = F.locate("{", inner), F.length(inner) - F.locate("}", F.reverse(inner)) + 1
    cut = F.when((first > 0) & (F.locate("}", inner) > 0) & (last > first), F.substring(inner, first, last - first + 1))
    good = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    plain = F.coalesce(good(inner), good(cut))
    return F.coalesce(plain, outermost_object(F.when(plain.isNull(), inner)))
