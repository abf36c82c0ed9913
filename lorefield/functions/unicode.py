"""Functions that need Unicode tables Spark has no expression for: Arrow-backed, one batch at a time."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def _slug(text: str | None) -> str | None:
    """Compatibility form, case folded; letters and digits stay (with their marks), the rest becomes single dashes."""
    if text is None:
        return None
    out, gap = [], False
    for c in unicodedata.normalize("NFKC", text).casefold():
        kind = unicodedata.category(c)[0]
        if kind in "LN" or (kind == "M" and out and not gap):
            out += ["-", c] if gap and out else [c]
            gap = False
        else:
            gap = True
    return "".join(out)


@pandas_udf(StringType())
def slugify(text: pd.Series) -> pd.Series:
    return text.map(_slug)


@pandas_udf(StringType())
def decode_escapes(text: pd.Series) -> pd.Series:
    """``\\uXXXX`` to the character it names."""
    return text.map(lambda x: None if x is None else re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), x))
