"""Text to number, and placeholder text to missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.session import as_col

# The placeholder of the disclosure files, and the texts read as missing.
PLACEHOLDER = "Not Available"
NULL_TOKENS = ("Not Available", "nan", "None")

# A plain decimal number. Spark alone would also read a trailing type letter, as in 12d.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def placeholder_to_null(df: DataFrame, placeholder: str = PLACEHOLDER) -> DataFrame:
    """Replace the placeholder by NULL in every text column, in one projection."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit(placeholder)) for c in texts})


def _guarded(text: Column) -> Column:
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def to_number(c: str | Column, null_tokens: Sequence[str] = ()) -> Column:
    """Strip thousands commas and read as double; anything that is no number becomes NULL."""
    text = as_col(c).cast("string")
    if null_tokens:
        text = F.when(~text.isin(*null_tokens), text)
    return _guarded(F.replace(text, F.lit(","), F.lit("")))


def to_number_lenient(c: str | Column, null_tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """As `to_number`, after deleting all but digits, dots and minus signs: units and notes vanish."""
    text = F.trim(as_col(c).cast("string"))
    text = F.when(~text.isin("", *null_tokens), text)
    return _guarded(F.regexp_replace(text, r"[^0-9.\-]", ""))


def nan_to_null(c: str | Column) -> Column:
    """Missing is NULL everywhere: NaN would compare greater than every number."""
    return F.nanvl(as_col(c).cast("double"), F.lit(None).cast("double"))
