"""Unicode forms, which Spark has no function for: only texts beyond ASCII reach Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfkc(text: str) -> Column:
    """The column in compatibility form (NFKC); null stays null, and ASCII is its own form."""

    @F.pandas_udf("string")
    def form(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(form(F.when(F.col(text).rlike(r"[^\x00-\x7F]"), F.col(text))), F.col(text))
