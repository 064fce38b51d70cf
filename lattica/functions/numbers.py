"""Numbers rounded as binary fractions: to the nearest, halves to even, judged by the exact value of the double. Spark's round and bround judge by its decimal text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(x: Column | str, places: int) -> Column:
    """In Arrow batches; meant for the few rows whose order a rounded value decides. Null stays null, NaN and infinities stay."""
    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, places), na_action="ignore")

    return run(F.col(x) if isinstance(x, str) else x)
