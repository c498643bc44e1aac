"""Degree features from outdoor temperature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base temperature for heating and cooling degrees in the UK (fixed value).
BASE_TEMP_C = 15.5


def add_degree_days(
    df: DataFrame, temp_col: str = "temperature_c", base: float = BASE_TEMP_C
) -> DataFrame:
    """Add heating_degrees and cooling_degrees; an unknown temperature stays unknown."""
    above = F.col(temp_col) - F.lit(float(base))
    return df.withColumns(
        {
            "heating_degrees": F.when(above.isNotNull(), F.greatest(-above, F.lit(0.0))),
            "cooling_degrees": F.when(above.isNotNull(), F.greatest(above, F.lit(0.0))),
        }
    )
