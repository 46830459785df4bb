"""Data model: channels, grid, clock and the rules for missing values.

The canonical form is the cell table, one row for each (event_id, frame, row, col), with a nullable column a channel.
NULL stands for what a sentinel and a mask say together; NaN never passes a reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRID, PIXEL_KM, STEP_MIN, N_IN, N_OUT = 64, 2.0, 5, 6, 12
FILL = -999.0
# Channel order, physical ranges, and (mean, scale) of their normalised form.
CHANNELS = ["refl_sfc", "refl_m10", "echo_top", "vil", "ir_tb", "light_dens"]
RANGES = {
    "refl_sfc": (-32.0, 80.0),
    "refl_m10": (-32.0, 80.0),
    "echo_top": (0.0, 20.0),
    "vil": (0.0, 70.0),
    "ir_tb": (180.0, 320.0),
    "light_dens": (0.0, 500.0),
}
NORM = {
    "refl_sfc": (20.0, 20.0),
    "refl_m10": (10.0, 20.0),
    "echo_top": (6.0, 4.0),
    "vil": (5.0, 10.0),
    "ir_tb": (270.0, 30.0),
    "light_dens": (0.0, 2.0),
}
FREEZING_KM, CHARGING_LOW_KM, CHARGING_HIGH_KM, CHARGING_DBZ = 5.0, 6.5, 8.0, 40.0
LEAD_BANDS = [(5, 15), (20, 30), (35, 45), (50, 60)]
THRESHOLDS = [0.02, 0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50, 0.70]
FSS_RADII = [0, 1, 2, 4, 8]

CELL = T.StructType([T.StructField("event_id", T.IntegerType()), T.StructField("frame", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in CHANNELS), T.StructField("y", T.DoubleType())])
STRIKE = "id string, source string, lat double, lon double, timestamp double, stroke_type string, peak_current_ka double, location_accuracy_m double, confidence double, cell_label string"


def valid(c: str | Column) -> Column:
    """A reading or NULL: sentinels, which lie below half the fill value, and NaN become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when((c > FILL / 2) & ~F.isnan(c), c)


def from_sentinels(df: DataFrame, channels: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: valid(c) for c in channels or CHANNELS if c in df.columns})
