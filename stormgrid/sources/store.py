"""Event tables on disk: Parquet by event, with a manifest that readers check; JSON results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid import schema as S
from stormgrid.functions.scalar import finite
from stormgrid.operators import qc


def save_events(cells: DataFrame, path: str, validate: bool = True) -> None:
    if validate:
        qc.validate(cells)
    cells.write.mode("overwrite").partitionBy("event_id").parquet(f"{path}/cells")
    spark = cells.sparkSession
    manifest = {"format": 1, "channels": S.CHANNELS, "grid": S.GRID, "pixel_km": S.PIXEL_KM, "fill": S.FILL}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_events(spark: SparkSession, path: str) -> DataFrame:
    """Partition filters on event_id prune files. A store of other channels is refused."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if manifest["channels"] != S.CHANNELS:
        raise qc.ContractError(f"channels are {manifest['channels']}")
    return spark.read.parquet(f"{path}/cells")


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines; what is not finite becomes null."""
    df.withColumns({f.name: finite(F.col(f.name)) for f in df.schema if f.dataType.simpleString() in ("double", "float")}).write.mode("overwrite").json(path)
