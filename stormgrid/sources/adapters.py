"""Adapters of remote sources as a Spark data source: one partition an adapter, each with its own state.

A source's payloads lie in `path/source=<name>/`, the newest by name first. What can't be read makes a row, not an error:
NOT_CONFIGURED without a folder, UNAVAILABLE where nothing in it can be opened, DEGRADED where the newest payload lacks all
keys that its source needs, and STALE where an older payload stands in for one that can't be used. A payload that is no
JSON object counts by its size alone. Filters on the source reach the reader, if Spark is told to push them down
(spark.sql.python.filterPushdown.enabled), so that adapters nobody asks for are not opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from stormgrid.sources import health

SCHEMA = "source string, channels array<string>, state string, payload string, error string, stale boolean"


@dataclass
class _Adapter(InputPartition):
    source: str
    channels: list[str]
    needs: list[str]

    def __post_init__(self) -> None:
        self.value = self.source


def parsed(raw: bytes) -> dict:
    try:
        x = json.loads(raw.decode("utf-8"))
    except ValueError:
        x = None
    return x if isinstance(x, dict) else {"raw_size_bytes": len(raw)}


def usable(source: str, needs: list[str], payload: dict) -> bool:
    """As health.fetched judges: any needed key, or values that a numerical forecast kept from before."""
    kept = source == "nwp" and payload.get("status") in ("LIVE", "STALE") and "values" in payload
    return kept or any(k in payload for k in needs)


class AdapterReader(DataSourceReader):
    def __init__(self, path: str, adapters: list[tuple[str, list[str], list[str]]], fallback: bool) -> None:
        self.path, self.adapters, self.fallback = path, adapters, fallback

    def partitions(self) -> list[InputPartition]:
        return [_Adapter(*a) for a in self.adapters]

    def read(self, partition: _Adapter) -> Iterator[tuple]:
        a = partition
        row = lambda state, payload=None, error=None, stale=False: (a.source, a.channels, state, payload, error, stale)
        try:
            found = list(self._payloads(a.source))
        except FileNotFoundError:
            return iter([row("NOT_CONFIGURED", error="no folder for this source")])
        except Exception as e:  # noqa: BLE001  whatever a store does, the other sources go on
            return iter([row("UNAVAILABLE", error=f"{type(e).__name__}: {e}")])
        error = None
        for k, (name, raw) in enumerate(found):
            if raw is None:
                error = error or f"{name} can't be read or is empty"
                continue
            payload = parsed(raw)
            text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
            if usable(a.source, a.needs, payload):
                return iter([row("STALE" if k else "LIVE", text, error, bool(k))])
            if not self.fallback or not error and k == len(found) - 1:
                return iter([row("DEGRADED", text, "payload lacks all keys that its source needs")])
            error = error or "payload lacks all keys that its source needs"
        degraded = bool(found) and found[0][1] is not None
        return iter([row("DEGRADED" if degraded else "UNAVAILABLE", error=error or "no payload in the folder")])

    def _payloads(self, source: str) -> Iterator[tuple[str, bytes | None]]:
        """(name, content), newest first; None where a file can't be read or is blank. Any store that Arrow opens by its address."""
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path)
        files = store.get_file_info(fs.FileSelector(f"{at.rstrip('/')}/source={source}"))
        for f in sorted((f for f in files if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.base_name, reverse=True):
            try:
                with store.open_input_stream(f.path) as s:
                    raw = s.read()
                yield f.base_name, raw if raw.strip() else None
            except OSError:
                yield f.base_name, None


class PushingReader(AdapterReader):
    """Spark refuses a reader with this method where it doesn't push filters down."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the source leave their adapters; Spark applies all others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                self.adapters = [a for a in self.adapters if a[0] == f.value]
            elif isinstance(f, In) and f.attribute == ("source",):
                self.adapters = [a for a in self.adapters if a[0] in f.value]
            else:
                yield f


class AdapterSource(DataSource):
    """Options: path, a folder by its address (file:, hdfs:, s3: ...); sources, names with commas between (all registered);
    fallback, whether an older payload stands in (true); pushdown, whether Spark pushes filters down (false)."""

    @classmethod
    def name(cls) -> str:
        return "storm_adapters"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> AdapterReader:
        wanted = {x.strip() for x in self.options.get("sources", "").split(",") if x.strip()}
        known = {s for s, *_ in health.SOURCES}
        if wanted - known:
            raise ValueError(f"unknown sources: {', '.join(sorted(wanted - known))}")
        kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else AdapterReader
        return kind(self.options["path"], [s for s in health.SOURCES if not wanted or s[0] in wanted], self.options.get("fallback", "true").lower() == "true")


def read(spark: SparkSession, path: str, sources: list[str] | None = None, fallback: bool = True) -> DataFrame:
    """One row a source (SCHEMA)."""
    spark.dataSource.register(AdapterSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(AdapterSource.name()).option("path", path).option("pushdown", push).option("sources", ",".join(sources or [])).option("fallback", str(fallback)).load()
