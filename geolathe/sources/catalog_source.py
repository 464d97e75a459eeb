"""A catalog of STAC items as a data source of its own, which opens only the files that a search can need.

Items lie as JSON lines under ``provider=<name>/month=<yyyy-mm>/``. Searches by provider and time leave out folders when the
scan is planned, and those by cloud cover leave out items while they are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from math import isfinite
from urllib.parse import unquote

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

NAME = "scene_catalog"
SCHEMA = "id string, provider string, collection string, datetime timestamp_ntz, cloud_cover double, min_lon double, min_lat double, max_lon double, max_lat double, assets string"
_LOW, _HIGH = (GreaterThan, GreaterThanOrEqual), (LessThan, LessThanOrEqual)
#: Bytes of files that a task reads, about.
TASK_BYTES = 64 << 20


@dataclass
class _Files(InputPartition):
    paths: list[str] = field(default_factory=list)
    providers: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(0)


def _month(value) -> str | None:
    return value.strftime("%Y-%m") if isinstance(value, (date, datetime)) else None


def _number(value) -> float | None:
    try:
        number = float(value)
    except (TypeError, ValueError):
        return None
    return number if isfinite(number) else None


def _time(value) -> datetime | None:
    try:
        at = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    except ValueError:
        return None
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def row_of(line: str, provider: str) -> tuple | None:
    """The columns of an item; null for what it lacks or has in another form, none for a line that is no JSON object."""
    try:
        item = json.loads(line)
    except ValueError:
        return None
    if not isinstance(item, dict):
        return None
    p = item.get("properties")
    p = p if isinstance(p, dict) else {}
    first = lambda *names: next((p[n] for n in names if p.get(n) is not None), None)
    box = item.get("bbox")
    box = [_number(v) for v in box][:4] if isinstance(box, list) and len(box) == 4 else [None] * 4
    text = lambda v: v if isinstance(v, str) or v is None else json.dumps(v)
    assets = item.get("assets")
    return (text(item.get("id")), provider, text(item.get("collection")), _time(first("datetime", "start_datetime")), _number(first("eo:cloud_cover", "cloudCover")), *box, None if assets is None else json.dumps(assets, sort_keys=True))


class CatalogReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.providers: set[str] | None = None
        self.low = self.high = None  # months
        self.cloud: list[tuple[type, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Providers and cloud cover are settled here; times leave out months and go on to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "provider" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.providers = asked if self.providers is None else self.providers & asked
                continue
            if name == "provider" and isinstance(f, IsNotNull):
                continue
            if name == "cloud_cover" and isinstance(f, _LOW + _HIGH) and _number(f.value) is not None:
                self.cloud.append((type(f), float(f.value)))
                continue
            if name == "datetime" and isinstance(f, (*_LOW, *_HIGH, EqualTo)) and (month := _month(f.value)):
                if not isinstance(f, _HIGH):
                    self.low = max(self.low or month, month)
                if not isinstance(f, _LOW):
                    self.high = min(self.high or month, month)
            yield f

    def _wanted(self, provider: str, month: str) -> bool:
        return (self.providers is None or provider in self.providers) and (self.low is None or month >= self.low) and (self.high is None or month <= self.high)

    def partitions(self) -> Sequence[InputPartition]:
        """Files of the folders that can hold an answer, about ``TASK_BYTES`` to a task; the driver lists folders, and files of those alone."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        folders = lambda at: sorted((i for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if i.type == pafs.FileType.Directory), key=lambda i: i.path)
        out, size = [_Files()], 0
        for p in folders(root):
            name, _, provider = p.base_name.partition("=")
            provider = unquote(provider)
            if name != "provider" or self.providers is not None and provider not in self.providers:
                continue
            for m in folders(p.path):
                if not self._wanted(provider, m.base_name.partition("=")[2]):
                    continue
                for f in sorted(fs.get_file_info(pafs.FileSelector(m.path)), key=lambda i: i.path):
                    if f.type != pafs.FileType.File or f.base_name[:1] in "._":
                        continue
                    if size and size + f.size > TASK_BYTES:
                        out, size = [*out, _Files()], 0
                    out[-1].paths.append(f.path)
                    out[-1].providers.append(provider)
                    size += f.size
        return out

    def _clear(self, cover: float | None) -> bool:
        tests = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        return all(cover is not None and tests[kind](cover, v) for kind, v in self.cloud)

    def read(self, partition: _Files) -> Iterator[tuple]:
        if not partition.paths:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        for path, provider in zip(partition.paths, partition.providers):
            with fs.open_input_stream(path, compression="detect") as stream:
                rest = b""
                while chunk := stream.read(1 << 20):
                    *lines, rest = (rest + chunk).split(b"\n")
                    yield from self._rows(lines, provider)
                yield from self._rows([rest], provider)

    def _rows(self, lines: list[bytes], provider: str) -> Iterator[tuple]:
        for line in lines:
            if line.strip() and (row := row_of(line.decode("utf-8", "replace"), provider)) and self._clear(row[4]):
                yield row


class CatalogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CatalogReader:
        if "path" not in self.options:
            raise ValueError("the catalog needs a path")
        return CatalogReader(self.options["path"])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The items under ``path``, which driver and executors share. The session's filters are pushed into Python sources from here on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogSource)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()  # with the scheme of the session's file system
    return spark.read.format(NAME).load(whole.replace("file:/", "file:///", 1) if not whole.startswith("file://") else whole)


def write_catalog(scenes: DataFrame, path: str) -> None:
    """``scenes`` (id, provider, collection, datetime, cloud_cover, min_lon to max_lat) as items in the folders that the source reads.

    A folder of very many scenes is written by several tasks. Scenes without a provider or time cannot be found by them and are an error.
    """
    item = F.struct(
        F.lit("Feature").alias("type"), "id", "collection", F.array("min_lon", "min_lat", "max_lon", "max_lat").alias("bbox"),
        F.struct(F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover")).alias("properties"),
    )
    whole = F.when(F.col("provider").isNull() | F.col("datetime").isNull(), F.raise_error(F.lit("a scene needs a provider and a time")).cast("string")).otherwise(F.to_json(item))
    rows = scenes.select(whole.alias("value"), "provider", F.date_format("datetime", "yyyy-MM").alias("month"))
    rows.hint("rebalance", "provider", "month").write.partitionBy("provider", "month").text(path)
