"""Open-data tables: a paged REST source as a Spark data source, JSON-array files, and catalogue planning."""

from __future__ import annotations

import json
import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Pages(InputPartition):
    """Every `step`-th page of a dataset from `first`, until a page is short."""

    dataset: str
    first: int
    step: int


class RecordsReader(DataSourceReader):
    """`lanes` partitions per dataset, which take its pages in turn; equality filters are sent to the service.

    Each lane reads on until a page comes short, so nothing is lost whatever the size and no count need be known.
    """

    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = schema.fieldNames()
        self.base = options["path"]
        self.datasets = [x.strip() for x in options["datasets"].split(",") if x.strip()]
        self.size, self.lanes = int(options.get("pagesize", 50_000)), int(options.get("lanes", 1))
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1:
                self.where.append((f.attribute[0], f.value))
            yield f  # checked again by Spark, since a service may ignore a clause

    def partitions(self) -> list[InputPartition]:
        return [Pages(d, k, self.lanes) for d in self.datasets for k in range(self.lanes)]

    def read(self, lane: Pages) -> Iterator[tuple]:
        fetch = self._from_service if self.base.startswith(("http://", "https://")) else self._from_file(lane.dataset)
        page = lane.first
        while True:
            rows = fetch(lane.dataset, page * self.size)
            for r in rows:
                yield tuple(None if r.get(n) is None else str(r[n]) for n in self.names)
            if len(rows) < self.size:
                return
            page += lane.step

    def _from_service(self, dataset: str, offset: int) -> list[dict]:
        q = {"$limit": self.size, "$offset": offset, "$order": ":id"}
        if self.where:
            q["$where"] = " AND ".join(f"{k}='{str(v).replace(chr(39), chr(39) * 2)}'" for k, v in self.where)
        with urllib.request.urlopen(f"{self.base}/{dataset}.json?{urllib.parse.urlencode(q)}", timeout=120) as r:
            return json.load(r)

    def _from_file(self, dataset: str) -> Callable[[str, int], list[dict]]:
        """The pages of a saved answer, which is parsed once per lane; a missing file has no rows."""
        path, rows = f"{self.base.removeprefix('file://')}/{dataset}.json", []
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                rows = [r for r in json.load(f) if all(str(r.get(k)) == str(v) for k, v in self.where)]
        return lambda _, offset: rows[offset : offset + self.size]


class RecordsSource(DataSource):
    """spark.read.format("records").schema(...).option("datasets", "a,b").load(base): all columns are strings."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordsReader(schema, self.options)


def read_records(spark: SparkSession, base: str, datasets: list[str], columns: list[str], page_size: int = 50_000, lanes: int = 1) -> DataFrame:
    """All rows of the datasets; `lanes` tasks read each dataset's pages in turn."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordsSource)
    return spark.read.format("records").schema(", ".join(f"`{c}` string" for c in columns)).options(datasets=",".join(datasets), pagesize=page_size, lanes=lanes).load(base)


def read_json_array(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The objects of a JSON-array file as strings; a missing file is an empty table, absent columns are null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    local = path.removeprefix("file://")
    if not path.startswith(("s3", "hdfs", "gs", "abfs")) and not os.path.exists(local):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def first_with_rows(candidates: list[DataFrame]) -> DataFrame:
    """The first candidate that has a row (alternative filter columns of one dataset); the last one if none has."""
    for c in candidates[:-1]:
        if not c.isEmpty():
            return c
    return candidates[-1]


def search_catalogue(fetch: Callable[[str], list[dict]], spark: SparkSession, terms: list[str]) -> DataFrame:
    """(id, name, kind) of all answers to the search terms; fetch gives the entries of one term. A catalogue is a driver-side list."""
    rows = [(r.get("id"), r.get("name"), r.get("type")) for t in terms for r in fetch(t)]
    return spark.createDataFrame(rows, "id string, name string, kind string").where("id is not null")


def probe(spark: SparkSession, base: str, dataset: str, columns: list[str], filters: list[tuple[str, str]]) -> DataFrame:
    """The dataset under the first (column, value) filter that has rows; the last one if none has."""
    df = read_records(spark, base, [dataset], columns)
    return first_with_rows([df.where(F.col(c) == v) for c, v in filters])


def new_datasets(found: DataFrame, known: DataFrame) -> DataFrame:
    """Catalogue entries of kind dataset that are not known yet, each id once (the least name)."""
    d = found.where("kind = 'dataset'").groupBy("id").agg(F.min("name").alias("name"))
    return d.join(known.select("id"), "id", "left_anti")


def canonical_rows(df: DataFrame, ignore: tuple[str, ...] = ("rowid", ":id")) -> DataFrame:
    """Rows that are distinct but for the service's own columns."""
    keys = sorted(c for c in df.columns if c not in ignore)
    return df.withColumn("__k", F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in keys])), 256)).dropDuplicates(["__k"]).drop("__k")
