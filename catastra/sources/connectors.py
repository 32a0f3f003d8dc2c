"""S-17, S-18: sources as one Spark data source, each in partitions of its own; what goes wrong in one is a row, and no fault of the others."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from catastra.sources.schemas import SOURCE_ITEM
from catastra.sources.shared import staged

ITEM = [f.name for f in SOURCE_ITEM.fields]
#: `part` and `error` besides an item's fields; a row with an error has no others but the source.
SCHEMA = SOURCE_ITEM.simpleString()[len("struct<") : -1] + ",part:string,error:string"


@dataclass(frozen=True)
class Connector:
    """A source by name: parts, each read by a task, and how a part gives its items (tuples of the fields of SOURCE_ITEM but the source). `check` may raise where the source can't be asked."""

    name: str
    read: Callable[[str], Iterable[tuple]]
    parts: list[str] = field(default_factory=lambda: [""])
    check: Callable[[], str] = lambda: "available"


class Part(InputPartition):
    def __init__(self, name: str, part: str) -> None:
        self.name, self.part = name, part


class Reader(DataSourceReader):
    """Filters on the source's name leave other sources unasked."""

    def __init__(self, connectors: dict[str, Connector]) -> None:
        self.connectors, self.wanted = connectors, set(connectors)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("source",):
                self.wanted &= {f.value}
            elif isinstance(f, In) and f.attribute == ("source",):
                self.wanted &= set(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Part(n, p) for n in sorted(self.wanted) for p in self.connectors[n].parts] or [Part("", "")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.name:
            return
        gap = (None,) * (len(ITEM) - 1)
        try:
            for item in self.connectors[partition.name].read(partition.part):
                yield (partition.name, *item, partition.part, None)
        except Exception as e:  # told as a row: the other parts go on
            yield (partition.name, *gap, partition.part, f"{type(e).__name__}: {e}"[:500])


def source_of(connectors: dict[str, Connector], name: str = "connectors") -> type[DataSource]:
    class Connected(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA.replace(":", " ")

        def reader(self, schema) -> DataSourceReader:
            return Reader(connectors)

    return Connected


class Connectors:
    """S-18: connectors by name; a later one of the same name replaces the former."""

    def __init__(self, *connectors: Connector) -> None:
        self.by_name = {c.name: c for c in connectors}

    def register(self, connector: Connector) -> None:
        self.by_name[connector.name] = connector

    def get(self, name: str) -> Connector | None:
        return self.by_name.get(name)

    def has(self, name: str) -> bool:
        return name in self.by_name

    def statuses(self, spark: SparkSession) -> DataFrame:
        """(source, status, message): `error` for a source whose check raises, the others are asked all the same."""
        rows = []
        for name, c in sorted(self.by_name.items()):
            try:
                rows.append((name, c.check(), None))
            except Exception as e:
                rows.append((name, "error", f"Failed to check status: {e}"))
        return spark.createDataFrame(rows, "source string, status string, message string")

    def search(self, spark: SparkSession, *names: str) -> tuple[DataFrame, DataFrame]:
        """The items of the sources named (all, without a name), and (source, part, error) of the parts that failed.

        Every part is read once. Of a part that fails no items are given, not even those that it gave before; those of other
        parts and sources are all there.
        """
        spark.dataSource.register(source_of(self.by_name))
        switch = "spark.sql.python.filterPushdown.enabled"
        before = spark.conf.get(switch, "false")
        spark.conf.set(switch, "true")
        try:
            rows = spark.read.format("connectors").load()
            rows = staged(rows.filter(F.col("source").isin(*names)) if names else rows)
        finally:
            spark.conf.set(switch, before)
        failed = rows.filter("error is not null").select("source", "part", "error")
        return rows.filter("error is null").join(failed, ["source", "part"], "left_anti").select(*ITEM), failed


def parquet_connector(name: str, uri: str, id: str, title: str, raw: str) -> Connector:
    """A Parquet file as a source: a part for each of its row groups."""

    def opened():
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        return pq.ParquetFile(fs.open_input_file(path))

    def read(part: str) -> Iterator[tuple]:
        with opened() as f:
            for batch in f.iter_batches(row_groups=[int(part)], columns=[id, title, raw]):
                for row in batch.to_pylist():
                    yield tuple(None if row[c] is None else str(row[c]) for c in (id, title, raw))

    def check() -> str:
        with opened() as f:
            return "available" if f.metadata.num_rows else "unavailable"

    with opened() as f:
        return Connector(name, read, [str(k) for k in range(f.num_row_groups)], check)
