"""Sources of claims: files of statements as a Spark data source, and adapters that answer about entities."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from provenir.operators.expand import bounded
from provenir.sources.statements import stated_edges

SPLIT = 64_000_000
BATCH = 4_000_000


@dataclass
class FileRange(InputPartition):
    path: str
    begin: int
    end: int


class _Reader(DataSourceReader):
    """Lines of {"id": ..., ...}. A range reads the lines that begin in it. An id that is asked for reaches the reader as a filter,
    so that other lines are dropped before they are made into rows."""

    def __init__(self, folder: str, split: int):
        self.folder, self.split, self.only = folder, split, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            match f:
                case EqualTo(("qid",), value) if isinstance(value, str):
                    self._restrict({value})
                case In(("qid",), values):
                    self._restrict(set(values))
                case _:
                    yield f

    def _restrict(self, ids: set[str]) -> None:
        self.only = ids if self.only is None else self.only & ids

    def partitions(self) -> Sequence[InputPartition]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        files = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        out = [FileRange(f.path, k, min(k + self.split, f.size)) for f in sorted(files, key=lambda f: f.path) for k in range(0, f.size, self.split)]
        return out or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.folder)
        ids, lines, size = [], [], 0
        if not partition.path:
            return
        with io.BufferedReader(fs.open_input_file(partition.path), 1 << 20) as f:
            f.seek(max(0, partition.begin - 1))
            if partition.begin:
                f.readline()  # the end of a line that began before, or a line feed
            while f.tell() < partition.end and (line := f.readline()):
                if not line.strip():
                    continue
                qid = json.loads(line)["id"]
                if self.only is not None and qid not in self.only:
                    continue
                ids.append(qid)
                lines.append(line.decode().rstrip("\r\n"))
                size += len(line)
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines)], ["qid", "json"])
                    ids, lines, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines)], ["qid", "json"])


class StatementFiles(DataSource):
    """spark.read.format("statement_files").load(folder): qid, json. Option split: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "statement_files"

    def schema(self) -> str:
        return "qid string, json string"

    def reader(self, schema) -> DataSourceReader:
        if not (folder := self.options.get("path", "").strip()):
            raise ValueError("statement_files needs a folder")
        return _Reader(folder, int(self.options.get("split", SPLIT)))


def read_statement_files(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """Registers the source in the session, and lets filters reach it: Spark refuses a reader that takes filters otherwise."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StatementFiles)
    return spark.read.format("statement_files").option("split", split).load(folder)


class Adapter:
    """A source that can be asked about entities. Subclasses give an id, the kinds they know, and their claims."""

    id: str = ""
    kinds: tuple[str, ...] | None = None

    def supports(self, kind: Column) -> Column:
        return F.lit(True) if self.kinds is None else kind.isin(*self.kinds)

    def claims(self, seeds: DataFrame) -> DataFrame:
        """seeds(qid, kind) -> seed, from_qid, type_code, to_qid, valid_from, valid_to, confidence, source_ref."""
        raise NotImplementedError


class StatementAdapter(Adapter):
    """Entities' own statements, from statement files."""

    def __init__(self, id: str, statements: DataFrame, kinds: tuple[str, ...] | None = None):
        self.id, self.statements, self.kinds = id, statements, kinds

    def claims(self, seeds: DataFrame) -> DataFrame:
        return stated_edges(self.statements.join(seeds.select("qid"), "qid", "left_semi"))


class Adapters:
    """Adapters in the order in which their answers count. Ids that are blank, hold a tab or line feed, or come twice are refused."""

    def __init__(self, *all: Adapter):
        seen: set[str] = set()
        for a in all:
            if not a.id or not a.id.strip():
                raise ValueError("an adapter's id must not be blank")
            if any(c in a.id for c in "\t\n\r"):
                raise ValueError(f"an adapter's id must not hold tabs or line feeds: {a.id!r}")
            if a.id in seen:
                raise ValueError(f"two adapters share the id: {a.id}")
            seen.add(a.id)
        self.all = all

    def expand(self, seeds: DataFrame, requested: int) -> DataFrame:
        """What each adapter says about seeds(qid, kind) of the kinds it knows, one adapter after the other, at most requested claims a seed
        (fewer for a concept). Adds source_id, bound and place."""
        if requested <= 0:
            raise ValueError(f"the bound must be positive, got {requested}")
        parts = [a.claims(seeds.where(a.supports(F.col("kind")))).withColumns({"source_id": F.lit(a.id), "adapter": F.lit(k)}) for k, a in enumerate(self.all)]
        answers = reduce(DataFrame.unionByName, parts)
        return bounded(answers.withColumnRenamed("from_qid", "qid"), seeds, requested).withColumnRenamed("qid", "from_qid").drop("adapter")
