"""Table definitions: names, column attributes, and their persistence as one JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession, types as T

from strandline.errors import TableExists, TableNotFound
from strandline.functions.quantize import effective_precision

DEFAULT_TABLE = "default"
#: The codes of column types.
UNKNOWN, INT, FLOAT, STRING, BOOL, JSON, STRUCTURE = range(7)
_SPARK = {INT: T.LongType(), FLOAT: T.DoubleType(), STRING: T.StringType(), BOOL: T.BooleanType(), JSON: T.VariantType(), UNKNOWN: T.VariantType()}


@dataclass
class ColumnAttribute:
    """A column: type code, decimals kept of floats, and the members of a structure."""

    name: str = "value"
    type: int = UNKNOWN
    desc: str = ""
    float_precision: int = 0
    structure: list[ColumnAttribute] = field(default_factory=list)

    def spark_type(self) -> T.DataType:
        if self.type == STRUCTURE:
            return T.StructType([T.StructField(c.name, c.spark_type(), True, {"desc": c.desc, "float_precision": c.float_precision}) for c in self.structure])
        if self.type not in _SPARK:
            raise ValueError(f"unknown column type {self.type}")
        return _SPARK[self.type]

    @classmethod
    def from_dict(cls, d: dict) -> ColumnAttribute:
        return cls(d["name"], d["type"], d.get("desc", ""), d.get("float_precision", 0), [cls.from_dict(x) for x in d.get("structure") or []])


@dataclass
class TableInfo:
    """``version``: the folder that the table's data are in, ``swept_day``: the first day that retention has left (None: all)."""

    name: str
    column: ColumnAttribute = field(default_factory=ColumnAttribute)
    version: int = 0
    swept_day: int | None = None


class Catalog:
    """The tables of one database folder. The list is written to a side name, which then replaces it in one rename, so that a reader, or a
    start after a crash, sees the old or the new list. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables: dict[str, TableInfo] = {}
        self.load()

    def _fs(self, name: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def load(self) -> None:
        """Read the list as it is now: another session may have made tables or compacted some."""
        fs, p = self._fs("tables.json")
        if not fs.exists(p):
            return
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        self.tables = {d["name"]: TableInfo(d["name"], ColumnAttribute.from_dict(d["column"]), d.get("version", 0), d.get("swept_day")) for d in json.loads(text)}

    def store(self) -> None:
        _, p = self._fs("tables.json")
        fs, side = self._fs("tables.json.new")
        out = fs.create(side, True)
        out.write(bytearray(json.dumps([asdict(t) for t in self.tables.values()]), "utf-8"))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        how = getattr(hadoop, "Options$Rename")
        replace = self.spark._sc._gateway.new_array(how, 1)
        replace[0] = how.OVERWRITE
        hadoop.FileContext.getFileContext(side.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(side), fs.makeQualified(p), replace)

    def create(self, table: TableInfo) -> TableInfo:
        if table.name in self.tables:
            raise TableExists(table.name)
        if table.column.type in (FLOAT, UNKNOWN):
            table.column.float_precision = effective_precision(table.column.float_precision)
        table.column.spark_type()
        self.tables[table.name] = table
        self.store()
        return table

    def get(self, name: str) -> TableInfo:
        name = name or DEFAULT_TABLE
        if name not in self.tables:
            raise TableNotFound(name)
        return self.tables[name]

    def folder(self, name: str) -> str:
        """The folder of a table's present version."""
        info = self.get(name)
        return f"{self.path}/{info.name}/v{info.version}"
