"""Scans. Spark's own readers where there is one; a Python data source for spreadsheets."""

from __future__ import annotations

import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from mutagrid import schemas
from mutagrid.functions.text import manifest_class_name


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The target manifest, one JSON object a line; blank lines are dropped, class names normalised."""
    return spark.read.schema(schemas.MANIFEST).json(path).withColumn("class_name", manifest_class_name(F.coalesce("class_name", "class_f")))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, gzip by extension."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def whole_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, text) of every file below a folder whose name fits: .java sources, generated tests, reports."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(path, properties): key=value lines of each file as a map, comments and blanks left out, the last of a key wins."""
    lines = spark.read.text(path).withColumn("path", F.col("_metadata.file_path")).withColumn("no", F.monotonically_increasing_id())
    lines = lines.filter(~F.col("value").rlike(r"^\s*([#!].*)?$"))
    parts = F.split("value", r"\s*[=:]\s*", 2)
    pairs = lines.select("path", "no", F.trim(F.get(parts, F.lit(0))).alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value"))
    last = pairs.groupBy("path", "key").agg(F.max_by("value", "no").alias("value"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))


def target_files(spark: SparkSession, batch_dir: str, schema: StructType | str, name: str = "state.json") -> DataFrame:
    """A JSON document of each target's folder, with the target's name."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name.rpartition("/")[2]).json(f"{batch_dir}/targets")
    return rows.withColumn("target", F.regexp_extract(F.col("_metadata.file_path"), r"/targets/([^/]+)/", 1))


def pickles(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of pickle files that the user trusts: a mapping or a list of mappings in each."""

    names = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).names

    def rows(batches):
        import pickle

        import pandas as pd

        for pdf in batches:
            for raw in pdf["content"]:
                found = pickle.loads(raw)
                found = list(found.values()) if isinstance(found, dict) and all(isinstance(v, dict) for v in found.values()) else found if isinstance(found, list) else [found]
                yield pd.DataFrame([[r.get(n) for n in names] for r in found], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def delimited_records(spark: SparkSession, path: str) -> DataFrame:
    """Length-prefixed records (unsigned LEB128, then bytes), one row each, for from_protobuf to read."""

    def rows(batches):
        import pandas as pd

        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                at, out = 0, []
                while at < len(raw):
                    size = shift = 0
                    while True:
                        byte = raw[at]
                        at += 1
                        size |= (byte & 127) << shift
                        shift += 7
                        if byte < 128:
                            break
                    out.append((name, len(out), raw[at : at + size]))
                    at += size
                yield pd.DataFrame(out, columns=["path", "no", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, no long, record binary")


def mutation_log(spark: SparkSession, path: str, separator: str = " : ") -> DataFrame:
    """The six fields of each log record, and the change as before and after."""
    from mutagrid.functions.text import change_parts

    parts = F.split("value", re.escape(separator), 6)
    names = ["class", "line", "method_signature", "class_alias", "class_name", "change"]
    rows = spark.read.text(path).filter(F.length("value") > 0).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rows.withColumn("line", F.col("line").try_cast("int")).withColumn("_c", change_parts("change")).select(*names, "_c.before", "_c.after")


def tag_text(html: Column | str, tag: str) -> Column:
    """The text of the first element of a tag that holds no other."""
    return F.regexp_extract(html, rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", 1)


def coverage_totals(html: Column) -> Column:
    """Cells of the footer of a report's coverage table, as an array of texts."""
    table = F.regexp_extract(html, r'(?s)<table[^>]*class="coverage"[^>]*>(.*?)</table>', 1)
    foot = F.regexp_extract(table, r"(?s)<tfoot>(.*?)</tfoot>", 1)
    return F.transform(F.regexp_extract_all(foot, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))


def coverage_counts(html: Column) -> Column:
    """(missed, total) branches and lines of a report: "missed of total" cells and the counts that follow."""
    from mutagrid.functions.convert import thousands_int

    cells = coverage_totals(html)
    of = lambda i: F.split(F.get(cells, F.lit(i)), " of ")
    number = lambda i: thousands_int(F.get(cells, F.lit(i)))
    branches = of(3)
    return F.struct(thousands_int(F.get(branches, F.lit(0))).alias("missed_branches"), thousands_int(F.get(branches, F.lit(1))).alias("total_branches"), number(7).alias("missed_lines"), number(8).alias("total_lines"))


class SheetSource(DataSource):
    """``spark.read.format("sheet").schema(...).load(path)``: rows of one sheet of workbooks, as texts by cell address.

    Options: sheet (index from 0), header (rows to skip). A missing cell is null and
    shifts nothing; a formula cell gives its formula; blanks are empty texts. Each
    workbook is read by one task.
    """

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return ", ".join(f"c{i} string" for i in range(int(self.options.get("columns", "12"))))

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(self.options, schema)


class SheetReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.sheet, self.header, self.schema = options["path"], int(options.get("sheet", "0")), int(options.get("header", "0")), schema

    def partitions(self):
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*.xlsx"))) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(p) for p in found]

    def read(self, partition):
        width = len(self.schema.fields)
        for i, cells in enumerate(sheet_rows(partition.value, self.sheet)):
            if i >= self.header:
                yield tuple(cells.get(k) for k in range(width))


def column_number(address: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", address)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def sheet_rows(path: str, sheet: int):
    """Rows of a workbook's sheet as {column: text}."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(path) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in item.iter(f"{ns}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        names = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))
        for row in ElementTree.fromstring(book.read(names[sheet])).iter(f"{ns}row"):
            out = {}
            for cell in row.iter(f"{ns}c"):
                kind, value, formula = cell.get("t"), cell.find(f"{ns}v"), cell.find(f"{ns}f")
                text = value.text if value is not None else ""
                if formula is not None:
                    text = formula.text or ""
                elif kind == "s":
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{ns}t"))
                elif kind == "b":
                    text = "true" if text == "1" else "false"
                elif kind == "e":
                    text = "UNKNOWN"
                out[column_number(cell.get("r"))] = text
            yield out


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path if there is one, else what build makes, written there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        build().write.parquet(path)
    return spark.read.parquet(path)
