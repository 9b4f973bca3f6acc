"""Syntax trees as text, indented or JSON, and as tables of numbered nodes.

A node is a row: its number in document order (``node_id``), its depth, its parent, the last node of its
subtree (``last_id``) and its number in post-order. A node is within another exactly if its number
lies between that one's ``node_id`` and ``last_id``, so subtrees are ranges. Numbers are made from the depths alone: a
node's parent is the last node before it that is one less deep, and between two lines those levels end
that the next one is not deeper than. All are running values (``operators.scans``), so a file of any
number of nodes is dealt to many tasks.

Labels may hold any character: the indented form writes backslash, quote and line ends with a backslash, JSON as JSON does.
A null text, and one without nodes, gives no rows; a line that is no node, or is deeper than one level below the line before
it, makes the read fail and names its file and line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mutagrid.operators import joins, scans
from mutagrid.shared import stored, work_folder

TREE = "file string, node_id long, parent_id long, last_id long, post_id long, depth int, kind string, label string, pos int, len int, line int, line_end int"
NODE = r"^( *)(\S+) label='((?:[^'\\]|\\.)*)' \[pos=(-?\d+) len=(-?\d+)\] \[lines=(-?\d+)\.\.(-?\d+)\]$"
#: Pieces of JSON: a key, a text, a number, or a bracket.
PIECE = r'"(?:[^"\\]|\\.)*"\s*:|"(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|[{}\[\]]'


def numbered(nodes: DataFrame, scan: Callable | None = None) -> DataFrame:
    """Nodes (file, node_id, depth, ...) with ``parent_id``, ``last_id`` and ``post_id``."""
    scan = scan or scans.way(nodes, ["file"])
    keys = nodes.select("file", "node_id", F.col("depth").cast("long").alias("depth"))
    levels = keys.select("file", F.col("depth").alias("level"), "node_id", F.col("node_id").alias("found"))
    up = keys.select("file", (F.col("depth") - 1).alias("level"), "node_id", F.lit("up").alias("what"))
    behind = scan(keys.withColumn("back", -F.col("node_id")), ["file"], ["back"], {"next": ("before", F.col("depth"))})
    ends = behind.filter(F.col("next").isNull() | (F.col("next") <= F.col("depth"))).select("file", F.explode(F.sequence(F.coalesce("next", F.lit(0)), F.col("depth"))).alias("level"), "node_id", F.lit("end").alias("what"))
    met = joins.as_of(up.unionByName(ends), levels, ["file", "level"], "node_id", "found", scan=scan)
    parents = met.filter("what = 'up'").select("file", "node_id", F.col("found").alias("parent_id"))
    last = met.filter("what = 'end'").select("file", F.col("found").alias("node_id"), F.col("node_id").alias("last_id"))
    out = nodes.join(parents, ["file", "node_id"]).join(last, ["file", "node_id"])
    return out.withColumn("post_id", F.col("last_id") - F.col("depth"))


def from_indented(texts: DataFrame, most: int | None = None) -> DataFrame:
    """``TREE`` of (file, text): two spaces a level, then kind, label, position, length and lines."""
    lines = texts.select("file", F.posexplode(F.split("text", "\r?\n")).alias("no", "line")).filter(F.trim("line") != "")
    part = lambda i: F.regexp_extract("line", NODE, i)
    known = F.when(F.col("line").rlike(NODE) & (F.length(part(1)) % 2 == 0), F.length(part(1)) / 2).otherwise(F.raise_error(F.concat(F.lit("no node: "), F.col("file"), F.lit(" line "), F.col("no") + 1))).cast("int")
    nodes = lines.select("file", "no", known.alias("depth"), part(2).alias("kind"), plain(part(3)).alias("label"), *[part(i).cast("int").alias(c) for i, c in ((4, "pos"), (5, "len"), (6, "line"), (7, "line_end"))])
    return in_shape(nodes, scans.way(lines, ["file"], most))


def from_json(texts: DataFrame, most: int | None = None) -> DataFrame:
    """``TREE`` of (file, text), where a node is an object with ``type`` (or ``typeLabel``), ``label``, ``pos``, ``length`` and ``children``."""
    pieces = texts.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("no", "piece"))
    step = F.when(F.col("piece") == "{", 1).when(F.col("piece") == "}", -1).otherwise(0)
    scan = scans.way(pieces, ["file"], most)
    pieces = scan(pieces, ["file"], ["no"], {"level": ("sum", step), "key": ("before", F.col("piece"))})
    opens = pieces.filter("piece = '{'").select("file", "level", "no", F.col("no").alias("owner"))
    values = pieces.filter(F.col("key").endswith(":") & ~F.col("piece").isin("{", "[")).select("file", "level", "no", F.regexp_extract("key", r'^"((?:[^"\\]|\\.)*)"', 1).alias("key"), "piece")
    owned = joins.as_of(values, opens, ["file", "level"], "no", "owner", scan=scan)
    said = F.when(F.col("piece").startswith('"'), F.get(F.from_json(F.concat(F.lit("["), F.col("piece"), F.lit("]")), "array<string>"), F.lit(0))).otherwise(F.col("piece"))
    value = lambda *keys: F.max(F.when(F.col("key").isin(*keys), said))
    objects = owned.groupBy("file", "level", F.col("owner").alias("no")).agg(F.coalesce(value("typeLabel"), value("type")).alias("kind"), F.coalesce(value("label"), F.lit("")).alias("label"), value("pos").cast("int").alias("pos"), value("length").cast("int").alias("len"), value("line").cast("int").alias("line"), value("lineEnd").cast("int").alias("line_end"))
    objects = objects.filter("kind is not null")
    # an object around the root is no node
    top = objects.groupBy("file").agg(F.min("level").alias("top"))
    nodes = objects.join(top, "file").withColumn("depth", (F.col("level") - F.col("top")).cast("int")).drop("level", "top")
    return in_shape(nodes, scan)


def counted(nodes: DataFrame, scan: Callable) -> DataFrame:
    """Nodes in the order of ``no`` numbered from 0; depths that jump are an error."""
    found = scan(nodes, ["file"], ["no"], {"node_id": ("count", F.lit(1)), "above": ("before", F.col("depth"))})
    jump = F.col("depth") > F.coalesce(F.col("above"), F.lit(-1)) + 1
    return found.withColumn("depth", F.when(jump, F.raise_error(F.concat(F.lit("too deep: "), F.col("file"), F.lit(" line "), F.col("no") + 1)).cast("int")).otherwise(F.col("depth"))).withColumn("node_id", F.col("node_id") - 1).drop("no", "above")


def in_shape(nodes: DataFrame, scan: Callable) -> DataFrame:
    """Nodes in the order of ``no``, numbered and with their parents, as ``TREE``. Their numbers are read several times and so written once."""
    held = stored(counted(nodes, scan), work_folder(nodes.sparkSession, "trees"), "nodes")
    return numbered(held, scan).select(*[c.split()[0] for c in TREE.split(", ")])


def quoted(label: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def plain(label: Column) -> Column:
    held = F.replace(label, F.lit("\\\\"), F.lit("\0"))
    return F.replace(F.replace(F.replace(F.replace(held, F.lit("\\'"), F.lit("'")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\0"), F.lit("\\"))


def texts_of(lines: DataFrame, gap: str) -> DataFrame:
    """(file, text) of (file, node_id, said)."""
    return lines.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "said"))), lambda x: x["said"]), gap).alias("text"))


def to_indented(tree: DataFrame) -> DataFrame:
    said = F.format_string("%s%s label='%s' [pos=%d len=%d] [lines=%d..%d]", F.repeat(F.lit("  "), F.col("depth")), "kind", quoted(F.coalesce("label", F.lit(""))), "pos", "len", "line", "line_end")
    return texts_of(tree.select("file", "node_id", said.alias("said")), "\n")


def to_json(tree: DataFrame, most: int | None = None) -> DataFrame:
    """What a node says depends on itself and on how deep the next one is: it closes the levels that end with it."""
    behind = scans.scanned(tree.withColumn("back", -F.col("node_id")), ["file"], ["back"], {"next": ("before", F.col("depth"))}, most)
    own = F.struct(F.col("kind").alias("type"), "label", F.col("pos").cast("string").alias("pos"), F.col("len").cast("string").alias("length"), F.col("line").cast("string").alias("line"), F.col("line_end").cast("string").alias("lineEnd"))
    opened = F.concat(F.regexp_replace(F.to_json(own), r"\}$", ""), F.lit(',"children":['))
    closed = F.repeat(F.lit("]}"), F.greatest(F.col("depth") - F.coalesce("next", F.lit(0)) + 1, F.lit(0)))
    comma = F.when(F.col("next") <= F.col("depth"), ",").otherwise("")
    texts = texts_of(behind.select("file", "node_id", F.concat(opened, closed, comma).alias("said")), "")
    return texts.withColumn("text", F.concat(F.lit('{"root":'), F.col("text"), F.lit("}")))


def statements(tree: DataFrame) -> DataFrame:
    """Statement deletion (SDL): each statement that stands in a block, with the range of nodes and of code that goes with it."""
    blocks = tree.filter("kind in ('Block', 'SwitchStatement')").select("file", F.col("node_id").alias("parent_id"))
    found = tree.filter(F.col("kind").endswith("Statement")).join(blocks, ["file", "parent_id"], "left_semi")
    return found.select("file", F.concat(F.lit("SDL_"), F.col("node_id")).alias("mutant"), "node_id", "last_id", "pos", "len", "line", (F.col("last_id") - F.col("node_id") + 1).alias("removed"))


def without_statement(tree: DataFrame, picked: DataFrame, most: int | None = None) -> DataFrame:
    """The trees of the picked mutants (file, mutant, node_id, last_id): all nodes but the statement's subtree, numbered anew; ``file`` is file and mutant."""
    gone = picked.select("file", "mutant", F.col("node_id").alias("first"), F.col("last_id").alias("last"))
    left = tree.drop("parent_id", "last_id", "post_id").join(gone, "file").filter((F.col("node_id") < F.col("first")) | (F.col("node_id") > F.col("last")))
    nodes = left.withColumn("file", F.concat_ws("#", "file", "mutant")).withColumnRenamed("node_id", "no").drop("mutant", "first", "last")
    return in_shape(nodes, scans.way(nodes, ["file"], most))


def cut_source(sources: DataFrame, picked: DataFrame) -> DataFrame:
    """(file, mutant, text) of the picked mutants: the source without the statement's code."""
    text, pos, size = F.col("text"), F.col("pos"), F.col("len")
    return picked.join(sources.select("file", "text"), "file").select("file", "mutant", F.concat(F.substr(text, F.lit(1), pos), F.substr(text, pos + size + 1)).alias("text"))


def ast_nodes(tree: DataFrame, schema: str) -> DataFrame:
    """The tree in the columns of a table of syntax nodes, null where a tree doesn't say; the class is the file."""
    known = {"node_id": F.col("node_id"), "parent_id": F.col("parent_id"), "class": F.col("file"), "kind": F.col("kind"), "text": F.col("label"), "line": F.col("line")}
    return tree.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields])
