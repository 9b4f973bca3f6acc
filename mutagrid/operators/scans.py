"""Running totals of keys of any size: range blocks, a carry per block, and a second pass.

A window over a key is one task's work, however many rows the key has. Here rows are
dealt to ranges of key and order, so a hot key lies in many ranges. Each (key, block)
is scanned by itself; what a block ends with is one small row; the rows of a key's later blocks take in what
its blocks before end with. A block goes on with one key of its predecessor at most, so there are no more
carries than blocks, and they are broadcast.

Order: nulls come first, and rows that tie come in the order of their other columns, so that results
are defined as a bag. Null keys are a key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutagrid.shared import stored, work_folder

#: Rows of a key that one task may scan.
MOST = 1 << 20

#: (running value up to a row, what a block ends with, how a carry and a value in the block are joined) of each kind.
#: ``before`` is the value of the row before, as it is; ``last`` the last that is not null.
KINDS = {
    "sum": (lambda x, upto, earlier: F.sum(x).over(upto), lambda x, place: F.sum(x), lambda carry, x: F.coalesce(carry + x, carry, x)),
    "count": (lambda x, upto, earlier: F.count(x).over(upto), lambda x, place: F.count(x), lambda carry, x: carry + x),
    "max": (lambda x, upto, earlier: F.max(x).over(upto), lambda x, place: F.max(x), lambda carry, x: F.greatest(carry, x)),
    "last": (lambda x, upto, earlier: F.last(x, ignorenulls=True).over(upto), lambda x, place: F.max_by(x, F.when(x.isNotNull(), place)), lambda carry, x: F.coalesce(x, carry)),
    "before": (lambda x, upto, earlier: F.last(F.struct(x.alias("v"))).over(earlier), lambda x, place: F.max_by(F.struct(x.alias("v")), place), lambda carry, x: F.coalesce(x, carry)),
}


def way(rows: DataFrame, by: list[str], most: int | None = None) -> Callable[..., DataFrame]:
    """``windowed`` where no key has more than ``most`` rows, else ``blocked``. What is scanned step by step decides once, by its coarsest key."""
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0]
    return blocked if (largest or 0) > (MOST if most is None else most) else windowed


def scanned(rows: DataFrame, by: list[str], order: list[str], columns: dict[str, tuple[str, Column]], most: int | None = None) -> DataFrame:
    """The rows with running columns {name: (kind, value)}: one window where no key has more than ``most`` rows, else blocks."""
    return way(rows, by, most)(rows, by, order, columns)


def places(rows: DataFrame, by: list[str], order: list[str]) -> list[str]:
    """The order made total: what ties is told apart by all other columns that have an order."""
    rest = [f.name for f in rows.schema.fields if f.name not in {*by, *order} and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return [*order, *rest]


def running(rows: DataFrame, by: list[str], order: list[str], columns: dict[str, tuple[str, Column]]) -> dict[str, Column]:
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return {name: KINDS[kind][0](x, upto, earlier) for name, (kind, x) in columns.items()}


def plain(columns: dict[str, tuple[str, Column]]) -> dict[str, Column]:
    """The values of rows before out of their wraps."""
    return {name: F.col(f"{name}.v") for name, (kind, _) in columns.items() if kind == "before"}


def windowed(rows: DataFrame, by: list[str], order: list[str], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    return rows.withColumns(running(rows, by, places(rows, by, order), columns)).withColumns(plain(columns))


def blocked(rows: DataFrame, by: list[str], order: list[str], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    place = places(rows, by, order)
    block = free("_block", rows.columns)
    # which block a row is in is decided once: the table that is written says so
    ranged = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, *place).withColumn(block, F.spark_partition_id())
    local = stored(ranged.withColumns(running(ranged, [*by, block], place, columns)), work_folder(rows.sparkSession, "scan"), "blocks")
    at = F.struct(*place)
    ends = local.groupBy(*by, block).agg(*[KINDS[kind][1](x, at).alias(name) for name, (kind, x) in columns.items()])
    earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    total = {"sum": F.sum, "count": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True), "before": lambda c: F.last(c, ignorenulls=True)}
    carried = {name: free(f"_carry_{name}", rows.columns) for name in columns}
    keys = {c: free(f"_key_{c}", rows.columns) for c in [*by, block]}
    carry = ends.withColumns({carried[name]: total[kind](name).over(earlier) for name, (kind, _) in columns.items()}).withColumn("_earlier", F.count("*").over(earlier))
    # only blocks that go on with a key: no more than there are blocks
    carry = carry.filter("_earlier > 0").select(*[F.col(c).alias(k) for c, k in keys.items()], *carried.values(), F.lit(True).alias("_goes_on"))
    met = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()])
    joined = local.join(F.broadcast(carry), met, "left")
    whole = {name: F.when(F.col("_goes_on"), KINDS[kind][2](F.col(carried[name]), F.col(name))).otherwise(F.col(name)) for name, (kind, _) in columns.items()}
    return joined.withColumns(whole).select(*rows.columns, *columns).withColumns(plain(columns))


def free(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name
