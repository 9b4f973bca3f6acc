"""Names bound to declarations: the innermost scope around a reference that declares its name.

Scopes nest. For each name a sweep over its scopes' ends and its references counts how many are open: a
reference at depth d belongs to the last scope that was opened at depth d. Both steps are running totals
(``scans``), so no reference meets the scopes that it isn't in, and a file of any size is spread over
tasks. A scope holds both of its ends; of scopes of one extent the one with the greater id is the inner one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutagrid.operators import scans


def bound(references: DataFrame, declarations: DataFrame, by: list[str], at: str, ident: str, most: int | None = None, name: str = "declared_by") -> DataFrame:
    """The references with the id of the declaration (``by``, start, end, ``ident``) that binds them, null where none does. Null names bind nothing."""
    row = F.struct(*[F.col(c) for c in references.columns if c not in by])
    kind = references.select(row.alias("r")).schema["r"].dataType
    place = lambda at, side, a, b: [F.col(at).cast("long").alias("_at"), F.lit(side).alias("_side"), a.cast("long").alias("_a"), b.cast("long").alias("_b")]
    no_row, no_id = F.lit(None).cast(kind).alias("_row"), F.lit(None).cast("long").alias("_id")
    scope = declarations.filter(F.col("start") <= F.col("end"))
    opens = scope.select(*by, *place("start", 0, -F.col("end"), F.col(ident)), F.lit(1).alias("_step"), F.col(ident).cast("long").alias("_id"), no_row)
    closes = scope.select(*by, *place("end", 2, -F.col("start"), -F.col(ident)), F.lit(-1).alias("_step"), no_id, no_row)
    zero = F.lit(0)
    seen = references.select(*by, *place(at, 1, zero, zero), zero.alias("_step"), no_id, row.alias("_row"))
    scan = scans.way(scope.select(*by).unionAll(scope.select(*by)).unionAll(references.select(*by)), by, most)
    sweep = scan(opens.unionByName(closes).unionByName(seen), by, ["_at", "_side", "_a", "_b"], {"_depth": ("sum", F.col("_step"))})
    held = scan(sweep.filter("_side < 2").drop("_step"), [*by, "_depth"], ["_at", "_side", "_a", "_b"], {"_scope": ("last", F.col("_id"))})
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    inside = F.when(known & F.col("_at").isNotNull() & (F.col("_depth") > 0), F.col("_scope"))
    return held.filter("_side = 1").select(*[F.col(c) if c in by else F.col(f"_row.{c}") for c in references.columns], inside.alias(name))


def unreferenced_fields(fields: DataFrame, locals_: DataFrame, methods: DataFrame, references: DataFrame, most: int | None = None) -> DataFrame:
    """Fields (file, name, start, end, id) whose change nothing can tell: no reference (file, name, at) is bound to them outside of ``main``.

    Parameters and local variables ``locals_`` hide fields of their name; ``methods`` (file, method, start, end, id) say what is within main.
    """
    inside = bound(references, methods.withColumnRenamed("id", "_method_id"), ["file"], "at", "_method_id", most, "_method")
    main = methods.filter("method = 'main'").select(F.col("file").alias("_file"), F.col("id").alias("_main"))
    counted = inside.join(main, (F.col("file") == F.col("_file")) & (F.col("_method") == F.col("_main")), "left_anti").drop("_method")
    # ids of fields are even here and those of locals odd: one order of declarations
    every = fields.select("file", "name", "start", "end", (F.col("id") * 2).alias("id")).unionByName(locals_.select("file", "name", "start", "end", (F.col("id") * 2 + 1).alias("id")))
    used = bound(counted, every, ["file", "name"], "at", "id", most).filter("declared_by % 2 = 0").select((F.col("declared_by") / 2).cast("long").alias("_used"), F.col("file").alias("_in")).distinct()
    return fields.join(used, (F.col("id") == F.col("_used")) & (F.col("file") == F.col("_in")), "left_anti")


def uncalled_methods(methods: DataFrame, calls: DataFrame, most: int | None = None) -> DataFrame:
    """Methods (file, name, arg_types, start, end, id; the extent is their class's) that can be renamed unseen: no call (file, name, arg_types, at) is bound to them."""
    by = ["file", "name", "arg_types"]
    used = bound(calls, methods, by, "at", "id", most).filter("declared_by is not null").select(F.col("file").alias("_in"), F.col("declared_by").alias("_used")).distinct()
    return methods.join(used, (F.col("id") == F.col("_used")) & (F.col("file") == F.col("_in")), "left_anti")
