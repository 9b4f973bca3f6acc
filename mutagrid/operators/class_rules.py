"""Mutation rules over classes: modifiers, accessors, hiding, overriding, overloading and reference types.

Each takes nodes (``schemas.AST_NODES``, with the extra columns that its docstring names) and the
tables of facts that it needs, and gives a row for each mutant, with rule and
replacement. All are equality joins and explodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutagrid.operators import joins
from mutagrid.operators.selection import ARITHMETIC_TYPES

#: The modifiers of access, none being that of a package; what the names of accessors and modifiers of state begin with.
ACCESS = ["public", "protected", "private", ""]
CALLS = {"EAM": "get", "EMM": "set"}
#: The rules that put a related type, the kind of node that they take, and whether relatives are ancestors, descendants or both.
TYPES = {"PNC": ("New", "down"), "PMD": ("Declaration", "up"), "PPD": ("Parameter", "up"), "PCC": ("Cast", "both")}


def _made(hit: DataFrame, rule: str, replacement: Column) -> DataFrame:
    return hit.withColumns({"rule": F.lit(rule), "replacement": replacement})


def access_changes(nodes: DataFrame) -> DataFrame:
    """AMC: the access of a member (``modifier``) becomes each other one."""
    others = F.array_except(F.array(*[F.lit(a) for a in ACCESS]), F.array(F.coalesce("modifier", F.lit(""))))
    return _made(nodes.filter("kind in ('Field', 'Method', 'Constructor')"), "AMC", F.explode(others))


def call_swaps(nodes: DataFrame, methods: DataFrame, rule: str) -> DataFrame:
    """EAM, EMM: a call (``operator`` its method, ``lhs_type`` its class) of an accessor, or of a modifier, becomes that of another one
    of the class with equal parameters and type; methods are (class, name, params, type)."""
    known = methods.filter(F.startswith(F.col("name"), F.lit(CALLS[rule]))).select(F.col("class").alias("lhs_type"), "name", "params", "type").distinct()
    pairs = known.withColumnRenamed("name", "operator").join(known.withColumnRenamed("name", "_other"), ["lhs_type", "params", "type"]).filter("operator <> _other")
    hit = nodes.filter("kind = 'MethodCall'").join(pairs.select("lhs_type", "operator", "_other").distinct(), ["lhs_type", "operator"])
    return _made(hit, rule, F.replace("text", F.concat("operator", F.lit("(")), F.concat("_other", F.lit("(")))).drop("_other")


def equality_changes(nodes: DataFrame) -> DataFrame:
    """EOC: ``a.equals(b)`` becomes ``a == b``, and ``a == b`` of references (``lhs_text``, ``rhs_text``) ``a.equals(b)``."""
    call = nodes.filter("kind = 'MethodCall' and operator = 'equals' and n_args = 1")
    same = nodes.filter((F.col("kind") == "Binary") & (F.col("operator") == "==") & ~F.col("lhs_type").isin([*ARITHMETIC_TYPES, "boolean", "null"]))
    return _made(call, "EOC", F.concat("lhs_text", F.lit(" == "), F.col("rhs_text"))).unionByName(_made(same, "EOC", F.concat("lhs_text", F.lit(".equals("), F.col("rhs_text"), F.lit(")"))))


def hiding_deletions(fields: DataFrame, inherited: DataFrame) -> DataFrame:
    """IHD: a field (class, text) goes that hides one which its class inherits (class, text)."""
    return _made(joins.hiding_members(fields, inherited, ["class", "text"]), "IHD", F.lit(""))


def hiding_insertions(fields: DataFrame, inherited: DataFrame) -> DataFrame:
    """IHI: every inherited field that its class doesn't declare is declared there."""
    return _made(joins.without(inherited.distinct(), fields, ["class", "text"]), "IHI", F.col("text"))


def override_deletions(methods: DataFrame, inherited: DataFrame) -> DataFrame:
    """IOD: a method (class, name, params, type) goes that overrides an inherited one."""
    return _made(joins.hiding_members(methods, inherited, ["class", "name", "params", "type"]), "IOD", F.lit(""))


def qualified(nodes: DataFrame, names: DataFrame, rule: str) -> DataFrame:
    """ISI, JTI: a variable or call (class, text) whose name is in ``names`` (class, text) gets ``super.``, or ``this.``."""
    return _made(nodes.filter("kind in ('Variable', 'FieldAccess', 'MethodCall')").join(names.distinct(), ["class", "text"], "left_semi"), rule, F.concat(F.lit({"ISI": "super.", "JTI": "this."}[rule]), F.col("text")))


def unqualified(nodes: DataFrame, rule: str) -> DataFrame:
    """ISK, JTD: ``super.``, or ``this.``, goes."""
    word = {"ISK": "super.", "JTD": "this."}[rule]
    return _made(nodes.filter(F.startswith(F.col("text"), F.lit(word)) & F.col("kind").isin("FieldAccess", "MethodCall")), rule, F.substring(F.col("text"), F.lit(len(word) + 1), F.length("text")))


def argument_changes(nodes: DataFrame, methods: DataFrame) -> DataFrame:
    """OAN: a call (``args``) is made with its first arguments only, as many as another overload of its class takes; methods are (class, name, n_params)."""
    fewer = methods.select(F.col("class").alias("lhs_type"), F.col("name").alias("operator"), F.col("n_params").alias("_n")).distinct()
    hit = nodes.filter("kind = 'MethodCall'").join(fewer, ["lhs_type", "operator"]).filter("_n < n_args")
    return _made(hit, "OAN", F.concat("operator", F.lit("("), F.array_join(F.slice("args", F.lit(1), F.col("_n")), ", "), F.lit(")"))).drop("_n")


def overload_rows(methods: DataFrame) -> DataFrame:
    """OMD: every method (class, name, params, n_params, names) of several of its name goes; OMR: its body becomes a call of another one that takes no more arguments."""
    more = methods.groupBy("class", "name").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    several = methods.join(more, ["class", "name"], "left_semi")
    others = methods.select("class", "name", F.col("n_params").alias("_k"), F.col("params").alias("_other"))
    redirected = several.join(others, ["class", "name"]).filter("_k <= n_params and params <> _other")
    call = F.concat(F.lit("this."), F.col("name"), F.lit("("), F.array_join(F.slice("names", F.lit(1), F.col("_k")), ", "), F.lit(")"))
    return _made(several, "OMD", F.lit("")).unionByName(_made(redirected, "OMR", call).drop("_k", "_other"))


def type_changes(nodes: DataFrame, closure: DataFrame, rule: str) -> DataFrame:
    """PNC, PMD, PPD, PCC: the type of a node (``lhs_type``) becomes each relative, by the closure (node, ancestor)."""
    kind, way = TYPES[rule]
    up, down = closure.select(F.col("node").alias("lhs_type"), F.col("ancestor").alias("_type")), closure.select(F.col("ancestor").alias("lhs_type"), F.col("node").alias("_type"))
    relatives = {"up": up, "down": down, "both": up.union(down)}[way].distinct()
    return _made(nodes.filter(F.col("kind") == kind).join(relatives, "lhs_type"), rule, F.col("_type")).drop("_type")


def cast_insertions(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """PCI: a variable is cast to each ancestor of its type."""
    up = closure.select(F.col("node").alias("lhs_type"), F.col("ancestor").alias("_type")).distinct()
    return _made(nodes.filter("kind = 'Variable'").join(up, "lhs_type"), "PCI", F.concat(F.lit("(("), F.col("_type"), F.lit(")"), F.col("text"), F.lit(")"))).drop("_type")


def value_changes(nodes: DataFrame, variables: DataFrame) -> DataFrame:
    """PRV: an assigned variable (``lhs_text``, ``rhs_text``) becomes each other one (class, text, type) of the class with the type."""
    others = variables.select("class", F.col("type").alias("rhs_type"), F.col("text").alias("_other")).distinct()
    hit = nodes.filter("kind = 'Assignment'").join(others, ["class", "rhs_type"]).filter("_other <> rhs_text and _other <> lhs_text")
    return _made(hit, "PRV", F.concat("lhs_text", F.lit(" = "), F.col("_other"))).drop("_other")
