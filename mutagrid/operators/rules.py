"""Mutation rules as data: a rule filters AST nodes and fans each out to its replacements.

``replacements`` covers the rules that swap an operator for others of its set;
``deletions`` those that remove what a node holds, or insert before it; the rest
need other tables (fields, casts, catch blocks) and are functions of their own.
All are joins and explodes over ``schemas.AST_NODES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mutagrid.operators.selection import ARITHMETIC_TYPES

#: The operator sets of the swapping rules; COR's own table follows its not-AND, not-OR, not-XOR rule.
SWAPS = {
    "AORU": ("Unary", ["+", "-"], "arithmetic"),
    "LOR": ("Binary", ["&", "|", "^"], "not boolean"),
    "SOR": ("Binary", ["<<", ">>", ">>>"], ""),
    "AORB": ("Binary", ["*", "/", "%", "+", "-"], "arithmetic"),
    "AORS": ("Unary", ["++", "--"], "arithmetic"),
    "ROR": ("Binary", ["<", "<=", ">", ">=", "==", "!="], ""),
    "ASRS": ("Assignment", ["+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="], ""),
    "AOR": ("Binary", ["*", "/", "%", "+", "-"], ""),
}
CONDITIONAL = {"&&": ["||", "^"], "&": ["||", "^"], "||": ["&&", "^"], "|": ["&&", "^"], "^": ["&&", "||"]}
EMPTY = ("ABS", "LCR", "UOI", "EHI", "ExceptionAnalyzer")
#: Log texts of rules that are known by their log only.
LOGS = {"AOIS": "{v} => {v}++", "AOIU": "{v} => -{v}", "COI": "{v} => !({v})", "ISI": "{v} --> super.{v}", "JTI": "{v} --> this.{v}", "EOC": "{v} => {v}.equals", "ETC": "{v} --> {r}", "IHD": "{v} is deleted", "IOD": "{v} is deleted", "JSI": "static is inserted: {v}", "JSD": "static is deleted: {v}"}


def typed(kind: str) -> Column:
    numeric = F.col("lhs_type").isin(ARITHMETIC_TYPES)
    return {"arithmetic": numeric, "not boolean": F.coalesce(F.col("lhs_type") != "boolean", F.lit(True)), "": F.lit(True)}[kind]


def replacements(nodes: DataFrame, names: list[str]) -> DataFrame:
    """(node columns, rule, replacement): a row for each operator that a rule puts instead."""
    out = None
    for name in names:
        if name == "COR":
            both = (F.col("lhs_type") == "boolean") & (F.col("rhs_type") == "boolean") & (F.col("kind") == "Binary")
            table = F.create_map(*[x for op, new in CONDITIONAL.items() for x in (F.lit(op), F.array(*[F.lit(n) for n in new]))])
            one = nodes.filter(both).withColumn("replacement", F.explode(F.try_element_at(table, F.col("operator"))))
        else:
            kind, operators, of = SWAPS[name]
            hit = nodes.filter((F.col("kind") == kind) & F.col("operator").isin(operators) & typed(of))
            one = hit.withColumn("replacement", F.explode(F.array_except(F.array(*[F.lit(o) for o in operators]), F.array("operator"))))
        one = one.withColumn("rule", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def swapped(row_text: Column, operator: Column, replacement: Column) -> Column:
    """The node's text with its first operator replaced."""
    at = F.locate(operator, row_text) if isinstance(operator, str) else F.instr(row_text, operator)
    return F.when(at > 0, F.concat(F.substr(row_text, F.lit(1), at - 1), replacement, F.substr(row_text, at + F.length(operator)))).otherwise(row_text)


def shortcut_deletions(nodes: DataFrame) -> DataFrame:
    """AODS: ++ and -- go, but not in a for header."""
    return _gone(nodes.filter((F.col("kind") == "Unary") & F.col("operator").isin("++", "--") & ~F.coalesce("in_for_header", F.lit(False))), "AODS")


def sign_deletions(nodes: DataFrame) -> DataFrame:
    """AODU: unary signs of arithmetic operands go; the left of an assignment is left alone."""
    return _gone(nodes.filter((F.col("kind") == "Unary") & F.col("operator").isin("+", "-") & F.col("lhs_type").isin(ARITHMETIC_TYPES) & ~F.coalesce("is_assign_target", F.lit(False))), "AODU")


def not_deletions(nodes: DataFrame) -> DataFrame:
    return _gone(nodes.filter((F.col("kind") == "Unary") & (F.col("operator") == "!")), "COD")


def complement_deletions(nodes: DataFrame) -> DataFrame:
    return _gone(nodes.filter((F.col("kind") == "Unary") & (F.col("operator") == "~")), "LOD")


def complement_insertions(nodes: DataFrame) -> DataFrame:
    """LOI: ~ before an arithmetic variable or field that is no plain assignment's target."""
    hit = nodes.filter(F.col("kind").isin("Variable", "FieldAccess") & F.col("lhs_type").isin(ARITHMETIC_TYPES) & ~F.coalesce("is_assign_target", F.lit(False)))
    return hit.withColumns({"rule": F.lit("LOI"), "replacement": F.concat(F.lit("~"), F.col("text"))})


def shortcut_insertions(nodes: DataFrame) -> DataFrame:
    """AOIS: v++, ++v, v-- and --v for an arithmetic variable."""
    hit = nodes.filter((F.col("kind") == "Variable") & F.col("lhs_type").isin(ARITHMETIC_TYPES) & ~F.coalesce("is_assign_target", F.lit(False)))
    forms = F.array(F.concat("text", F.lit("++")), F.concat(F.lit("++"), F.col("text")), F.concat("text", F.lit("--")), F.concat(F.lit("--"), F.col("text")))
    return hit.withColumn("replacement", F.explode(forms)).withColumn("rule", F.lit("AOIS"))


def sign_insertions(nodes: DataFrame) -> DataFrame:
    hit = nodes.filter(F.col("kind").isin("Variable", "FieldAccess") & F.col("lhs_type").isin(ARITHMETIC_TYPES) & ~F.coalesce("is_assign_target", F.lit(False)))
    return hit.withColumns({"rule": F.lit("AOIU"), "replacement": F.concat(F.lit("-"), F.col("text"))})


def not_insertions(nodes: DataFrame) -> DataFrame:
    hit = nodes.filter(F.col("lhs_type") == "boolean")
    return hit.withColumns({"rule": F.lit("COI"), "replacement": F.when(F.col("kind") == "Binary", F.concat(F.lit("!("), F.col("text"), F.lit(")"))).otherwise(F.concat(F.lit("!"), F.col("text")))})


def relational_literals(nodes: DataFrame) -> DataFrame:
    """ROR: the whole comparison becomes true, or false."""
    hit = nodes.filter((F.col("kind") == "Binary") & F.col("operator").isin(SWAPS["ROR"][1]))
    return hit.withColumn("replacement", F.explode(F.array(F.lit("true"), F.lit("false")))).withColumn("rule", F.lit("ROR"))


def operator_deletions(nodes: DataFrame) -> DataFrame:
    """ODL on the other nodes: a unary operator leaves its operand, a compound assignment becomes a plain one."""
    unary = _gone(nodes.filter("kind = 'Unary'"), "ODL")
    compound = nodes.filter((F.col("kind") == "Assignment") & F.col("operator").isin(SWAPS["ASRS"][1]))
    return unary.unionByName(compound.withColumns({"rule": F.lit("ODL"), "replacement": swapped(F.col("text"), F.col("operator"), F.lit("="))}))


def unary_inserted(kind: Column, text: Column, operator: Column, prefix: Column) -> Column:
    """UOI's text: calls take their operator in front, variables in front or behind."""
    return F.when((kind == "MethodCall") | prefix, F.concat(F.lit("("), operator, text, F.lit(")"))).otherwise(F.concat(F.lit("("), text, operator, F.lit(")")))


def operand_deletions(nodes: DataFrame, rule: str) -> DataFrame:
    """CDL, VDL, ODL: a binary node keeps one of its operands (lhs, rhs); constants only, variables only, or either."""
    kind = {"CDL": "Constant", "VDL": "Variable", "ODL": None}[rule]
    keep = lambda mine, other: F.when(F.lit(True) if kind is None else F.col(f"{mine}_kind") == kind, F.col(other))
    kept = F.array_compact(F.array(keep("lhs", "rhs_text"), keep("rhs", "lhs_text")))
    return nodes.filter("kind = 'Binary'").withColumn("replacement", F.explode(kept)).withColumn("rule", F.lit(rule))


def _gone(hit: DataFrame, rule: str) -> DataFrame:
    """The node's own operator goes, in front or behind; what its operand holds stays."""
    inner, size = F.col("text"), F.length("operator")
    inner = F.when(F.startswith("text", F.col("operator")), F.substr("text", size + 1)).when(F.endswith("text", F.col("operator")), F.left("text", F.length("text") - size)).otherwise(inner)
    return hit.withColumns({"rule": F.lit(rule), "replacement": F.ltrim(inner)})


def super_call_deletions(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("kind") == "SuperCall") & (F.col("n_args") >= 1)).withColumns({"rule": F.lit("IPC"), "replacement": F.lit("")})


def default_constructor_deletions(nodes: DataFrame) -> DataFrame:
    """JDC: the constructor without arguments goes where it is a class's only one and has a body."""
    one = nodes.filter("kind = 'Constructor'").withColumn("_n", F.count("*").over(Window.partitionBy("class")))
    return one.filter("_n = 1 and n_args = 0 and body_size > 0").drop("_n").withColumns({"rule": F.lit("JDC"), "replacement": F.lit("")})


def initialiser_deletions(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'Field' and not is_final and initialiser is not null").withColumns({"rule": F.lit("JID"), "replacement": F.lit("")})


def static_deletions(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """JSD: static goes from fields that no static method uses (class, text)."""
    return nodes.filter("kind = 'Field' and is_static").join(uses, ["class", "text"], "left_anti").withColumns({"rule": F.lit("JSD"), "replacement": F.col("text")})


def static_insertions(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'Field' and not is_static").withColumns({"rule": F.lit("JSI"), "replacement": F.concat(F.lit("static "), F.col("text"))})


def cast_deletions(nodes: DataFrame, hidden: DataFrame) -> DataFrame:
    """PCD: a cast between different types goes where the cast type hides or overrides members (class)."""
    hit = nodes.filter("kind = 'Cast' and lhs_type <> rhs_type")
    return hit.join(hidden.select(F.col("class").alias("lhs_type")).distinct(), "lhs_type", "left_semi").withColumns({"rule": F.lit("PCD"), "replacement": F.col("text")})


def finally_deletions(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'Try' and n_catches > 0 and has_finally").withColumns({"rule": F.lit("EFD"), "replacement": F.lit("")})


def _removable(catches: DataFrame) -> DataFrame:
    """Catch nodes of a try with others, or with a finally."""
    return catches.filter("kind = 'Catch' and (n_catches > 1 or has_finally)")


def catch_widenings(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """EHC: the caught type (lhs_type) becomes each of its ancestors (node, ancestor)."""
    return _removable(nodes).join(closure.select(F.col("node").alias("lhs_type"), F.col("ancestor").alias("replacement")), "lhs_type").withColumn("rule", F.lit("EHC"))


def catch_deletions(nodes: DataFrame) -> DataFrame:
    return _removable(nodes).withColumns({"rule": F.lit("EHD"), "replacement": F.lit("")})


def throw_changes(nodes: DataFrame, inherits: DataFrame) -> DataFrame:
    """ETC: the thrown type becomes each of its direct children (child, parent)."""
    children = inherits.select(F.col("parent").alias("lhs_type"), F.col("child").alias("replacement"))
    return nodes.filter("kind = 'Throw'").join(children, "lhs_type").withColumn("rule", F.lit("ETC"))


def throw_deletions(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'Throw'").withColumns({"rule": F.lit("ETD"), "replacement": F.lit("")})


def log_records(mutants: DataFrame, separator: str = " : ") -> DataFrame:
    """Six joined fields: class, line, method, class twice, and the change."""
    change = F.concat("text", F.lit(" => "), F.col("replacement"))
    return mutants.select(F.concat_ws(separator, "class", F.col("line").cast("string"), "method_sig", "class", "class", F.regexp_replace(change, r"[\r\n]+", " ")).alias("value"))


def log_text(rule: str, value: Column, replacement: Column) -> Column:
    return F.replace(F.replace(F.lit(LOGS[rule]), F.lit("{v}"), value), F.lit("{r}"), replacement)


def no_mutants(nodes: DataFrame, rule: str) -> DataFrame:
    """Rules that are declared without a body make none."""
    assert rule in EMPTY
    return nodes.limit(0).withColumns({"rule": F.lit(rule), "replacement": F.lit("")})
