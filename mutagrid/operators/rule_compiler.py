"""The rules that need nothing but the node, compiled into one expression: one scan whatever the number of rules.

A rule is a condition and the array of what it puts instead; ``compiled`` makes one array of (rule, replacement) of all of
them, null where a condition doesn't hold, and unfolds it in place. The nodes are read once, and there is no union and no join.
Rules that need other tables (types, casts, members) are functions of ``rules`` and ``class_rules``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mutagrid.operators import rules
from mutagrid.operators.selection import ARITHMETIC_TYPES


class Rule(NamedTuple):
    name: str
    when: Column
    makes: Column


def local_rules() -> list[Rule]:
    """COR, the swaps, deletions and insertions of operators, operands, statements and modifiers."""
    kind, operator, text, target = F.col("kind"), F.col("operator"), F.col("text"), F.coalesce("is_assign_target", F.lit(False))
    numeric, either = F.col("lhs_type").isin(ARITHMETIC_TYPES), F.lit(True)
    unary, binary, assigned = kind == "Unary", kind == "Binary", (kind == "Assignment") & operator.isin(rules.SWAPS["ASRS"][1])
    place = kind.isin("Variable", "FieldAccess") & numeric & ~target
    swap = lambda new: F.array_except(F.array(*[F.lit(o) for o in new]), F.array(operator))
    other = F.create_map(*[x for op, new in rules.CONDITIONAL.items() for x in (F.lit(op), F.array(*[F.lit(n) for n in new]))])
    gone, nothing = F.array(bare(text, operator)), F.array(F.lit(""))
    form = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    found = [Rule("COR", binary & (F.col("lhs_type") == "boolean") & (F.col("rhs_type") == "boolean"), F.try_element_at(other, operator))]
    found += [Rule(name, (kind == on) & operator.isin(new) & rules.typed(of), swap(new)) for name, (on, new, of) in rules.SWAPS.items()]
    found += [
        Rule("ROR", binary & operator.isin(rules.SWAPS["ROR"][1]), F.array(F.lit("true"), F.lit("false"))),
        Rule("AODS", unary & operator.isin("++", "--") & ~F.coalesce("in_for_header", F.lit(False)), gone),
        Rule("AODU", unary & operator.isin("+", "-") & numeric & ~target, gone),
        Rule("COD", unary & (operator == "!"), gone),
        Rule("LOD", unary & (operator == "~"), gone),
        Rule("LOI", place, F.array(form("~", text))),
        Rule("AOIS", (kind == "Variable") & numeric & ~target, F.array(form(text, "++"), form("++", text), form(text, "--"), form("--", text))),
        Rule("AOIU", place, F.array(form("-", text))),
        Rule("COI", F.col("lhs_type") == "boolean", F.array(F.when(binary, form("!(", text, ")")).otherwise(form("!", text)))),
        Rule("ODL", unary, gone),
        Rule("ODL", assigned, F.array(rules.swapped(text, operator, F.lit("=")))),
    ]
    for name, of in (("CDL", "Constant"), ("VDL", "Variable"), ("ODL", None)):
        fits = lambda side: either if of is None else F.coalesce(F.col(f"{side}_kind") == of, F.lit(False))  # noqa: E731, B023
        found.append(Rule(name, binary, F.array_compact(F.array(F.when(fits("lhs"), F.col("rhs_text")), F.when(fits("rhs"), F.col("lhs_text"))))))
        if of:
            # what is deleted is all that the operator works on: of an assignment its target stays, of a unary expression nothing
            found += [Rule(name, assigned & fits("rhs"), F.array("lhs_text")), Rule(name, unary & fits("rhs"), nothing)]
    return found + [
        Rule("IPC", (kind == "SuperCall") & (F.col("n_args") >= 1), nothing),
        Rule("JID", (kind == "Field") & ~F.col("is_final") & F.col("initialiser").isNotNull(), nothing),
        Rule("JSI", (kind == "Field") & ~F.col("is_static"), F.array(form("static ", text))),
        Rule("EFD", (kind == "Try") & (F.col("n_catches") > 0) & F.col("has_finally"), nothing),
        Rule("EHD", (kind == "Catch") & ((F.col("n_catches") > 1) | F.col("has_finally")), nothing),
        Rule("ETD", kind == "Throw", nothing),
    ]


def bare(text: Column, operator: Column) -> Column:
    """A unary expression's text without its operator, in front or behind."""
    size = F.length(operator)
    return F.ltrim(F.when(F.startswith(text, operator), F.substr(text, size + 1)).when(F.endswith(text, operator), F.left(text, F.length(text) - size)).otherwise(text))


def named(rule: Rule) -> Column:
    """The rule's array as one of (rule, replacement)."""
    return F.transform(rule.makes, lambda x: F.struct(F.lit(rule.name).alias("rule"), x.alias("replacement")))


def compiled(nodes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(node columns, rule, replacement) of the named rules, or of all; operands (``lhs_kind``, ``lhs_text``, ...) that the nodes don't tell fit no rule."""
    for c in ("lhs_kind", "rhs_kind", "lhs_text", "rhs_text"):
        if c not in nodes.columns:
            nodes = nodes.withColumn(c, F.lit(None).cast("string"))
    made = [F.when(r.when, named(r)) for r in local_rules() if names is None or r.name in names]
    return nodes.select(*nodes.columns, F.inline(F.flatten(F.array_compact(F.array(*made)))))
