"""Syntax trees as text and as numbered nodes, against a recursive reading."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mutagrid.schemas import AST_NODES
from mutagrid.sources import trees

LABELS = ["", "x", "it's", 'say "hi"', "a\\b\\n", "two\nlines\r", "é 日本", "{[]}", "label='y' [pos=1 len=2]", "7"]
KINDS = ["Block", "ExpressionStatement", "IfStatement", "SimpleName", "CompilationUnit"]


def grown(rng, depth=0):
    own = {"type": rng.choice(KINDS), "label": rng.choice(LABELS), "pos": str(rng.randrange(90)), "length": str(rng.randrange(9)), "line": "1", "lineEnd": "2"}
    return own | {"children": [grown(rng, depth + 1) for _ in range(rng.choice([0, 1, 2, 3]) if depth < 7 else 0)]}


def walked(file, root):
    out, post = [], [0]

    def walk(node, parent, depth):
        me = len(out)
        out.append(None)
        for child in node["children"]:
            walk(child, me, depth + 1)
        out[me] = (file, me, parent, len(out) - 1, post[0], depth, node["type"], node["label"], int(node["pos"]), int(node["length"]), 1, 2)
        post[0] += 1

    walk(root, None, 0)
    return out


@pytest.fixture(scope="module")
def forest():
    rng = random.Random(11)
    return {f"f{i}": grown(rng) for i in range(25)}


@pytest.mark.parametrize("most", [8, None])
def test_both_forms_round_trip(spark, forest, most):
    want = sorted((r for f, root in forest.items() for r in walked(f, root)), key=repr)
    assert len(want) > 200
    texts = spark.createDataFrame([(f, json.dumps({"root": root}, ensure_ascii=False)) for f, root in forest.items()] + [("none", None), ("empty", ""), ("no", "{}")], "file string, text string").repartition(4)
    tree = trees.from_json(texts, most)
    assert sorted(map(tuple, tree.collect()), key=repr) == want
    lines = trees.to_indented(tree)
    assert "label='it\\'s'" in "".join(r.text for r in lines.collect())
    again = trees.from_indented(lines.unionAll(spark.createDataFrame([("none", None), ("empty", " \n")], "file string, text string")), most)
    assert sorted(map(tuple, again.collect()), key=repr) == want
    assert {r.file: json.loads(r.text)["root"] for r in trees.to_json(again).collect()} == forest


def test_a_line_that_is_no_node_is_an_error(spark):
    good = "Block label='' [pos=0 len=9] [lines=1..2]"
    for bad in ("  nothing", "   Odd label='' [pos=0 len=9] [lines=1..2]", "    Deep label='' [pos=0 len=9] [lines=1..2]"):
        with pytest.raises(Exception, match="f1 line 2"):
            trees.from_indented(spark.createDataFrame([("f1", good + "\n" + bad)], "file string, text string")).collect()


@pytest.mark.parametrize("most", [8, None])
def test_statements_are_deleted_with_all_below(spark, forest, most):
    tree = spark.createDataFrame([r for f, root in forest.items() for r in walked(f, root)], trees.TREE)
    picked = trees.statements(tree)
    want, code = {}, "".join(chr(97 + i % 26) for i in range(100))
    for f, root in forest.items():
        rows = walked(f, root)
        for r in rows:
            if r[6].endswith("Statement") and r[2] is not None and rows[r[2]][6] == "Block":
                want[f"{f}#SDL_{r[1]}"] = [(x[5], x[6], x[7]) for x in rows if not r[1] <= x[1] <= r[3]]
    left = {}
    for r in trees.without_statement(tree, picked, most).orderBy("node_id").collect():
        left.setdefault(r.file, []).append((r.depth, r.kind, r.label))
    assert left == want and len(want) > 10
    sources = spark.createDataFrame([(f, code) for f in forest], "file string, text string")
    held = {(r.file, r.mutant): (r.pos, r.len) for r in picked.collect()}
    assert all(r.text == code[: held[r.file, r.mutant][0]] + code[sum(held[r.file, r.mutant]) :] for r in trees.cut_source(sources, picked).collect())
    nodes = trees.ast_nodes(tree, AST_NODES)
    assert nodes.filter(F.col("parent_id").isNull()).count() == len(forest) and [f"{n} {t}" for n, t in nodes.dtypes] == AST_NODES.split(", ")
