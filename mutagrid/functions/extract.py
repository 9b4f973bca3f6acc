"""Extraction that no regular expression can do: test methods by balanced braces, aware of strings and comments."""

from __future__ import annotations

import re

from pyspark.sql.functions import udtf

MARK = re.compile(r"@Test\b")


def end_of_block(source: str, start: int) -> int | None:
    """Where the block that opens after start ends; None if its braces don't balance."""
    depth, at, n = 0, start, len(source)
    while at < n:
        ch = source[at]
        if source.startswith("//", at):
            at = n if (end := source.find("\n", at)) < 0 else end
        elif source.startswith("/*", at):
            at = n if (end := source.find("*/", at + 2)) < 0 else end + 1
        elif ch in "\"'":
            at += 1
            while at < n and source[at] != ch:
                at += 2 if source[at] == "\\" else 1
        elif ch == "{":
            depth += 1
        elif ch == "}":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return None


def test_methods(source: str | None) -> list[tuple[int, int, str | None]]:
    """(start, end, text) of every test method; one that doesn't balance has no text and ends the search."""
    out: list[tuple[int, int, str | None]] = []
    at = 0
    while found := MARK.search(source or "", at):
        end = end_of_block(source, found.end())
        if end is None:
            out.append((found.start(), len(source), None))
            break
        out.append((found.start(), end, source[found.start() : end]))
        at = end
    return out


@udtf(returnType="no int, start int, end int, method string, valid boolean")
class TestMethods:
    """A table function: a row for each test method of a source; valid is false where braces don't balance."""

    def eval(self, source: str):
        for no, (start, end, method) in enumerate(test_methods(source)):
            yield no, start, end, method, method is not None


def register(spark) -> None:
    spark.udtf.register("test_methods", TestMethods)
