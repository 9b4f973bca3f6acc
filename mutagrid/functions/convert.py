"""Conversions, budgets, token usage and nested values as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mutagrid.functions.text import c

#: Spark types for the names of the coercion table; files and strings stay as they are.
COERCIONS = {"string": "string", "int": "int", "integer": "int", "long": "bigint", "float": "float", "double": "double", "boolean": "boolean", "bigdecimal": "decimal(38,18)", "file": "string", "date": "date"}
#: The base budget, and (input, output) ratios by stage, ceiling, kind of error, and for an answer of reasoning only.
INITIAL_BUDGET = {"input_tokens": 10_000, "input_chars": 30_000, "output_tokens": 3_500}
STAGE_RATIOS = {"initial": (1.0, 1.0), "repair1": (1.80, 1.45), "repair2": (2.60, 2.30)}
HARD_RATIOS = (3.00, 3.00)
ERROR_RATIOS = {"CONSTRUCTOR_MISMATCH": (1.20, 1.20), "METHOD_NOT_FOUND": (1.10, 1.10), "ABSTRACT_STUB_INCOMPLETE": (1.20, 1.30), "LONG_JAVAC": (1.25, 1.25)}
REASONING_OUTPUT_RATIO = 2.00
CHARS_PER_TOKEN = 3


def int_or(x, fallback: int = -1) -> Column:
    return F.coalesce(F.trim(c(x)).try_cast("int"), F.lit(fallback))


def thousands_int(x) -> Column:
    return F.trim(F.replace(c(x), F.lit(","), F.lit(""))).cast("int")


def lenient_boolean(x) -> Column:
    """true in any case, else false."""
    return F.coalesce(F.lower(F.trim(c(x))) == "true", F.lit(False))


def strict_boolean(x) -> Column:
    low = F.lower(c(x))
    return F.when(low.isin("true", "false"), low == "true").otherwise(F.raise_error(F.format_string("couldn't convert \"%s\" to a boolean", c(x))))


def coerced(x, kind: str, option: str | None = None) -> Column:
    """The value as a kind of COERCIONS; an error that names the option where it can't be."""
    if kind == "boolean":
        return strict_boolean(x)
    to = COERCIONS[kind]
    if to == "string":
        return c(x)
    value = F.try_to_timestamp(c(x), F.lit("yyyy-MM-dd")).cast("date") if kind == "date" else c(x).try_cast(to)
    bad = F.raise_error(F.format_string(f"\"{option or kind}\": couldn't convert \"%s\" to {kind}", c(x)))
    return F.when(c(x).isNotNull() & value.isNull(), bad).otherwise(value)


def comma_list(x) -> Column:
    """Comma-split with trailing empty items dropped."""
    return F.split(F.regexp_replace(c(x), r",+$", ""), ",")


def non_negative(x) -> Column:
    return c(x).try_cast("int") >= 0


def java_hash(x) -> Column:
    """The 32-bit polynomial hash of a text of the basic plane, as a signed number."""
    codes = F.transform(F.filter(F.split(c(x), ""), lambda ch: ch != ""), lambda ch: F.conv(F.hex(F.encode(ch, "UTF-16BE")), 16, 10).cast("bigint"))
    h = F.aggregate(codes, F.lit(0).cast("bigint"), lambda acc, code: (acc * 31 + code) % (1 << 32))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def bucket256(x) -> Column:
    """A 256-way bucket: the hash folded on itself, its low byte; null is 0."""
    h = java_hash(x)
    return F.when(c(x).isNull(), 0).otherwise(h.bitwiseXOR(F.shiftrightunsigned(h, 16)).bitwiseAND(F.lit(255)))


def worker_count(requested, configured, tasks) -> Column:
    n = F.least(F.coalesce(F.nullif(c(requested), F.lit(0)), c(configured)), c(tasks))
    return F.when(c(configured) <= 0, F.raise_error(F.lit("the worker count must be positive"))).otherwise(n)


def input_chars(chars, tokens, hard_limit) -> Column:
    """The effective limit in characters: given, or three a token, within the hard limit."""
    given = F.when(c(chars) > 0, c(chars)).otherwise(c(tokens) * CHARS_PER_TOKEN)
    return F.when(c(hard_limit) > 0, F.least(given, c(hard_limit))).otherwise(given)


def budget(stage, error_kind, reasoning_only, output: bool) -> Column:
    """The tokens of a call: base x stage x error ratios, within the hard ceiling."""
    side = int(output)
    base = INITIAL_BUDGET["output_tokens" if output else "input_tokens"]
    pick = lambda ratios, key: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for k, r in ratios.items() for v in (k, r[side])]), c(key)), F.lit(1.0))
    ratio = pick(STAGE_RATIOS, stage) * pick(ERROR_RATIOS, error_kind)
    if output:
        ratio = ratio * F.when(c(reasoning_only), REASONING_OUTPUT_RATIO).otherwise(1.0)
    return F.floor(base * F.least(ratio, F.lit(HARD_RATIOS[side])) + F.lit(1e-9)).cast("int")


def policy(x, default: str) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(c(x))), F.lit("")), F.lit(default))


def cut_or_fail(text, limit, how) -> Column:
    """An oversize text is cut, or fails."""
    return F.when(F.length(c(text)) <= c(limit), c(text)).when(c(how) == "truncate", F.left(c(text), c(limit))).otherwise(F.raise_error(F.lit("the prompt is over its limit")))


def encoded_line(record: Column) -> Column:
    return F.base64(F.encode(F.to_json(record), "UTF-8"))


def decoded_line(line, schema) -> Column:
    """The record of an encoded line; a blank line is an error."""
    raw = F.when(F.trim(F.coalesce(c(line), F.lit(""))) == "", F.raise_error(F.lit("a record line must not be blank"))).otherwise(F.decode(F.unbase64(c(line)), "UTF-8"))
    return F.from_json(raw, schema)


def record_map(record: Column) -> Column:
    """A struct as name -> text; null fields are left out."""
    return F.from_json(F.to_json(record), "map<string,string>")


def map_record(pairs: Column, schema) -> Column:
    return F.from_json(F.to_json(pairs), schema)


def layered(*maps: Column) -> Column:
    """Maps over each other: the last that has a key wins."""
    entries = F.concat(*[F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps])
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def usage_normal(usage: Column, local_hit: Column) -> Column:
    """Provider usage (schemas.USAGE) under common names; a locally cached answer costs nothing but keeps its source's total."""
    details = F.coalesce(usage["prompt_tokens_details"], usage["input_tokens_details"])
    prompt = F.coalesce(usage["prompt_tokens"], usage["input_tokens"], F.lit(0))
    done = F.coalesce(usage["completion_tokens"], usage["output_tokens"], F.lit(0))
    read = F.coalesce(usage["prompt_cache_hit_tokens"], details["cached_tokens"], F.lit(0))
    uncached = F.coalesce(usage["prompt_cache_miss_tokens"], F.greatest(prompt - read, F.lit(0)))
    write = F.coalesce(details["cache_write_tokens"], usage["cache_creation_input_tokens"])
    total = F.coalesce(usage["total_tokens"], prompt + done)
    zero = lambda x: F.when(local_hit, F.lit(0)).otherwise(x).cast("bigint")
    return F.struct(
        zero(read).alias("cache_read_input_tokens"),
        zero(uncached).alias("uncached_input_tokens"),
        zero(F.coalesce(write, F.lit(0))).alias("cache_write_input_tokens"),
        write.isNotNull().alias("cache_write_tokens_reported"),
        zero(F.coalesce(usage["completion_tokens_details"]["reasoning_tokens"], F.lit(0))).alias("reasoning_output_tokens"),
        zero(total).alias("total_tokens"),
        F.try_divide(zero(read), F.nullif(zero(read) + zero(uncached), F.lit(0))).alias("cache_hit_rate"),
        (~local_hit).alias("api_request_performed"),
        total.cast("bigint").alias("source_total_tokens"),
    )


def url_map(url) -> Column:
    """The query part of a url as a map."""
    query = F.regexp_extract(c(url), r"\?([^#]*)", 1)
    return F.when(query != "", F.str_to_map(query, F.lit("&"), F.lit("=")))


def json_kind(x) -> Column:
    """number, string, boolean, array or object of a JSON text."""
    first = F.left(F.trim(c(x)), F.lit(1))
    return F.when(first == "[", "array").when(first == "{", "object").when(first == '"', "string").when(F.trim(c(x)).isin("true", "false"), "boolean").when(F.trim(c(x)) == "null", "null").otherwise("number")


def dense_row(cells: Column, width, default: str = "") -> Column:
    """Cells (col, text) of one sparse row as an array of all columns."""
    at = F.map_from_entries(F.transform(cells, lambda x: F.struct(x["col"], x["text"])))
    return F.transform(F.sequence(F.lit(0), c(width) - 1), lambda i: F.coalesce(F.try_element_at(at, i), F.lit(default)))


def csv_line(*columns, sep: str = ",") -> Column:
    return F.to_csv(F.struct(*columns), {"sep": sep})


#: The scalar fields of a serialised table, in order; its cells follow as ``data``.
TABLE_FIELDS = ["extraction_method", "page_number", "top", "left", "width", "height", "right", "bottom"]


def table_record(data: Column) -> Column:
    """A table's fields (columns of these names) and its rows of cells."""
    return F.struct(*[F.col(f) for f in TABLE_FIELDS], data.alias("data"))


def table_json(data: Column) -> Column:
    return F.to_json(table_record(data))


def tables_json(tables) -> Column:
    """One document's tables (an array of table records) as a JSON list; no tables are an empty list."""
    return F.when(F.coalesce(F.size(c(tables)), F.lit(0)) <= 0, "[]").otherwise(F.to_json(c(tables)))


def appended(commented: Column, item) -> Column:
    """A commented list with one more item; a list that is null begins with it."""
    items = F.coalesce(commented["items"], F.array().cast("array<string>"))
    return F.struct(commented["comment"].alias("comment"), F.array_append(items, c(item)).alias("items"))
