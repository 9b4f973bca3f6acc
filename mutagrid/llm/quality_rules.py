"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every rule is a row of ``RULES``: a name, a metric over the base counts, an
inclusive range, and the languages it holds for (all, where none are given).
``judge`` computes each base count once, compiles the table into one boolean
column per rule and combines them.

Defined results: a null text is an empty text, and fails; a null or unknown language skips the
rules that are bound to languages. A very long text is judged whole; one of more words than
``words_most`` allows (a million) fails by that rule. Ranges are inclusive, so ties with a threshold
pass. Repeated rows are judged alike; an empty table has no verdicts. Extra columns pass through
``judge`` untouched unless they clash, in whatever case, with a column that it
makes, which then is replaced; ``stage`` keeps them all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mutagrid.llm.common import WORD_GAP, table, unused

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages that the stop-word rules hold for.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "with", "as", "was", "by", "it"],
    "fr": ["le", "la", "de", "et", "les", "des", "un", "une", "que", "pour", "dans", "en", "est", "sur"],
    "de": ["der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "ein", "eine", "für", "auf", "sich"],
    "es": ["el", "la", "los", "las", "de", "y", "en", "que", "del", "se", "no", "por", "con", "una"],
}


@dataclass(frozen=True)
class Rule:
    name: str
    metric: str  # a SQL expression over the base counts
    least: float | None = None
    most: float | None = None
    langs: tuple[str, ...] = ()


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "n_repeat_words")
NAMES = re.compile(r"\b(" + "|".join(COUNTS) + r")\b")
LANGS = tuple(STOP_WORDS)
RULES = (
    Rule("words_most", "n_words", most=1_000_000),
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols / nullif(n_words, 0)", most=0.1),
    Rule("stop_words", "n_stop_words", least=2, langs=LANGS),
    Rule("stop_word_share", "n_stop_words / nullif(n_words, 0)", least=0.03, langs=LANGS),
    Rule("dup_line_share", "n_dup_lines / nullif(n_lines, 0)", most=0.5),
    Rule("bullet_line_share", "n_bullet_lines / nullif(n_lines, 0)", most=0.9),
    Rule("ellipsis_line_share", "n_ellipsis_lines / nullif(n_lines, 0)", most=0.3),
)


def passes(rule: Rule, of: str = "") -> str:
    """The rule as a SQL predicate that is never null; ``of`` stands before the names of counts."""
    value = f"({NAMES.sub(lambda m: of + m[0], rule.metric)})"
    tests = [f"{value} >= {rule.least}"] if rule.least is not None else []
    tests += [f"{value} <= {rule.most}"] if rule.most is not None else []
    test = f"coalesce({' AND '.join(tests)}, true)"
    if rule.langs:
        test = f"(coalesce({of}lang, '') NOT IN ({', '.join(repr(x) for x in rule.langs)}) OR {test})"
    return test


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more.

    Windows are sorted with their positions, so that equal ones are neighbours;
    the positions of the repeated ones are sorted again and each covers three
    words less its overlap with the next.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.struct(F.concat_ws(" ", F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("w"), i.alias("i")),
    )
    repeats = lambda s: F.filter(s, lambda x, k: (x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]))
    spots = lambda s: F.array_sort(F.transform(repeats(s), lambda x: x["i"]))
    gaps = lambda p: F.zip_with(F.slice(p, 2, F.size(p)), p, lambda later, i: F.coalesce(F.least(later - i, F.lit(3)), F.lit(3)))
    cover = lambda p: F.aggregate(gaps(p), F.lit(0), lambda acc, g: acc + g)
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.sort_array(windows), lambda s: let(spots(s), cover)))


def base_counts(text: Column, lang: Column) -> Column:
    """A struct of the contract's base counts and of those that the rules need besides.

    Words and lines are split once and bound as lambda variables, so that no
    optimiser rule can put the splitting inside a loop over the words.
    """
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    stop = sorted({w for words_ in STOP_WORDS.values() for w in words_})

    def counts(s: Column) -> Column:
        w, ln = s["words"], s["lines"]
        found = {
            "n_words": F.size(w),
            "word_chars": F.length(F.concat_ws("", w)),
            "n_symbols": F.length(F.regexp_replace(s["text"], r"[^#*$%&|<>]+", "")),
            "n_lines": F.size(ln),
            "n_dup_lines": F.size(ln) - F.size(F.array_distinct(ln)),
            "n_bullet_lines": F.size(F.filter(ln, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))),
            "n_ellipsis_lines": F.size(F.filter(ln, lambda x: F.endswith(F.rtrim(x), F.lit("...")) | F.endswith(F.rtrim(x), F.lit("…")))),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*stop))),
            "n_repeat_words": repeated_words(w),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in found.items()], s["lang"].alias("lang"))

    return let(F.struct(words.alias("words"), lines.alias("lines"), text.alias("text"), lang.alias("lang")), counts)


def judged(docs: DataFrame, counts: str, verdict: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with two structs of the given names: the counts, and base_failed, failed_rules (names) and kept."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    failed = ", ".join(f"CASE WHEN NOT {passes(r, 'c.')} THEN '{r.name}' END" for r in rules)
    base = "c.n_words < 50 OR 100 * c.n_repeat_words > 50 * c.n_words"
    said = f"transform(array({counts}), c -> named_struct('base_failed', {base}, 'failed_rules', array_compact(array({failed})), 'kept', NOT ({base}) AND {' AND '.join(passes(r, 'c.') for r in rules)}))[0]"
    return docs.withColumn(counts, base_counts(F.col("text"), lang)).withColumn(verdict, F.expr(said))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with their counts, base_failed, failed_rules (names) and kept."""
    kept = [c for c in docs.columns if c.lower() not in {*COUNTS, "base_failed", "failed_rules", "kept"}]
    counts, verdict = unused(docs.columns, "_counts", "_verdict")
    rows = judged(docs, counts, verdict, rules)
    return rows.select(*kept, *[F.col(f"{counts}.{c}").alias(c) for c in COUNTS], *[F.col(f"{verdict}.{c}").alias(c) for c in ("base_failed", "failed_rules", "kept")])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, with all their columns as they were."""
    counts, verdict = unused(docs.columns, "_counts", "_verdict")
    return judged(docs, counts, verdict).filter(F.col(f"{verdict}.kept")).select(*docs.columns)


def sql_counts(source: str) -> str:
    """Common table expressions ``q4w`` (counts) and ``q4`` (verdicts) over ``source`` for DuckDB."""
    gap, stop = r"[\x20\x09-\x0D]+", ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    kept = " AND ".join(passes(r) for r in RULES)
    return rf"""q4d AS (SELECT *, coalesce(text, '') AS q4t FROM {source}),
q4s AS (SELECT *, list_filter(regexp_split_to_array(q4t, '{gap}'), lambda x: x <> '') AS w,
  list_filter(string_split(q4t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM q4d),
q4win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM q4s)),
q4rep AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM q4win) WHERE c > 1),
q4r AS (SELECT doc_id, count(DISTINCT pos) AS n FROM q4rep GROUP BY doc_id),
q4w AS (SELECT s.* EXCLUDE (w, ln, q4t), len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(q4t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ln)::BIGINT AS n_lines, (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines,
  len(list_filter(ln, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•')))::BIGINT AS n_bullet_lines,
  len(list_filter(ln, lambda x: ends_with(rtrim(x, ' '), '...') OR ends_with(rtrim(x, ' '), '…')))::BIGINT AS n_ellipsis_lines,
  len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM q4s s LEFT JOIN q4r r USING (doc_id)),
q4b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q4w),
q4 AS (SELECT *, NOT base_failed AND {kept} AS kept FROM q4b)"""


SQL = f"WITH {sql_counts('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q4"
