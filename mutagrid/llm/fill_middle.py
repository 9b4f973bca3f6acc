"""Fill-in-middle by relational units: a text is a table of units, and a cut is a request for one of them.

A text is matched left to right by the unit's pattern (a code point, a word, a line);
a character that the pattern doesn't match is a unit of its own, and the pattern sees nothing but its match, so the units tile
the text. A cut request asks where the k-th unit ends. Units are exploded twice,
so that a text of n units costs some n / ``RUN`` + 2 ``RUN`` rows rather than n:

1. runs of ``RUN`` units are matched and exploded with their ordinals, a window sums
   their lengths, and the requests are joined with the run that holds their ordinal;
2. only these runs are exploded unit by unit, and the same window and ordinal give
   each request's offset. Offsets are aggregated per document, and substrings taken.

A text is known by its id and hash. Of the runs only the lengths are shuffled, and the two
that hold a cut, with their requests; where rows are repeated whole, they are combined
before that. The texts are shuffled once, to meet their offsets.

Defined results: a null text is an empty one, and plain; so is a text that holds a marker, and the
share of texts that the hash leaves as they are. A null id hashes as an empty one. Repeated
rows give the same result each. Very long texts are cut whole. Columns but the id and the text
are dropped, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutagrid.llm.common import table

#: Units of one run.
RUN = 128
#: What tells texts apart: their id, or a hash where that is null, and a hash of id and text.
KEY = ["id", "hash"]


@dataclass(frozen=True)
class FillMiddle:
    """The unit's pattern, the markers, and the percentages of texts that are cut and, of these, that have their suffix first."""

    unit: str = "."
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    cut: int = 90
    suffix_first: int = 20
    seed: int = 1

    def __post_init__(self):
        if re.search(f"(?s)^(?:{self.unit})$", ""):
            raise ValueError("a unit can't be empty")

    @property
    def one(self) -> str:
        """The pattern of a unit, or else of the one character that none matches."""
        return f"(?s)(?>(?:{self.unit})|.)"

    @property
    def run(self) -> str:
        """The pattern of ``RUN`` units, or of those that are left."""
        return f"(?s)(?>(?:{self.unit})|.){{1,{RUN}}}+"


def hashes(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def measured(docs: DataFrame, rule: FillMiddle, id_column: str, text_column: str) -> DataFrame:
    """(id, hash, doc_id, text, n, form, low, high): each row's number of units, its form, and the units that end its prefix and its middle."""
    h1, h2, h3, h4 = hashes(F.col("doc_id"), rule.seed)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("runs", matches(F.col("text"), rule.run))
    # every run but the last is full
    units = F.when(F.col("text") == "", 0).otherwise((F.size("runs") - 1) * RUN + F.size(matches(F.element_at("runs", -1), rule.one))).cast("long")
    plain = (F.col("text") == "") | (h3 % 100 >= rule.cut)
    for marker in (rule.prefix, rule.suffix, rule.middle):
        plain = plain | F.contains("text", F.lit(marker))
    form = F.when(plain, "plain").when(h4 % 100 < rule.suffix_first, "spm").otherwise("psm")
    key = [F.coalesce("doc_id", F.xxhash64(F.lit("id"), F.col("text"))).alias("id"), F.xxhash64("doc_id", "text").alias("hash")]
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    return rows.withColumn("n", units).select(*key, "doc_id", "text", "n", form.alias("form"), F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def offsets(rows: DataFrame, rule: FillMiddle) -> DataFrame:
    """(id, hash, low_at, high_at): where the units end that are asked for, in code points; null where no unit comes before the cut."""
    cut = rows.filter("form <> 'plain'").withColumn("runs", matches(F.col("text"), rule.run))
    of_run = F.floor((F.col("ordinal") - 1) / RUN).cast("int")
    wanted = cut.select(*KEY, "runs", F.posexplode(F.array("low", "high")).alias("which", "ordinal")).filter("ordinal > 0")
    wanted = wanted.select(*KEY, "which", "ordinal", F.get("runs", of_run).alias("part"))
    runs = cut.select(*KEY, F.posexplode("runs").alias("run", "piece")).select(*KEY, "run", F.length("piece").alias("chars"))
    if not rows.groupBy(*KEY).count().filter("count > 1").isEmpty():
        runs, wanted = runs.distinct(), wanted.distinct()
    before = Window.partitionBy(*KEY).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("at", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    first = F.col("run").cast("long") * RUN
    held = runs.join(wanted, KEY).filter((F.col("ordinal") > first) & (F.col("ordinal") <= first + RUN))
    units = held.select(*KEY, "which", "at", (F.col("ordinal") - first).alias("ordinal"), F.posexplode(matches(F.col("part"), rule.one)).alias("unit", "piece"))
    upto = Window.partitionBy(*KEY, "which").orderBy("unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = units.withColumn("end", F.col("at") + F.sum(F.length("piece")).over(upto)).filter(F.col("unit") + 1 == F.col("ordinal"))
    return ends.groupBy(*KEY).agg(*[F.max(F.when(F.col("which") == i, F.col("end"))).alias(name) for i, name in enumerate(("low_at", "high_at"))])


def arranged(text: Column, form: Column, low: Column, high: Column, rule: FillMiddle) -> Column:
    """The output of a text that is cut at two offsets."""
    prefix, middle, suffix = F.substr(text, F.lit(1), low), F.substr(text, low + 1, high - low), F.substr(text, high + 1)
    p, s, m = (F.lit(x) for x in (rule.prefix, rule.suffix, rule.middle))
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(output: Column, form: Column, rule: FillMiddle) -> Column:
    """The text that an output was made of: each marker is in it once."""
    p, s, m = rule.prefix, rule.suffix, rule.middle
    body, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(body, s, 1), p, -1), middle, F.substring_index(body, s, -1))
    spm = F.concat(F.substring_index(body, p, -1), middle, F.substring_index(F.substring_index(body, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_middle(docs: DataFrame, rule: FillMiddle = FillMiddle(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored) of every row: numbers of units, lengths in code points (null if plain), texts."""
    rows = measured(docs, rule, id_column, text_column)
    cut = rows.filter("form <> 'plain'").drop("low", "high").join(offsets(rows, rule), KEY, "left")
    plain = rows.filter("form = 'plain'").drop("low", "high").withColumns({"low_at": F.lit(None).cast("long"), "high_at": F.lit(None).cast("long")})
    low, high, form = F.coalesce("low_at", F.lit(0)).cast("int"), F.coalesce("high_at", F.lit(0)).cast("int"), F.col("form")
    out = cut.unionByName(plain).withColumn("output", arranged(F.col("text"), form, low, high, rule))
    chars = lambda x: F.when(form != "plain", x.cast("long"))
    return out.select("doc_id", "n", "form", chars(low).alias("prefix_chars"), chars(high - low).alias("middle_chars"), "output", restored(F.col("output"), form, rule).alias("restored"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b, ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM h),
f AS (SELECT doc_id, t, n, least(a, b) AS lo, greatest(a, b) AS hi, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t
  WHEN 'psm' THEN '<P>' || substring(t, 1, lo) || '<S>' || substring(t, hi + 1) || '<M>' || substring(t, lo + 1, hi - lo) ELSE '<S>' || substring(t, hi + 1) || '<P>' || substring(t, 1, lo) || '<M>' || substring(t, lo + 1, hi - lo) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM f"""
