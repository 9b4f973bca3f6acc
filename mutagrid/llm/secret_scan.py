"""Secret scans: an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger
remembers which (blob, rule, rule version) were scanned and what was found;
``scan_versions`` scans only the unseen pairs, appends them to the ledger and
joins the findings back to all paths that ever held the blob.

No text is shuffled. What is unseen is decided on blob ids and paths alone; one path of
each unseen blob is marked, rule by rule, in bitmaps of bounded size, and the text
is scanned where it is read, if its bit is set. A bit may be set by another blob, the more
often the fuller the bitmaps are: then a text is scanned again, and its findings,
which are the same, count once.

Spans are code points, the end exclusive. A regular expression has no position
function in Spark SQL; the pieces between the matches (``split``) and the
matches (``regexp_extract_all``) come from the same left-to-right search, so a
running sum of their lengths, by doubling runs, gives every start. All of it is DataFrame code.

Defined results: a null text is an empty text; a null path is a path of its own and keeps
its rows. Very long texts are scanned whole. Spans that tie in their start are ordered by
rule, as listed. Repeated rows are reported once each; an empty table has no findings. Extra
columns are dropped by ``scan_versions`` and kept by ``stage``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mutagrid.llm.common import Bitmaps, Workspace, table, unused


@dataclass(frozen=True)
class SecretRule:
    """``group`` of a match must hold ``least`` characters, else the match is dropped; ``hint`` is a cheap literal test."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The patterns of the rules, the three base ones first.
RULES = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    SecretRule("hex", r"[0-9a-f]{24,}", 0, 24),
    SecretRule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]+-----END [A-Z ]{0,20}PRIVATE KEY-----", 0, 1, "PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 32, "eyJ"),
)
BASE = ("assign", "access", "hex")
#: Code points of a block of a text that is cut, and passes of a running total: 4 to their power elements.
BLOCK, PASSES = 1024, 14
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def occurs(text: Column, rule: SecretRule) -> Column:
    found = text.rlike(rule.pattern)
    return text.contains(rule.hint) & found if rule.hint else found


def lengths(text: Column, rule: SecretRule) -> Column:
    """Array of (length before the match, length of the match, whether it holds), match by match."""
    pattern = F.lit(rule.pattern)
    return F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(rule.group)),
        F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"))),
        lambda part, x: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), (F.length(part) >= rule.least).alias("holds")),
    )


def findings_of(texts: DataFrame, rules: tuple[SecretRule, ...]) -> DataFrame:
    """(blob_id, kind, key, start, end) of (blob_id, text, wanted): wanted has a boolean for each rule."""
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    hits = [F.struct(F.lit(r.name).alias("kind"), F.lit(r.key).alias("key"), F.when(F.get("wanted", F.lit(i)) & occurs(F.col("text"), r), spans_of(F.col("text"), r)).otherwise(nothing).alias("spans")) for i, r in enumerate(rules)]
    rows = texts.select("blob_id", F.filter(F.array(*hits), lambda x: F.size(x["spans"]) > 0).alias("hits")).filter(F.size("hits") > 0)
    rows = rows.select("blob_id", F.inline("hits")).select("blob_id", "kind", "key", F.inline("spans"))
    return rows.select("blob_id", "kind", "key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def content(text: Column) -> Column:
    """The address of a text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_versions(spark: SparkSession, versions: DataFrame, path: str = "doc_id", ledger: str | None = None, rules: tuple[SecretRule, ...] = RULES, work: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths with blob_id, findings of every known blob). ``ledger`` is a folder that grows from call to call; a fresh one if None."""
    work = work or Workspace(spark, "secrets")
    ledger = ledger or f"{work.root}/ledger"
    keys = F.array(*[F.lit(r.key) for r in rules])
    paths = work.put("paths", versions.select(F.col(path).alias("path"), content(F.col("text")).alias("blob_id")))
    unseen = paths.groupBy("blob_id").agg(F.min("path").alias("path"))
    seen = read_ledger(spark, f"{ledger}/scanned", "blob_id binary, key string")
    if seen is None:
        unseen = unseen.withColumn("todo", keys)
    else:
        done = seen.groupBy("blob_id").agg(F.collect_set("key").alias("done"))
        unseen = unseen.join(done, "blob_id", "left").withColumn("todo", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))).filter(F.size("todo") > 0).drop("done")
    unseen = work.put("unseen", unseen)
    mark = F.xxhash64("blob_id", "path")
    marks = Bitmaps(unseen, mark, [F.array_contains("todo", r.key) for r in rules]).put(work, "marks")
    texts = versions.select(F.col(path).alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"), content(F.col("text")).alias("blob_id"))
    wanted = marks.flagged(texts, mark, "wanted").filter(F.exists("wanted", lambda x: x))
    findings_of(wanted, rules).write.mode("append").parquet(f"{ledger}/findings")
    unseen.select("blob_id", F.explode("todo").alias("key")).write.mode("append").parquet(f"{ledger}/scanned")
    found = spark.read.schema("blob_id binary, kind string, key string, start long, end long").parquet(f"{ledger}/findings")
    # a text that was scanned twice, or by a run that died between the two appends, has its findings once
    return paths, found.filter(F.col("key").isin([r.key for r in rules])).distinct()


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(schema).parquet(path)


def digests(findings: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """Per blob with findings: counts by base kind, the base spans' SHA-256 and all spans as text."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    spans = F.array_sort(F.collect_list(F.struct(F.col("start"), F.element_at(order, F.col("kind")).alias("kind_no"), F.col("end"), F.col("kind"))))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE]
    return (
        findings.groupBy("blob_id")
        .agg(*counts, spans.alias("all"))
        .select("blob_id", *[f"n_{k}" for k in BASE], F.sha2(said(F.filter("all", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), said(F.col("all")).alias("spans"))
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, findings = scan_versions(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = paths.join(digests(findings), "blob_id", "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE]
    return joined.select(F.col("path").alias("doc_id"), *counts, F.coalesce("base_sha256", F.lit(EMPTY_SHA)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is read."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(xs: Column, join) -> Column:
    """What ``join`` makes of an array's elements up to each one: every pass joins four runs of the last pass's length."""

    def behind(so_far: Column, i: Column, x: Column, width: int) -> Column:
        for k in (1, 2, 3):
            x = F.when(i >= k * width, join(x, F.get(so_far, i - k * width))).otherwise(x)
        return x

    def passed(width: int):
        return lambda s: F.when(F.size(s) > width, F.transform(s, lambda x, i: behind(s, i, x, width))).otherwise(s)

    for k in range(PASSES):
        xs = let(xs, passed(4**k))
    return xs


def spans_of(text: Column, rule: SecretRule) -> Column:
    """Array of (start, end) of the holding matches of one rule."""

    def placed(matches: Column) -> Column:
        ends = running(F.transform(matches, lambda x: x["gap"] + x["n"]), lambda a, b: a + b)
        return F.zip_with(matches, ends, lambda x, end: F.struct(F.when(x["holds"], end - x["n"]).alias("start"), end.alias("end")))

    # the text behind the last match has no match of its own
    return F.filter(let(F.filter(lengths(text, rule), lambda x: x["n"].isNotNull()), placed), lambda x: x["start"].isNotNull())


def cut(text: Column, spans: Column, mark: str) -> Column:
    """The text with the union of the spans (start, end) replaced: ``mark`` stands for each run of spans that overlap.

    A position in a text is found by counting from its start, so pieces are taken from its blocks.
    """

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        last = F.floor((end - 1) / BLOCK).cast("int")
        whole = lambda i: F.substr(F.get(blocks, i), F.greatest(start - i * BLOCK, F.lit(0)) + 1, F.least(end - i * BLOCK, F.lit(BLOCK)) - F.greatest(start - i * BLOCK, F.lit(0)))
        return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), whole), "")).otherwise("")

    def joined(blocks: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))))
        return let(ordered, lambda xs: let(running(F.transform(xs, lambda x: x["end"]), F.greatest), lambda ends: between(blocks, xs, ends)))

    def between(blocks: Column, xs: Column, ends: Column) -> Column:
        before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        # a span that begins within what is cut prolongs the cut
        opened = F.transform(xs, lambda x, i: F.when(x["start"] >= before(i), F.concat(piece(blocks, before(i), x["start"]), F.lit(mark))))
        return F.concat(F.array_join(opened, ""), piece(blocks, before(F.size(ends)), F.length(text)))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), joined)


def redact(text: Column, rules: tuple[SecretRule, ...] = RULES, mark: str = "[SECRET]") -> Column:
    """The text without the spans of any rule; every rule sees the text as it was."""
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    return cut(text, F.flatten(F.array(*[F.when(occurs(text, r), spans_of(text, r)).otherwise(nothing) for r in rules])), mark)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; what the ledger found in its blob is replaced by a mark. Only texts with findings are shuffled."""
    work = Workspace(spark, "secrets")
    _, findings = scan_versions(spark, docs, work=work)
    flagged = work.put("flagged", findings.groupBy("blob_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    blob, maybe, there, spans = unused(docs.columns, "_blob", "_maybe", "_there", "_spans")
    marks = Bitmaps(flagged, F.xxhash64("blob_id"), [F.lit(True)]).put(work, "flags")
    rows = marks.flagged(docs.withColumn(blob, content(F.col("text"))), F.xxhash64(blob), maybe)
    hit = rows.filter(F.get(maybe, F.lit(0))).join(flagged.select(F.col("blob_id").alias(there), F.col("spans").alias(spans)), F.col(blob) == F.col(there), "left")
    out = hit.withColumn("text", F.when(F.col(spans).isNotNull(), cut(F.col("text"), F.col(spans), "[SECRET]")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.filter(~F.get(maybe, F.lit(0))).select(*docs.columns).unionByName(out.select(*docs.columns))


#: Another version of every document, for the query that fills its ledger twice.
REWRITTEN = ("token", "secret")


def secret_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every document in one ledger: the first scanned by the base rules, then both by all rules, the last rule in a second version.

    ``n_pairs`` is how many (blob, rule version) pairs of a document's blob the ledger holds in the end.
    """
    work = Workspace(spark, "versions")
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), f"{work.root}/ledger"
    first = docs.select((F.col("doc_id") * 2).alias("doc_id"), "text")
    both = first.union(docs.select(F.col("doc_id") * 2 + 1, F.replace("text", F.lit(REWRITTEN[0]), F.lit(REWRITTEN[1]))))
    scan_versions(spark, first, ledger=ledger, rules=RULES[:3])
    later = (*RULES[:-1], replace(RULES[-1], version=2))
    paths, findings = scan_versions(spark, both, ledger=ledger, rules=later)
    held = read_ledger(spark, f"{ledger}/scanned", "blob_id binary, key string").groupBy("blob_id").agg(F.count("*").alias("n_pairs"))
    joined = paths.join(digests(findings, later), "blob_id", "left").join(held, "blob_id", "left")
    return joined.select(F.col("path").alias("doc_id"), "n_pairs", F.coalesce("spans", F.lit("")).alias("spans"))


def sql(docs: str, columns: str) -> str:
    """DuckDB: the same spans from the pieces between matches and the matches, of ``docs`` (doc_id, t)."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS kind_no, '{r.name}' AS kind, k, sum(gap + n) OVER (PARTITION BY doc_id ORDER BY k) AS e, n, holds FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS k, "
            f"unnest(list_transform(m, lambda x: length(x))) AS n, unnest(list_transform(s[1:len(m)], lambda x: length(x))) AS gap, unnest(list_transform(g, lambda x: length(x) >= {r.least})) AS holds "
            f"FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS g, regexp_split_to_array(t, '{p}') AS s FROM d))"
        )
    said = "coalesce(string_agg({0}, ',' ORDER BY e - n, kind_no), '')"
    one = "kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    base = said.format(one).replace(" ORDER BY e - n, kind_no)", " ORDER BY e - n, kind_no) FILTER (kind_no < 3)")
    chosen = columns.format(counts=counts, base=base, spans=said.format(one))
    return f"WITH d AS ({docs}), f AS ({' UNION ALL '.join(parts)}), h AS (SELECT * FROM f WHERE holds) SELECT d.doc_id, {chosen} FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id"


SQL = sql("SELECT doc_id, coalesce(text, '') AS t FROM documents", "{counts}, sha256({base}) AS base_sha256, {spans} AS spans")
#: Of the first version the ledger has the three base rules and then the others; of texts that were there from the start no more.
VERSIONS_SQL = sql(
    f"SELECT doc_id * 2 AS doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT doc_id * 2 + 1, replace(coalesce(text, ''), '{REWRITTEN[0]}', '{REWRITTEN[1]}') FROM documents", f"{len(RULES)}::BIGINT AS n_pairs, {{spans}} AS spans"
)
