import gzip
import hashlib
import json
import pickle
import zipfile

from pyspark.sql import functions as F

from mutagrid import schemas
from mutagrid.operators import ordering
from mutagrid.sources import readers, sinks
from mutagrid.streaming import published, streams

SHEET = '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def test_manifest_round_trip(spark, tmp_path):
    lines = [{"operator": "COR", "line": 3, "class_f": "java.a.B", "project": "p", "method_signature": "void_m()"}, {"operator": "SOR", "line": 4, "class_f": "a.C", "project": "p", "method_signature": "void_n()"}]
    with gzip.open(tmp_path / "m.jsonl.gz", "wt") as out:
        out.write("\n   \n".join(json.dumps(x) for x in lines) + "\n\n")
    got = readers.manifest(spark, str(tmp_path / "m.jsonl.gz"))
    assert sorted(r.class_name for r in got.collect()) == ["a.B", "a.C"]
    one = sinks.manifest(got, str(tmp_path / "out"), schemas.GROUP_KEY).first()
    assert (one.mutant_rows, one.methods) == (2, 2) and len(one.content_sha256) == 64
    assert readers.manifest(spark, str(tmp_path / "out")).count() == 2


def test_text_sources(spark, tmp_path):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src" / "a" / "T.java").write_text("class T {}\n")
    (tmp_path / "src" / "a" / "T.txt").write_text("x")
    assert [r.name for r in readers.whole_files(spark, str(tmp_path / "src"), "*.java").collect()] == ["T.java"]
    (tmp_path / "p.properties").write_text("# c\na = 1\n\nb=x=y\na=2\n")
    assert readers.properties(spark, str(tmp_path / "p.properties")).first().properties == {"a": "2", "b": "x=y"}
    (tmp_path / "log").write_text("C : 7 : m() : T : C : a && b => a || b\n")
    one = readers.mutation_log(spark, str(tmp_path / "log")).first()
    assert (one.line, one.before, one.after) == (7, "a && b", "a || b")
    (tmp_path / "run" / "targets" / "t1").mkdir(parents=True)
    (tmp_path / "run" / "targets" / "t1" / "state.json").write_text('{"state": "DONE"}')
    assert [(r.target, r.state) for r in readers.target_files(spark, str(tmp_path / "run"), "state string").collect()] == [("t1", "DONE")]


def test_report_scrape(spark):
    html = '<table class="coverage"><tfoot><tr><td>Total</td><td>10 of 1,234</td><td>99%</td><td>3 of 40</td><td>92%</td><td>5</td><td>20</td><td>1,007</td><td>2,000</td></tr></tfoot></table>'
    one = spark.createDataFrame([(html,)], "h string").select(readers.coverage_counts(F.col("h")).alias("x")).first().x
    assert tuple(one) == (3, 40, 1007, 2000)


def test_sheet_keeps_columns_by_address(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>head</t></si><si><t>val</t></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", SHEET.format('<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="b"><v>1</v></c><c r="E2"><f>A2*2</f><v>3</v></c></row>'))
    spark.dataSource.register(readers.SheetSource)
    got = spark.read.format("sheet").schema("a string, b string, c string, d string, e string").option("header", 1).load(str(tmp_path / "b.xlsx")).collect()
    assert [tuple(r) for r in got] == [("1.5", None, "val", "true", "A2*2")]


def test_pickles_and_records(spark, tmp_path):
    (tmp_path / "x.pkl").write_bytes(pickle.dumps({"a": {"id": 1}, "b": {"id": 2}}))
    assert sorted(r.id for r in readers.pickles(spark, str(tmp_path / "x.pkl"), "id long").collect()) == [1, 2]
    (tmp_path / "x.rec").write_bytes(b"\x03abc" + b"\x80\x01" + b"z" * 128)
    assert [len(r.record) for r in readers.delimited_records(spark, str(tmp_path / "x.rec")).orderBy("no").collect()] == [3, 128]


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([("A", "B,C")], schemas.DEPENDS)
    sinks.edges(edges, str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).first().DependsOn == "B,C"
    log = spark.createDataFrame([("m", "l1"), ("n", "l2")], "method_signature string, value string")
    sinks.log(log, str(tmp_path / "l"), log.filter("method_signature = 'm'").select("method_signature"))
    sinks.log(log, str(tmp_path / "l"))
    lines = spark.read.text(str(tmp_path / "l"))
    assert sorted(r.value for r in lines.collect()) == ["l1", "l1", "l2"]
    sinks.without_line(lines, "l1", str(tmp_path / "l2"))
    assert spark.read.text(str(tmp_path / "l2")).count() == 1
    sinks.prompt_variants(spark.createDataFrame([("p", "code")], "id string, code string"), str(tmp_path / "v"), {"plain": F.col("code"), "zero": F.concat(F.col("code"), F.lit("!"))})
    assert sorted(r.variant for r in spark.read.parquet(str(tmp_path / "v")).collect()) == ["plain", "zero"]
    sinks.json_document(edges, str(tmp_path / "j"))
    sinks.csv(edges, str(tmp_path / "c"), header=False, mode="append")
    assert readers.cached(spark, str(tmp_path / "cache"), lambda: edges).count() == readers.cached(spark, str(tmp_path / "cache"), lambda: edges.limit(0)).count() == 1


def test_digests_and_files(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"x\n")
    rows = spark.createDataFrame([("a/b", "COR", "t2", 2), ("a/b", "COR", "t1", 1), ("c", "SOR", None, 1)], "project string, operator string, text string, no int")
    one = sinks.manifest(rows.coalesce(1), str(tmp_path / "m"), ["project"], str(tmp_path / "in.txt")).first()
    assert one.input_sha256 == hashlib.sha256(b"x\n").hexdigest()
    assert one.output_sha256 == hashlib.sha256(next((tmp_path / "m").glob("part-*")).read_bytes()).hexdigest()
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "p").write_bytes(b"1"), (tmp_path / "two" / "q").write_bytes(b"2")
    both = sorted(hashlib.sha256(x).hexdigest() for x in (b"1", b"2"))
    assert tuple(sinks.files_digest(spark, str(tmp_path / "two")).first()) == (2, hashlib.sha256("\n".join(both).encode()).hexdigest())
    named = ordering.numbered(rows, ["project"], "operator", ["no"])
    sinks.mutant_files(named.filter("project = 'a/b'"), str(tmp_path / "mutants"))
    assert (tmp_path / "mutants" / "mutant_name=COR_2").is_dir()
    assert sorted((r.mutant_name, r.value) for r in spark.read.text(str(tmp_path / "mutants")).collect()) == [("COR_1", "t1"), ("COR_2", "t2")]
    sinks.merged_files(rows.filter("no < 3").fillna(""), str(tmp_path / "merged"), "operator", "text", "no")
    assert sorted((r.operator, r.value) for r in spark.read.text(str(tmp_path / "merged"), wholetext=True).collect()) == [("COR", "t1\nt2\n"), ("SOR", "\n")]
    sinks.pickles(rows.filter("no = 1"), str(tmp_path / "pickles"), "project")
    assert sorted(p.name for p in (tmp_path / "pickles").iterdir() if not p.name.startswith(".")) == ["a%2Fb.pkl", "c.pkl"]
    assert sorted((r.project, r.text) for r in readers.pickles(spark, str(tmp_path / "pickles"), "project string, text string, no int").collect()) == [("a/b", "t1"), ("c", None)]


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: streams.file_stream(spark, str(tmp_path / "in"), events.schema)
    q = streams.windowed_counts(stream(), "ts", "event_type", "1 day", late="60 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable(), q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == events.count()
    q = streams.publish_latest(stream().select("user_id", "event_id", "event_type"), str(tmp_path / "latest"), ["user_id"], "event_id", str(tmp_path / "cp")).start()
    q.processAllAvailable(), q.stop()
    latest = published.read_latest(spark, str(tmp_path / "latest"), "user_id long, event_id long, event_type string", ["user_id"], "event_id")
    assert {(r.user_id, r.event_id) for r in latest.collect()} == {tuple(r) for r in events.groupBy("user_id").agg(F.max("event_id")).collect()}
    kills = stream().select(F.col("event_type").alias("target"), F.col("user_id").alias("mutant"))
    q = streams.killed_so_far(kills).writeStream.format("memory").queryName("k").outputMode("append").start()
    q.processAllAvailable(), q.stop()
    got = {r.target: r.m for r in spark.sql("select target, max(known_kills) m from k group by target").collect()}
    assert got == {r[0]: r[1] for r in events.groupBy("event_type").agg(F.count_distinct("user_id")).collect()}


def test_a_published_table_costs_what_its_batches_hold(spark, tmp_path):
    root, layout = str(tmp_path / "t"), published.Layout(buckets=4, most=3, keep=2)
    schema, want = "k long, o long, v string", {}
    read = lambda: {r.k: (r.o, r.v) for r in published.read_latest(spark, root, schema, ["k"], "o").collect()}
    assert read() == {}
    big = [(k, 0, f"base {k} {hashlib.sha256(str(k).encode()).hexdigest()}") for k in range(20_000)]
    sizes = []
    for batch_id, data in enumerate([big] + [[(b * 7 + j, b, f"v{b}.{j}") for j in range(5)] + [(3, -b, "older"), (None, b, "null"), (4, 0, f"tie {b}")] for b in range(1, 13)]):
        before = {p for p in (tmp_path / "t").rglob("*.parquet")} if batch_id else set()
        batch = spark.createDataFrame(data, schema)
        published.publish(batch, batch_id, root, ["k"], "o", layout)
        sizes.append(sum(p.stat().st_size for p in (tmp_path / "t").rglob("*.parquet") if p not in before))
        for k, o, v in data:
            if k not in want or o >= want[k][0]:
                want[k] = (o, v)
        assert read() == want
        # run again, a batch changes nothing
        published.publish(batch.limit(2), batch_id, root, ["k"], "o", layout)
        assert read() == want
    assert sorted(sizes)[len(sizes) // 2] < sizes[0] / 20
    assert len(list((tmp_path / "t" / "versions").glob("*.json"))) == 2
    named = json.loads((tmp_path / "t" / "versions" / "12.json").read_text())["buckets"]
    assert all(len(f) <= 7 for f in named.values())
    # what died before the swap doesn't count, and is replaced when it is run again
    (tmp_path / "t" / "data" / "13").mkdir()
    (tmp_path / "t" / "data" / "13" / "junk").write_text("x")
    published.publish(spark.createDataFrame([(1, 99, "new")], schema), 13, root, ["k"], "o", layout)
    assert read() == want | {1: (99, "new")}
