"""Fill-in-middle, language identification and the divergence audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mutagrid.llm import divergence, fill_middle, language_id
from mutagrid.llm.common import table

# fill in middle


def numbers(doc_id, seed):
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]


def cut(doc_id, text, rule):
    text = text or ""
    units = [m.group() for m in re.finditer(f"(?s)(?:{rule.unit})|.", text)]
    h1, h2, h3, h4 = numbers(doc_id, rule.seed)
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or h3 % 100 >= rule.cut or any(m in text for m in (rule.prefix, rule.suffix, rule.middle)):
        return doc_id, n, "plain", None, None, text, text
    a, b, c = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    spm = h4 % 100 < rule.suffix_first
    out = f"{rule.suffix}{c}{rule.prefix}{a}{rule.middle}{b}" if spm else f"{rule.prefix}{a}{rule.suffix}{c}{rule.middle}{b}"
    return doc_id, n, "spm" if spm else "psm", len(a), len(b), out, text


RULES = [fill_middle.FillMiddle(), fill_middle.FillMiddle(unit=r"[^\n]*\n", cut=100, seed=3), fill_middle.FillMiddle(unit=r"[a-zé日本]+ *", prefix="<|p|>", suffix="<|s|>", middle="<|m|>", cut=95, suffix_first=60)]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("repeats", [False, True])
def test_texts_are_cut_at_units(spark, monkeypatch, rule, repeats):
    monkeypatch.setattr(fill_middle, "RUN", 4)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", "é", "𝔘", "<", "S>", "<P", " ", "\n", "\r", " ", "word ", "日本"]) for _ in range(rng.choice([0, 1, 3, 4, 5, 8, 9, 40, 300])))) for i in range(150)]
    rows += [(1000, None), (None, "no id\nat all"), (None, "no id\nat all either"), (1001, "a <M> in it"), (1002, "x"), (1003, "end <S")]
    if repeats:
        rows += rows[:20] * 2 + [(None, "no id\nat all")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, runs string, n long").repartition(5)
    got = fill_middle.fill_middle(docs, rule).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(cut(*r, rule)) for r in rows)


def test_odd_texts_are_cut(spark, odd_docs, no_docs):
    got = fill_middle.fill_middle(odd_docs).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(cut(r.doc_id, r.text, fill_middle.FillMiddle())) for r in odd_docs.select("doc_id", "text").collect())
    assert fill_middle.fill_middle(no_docs).count() == 0


def test_a_unit_is_not_empty():
    with pytest.raises(ValueError):
        fill_middle.FillMiddle(unit="a*")


def test_texts_are_shuffled_once(spark, sf_dir):
    plan = fill_middle.op11_fill_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange .*", plan)) > 1 and "Python" not in plan and "Arrow" not in plan


# language id


def brute_phrases(text, sample):
    i, n = 0, 0
    while i < len(text):
        stop = min(len(text), (i // language_id.SEGMENT + 1) * language_id.SEGMENT)
        k = 1
        while i + k < stop and text[i : i + k + 1] in sample:
            k += 1
        i, n = i + k, n + 1
    return n


def normalised(text):
    out = re.sub(rb"[^a-z\x80-\xff]+", b" ", (text or "").lower().encode())
    return out


@pytest.mark.parametrize("segment", [7, 1024])
def test_phrases_are_the_longest_matches(monkeypatch, segment):
    monkeypatch.setattr(language_id, "SEGMENT", segment)
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))
    make = lambda letters, n: " ".join(word(letters) for _ in range(n))
    alphabets = {"aa": "abcde", "bb": "cdefé", "cc": "ñ日本e"}
    pieces = {k: [make(v, 20) for _ in range(5)] for k, v in alphabets.items()}
    automata = [{"lang": k, **language_id.edges_of(v)} for k, v in pieces.items()]
    known = language_id.Automata(automata)
    texts = [make(v, n) for v in alphabets.values() for n in (0, 1, 3, 400)] + ["", "12 34", "zzz", "ABC,, dé\n\tE", None, "日本 日本語"]
    flat, ends = language_id.normal(pa.array(texts, pa.string()))
    assert [flat[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [normalised(t) for t in texts]
    got = known.phrases(flat, ends)
    for i, text in enumerate(texts):
        for j, k in enumerate(alphabets):
            sample = b"\0".join(normalised(p) for p in pieces[k])
            assert got[i, j] == brute_phrases(normalised(text), sample)
    langs, score = known.judged(pa.array(texts, pa.string()))
    assert [langs[i] for i in (3, 7, 11)] == ["aa", "bb", "cc"] and ((score >= 0) & (score <= 1)).all()
    assert [x == "und" for x in langs[12:]] == [True, True, False, False, True, False]
    # slices of larger arrays, as batches have them
    part = pa.array(texts, pa.string()).slice(3, 4)
    assert known.judged(part)[0] == langs[3:7]


def test_automata_know_every_substring_and_nothing_else():
    data = bytes(random.Random(1).choice(b"abc") for _ in range(60))
    moves = language_id.suffix_automaton(data)
    known, queue = set(), [(0, b"")]
    while queue:
        state, said = queue.pop()
        known.add(said)
        queue += [(to, said + bytes([byte])) for byte, to in moves[state].items()]
    assert known == {data[i:j] for i in range(61) for j in range(i, 61)} and len(moves) < 120


def test_held_out_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = language_id.op12_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert len(out) > 20 and np.mean(out) >= 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_only_text_and_the_learning_fold_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(120)
    want = {r.doc_id: (r.lang_pred, r.score) for r in language_id.languages(docs).collect()}
    blind = docs.withColumn("lang", F.when(language_id.fold(F.col("doc_id")) != 2, F.col("lang")).otherwise("zz")).withColumn("source", F.lit(None)).repartition(7)
    assert {r.doc_id: (r.lang_pred, r.score) for r in language_id.languages(blind).collect()} == want


def test_samples_are_bounded(spark):
    rows = [("a", f"text number {i} of the first language, and so on") for i in range(400)] * 2 + [("b", "b" * 900), ("c", "12"), (None, "nothing")]
    got = language_id.sample(spark.createDataFrame(rows, "lang string, text string"), language_id.CrossParsing(chars=20, pieces=9, total=1000)).collect()
    found = Counter(r.lang for r in got)
    assert found == {"a": 9, "b": 9} and all(len(r.piece) <= 20 for r in got)
    few = language_id.sample(spark.createDataFrame(rows, "lang string, text string"), language_id.CrossParsing(chars=20, pieces=9, total=4)).collect()
    assert Counter(r.lang for r in few) == {"a": 2, "b": 2}


def test_languages_of_odd_documents(spark, odd_docs, no_docs):
    got = defaultdict(list)
    for r in language_id.languages(odd_docs).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
    assert got[3] == got[4] == got[5] == [("und", 0.0)] and len(got[2]) == 2 and got[2][0] == got[2][1]
    assert got[8][0][0] == "en" and language_id.languages(no_docs).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.languages(unlabelled).collect()} == {("und", 0.0)}


# divergence


def brute_audit(rows, rule):
    docs = [tuple(x or "" for x in r) for r in rows]
    terms = [Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))) for t, _, _ in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(d[2], c) for d, c in zip(docs, terms) if d[1] == lang]
        seen = Counter(t for _, c in own for t in c)
        kept = [t for t, k in seen.items() if k >= rule.least_docs]
        counts = {s: Counter() for s, _ in own}
        for s, c in own:
            counts[s] += Counter({t: c[t] for t in kept if t in c})
        share = lambda c: {t: 1 + 10**9 * (c[t] + rule.prior) // (c.total() + rule.prior * len(kept)) for t in kept}
        p = {s: share(c) for s, c in counts.items()}
        q = share(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            marked = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", marked, rule.top)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found)]
    return out


@pytest.mark.parametrize("rule", [divergence.Audit(), divergence.Audit(3, 1, 2), divergence.Audit(10**6)])
def test_audit_matches_brute_force(spark, rule):
    rng = random.Random(9)
    words = ["the", "The", "É", "é", "日本", "a1b", "x_y", "it's", "𝔘n", "THE"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(5)]
    rows = []
    for _ in range(300):
        source = rng.choice(["s1", "s1", "s1", "s2", "é", "", None])
        some = words[: 6 + (len(source or "") * 9)]
        rows.append((" ".join(rng.choices(some, k=rng.choice([0, 1, 5, 30]))), rng.choice(["l", "l", "m", None, ""]), source))
    rows += rows[:30] + [(None, "l", "quiet"), ("", "n", "alone"), (None, "o", "p"), (None, "o", "q"), ("word " * 30_000, "l", "s1")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n long").repartition(5)
    got = divergence.audit(spark, docs, rule)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_audit(rows, rule))


def test_equal_vectors_are_evaluated_once(spark, monkeypatch):
    rows = [(" ".join(f"t{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)), "l", s) for s in ("a", "b", "c") for _ in range(4)]
    held = {}
    put = divergence.Workspace.put
    monkeypatch.setattr(divergence.Workspace, "put", lambda self, name, df: held.setdefault(name, put(self, name, df)))
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    assert divergence.audit(spark, docs).filter("part = 'pair'").count() == 6
    assert held["vectors"].count() == 1 and held["vectors"].first().terms == 400


def test_shares_of_large_counts_are_exact(spark):
    cases = [(0, 0, 1), (7, 7, 1), (10**15, 3 * 10**15, 12345), (4 * 10**14 + 1, 9 * 10**14, 10**9), (0, 10**15, 1)]
    got = spark.createDataFrame(cases, "c long, n long, v long").select(divergence.share(F.col("c"), F.col("n"), F.col("v"), 2).alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]


def test_audit_of_odd_documents(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("text", "lang", "source").collect()]
    rule = divergence.Audit(least_docs=2)
    assert sorted(map(tuple, divergence.audit(spark, odd_docs, rule).collect())) == sorted(brute_audit(rows, rule))
    assert divergence.audit(spark, no_docs).count() == 0
