"""Suffix index, Jaccard join, decontamination and personal data against their definitions."""

import random

import llm_brute as brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clicktrail.llm import decontam, graph, jaccard, pii, suffix
from clicktrail.llm.queries import QUERIES
from clicktrail.sources import work

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    """Driver documents with awkward ones: null, empty, repeated, periodic, long, not ASCII."""
    rows = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(120).collect()]
    rng = random.Random(5)
    base = rows[0]
    near = []
    for k in range(12):  # a group of near copies: every one a word or two off
        words = base.split(" ")
        for _ in range(2):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}"
        near.append(" ".join(words))
    odd = [None, "", "   ", "one", "one two", "One TWO", "ab" * 400, "ab" * 300 + "é" * 90, "x" * 99, "x" * 100, "x" * 101]
    return rows + near + odd + [rows[3], rows[3], rows[5][100:] + rows[7], "İ Ünï ſ " * 40, "\x1c a b \x85 c " * 30]


def plain(spark, texts):
    """Documents with an extra column whose name clashes with a working column."""
    return brute.documents(spark, texts).withColumn("label", F.lit(1)).withColumn("lo", F.lit("x"))


def test_suffix_levels(spark, texts):
    docs = plain(spark, texts)
    family = suffix.SuffixLevels(spark, work.work_folder(spark, "t"), suffix.Suffixes(block_entries=300, group_entries=6, part_entries=4))
    runs = None
    for lo, hi in ((0, 20), (20, 41), (41, 60), (60, 1000)):
        found = family.add(docs.where((F.col("doc_id") >= lo) & (F.col("doc_id") < hi)), docs)
        runs = found if runs is None else runs.unionByName(found)
    family.merge_equal()
    classes = [c for c, _ in family.levels]
    assert len(set(classes)) == len(classes) < 4
    got = {r[0]: tuple(r)[1:] for r in suffix.dedup_report(docs, runs).collect()}
    assert got == brute.removed(list(enumerate(texts)))


def test_suffix_repeated_rows_and_empty_table(spark, texts):
    docs = plain(spark, texts[:10])
    twice = docs.unionByName(docs).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("z" * 250)))
    family = suffix.SuffixLevels(spark, work.work_folder(spark, "t"))
    got = suffix.dedup_report(twice, family.add(twice, twice)).collect()
    want = brute.removed(list(enumerate(texts[:10])))
    assert len(got) == 21 and all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id is not None)
    null = next(r for r in got if r.doc_id is None)
    assert (null.n_bytes, null.n_removed, null.n_spans) == (250, 249, 1)
    none = docs.where("false")
    family = suffix.SuffixLevels(spark, work.work_folder(spark, "t"))
    assert suffix.dedup_report(none, family.add(none, none)).count() == 0


@pytest.mark.parametrize("words,percent,how", [(4, 85, {}), (5, 80, {"block_shingles": 900, "long_list": 3, "part_rows": 4})])
def test_jaccard(spark, texts, words, percent, how):
    docs = plain(spark, texts)
    got = {r[0]: (r[1], r[2]) for r in jaccard.similar_components(docs, jaccard.Jaccard(words, percent, **how)).collect()}
    assert got == brute.similar(list(enumerate(texts)), words, percent)


def test_jaccard_large_groups_and_boilerplate(spark):
    """A chain of near copies in several blocks, and a passage that most documents share."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    passage = " ".join(word() for _ in range(30))
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(60):
        base = [*base]
        base[rng.randrange(80)] = word()
        texts.append(" ".join(base))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(2, 90))) for _ in range(120)]
    rng.shuffle(texts)
    how = jaccard.Jaccard(4, 85, long_list=16, part_rows=20, block_shingles=800)
    got = {r[0]: (r[1], r[2]) for r in jaccard.similar_components(brute.documents(spark, texts), how).collect()}
    assert got == brute.similar(list(enumerate(texts)), 4, 85)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=18), min_size=1, max_size=25), st.sampled_from([60, 80, 85]))
def test_t_occurrence(sets, percent):
    import numpy as np

    how = jaccard.Jaccard(4, percent)
    tops = jaccard.t_occurrence_links([np.array(sorted(s), np.uint64) for s in sets], how)
    up = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    assert tops == up


def test_jaccard_empty_null_and_repeated(spark):
    docs = brute.documents(spark, ["a b c d e f", None, "", "a b c d e f"])
    more = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, "a b c d e f", "en", "s", 1)], brute.DOCS))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_components(more).where("doc_id is not null").collect())
    assert got == [(0, 3, 0)] * 2 + [(1, 0, 1)] * 2 + [(2, 0, 2)] * 2 + [(3, 3, 0)] * 2
    assert jaccard.similar_components(docs.where("false")).count() == 0


def test_jaccard_near_copy_under_a_null_id(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    docs = brute.documents(spark, [" ".join(words), "unlike " * 9]).unionByName(spark.createDataFrame([(None, near, "en", "s0", 1)], brute.DOCS))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, jaccard.Jaccard(words=4, percent=85)).collect()}
    assert got == {0: (57, 0), 1: (1, 1), None: (57, 0)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (101, 100), (7, 7), (60, 61), (60, 61)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 101: 50, 60: 60, 61: 60}


@pytest.mark.parametrize("block", [1_000_000, 50])
def test_decontamination(spark, texts, block):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(20).collect()]
    items += [(900, "Short item"), (901, None), (902, "..."), (903, "one"), (None, "lost words here"), (900, "short ITEM")]
    more = texts + ["a short, item here. " + items[0][1][:200], items[1][1] + " " + items[1][1], "one one two"]
    docs = plain(spark, more)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(1))
    found = decontam.judged(decontam.find_contamination(docs, bench, block_windows=block))
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), brute.sha(",".join(r["items"])), r.contaminated) for r in found.collect()}
    assert got == brute.contamination(list(enumerate(more)), items)
    cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, found).collect()}
    assert cut[len(more) - 1] == " two" and not cut[len(more) - 2].strip(" .").endswith("here")
    assert all(cut[d] == more[d] for d in cut if not got[d][1])


def test_decontamination_empty(spark, texts):
    docs = plain(spark, texts[:3])
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontam.judged(decontam.find_contamination(docs, none)).collect()] == [0] * 3
    assert decontam.find_contamination(docs.where("false"), none).count() == 0


PII_TEXTS = [
    None,
    "",
    "a.b@c.d_e@f.g x@y z@@q.r m@n.o. -@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.2.3 1.2.3 99999.1.1.1.1 1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111, 37828224631000500000000",
    "+1 (327) 555-0102 +49 30 1234567. ++1234567890 +1+12345678901 +12",
    "é😀 a@b.cc ü +44 20 7946 0958 😀 10.0.0.1",
    "9" * 3000 + " " + "a" * 3000 + "@ " + "1." * 500,
    "4012 8888 8888 1881 4012888888881881@mail.com +4012888888881881",
]


def test_personal_data_base(spark, texts):
    every = PII_TEXTS + texts
    found = pii.find_spans(plain(spark, every))
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.base] for r in found.collect()}
    assert got == {d: brute.personal(t) for d, t in enumerate(every)}


def test_personal_data_bootstrap(spark):
    """Mail addresses teach the pattern "write to"; it finds accounts that no base pattern knows."""
    rng = random.Random(1)
    texts = [f"hello{i} please write to user{i}@host{i}.org today" for i in range(30)]
    texts += [f"hello please write to account ZX{rng.randrange(10**6)} now" for _ in range(1)]
    texts += [f"or write to @handle{i}77 soon" for i in range(4)] + ["version 3.14159 of the text", "in chapter 12345 we see"]
    rows = {r.doc_id: r for r in pii.find_spans(brute.documents(spark, texts)).select("doc_id", pii.as_text("spans").alias("spans"), pii.as_text("base").alias("base")).collect()}
    assert rows[0].spans == rows[0].base == "email:23:38"
    assert rows[31].spans == "id:12:22" and rows[31].base == ""
    assert rows[35].spans == rows[36].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(brute.documents(spark, texts)).collect()}
    assert clean[0] == "hello0 please write to <email> today" and clean[31] == "or write to <id> soon" and clean[35] == texts[35]


def test_personal_data_names_without_digits(spark):
    """Handles without a digit are found after a learnt context; an everyday word that once stands there is not."""
    texts = [f"new member: user{i}@host.org joined" for i in range(40)]
    texts += ["new member: (maria_k), joined", "new member: 王小明 joined", "new member: today joined"]
    texts += ["it rains today, as it did"] * 30 + ["old member maria_x left"]
    found = {r.doc_id: r for r in pii.find_spans(brute.documents(spark, texts)).select("doc_id", pii.as_text("spans").alias("spans")).collect()}
    assert found[40].spans == "id:13:20" and found[41].spans == "id:12:15"
    assert all(found[i].spans == "" for i in range(42, len(texts)))
    alone = pii.find_spans(brute.documents(spark, texts[:5] + ["new member: x joined"])).select(pii.as_text("spans").alias("spans"))
    assert all(r.spans.startswith("email") for r in alone.collect() if r.spans)  # five seeds and one other fall short of 0.8


def test_personal_data_support_acts(spark):
    """``support`` seeds seen once reach the confidence by themselves, one less never does."""
    for k, sure in ((4, False), (5, True)):
        docs = brute.documents(spark, [f"ask u{i}@h.org" for i in range(k)] + ["the u@h.org"] * 9)
        seeds = pii.seed_edges(pii.scan(docs))
        chosen = pii.supported_patterns(docs, seeds, 5)
        assert ([r.pattern for r in chosen.collect()] == ["ask"]) == sure
    edges = pii.graph(docs, seeds, chosen)
    assert [r.confidence for r in pii.score(edges)[0].collect()] == [pytest.approx(0.8)]
    everyday = docs.unionByName(brute.documents(spark, ["ask me", "ask her"] * 30))
    assert pii.supported_patterns(everyday, seeds, 5).count() == 0 and pii.supported_patterns(everyday, seeds, 5, share=0.05).count() == 1


def test_personal_data_long_text(spark):
    """A text costs about its length: 20,000 numbered words and 3,000 addresses, cut out exactly."""
    import re
    import time

    text = " ".join(f"é{i}x" + (f" call +49 30 {1000000 + i} a{i}@b.org," if i % 7 == 0 else "") for i in range(20_000))
    docs = brute.documents(spark, [text] + [f"call u{i}@h.org" for i in range(9)])
    started = time.time()
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got[0] == re.sub(r"a\d+@b.org", "<email>", re.sub(r"\+49 30 \d+", "<phone>", text))
    assert time.time() - started < 60


def test_personal_data_overlaps(spark):
    """Overlapping spans are one, named after the first; what masks them when words are read keeps every place."""
    docs = brute.documents(spark, ["x 4012888888881881@mail.com 10.0.0.1 y", "é😀 +4012888888881881 z", None, "q" * 3000 + " a@b.c " + "r" * 3000])
    got = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert got == {0: "x <email> <ip> y", 1: "é😀 +<card> z", 2: None, 3: "q" * 3000 + " <email> " + "r" * 3000}
    rows = pii.words(docs, placed=True).select("doc_id", "instance", "start", "end", "two").collect()
    assert sorted((r.doc_id, r.instance[:3], r.start, r.end) for r in rows) == [
        (0, "x", 0, 1), (0, "y", 37, 38), (1, "z", 21, 22), (1, "é😀", 0, 2), (3, "qqq", 0, 3000), (3, "rrr", 3007, 6007),
    ]


def test_personal_data_repeated_and_empty(spark):
    docs = plain(spark, ["a@b.c", None])
    assert sorted((r.doc_id, len(r.spans)) for r in pii.find_spans(docs.unionByName(docs)).collect()) == [(0, 1), (0, 1), (1, 0), (1, 0)]
    assert pii.find_spans(docs.where("false")).count() == 0
    assert pii.redact(docs.where("false")).columns == docs.columns


@pytest.mark.parametrize("name", ["op2_suffix_array_dedup", "op5_ngram_jaccard_join", "op7_personal_data", "op9_benchmark_decontamination"])
def test_queries(spark, name):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, SF).collect()}
    if name.startswith("op2"):
        want = brute.removed(docs)
    elif name.startswith("op5"):
        want = brute.similar(docs, 4, 85)
    elif name.startswith("op9"):
        want = brute.contamination(docs, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    else:
        want = {}
        for d, t in docs:
            spans = brute.personal(t)
            counts = [sum(1 for s in spans if s[0] == k) for k in range(4)]
            want[d] = (*counts, brute.sha(",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)))
        got = {d: v[:5] for d, v in got.items()}
    assert got == want
