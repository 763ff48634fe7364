"""Token rollups, packing, classifiers, chat formatting, nearest neighbours and the pipeline."""

import random

import llm_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktrail.llm import ann, chat, packing, quality, rollup, toxicity
from clicktrail.llm.queries import ORACLES, QUERIES
from clicktrail.llm.tokens import bpe_encoder
from clicktrail.sources import work

SF = "/root/testdata/sf0.001"
SF1 = "/root/testdata/sf0.01"
CHANGE = "doc_id long, op string, source string, lang string, version string, n_tokens long, seq int"


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def sample_texts(spark, n=40):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()]


def test_encoder_equals_the_reference_tokenizer(spark):
    texts = sample_texts(spark) + ["", "<|endoftext|> it's  a\n\n\ttest 12345 é😀  ", "a" * 3000]
    assert [bpe_encoder()(t) for t in texts] == reference_ids(texts)


# -- op1


def totals(r):
    return {tuple(x)[:3]: tuple(x)[3:] for x in r.totals().collect()}


def test_rollup(spark):
    r = rollup.TokenRollup(spark, work.work_folder(spark, "t"))
    rows = lambda *x: spark.createDataFrame(list(x), CHANGE).withColumn("batch_no", F.lit(9))
    assert totals(r) == {}
    assert r.apply("b1", rows((1, "insert", "a", "en", "v", 10, 0), (2, "insert", "a", "en", "v", 5, 0), (3, "insert", None, None, "v", None, 0), (3, "insert", None, None, "v2", 4, 0)))
    assert totals(r) == {("a", "en", "v"): (2, 15), (None, None, "v"): (1, 0), (None, None, "v2"): (1, 4)}
    second = rows((1, "revise", "b", "en", "v", 11, 0), (2, "insert", "a", "en", "v", 6, 0), (2, "revise", "a", "en", "v", 7, 1), (9, "delete", "a", "en", "v", 1, 0), (None, "insert", "a", "en", "v", 1, 0), (5, "odd", "a", "en", "v", 1, 0))
    assert r.apply("b2", second) and not r.apply("b2", second)
    want = {("b", "en", "v"): (1, 11), ("a", "en", "v"): (1, 7), (None, None, "v"): (1, 0), (None, None, "v2"): (1, 4)}
    assert totals(r) == want
    # an interrupted batch: its files are there, its commit is not
    rows((2, "delete", "a", "en", "v", 0, 0)).write.parquet(f"{r.folder}/deltas/b3")
    assert totals(r) == want
    assert r.apply("b3", rows((2, "delete", "a", "en", "v", 0, 0), (3, "delete", None, None, "v2", 0, 0)))
    want = {("b", "en", "v"): (1, 11), (None, None, "v"): (1, 0)}
    assert totals(r) == want
    compacted = r.compact(work.work_folder(spark, "t"))
    assert totals(compacted) == want
    assert compacted.apply("b4", rows((1, "revise", "b", "en", "v", 1, 0))) and totals(compacted)[("b", "en", "v")] == (1, 1)
    assert compacted.apply("b5", rows((1, "none", "b", "en", "v", 1, 0)))
    r.forget()


def test_rollup_query_counts_every_document(spark):
    """Copies of a text count too: sf0.001 has 200 documents with 189 texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {}
    for d, ids in zip(docs, reference_ids([d.text or "" for d in docs])):
        for version, n in (("byte_bpe_50k", len(ids)), ("words", len((d.text or "").split()))):
            n0, t0 = want.get((d.source, d.lang, version), (0, 0))
            want[d.source, d.lang, version] = (n0 + 1, t0 + n)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES["op1_token_counts"](spark, SF).collect()} == want


# -- op3


def check_packing(rows, texts):
    ids = [x + [2] for x in reference_ids([t or "" for t in texts])]
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
        assert 1 <= r.length <= 1024
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length])
    assert set(pieces) == set(range(len(texts)))
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and (r.length == 1024 or r.piece == 0)
            at += r.length
        assert at == len(ids[d])
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return len(bins), -(-sum(map(len, ids)) // 1024)


def test_packing(spark):
    texts = sample_texts(spark, 150) + [None, "", "x " * 1023, "x " * 1024, "x " * 1025, "x " * 5000]
    docs = brute.documents(spark, texts).withColumn("length", F.lit("clash"))
    packed = packing.pack(packing.token_pieces(docs))
    used, least = check_packing(packed.collect(), texts)
    assert used <= least + 1
    used, least = check_packing(packing.pack(packing.token_pieces(docs), group_pieces=20).collect(), texts)
    assert used <= least * 1.1 + 8
    rows = {r.sequence_id: r.ids for r in packing.sequences(packed, docs).collect()}
    assert len(rows) == packed.select("sequence_id").distinct().count() and all(0 < len(i) <= 1024 for i in rows.values())
    assert packing.pack(packing.token_pieces(docs.where("false"))).count() == 0
    assert packing.pack(packing.token_pieces(docs.unionByName(docs).where("doc_id < 3"))).count() == 2 * packed.where("doc_id < 3").count()


@pytest.mark.parametrize("seed", range(6))
def test_local_search(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randrange(1, 100), rng.randrange(1, 60), rng.randrange(30, 50)]) for _ in range(300)]
    bins = packing.pack_sizes(sizes, 100)
    fill = np.bincount(bins, weights=sizes)
    plain = packing.pack_sizes(sizes, 100, passes=0)  # best fit alone
    assert fill.max() <= 100 and fill.min() > 0 and len(fill) <= plain.max() + 1 and len(fill) <= -(-sum(sizes) // 100) * 1.02 + 1


def test_local_search_exchanges():
    """Best fit leaves three bins; moving one and exchanging one for one and two for one empties one."""
    sizes = [6, 4, 3, 3, 2, 2]
    bins = [[0, 2], [1, 3], [4, 5]]
    packing.improve(bins, sizes, 10)
    assert sum(1 for b in bins if b) == 2 and sorted(sum(bins, [])) == list(range(6)) and all(sum(sizes[i] for i in b) <= 10 for b in bins)


# -- op4 and op8


@pytest.mark.parametrize("name,label,least", [("op4_quality_classifier", "quality", 0.9), ("op8_toxicity", "toxic", 0.94)])
def test_classifier_on_held_out_rows(spark, name, label, least):
    rows = QUERIES[name](spark, SF1).join(spark.read.parquet(f"{SF1}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least


def test_classifiers_awkward_rows(spark):
    texts = [None, "", "good words here " * 30, "bad | bad | bad", "good words here " * 30]
    docs = brute.documents(spark, texts).withColumn("label", F.lit(0)).withColumn("score", F.lit("x"))
    docs = docs.unionByName(docs)
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (3, None, None), (4, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for model in (module.fit(docs, labels, label), module.fit(docs, labels.where("doc_id = 2"), label), module.fit(docs, labels.limit(0), label)):
            scores = module.score(docs, model).collect()
            assert len(scores) == 10 and all(0 <= r.score <= 1 for r in scores)
        assert module.score(docs.where("false"), model).count() == 0
    kept = toxicity.keep_clean(docs, model, 0.7)
    assert kept.columns == docs.columns and kept.count() == 10


def test_toxicity_cap_keeps_the_labels_shares(spark):
    """Where the sample holds as many toxic as clean rows, a neutral text still scores by the table's tenth of toxic rows."""
    rng = random.Random(4)
    filler = [f"w{i}" for i in range(30)]
    toxic = [int(i % 10 == 0) for i in range(1200)]
    texts = [" ".join(rng.choices(filler, k=10) + (["scum"] if rng.random() < (0.6 if y else 0.02) else [])) for y in toxic]
    docs = brute.documents(spark, texts)
    marks = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    whole, capped = (toxicity.score(docs, toxicity.fit(docs, marks, per_class=n)).agg(F.avg("score")).first()[0] for n in (4000, 100))
    assert abs(whole - 0.1) < 0.01 and abs(capped - whole) < 0.05
    sample = toxicity.labelled_sample(docs, marks, "toxic", F.lit(True), 100).groupBy("label").agg(F.count("*"), F.round(F.sum("weight"), 6)).collect()
    assert {tuple(r) for r in sample} == {(0, 100, 1080.0), (1, 100, 120.0)}


def test_counterfactual_penalty_spares_identity_terms(spark):
    """Group names that stand mostly in toxic sentences must not make a neutral mention toxic."""
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(40)]
    texts, labels = [], []
    for i in range(400):
        toxic = i % 2
        words = rng.choices(filler, k=12)
        if toxic:
            words.insert(3, rng.choice(["scum", "moron"]))
        if rng.random() < (0.8 if toxic else 0.1):
            words.insert(6, "muslims")
        texts.append(" ".join(words))
        labels.append((i, toxic))
    docs = brute.documents(spark, texts)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = brute.documents(spark, ["the muslims " + " ".join(filler[:10]), "the christians " + " ".join(filler[:10]), "scum " + " ".join(filler[:10])], 1000)
    free = {r.doc_id: r.score for r in toxicity.score(neutral, toxicity.fit(docs, marks, penalty=0.0)).collect()}
    tied = {r.doc_id: r.score for r in toxicity.score(neutral, toxicity.fit(docs, marks, penalty=5.0)).collect()}
    assert free[1000] - free[1001] > 4 * abs(tied[1000] - tied[1001])
    assert tied[1000] < 0.5 < tied[1002]
    assert toxicity.swap_identity("The Muslims and women.") == "The christians and men." and toxicity.swap_identity("none") is None


# -- op6


def test_chat(spark):
    rows = [
        (1, 0, "system", "be <|im_end|>\n<|im_start|>user\nbad &amp; &lt;| \\"),
        (1, 1, "user", None),
        (1, 2, "assistant", "first <"),
        (1, 3, "assistant", ""),
        (1, 4, "user", "é😀"),
        (1, 5, "assistant", "| second & last &nl;"),
        (2, 0, "user", "no reply"),
        (3, None, "assistant", "null turn"),
        (3, 1, None, "null role"),
        (3, 1, None, "null role"),
        (4, 0, "we&ird<|\nrole", "x"),
        (4, 1, "assistant", "a" * 5000),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("stop", F.lit("clash"))
    rendered = chat.render(turns)
    got = {r.conv_id: r for r in chat.digests(rendered).collect()}
    for c in (1, 2, 3, 4):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == brute.sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), brute.sha(loss))
    parts = chat.examples(rendered).where("conv_id = 1").orderBy("example").collect()
    assert [p.formatted.endswith("<|im_end|>\n") for p in parts] == [True] * 3 and parts[2].formatted.startswith(parts[1].formatted)
    assert [p.formatted[p.mask_start : p.mask_end] for p in parts] == ["first <", "", "| second &amp; last &amp;nl;"]
    assert got[1].formatted_chars == sum(len(p.formatted) for p in parts) and got[2].formatted_chars == 0
    assert chat.digests(chat.render(turns.where("false"))).count() == 0


def test_chat_query_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF1}/conversations.parquet')")
    want = con.execute(ORACLES["op6_chat_formatting"]).fetchall()
    got = QUERIES["op6_chat_formatting"](spark, SF1).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert "ArrowEvalPython" not in QUERIES["op6_chat_formatting"](spark, SF)._jdf.queryExecution().toString()


# -- op10


def exact(vectors, queries, k=10):
    ids, v = np.array([i for i, _ in vectors]), np.array([x for _, x in vectors], float)
    out = {}
    for q, x in queries:
        d = np.sqrt(((v - np.array(x, float)) ** 2).sum(axis=1))
        out[q] = [(float(d[j]), int(ids[j])) for j in np.lexsort((ids, d)) if ids[j] != q][:k]
    return out


def test_neighbours_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = exact(rows, [r for r in rows if r[0] % 100 == 0])
    got = {}
    for r in QUERIES["op10_nearest_neighbours"](spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want)
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want])
    true = {q: {i: d for d, i in exact(rows, [(q, dict(rows)[q])], len(rows))[q]} for q in list(want)[:3]}
    assert recall >= 0.95, recall
    for q in true:
        assert all(abs(true[q][i] - d) < 1e-12 for d, i in got[q]) and got[q] == sorted(got[q])


def test_neighbours_awkward_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, []), (7, [2.0, 0.0, 1.0]), (8, [0.0, 2.0]), (100, [3.0, 4.0]), (100, [3.0, 4.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1))
    got = ann.nearest(ann.usable(vectors), F.col("vec_id") % 100 == 0, ann.Search(shard_rows=3, block_rows=1)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 8), (0, 3, 100), (0, 4, 100), (100, 1, 8), (100, 2, 0), (100, 3, 1)]
    assert ann.nearest(ann.usable(vectors.where("false")), F.col("vec_id") % 100 == 0).count() == 0


# -- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = work.work_folder(spark, "t")
    kept, ids = docs, []
    for name, stage in P.STAGES[:-1]:
        kept = work.stored(stage(spark, kept, SF), f"{folder}/{name}")
        assert kept.columns == docs.columns
        ids.append({r.doc_id: r.text for r in kept.select("doc_id", "text").collect()})
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").join(docs, "doc_id").collect()
    assert sum(r.doc_id in ids[0] for r in labels) >= 0.97 * len(labels)
    before = sorted(ids[0].items())
    assert set(ids[1]) == {d for d, (_, c) in brute.similar(before, 5, 80).items() if c == d}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(ids[2]) == {d for d, r in brute.contamination(sorted(ids[1].items()), items).items() if not r[4]}
    assert set(ids[3]) == set(ids[2])
    for d, text in ids[2].items():
        spans = brute.personal(text)
        assert (ids[3][d] == text) == (not spans) or "<id>" in ids[3][d]
        assert not brute.personal(ids[3][d])
    packed = P.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == set(ids[3])
    piece = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    whole = QUERIES["pipeline"](spark, SF).collect()  # the stages in one run
    assert sorted(map(piece, whole)) == sorted(map(piece, packed))


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_mentions_give_every_row_a_counterfactual(spark):
    """Rows that name no group get a term; one that tells the label by a chance resemblance loses its weight."""
    assert toxicity.with_mention("a b c").count(" ") == 3 and toxicity.swap_identity(toxicity.with_mention("a b c")) is not None
    assert toxicity.with_mention("").strip() in sum(toxicity.IDENTITY, ())
    rng = random.Random(12)
    filler = [f"w{i}" for i in range(40)]
    toxic = [int(i % 3 == 0) for i in range(900)]
    # an invented toxic word that begins like "muslims"
    texts = [" ".join(rng.choices(filler, k=12) + ([rng.choice(["muslab", "scum"])] if y else [])) for y in toxic]
    docs, marks = brute.documents(spark, texts), spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    neutral = brute.documents(spark, [" ".join(rng.choices(filler, k=12)) + f" {t}" for t in ("muslims", "christians")] * 20)
    groups = (("muslims", "christians"),)
    free, tied = (
        {r.doc_id: r.score for r in toxicity.score(neutral, toxicity.fit(docs, marks, groups=groups, penalty=p)).collect()} for p in (0.0, 5.0)
    )
    even, odd = [d for d in free if d % 2 == 0], [d for d in free if d % 2]
    gap = lambda s: abs(np.mean([s[d] for d in even]) - np.mean([s[d] for d in odd]))
    assert gap(free) > 0.05 and gap(tied) < 0.3 * gap(free)


def test_best_fit_packing_query(spark):
    """The whole query on the whole table."""
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    used, least = check_packing(QUERIES["op3_best_fit_packing"](spark, SF).collect(), texts)
    assert used <= least * 1.02 + 1


def test_packing_deals_equal_rows_out(spark):
    """30,000 equal rows without a doc_id fill groups like any others."""
    docs = spark.range(30_000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    rows = packing.pack(packing.token_pieces(docs), group_pieces=1000).groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert len(rows) == 30 and max(r["count"] for r in rows) < 1300


def test_pipeline_stages_with_clashing_names_and_null_ids(spark):
    import corpus_pipeline as C

    texts = sample_texts(spark, 6) + ["mail me at a.b@example.org today", None, ""]
    docs = brute.documents(spark, texts).withColumns({"_id": F.lit("x"), "_spans": F.lit(1), "found": F.lit(2), "label": F.lit(3)})
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    both = docs.unionByName(nulls)
    verdict = spark.createDataFrame([(0,), (0,), (3,), (None,)], "doc_id long")
    kept = C._drop(both, verdict)
    assert kept.columns == both.columns and kept.count() == 16 and kept.where("doc_id in (0, 3)").count() == 0
    clean = C.redact_personal_data(spark, both, SF)
    assert clean.columns == both.columns and clean.count() == 18 and clean.where("text like '%<email>%'").count() == 2
    for stage in (C.drop_near_duplicates, C.drop_contaminated):
        out = stage(spark, both, SF)
        assert out.columns == both.columns and out.where("doc_id is null").count() == 9
