"""Order-preserving packing: exact round trip, the dynamic program against all packings, awkward rows."""

import random
from collections import defaultdict

import llm_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_models import SF, reference_ids, sample_texts

from clicktrail.llm import windows
from clicktrail.llm.queries import QUERIES


def padding(n, capacity=1024):
    return 0 if n & (n - 1) == 0 else capacity - n


def check(rows, texts, capacity=1024):
    """Every id in one piece, sequences gapless and in the order of their documents; returns the share of padding."""
    ids = {d: x + [0] for d, x in zip(texts, reference_ids([t or "" for t in texts.values()]))}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert r.length >= 1 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == brute.crc(ids[r.doc_id][r.start : r.start + r.length])
    assert set(pieces) == set(ids)
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return sum(padding(sum(r.length for r in s), capacity) for s in sequences.values()) / sum(map(len, ids.values()))


def cheapest(points, penalty, capacity, inside, runs):
    """Least cost over every predecessor of every point, written out."""
    p, cost = [0, *points], [0, *penalty]
    f = [0.0]
    for j in range(1, len(p)):
        ways = []
        for i in range(j):
            gap = p[j] - p[i]
            if gap <= capacity:
                ways.append(f[i] + padding(gap, capacity))
            for m in range(runs + 1):
                if m * capacity < gap <= (m + 1) * capacity:
                    ways.append(f[i] + m * inside + (m + 1) * capacity - gap)
        f.append(min(ways) + cost[j])
    return f[-1]


@pytest.mark.parametrize("seed", range(40))
def test_program_is_optimal(seed):
    rng = random.Random(seed)
    capacity, runs, inside = rng.choice([(16, 0, 3.0), (16, 2, 2.0), (32, 3, 1.0)])
    points = np.cumsum([rng.randint(1, rng.choice([3, capacity])) for _ in range(rng.randint(1, 60))]).tolist()
    penalty = [rng.choice([0.0, 0.5, 3.0]) for _ in points]
    ends = windows.windows(points, penalty, capacity, inside, runs)
    price = dict(zip(points, penalty))
    cost = sum(padding(b - a, capacity) + price.get(b, inside) for a, b in zip([0, *ends], ends))
    assert ends[-1] == points[-1] and all(0 < b - a <= capacity for a, b in zip([0, *ends], ends))
    # a full window that ends on a point by chance is charged ``inside`` by the program, and that point's penalty here
    assert cost <= cheapest(points, penalty, capacity, inside, runs) + 1e-9 + 3.0 * sum(b - a == capacity and b in price for a, b in zip([0, *ends], ends))
    if runs == 0:
        assert abs(cost - cheapest(points, penalty, capacity, inside, runs)) < 1e-9


def test_cut_points():
    ids = np.array(reference_ids(["First one here. And a second! " + "word " * 300 + ". Last"])[0] + [0], "<u4")
    points, cost = windows.cut_points(ids, longest=50)
    assert points[-1] == len(ids) and cost[-1] == 0 and np.diff([0, *points]).max() <= 50
    assert len(windows.sentence_ends(ids)) == 3
    assert (cost[np.isin(points, windows.sentence_ends(ids))] == windows.SENTENCE).all()


def test_ordered_packing_query(spark):
    """The whole query on the whole table, in the order of the table."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_ordered_packing"](spark, SF).collect()
    assert check(rows, texts) < 0.002
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert [d for k, d in enumerate(order) if k == 0 or order[k - 1] != d] == list(texts)


def test_ordered_packing_awkward_rows(spark):
    texts = sample_texts(spark, 60) + [None, "", "", "x" * 200_000, "a b<|endoftext|>c", "no stop " * 9000, "One. Two! Three?\n" * 3000, "é😀。" * 2000]
    docs = brute.documents(spark, texts).withColumn("length", F.lit("clash")).withColumn("sequence_id", F.lit(1)).coalesce(2)
    for block in (windows.BLOCK, 3000):
        rows = windows.pack_in_order(docs, block=block).collect()
        assert check(rows, dict(enumerate(texts))) < 0.01
    repeated = windows.pack_in_order(docs.where("doc_id in (0, 60)").unionByName(docs.where("doc_id in (0, 60)"))).collect()
    assert sum(r.length for r in repeated) == 2 * sum(len(i) + 1 for i in reference_ids([texts[0], ""]))
    nulls = windows.pack_in_order(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert all(r.doc_id is None for r in nulls) and sum(r.length for r in nulls) == sum(len(i) + 1 for i in reference_ids([t or "" for t in texts]))
    assert windows.pack_in_order(docs.where("false")).count() == 0


def test_ordered_packing_small_capacity(spark):
    texts = dict(enumerate(sample_texts(spark, 20)))
    rows = windows.pack_in_order(brute.documents(spark, list(texts.values())).coalesce(1), capacity=64, block=500).collect()
    assert check(rows, texts, 64) < 0.05
