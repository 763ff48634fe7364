import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from clicktrail.functions import temporal as TM
from clicktrail.operators import stats as ST


def test_beta_interval_known_quantiles(spark):
    # Beta(1,1): uniform; Beta(2,1): CDF x^2, quantile sqrt(p)
    counts = spark.createDataFrame([(0, 0), (1, 1)], "k long, n long")
    got = {r.k: (r.lower, r.upper) for r in ST.beta_interval(counts, "k", "n", draws=5000).collect()}
    assert got[0][0] == pytest.approx(0.025, abs=0.01) and got[0][1] == pytest.approx(0.975, abs=0.01)
    assert got[1][0] == pytest.approx(0.025 ** 0.5, abs=0.02) and got[1][1] == pytest.approx(0.975 ** 0.5, abs=0.01)


def test_beta_interval_independent_of_partitioning(spark):
    counts = spark.createDataFrame([(3, 10), (5, 7)], "k long, n long")
    a = rows(ST.beta_interval(counts, "k", "n", draws=500))
    b = rows(ST.beta_interval(counts.repartition(2), "k", "n", draws=500))
    assert a == b


def test_proportions_sum_to_one(spark):
    df = spark.createDataFrame([("x", "h1"), ("y", "h1"), ("y", "h2"), ("no response", "h2")], "x string, h string")
    p = ST.proportions(df, "x", "h").collect()
    by_h = {}
    for r in p:
        by_h[r.h] = by_h.get(r.h, 0) + r.proportion
    assert by_h == {"h1": pytest.approx(1.0), "h2": pytest.approx(1.0)}
    assert {r.x for r in p} == {"x", "y"}  # 'no response' dropped (P17)


def test_bernoulli_mean_equals_share(spark):
    df = spark.createDataFrame([("a", "h"), ("a", "h"), ("b", "h")], "x string, h string")
    e = ST.expand_bernoulli(ST.proportions(df, "x", "h"), "x", "h")
    means = {r.x: r.m for r in e.groupBy("x").agg(F.avg("in_data").alias("m")).collect()}
    assert means == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}


def test_pairs_symmetric_after_mirroring(spark):
    df = spark.createDataFrame([(["b", "a"],), (["a", "b"],), (["c", "a"],), (["a"],)], "motivation array<string>")
    pairs = ST.pair_counts(df)
    assert rows(pairs) == [("a", "b", 2), ("a", "c", 1)]
    m = {(r.m1, r.m2): r["count"] for r in ST.mirror_pairs(pairs).collect()}
    assert all(m[(a, b)] == m[(b, a)] for a, b in m)


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    h = ST.histogram(df, "v", bins=10).orderBy("bin").collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 2 and h[0].lower == 4.5 and h[-1].upper == 5.5


def test_mention_counts_include_zero_levels(spark):
    df = spark.createDataFrame([(["media"],), (["media", "other"],)], "motivation array<string>")
    got = {r.motivation: r["count"] for r in ST.mention_counts(df, ["media", "other", "bored/random"]).collect()}
    assert got == {"media": 2, "other": 1, "bored/random": 0}


def test_local_time(spark):
    zones = TM.known_zones(spark)
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 6, 23, 30), "Asia/Tokyo"), (dt.datetime(2024, 1, 1, 12), "Mars/Olympus_Mons")],
        "ts timestamp, tz string",
    )
    out = TM.with_local_time(df, "ts", F.col("tz"), zones).collect()
    assert len(out) == 1  # unknown zone dropped
    r = out[0]
    assert (r.local_hour_of_day, r.local_hour_of_day_div4, r.local_day_of_week, r.local_day_type) == (8, 8, 6, 1)
    lab = df.select(TM.hour_bucket_label(F.lit(13), 4), TM.day_name(F.col("ts"))).first()
    assert lab[0] == "12-16" and lab[1] == "Saturday"


def test_exact_quantiles_match_numpy(spark):
    import random

    import numpy as np

    rng = random.Random(23)
    data = [(g, float(rng.choice([rng.randrange(0, 50), rng.random() * 100]))) for g in "abc" for _ in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(data, "g string, y double")
    got = {r.g: (r.q1, r.med, r.q3) for r in ST.exact_quantiles(df, ["g"], "y", [0.25, 0.5, 0.75], ["q1", "med", "q3"]).collect()}
    for g in "abc":
        ys = [y for gg, y in data if gg == g]
        want = tuple(float(np.percentile(ys, p)) for p in (25, 50, 75))
        assert got[g] == pytest.approx(want)
    # the built-in exact percentile agrees as well
    builtin = {r.g: r.m for r in df.groupBy("g").agg(F.median("y").alias("m")).collect()}
    assert {g: v[1] for g, v in got.items()} == pytest.approx(builtin)


def test_bootstrap_interval_brackets_mean(spark):
    rows_ = [(i, "a" if i % 2 else "b", float(i % 17)) for i in range(400)]
    df = spark.createDataFrame(rows_, "id long, g string, y double")
    out = {r.g: r for r in ST.group_mean_ci(df, ["g"], "y", "id", boot=200).collect()}
    for r in out.values():
        assert r.ci_lower < r.mean < r.ci_upper and r.n == 200


def test_poisson_weights_of_digests_are_those_of_their_numbers(spark):
    """The hex digits that lie next to a threshold get the weight that their uniform gets."""
    edges = {int(t * 2**32) + d for t in ST.poisson1_cdf() for d in range(-2, 3)} | {0, 2**32 - 1}
    data = [(f"{b:08x}{tail * 24}", (b + 0.5) / 2**32) for b in edges if 0 <= b < 2**32 for tail in "0f"]
    df = spark.createDataFrame([*data, (None, None)], "h string, u double")
    got = df.select(ST.poisson1_from_md5(F.col("h")).alias("a"), ST.poisson1_from_uniform(F.col("u")).alias("b")).collect()
    assert len({r.a for r in got}) > 10 and all(r.a == r.b for r in got)


def test_bootstrap_rows_of_one_file_are_dealt_out(spark):
    """Draws are not made by as few tasks as the input has blocks: an exchange lies between the rows and the explode."""
    df = spark.range(100).selectExpr("id", "id % 2 AS g", "cast(id AS DOUBLE) AS y").coalesce(1)
    plan = ST.group_mean_ci(df, ["g"], "y", "id", boot=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan[plan.index("Generate explode"):]


def test_weights_made_as_arrays_are_those_of_the_digests():
    """Texts around every block boundary, and replicates of one to four digits that need one block more or not."""
    import hashlib

    import numpy as np

    from clicktrail.operators.draws import Weights

    bits = ST.poisson1_bits()
    for boot, lengths in ((1003, (0, 13, 51, 52, 53, 54, 55, 63, 64, 120)), (7, range(131))):
        weights = Weights(bits, boot)
        for length in lengths:
            text = np.random.default_rng(length).integers(0, 256, (weights.rows + 1 if boot > 7 else 2, length)).astype(np.uint8)
            got = np.full((len(text), boot), np.nan)
            for at, lo, hi, w in weights.tiles(text):
                got[at : at + len(w), lo:hi] = w
            for row, found in zip(text, got, strict=True):
                firsts = [int(hashlib.md5(row.tobytes() + str(b).encode()).hexdigest()[:8], 16) for b in range(1, boot + 1)]
                assert found.tolist() == [sum(x > k for k in bits) for x in firsts]


def test_weights_next_to_a_threshold():
    """A first half shared by both sides of a threshold is decided by the second half."""
    import numpy as np

    from clicktrail.operators.draws import Weights

    bits = ST.poisson1_bits()
    near = np.array(sorted({min(max(b + d, 0), 2**32 - 1) for b in bits for d in (-65_536, -1, 0, 1, 65_536)}), np.uint32)
    got = Weights(bits, 10)._weights(near.byteswap().reshape(1, -1))
    assert got[0].tolist() == [sum(int(x) > k for k in bits) for x in near]


def test_bootstrap_over_odd_rows_is_that_of_one_draw_a_row(spark):
    """NULL, empty, long and repeated row names, groups of any type, NULL, infinite and missing values: the same interval as
    from a weight per row and replicate; these are summed as arrays, not made one by one."""
    names = [None, "", "é", "x" * 45, "x" * 46, "y" * 70, "z" * 200, "same", "same", *map(str, range(95, 140))]
    inf, nan = float("inf"), float("nan")
    data = [(n, "a" if i % 2 else None, i % 3 / 2, float(i * i % 23)) for i, n in enumerate(names)]
    data += [("n1", "none", 0.0, None), ("n2", "none", 0.0, None), ("n3", "some", 0.0, None), ("n4", "some", -0.0, 3.0), ("n5", "some", 0.0, 4.0)]
    data += [("i1", "inf", nan, inf), ("i2", "inf", nan, 1.0), ("i3", "inf", nan, nan), (None, "late", 1.0, 2.0)]
    df = spark.createDataFrame(data, "id string, g string, h double, y double").selectExpr("id", "struct(g AS s, array(g, 'k') AS l) AS g", "h", "y")
    boot = 110
    weight = ST.poisson1_from_md5(F.md5(F.concat(F.lit("boot/"), "id", F.lit("/"), F.col("b").cast("string"))))
    pairs = df.crossJoin(spark.range(1, boot + 1).withColumnRenamed("id", "b").select("b")).withColumn("w", weight)
    means = pairs.groupBy("g", "h", "b").agg((F.sum(F.col("w") * F.col("y")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"), F.sum("w").alias("w"))
    want = means.where("w > 0").groupBy("g", "h").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    key = lambda r: (r.g.s, repr(r.h + 0.0))
    expected = {key(r): r.q for r in want.collect()}
    out = ST.group_mean_ci(df, ["g", "h"], "y", "id", boot=boot)
    got = {key(r): (r.ci_lower, r.ci_upper) for r in out.collect()}
    assert set(got) == set(expected) and len(got) == 10
    for k, q in expected.items():
        assert got[k] == (pytest.approx(q, nan_ok=True) if q is not None else (None, None)), k
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan[plan.index("Generate explode"):] and "md5" not in plan


def test_binned_bootstrap_agrees_with_rows(spark):
    """Random sums stand in for rows: the interval is as wide as the normal one, and draws do not follow the rows."""
    import numpy as np

    rng = np.random.default_rng(3)
    ys = rng.exponential(10.0, 20_000)
    data = [(i, "big", float(v)) for i, v in enumerate(ys)] + [(i, None, float(i)) for i in range(3)] + [(9, "empty", None), (10, "one", 5.0)]
    df = spark.createDataFrame(data, "id long, g string, y double")
    out = {r.g: r for r in ST.group_mean_ci_binned(df, ["g"], "y", "id", bins=1024, boot=400).collect()}
    want = 2 * 1.96 * ys.std() / len(ys) ** 0.5
    assert out["big"].mean == pytest.approx(ys.mean()) and out["big"].n == 20_000
    assert out["big"].ci_upper - out["big"].ci_lower == pytest.approx(want, rel=0.15)
    assert out["big"].ci_lower < out["big"].mean < out["big"].ci_upper
    assert (out[None].mean, out[None].n) == (1.0, 3) and 0 <= out[None].ci_lower <= out[None].ci_upper <= 2
    assert (out["empty"].mean, out["empty"].n, out["empty"].ci_lower) == (None, 0, None)
    assert (out["one"].mean, out["one"].ci_lower, out["one"].ci_upper) == (5.0, 5.0, 5.0)


def test_quantiles_by_narrowing_ranges(spark, monkeypatch):
    """With few values ranked at a time the ranges are narrowed over several rounds; results stay exact."""
    import random

    import numpy as np

    rng = random.Random(4)
    groups = {
        "wide": [rng.gauss(0, 1) ** 3 for _ in range(400)],
        "ties": [float(rng.randrange(6)) for _ in range(300)],
        "gap": [rng.random() for _ in range(50)] + [1e9 + rng.random() for _ in range(50)],
        "one": [7.0],
        None: [1.0, 2.0],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("empty", None)]
    df = spark.createDataFrame(data, "g string, y double")
    monkeypatch.setattr(ST, "QUANTILE_ROWS", 7)
    monkeypatch.setattr(ST, "QUANTILE_PARTS", 5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: list(r)[1:] for r in ST.exact_quantiles(df, ["g"], "y", probs, [f"q{i}" for i in range(5)]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(vs, probs)))
    box = {r.g: r for r in ST.box_summary(df, ["g"], "y").collect()}
    q1, q3 = np.quantile(groups["wide"], [0.25, 0.75])
    inside = [v for v in groups["wide"] if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (box["wide"].whisker_low, box["wide"].whisker_high) == (min(inside), max(inside))


def test_expansion_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ST, "EXPAND_BLOCK", 3)
    props = spark.createDataFrame([("a", "h", 4), ("b", "h", 7), ("a", "k", 1)], "x string, hue string, count long")
    got = ST.expand_bernoulli(props, "x", "hue").groupBy("x", "hue").agg(F.sum("in_data").alias("ones"), F.count("*").alias("n")).collect()
    assert sorted((r.x, r.hue, r.ones, r.n) for r in got) == [("a", "h", 4, 11), ("a", "k", 1, 1), ("b", "h", 7, 11)]
