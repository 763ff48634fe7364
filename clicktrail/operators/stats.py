"""Counts, shares and interval estimates.

Random draws (Beta intervals, bootstrap weights) are derived from md5 of a
text seed, so every engine and every partitioning produces the same numbers:
``u = (first 8 hex digits of md5(seed) + 0.5) / 2^32`` lies strictly in (0, 1).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clicktrail.operators.draws import replicate_sums
from clicktrail.operators.joins import key_of, null_safe_join
from clicktrail.operators.survey import NO_RESPONSE
from clicktrail.sources.work import stored, work_folder


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ---------------------------------------------------------------------------
# shares and counts
# ---------------------------------------------------------------------------
def share_within(df: DataFrame, n: str, by: Sequence[str], out: str = "proportion") -> DataFrame:
    """``n / sum(n)`` within each ``by`` group."""
    w = Window.partitionBy(*[_c(b) for b in by])
    return df.withColumn(out, (_c(n) / F.sum(_c(n)).over(w)).cast("double"))


def share_total(df: DataFrame, n: str, out: str = "proportion") -> DataFrame:
    """``n / sum(n)`` over all rows.

    The total is a global aggregate - exactly one row, so broadcasting it is
    safe - joined back on a constant key; the rows themselves stay where
    they are (a window without partitioning would move them all to one task).
    """
    total = df.agg(F.sum(_c(n)).alias("_total")).withColumn("_k", F.lit(1))
    return (
        df.withColumn("_k", F.lit(1))
        .join(F.broadcast(total), "_k")
        .withColumn(out, (_c(n) / F.col("_total")).cast("double"))
        .drop("_k", "_total")
    )


def value_counts(df: DataFrame, col: Column | str, name: str | None = None) -> DataFrame:
    """Rows per value (partial aggregation before the shuffle)."""
    c = _c(col) if isinstance(col, str) else col
    alias = name or (col if isinstance(col, str) else "value")
    return df.groupBy(c.alias(alias)).agg(F.count(F.lit(1)).alias("count"))


def value_shares(df: DataFrame, col: Column | str, name: str | None = None) -> DataFrame:
    """Rows per value and their share of all rows."""
    return share_total(value_counts(df, col, name), "count")


def share_of_external(counts: DataFrame, n: str, total: DataFrame, total_col: str = "n") -> DataFrame:
    """A10: ``n / total`` where the total is a one-row aggregate of another table (joined on a constant key)."""
    t = total.select(F.lit(1).alias("_k"), _c(total_col).alias("_total"))
    return (
        counts.withColumn("_k", F.lit(1))
        .join(F.broadcast(t), "_k")
        .withColumn("proportion", (_c(n) / F.col("_total")).cast("double"))
        .drop("_k", "_total")
    )


def freq_of_freq(df: DataFrame, key: Column | str) -> DataFrame:
    """How many keys occur once, twice, ... (``value_counts().value_counts()``)."""
    k = _c(key) if isinstance(key, str) else key
    per_key = df.groupBy(k.alias("_key")).agg(F.count(F.lit(1)).alias("occurrences"))
    return per_key.groupBy("occurrences").agg(F.count(F.lit(1)).alias("count"))


def length_distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows per text length."""
    return df.groupBy(F.length(_c(col)).alias("length")).agg(F.count(F.lit(1)).alias("count"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """O2/O3: first ``k`` rows by ``order`` (include a unique tie key in ``order``)."""
    return df.orderBy(*order).limit(k)


# ---------------------------------------------------------------------------
# motivations
# ---------------------------------------------------------------------------
def n_motivations_distribution(df: DataFrame, motivations: str = "motivation") -> DataFrame:
    """Answers per number of motivations, with shares."""
    c = df.groupBy(F.size(_c(motivations)).cast("int").alias("n_motivations")).agg(F.count(F.lit(1)).alias("count"))
    return share_total(c, "count")


def single_motivation_distribution(df: DataFrame, motivations: str = "motivation") -> DataFrame:
    """Distribution over motivations of answers that gave exactly one."""
    single = df.where(F.size(_c(motivations)) == 1).select(_c(motivations)[0].alias("motivation"))
    return share_total(value_counts(single, "motivation"), "count")


def mention_counts(df: DataFrame, levels: Sequence[str], motivations: str = "motivation") -> DataFrame:
    """For each level, answers that mention it (levels with no mention get 0), and share of mentions.

    One aggregate with a conditional count per level, then unpivoted: a
    single pass without an explode or a join.
    """
    aggs = [F.count_if(F.array_contains(_c(motivations), F.lit(lv))).alias(f"_m{i}") for i, lv in enumerate(levels)]
    wide = df.agg(*aggs)
    stack = "stack({n}, {args}) as (motivation, count)".format(
        n=len(levels), args=", ".join(f"'{lv}', _m{i}" for i, lv in enumerate(levels))
    )
    long = wide.selectExpr(stack).withColumn("count", F.col("count").cast("bigint"))
    return share_total(long, "count")


def pair_counts(df: DataFrame, motivations: str = "motivation") -> DataFrame:
    """Answers with exactly two motivations, counted per sorted pair (m1 < m2)."""
    two = df.where(F.size(_c(motivations)) == 2).select(F.array_sort(_c(motivations)).alias("_p"))
    return two.groupBy(F.col("_p")[0].alias("m1"), F.col("_p")[1].alias("m2")).agg(F.count(F.lit(1)).alias("count"))


def mirror_pairs(pairs: DataFrame) -> DataFrame:
    """Add each pair reversed, so the table is symmetric."""
    swapped = pairs.select(F.col("m2").alias("m1"), F.col("m1").alias("m2"), "count")
    return pairs.unionByName(swapped)


def cooccurrence_matrix(pairs: DataFrame, levels: Sequence[str]) -> DataFrame:
    """m1 x m2 count matrix over the mirrored pairs (one column per level)."""
    return mirror_pairs(pairs).groupBy("m1").pivot("m2", list(levels)).agg(F.sum("count"))


def pair_conditional(pairs: DataFrame) -> DataFrame:
    """P(m2 | m1) in long form from the mirrored pair counts."""
    return share_within(mirror_pairs(pairs), "count", ["m1"], out="p_m2_given_m1")


# ---------------------------------------------------------------------------
# two-way proportions
# ---------------------------------------------------------------------------
def proportions(
    df: DataFrame,
    x: str,
    hue: str,
    normx: bool = True,
    dropna_x: bool = True,
    dropna_hue: bool = True,
) -> DataFrame:
    """Counts per (x, hue) and the share within each hue (``normx=True``) or within each x.

    ``dropna_*`` remove 'no response' answers first (P17).
    """
    d = df
    if dropna_x:
        d = d.where(_c(x) != NO_RESPONSE)
    if dropna_hue:
        d = d.where(_c(hue) != NO_RESPONSE)
    counts = d.groupBy(_c(x).alias(x), _c(hue).alias(hue)).agg(F.count(F.lit(1)).alias("count"))
    return share_within(counts, "count", [hue] if normx else [x])


EXPAND_BLOCK = 100_000  # rows that one block of a cell expands to


def expand_bernoulli(props: DataFrame, x: str, hue: str, normx: bool = True) -> DataFrame:
    """One 1/0 row per answer: for cell (x, hue) ``count`` ones and ``n - count`` zeros, n the group size.

    The mean of ``in_data`` per cell equals the A20 share.
    """
    by = [hue] if normx else [x]
    w = Window.partitionBy(*[_c(b) for b in by])
    sized = props.withColumn("_n", F.sum("count").over(w))
    # a cell is dealt out in blocks, each expanded where it lands: no task and no array holds a whole cell
    block = F.lit(EXPAND_BLOCK)
    blocks = sized.select(
        _c(x).alias(x), _c(hue).alias(hue), "count", "_n",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / block))).alias("_b"),
    ).repartition(x, hue, "_b")
    last = F.least((F.col("_b") + 1) * block, F.col("_n"))
    rows = blocks.select(x, hue, "count", F.explode(F.sequence(F.col("_b") * block + 1, last)).alias("_i"))
    return rows.select(x, hue, (F.col("_i") <= F.col("count")).cast("int").alias("in_data"))


# ---------------------------------------------------------------------------
# Beta credible intervals
# ---------------------------------------------------------------------------
def md5_uniform(seed: Column, slot: int = 0) -> Column:
    """Uniform in (0, 1) from 32 bits of md5(seed): ``slot`` 0-3 picks which quarter of the digest."""
    return _hex_uniform(F.md5(seed), slot)


def _hex_uniform(digest: Column, slot: int) -> Column:
    bits = F.conv(F.substring(digest, 8 * slot + 1, 8), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(4294967296.0)


# Marsaglia-Tsang accepts at least 95% for shape >= 1, so 10 rejections in a row are about 1e-13; such a draw raises
GAMMA_ATTEMPTS = 10


def with_gamma_draw(df: DataFrame, out: str, shape: Column, seed: Column, attempts: int = GAMMA_ATTEMPTS) -> DataFrame:
    """Add ``out`` ~ Gamma(shape >= 1): the first accepted of ``attempts`` seeded Marsaglia-Tsang proposals.

    Each attempt hashes once (md5 of seed:attempt) and takes its three
    uniforms from separate 32-bit slices of the digest. The proposals are
    built in staged projections so every intermediate is computed once.
    """
    p = f"_{out}"
    d = df.withColumns({f"{p}d": shape - F.lit(1.0 / 3.0)})
    d = d.withColumns(
        {f"{p}c": F.lit(1.0) / F.sqrt(F.lit(9.0) * F.col(f"{p}d"))}
        | {f"{p}h{a}": F.md5(F.concat(seed, F.lit(f":{a}"))) for a in range(attempts)}
    )
    stage = {}
    for a in range(attempts):
        h = F.col(f"{p}h{a}")
        stage[f"{p}z{a}"] = F.sqrt(F.lit(-2.0) * F.log(_hex_uniform(h, 0))) * F.cos(
            F.lit(2.0 * math.pi) * _hex_uniform(h, 1)
        )
        stage[f"{p}u{a}"] = _hex_uniform(h, 2)
    d = d.withColumns(stage)
    d = d.withColumns({f"{p}t{a}": F.lit(1.0) + F.col(f"{p}c") * F.col(f"{p}z{a}") for a in range(attempts)})
    d = d.withColumns({f"{p}v{a}": F.col(f"{p}t{a}") * F.col(f"{p}t{a}") * F.col(f"{p}t{a}") for a in range(attempts)})
    vals = []
    for a in range(attempts):
        dd, z, v, u = F.col(f"{p}d"), F.col(f"{p}z{a}"), F.col(f"{p}v{a}"), F.col(f"{p}u{a}")
        accept = (v > 0) & (F.log(u) < F.lit(0.5) * z * z + dd - dd * v + dd * F.log(F.when(v > 0, v)))
        vals.append(F.when(accept, dd * v))
    none = F.raise_error(F.lit("all gamma proposals were rejected: raise GAMMA_ATTEMPTS")).cast("double")
    d = d.withColumns({out: F.coalesce(*vals, none)})
    return d.drop(*[c for c in d.columns if c.startswith(p)])


def _spread_draws(cells: DataFrame, draws: int) -> DataFrame:
    """One row per (cell, draw 1..draws), spread over the cluster.

    The cell table is tiny, so adaptive execution would put it in one
    partition and every draw in one task. Each cell is first cut into
    chunks that go round-robin to an explicit number of partitions (which
    adaptive coalescing leaves alone); draws are generated inside the chunks.
    """
    chunks = max(1, min(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), draws))
    per = -(-draws // chunks)
    spread = (
        cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_c"))
        .where(F.col("_c") * per < draws)
        .repartition(chunks)
    )
    first = F.col("_c") * per + 1
    last = F.least((F.col("_c") + 1) * per, F.lit(draws))
    return spread.select(*cells.columns, F.explode(F.sequence(first, last)).alias("_d"))


def beta_interval(
    counts: DataFrame,
    k: str,
    n: str,
    draws: int = 5000,
    level: float = 0.95,
    seed: str = "beta",
) -> DataFrame:
    """Equal-tailed credible interval of k successes in n trials, prior Beta(1, 1).

    Draws are rows (``explode(sequence)``) per distinct (k, n), so the cost
    depends on the number of cells, not on the data size. Adds ``lower`` and
    ``upper``. Beta(a, b) = X / (X + Y) with X ~ Gamma(a), Y ~ Gamma(b).
    """
    lo, hi = round((1 - level) / 2, 12), round(1 - (1 - level) / 2, 12)
    cells = counts.select(F.col(k).cast("bigint").alias("_k"), F.col(n).cast("bigint").alias("_nn")).distinct()
    base = F.concat(F.lit(seed), F.lit("/"), F.col("_k").cast("string"), F.lit("/"), F.col("_nn").cast("string"),
                    F.lit("/"), F.col("_d").cast("string"))
    drawn = _spread_draws(cells, draws)
    drawn = with_gamma_draw(drawn, "_x", (F.col("_k") + 1).cast("double"), F.concat(base, F.lit("/x")))
    drawn = with_gamma_draw(drawn, "_y", (F.col("_nn") - F.col("_k") + 1).cast("double"), F.concat(base, F.lit("/y")))
    q = drawn.groupBy("_k", "_nn").agg(
        F.percentile(F.col("_x") / (F.col("_x") + F.col("_y")), F.array(F.lit(lo), F.lit(hi))).alias("_q")
    )
    q = q.select("_k", "_nn", F.col("_q")[0].alias("lower"), F.col("_q")[1].alias("upper"))
    joined = counts.join(q, (counts[k].cast("bigint") == q["_k"]) & (counts[n].cast("bigint") == q["_nn"]), "left")
    return joined.drop("_k", "_nn")


def proportions_over_time(
    df: DataFrame, x: str, hue: str, draws: int = 5000, level: float = 0.95
) -> DataFrame:
    """Counts per (x, hue), share within each x, Beta interval and its distances from the share."""
    counts = df.groupBy(_c(x).alias(x), _c(hue).alias(hue)).agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(_c(x))
    counts = counts.withColumn("n", F.sum("count").over(w)).withColumn(
        "proportion", (F.col("count") / F.col("n")).cast("double")
    )
    out = beta_interval(counts, "count", "n", draws=draws, level=level)
    return out.withColumn("lower_err", F.col("proportion") - F.col("lower")).withColumn(
        "upper_err", F.col("upper") - F.col("proportion")
    )


# ---------------------------------------------------------------------------
# metrics by group
# ---------------------------------------------------------------------------
def poisson1_cdf() -> list[float]:
    """F(k) = e^-1 * sum_{i<=k} 1/i!, up to the last k below the largest uniform of 32 bits.

    The uniforms lie on the grid (i + 0.5) / 2^32, so no draw can be larger
    than the number of thresholds: nothing is cut off.
    """
    largest = 1 - 0.5 / 2**32
    cdf, term, acc, k = [], math.exp(-1.0), math.exp(-1.0), 0
    while acc < largest:
        cdf.append(acc)
        k += 1
        term /= k
        acc += term
    return cdf


def poisson1_from_uniform(u: Column) -> Column:
    """Inverse CDF of Poisson(1) with the thresholds of :func:`poisson1_cdf`."""
    expr, cdf = None, poisson1_cdf()
    for i, t in enumerate(cdf):
        expr = F.when(u <= F.lit(t), F.lit(i)) if expr is None else expr.when(u <= F.lit(t), F.lit(i))
    return expr.otherwise(F.lit(len(cdf)))


def poisson1_bits() -> list[int]:
    """The largest 32-bit numbers whose uniforms lie at or below the thresholds of :func:`poisson1_cdf`."""
    out = []
    for t in poisson1_cdf():
        bits = int(t * 2**32)
        while (bits + 0.5) / 2**32 > t:
            bits -= 1
        out.append(bits)
    return out


def poisson1_from_md5(digest: Column) -> Column:
    """:func:`poisson1_from_uniform` of the first 32 bits of a hex digest, without turning them into a number.

    u <= t where the bits are at most some integer; eight lower-case hex digits
    sort as the numbers they write, and a digest that starts with that integer
    sorts before the integer followed by a letter past f.
    """
    expr, found = None, poisson1_bits()
    for i, bits in enumerate(found):
        low = digest < F.lit(f"{bits:08x}g")
        expr = F.when(low, F.lit(i)) if expr is None else expr.when(low, F.lit(i))
    return expr.otherwise(F.lit(len(found)))


DRAWS = "_d array<struct<_b:int,_sw:double,_w:bigint>>"  # what replicate_sums adds to a group's key


def group_mean_ci(
    df: DataFrame,
    dims: Sequence[str],
    y: str,
    row_id: str,
    boot: int = 1000,
    level: float = 0.95,
    seed: str = "boot",
) -> DataFrame:
    """Mean of ``y`` per group and a Poisson-bootstrap interval.

    Each row gets a Poisson(1) weight per replicate from md5(seed, row, b);
    replicate means are sum(w*y)/sum(w). Rows are dealt out evenly before rows x
    replicates are generated, as a file of few blocks would be expanded by as
    few tasks. The draws, the same as ``poisson1_from_md5(md5(...))`` gives, are
    made and summed as arrays (:mod:`clicktrail.operators.draws`); the sums of
    some rows at a time are reduced in the same stage, so only group x replicate
    partial sums are shuffled.
    """
    lo, hi = round((1 - level) / 2, 12), round(1 - (1 - level) / 2, 12)
    dcols = [_c(d).alias(d) for d in dims]
    means = df.groupBy(*dcols).agg(F.avg(_c(y)).cast("double").alias("mean"), F.count(F.lit(1)).alias("n"))
    start = F.concat(F.lit(f"{seed}/"), _c(row_id).cast("string"), F.lit("/"))
    rows = df.select(*dcols, _c(y).cast("double").alias("_y"), start.alias("_id"))
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([*rows.drop("_y", "_id").schema.fields, *T.StructType.fromDDL(DRAWS).fields])
    bits = poisson1_bits()
    rep = rows.mapInArrow(lambda batches: replicate_sums(batches, dims, bits, boot), schema).select(*dims, F.explode("_d").alias("_d"))
    reps = (
        rep.groupBy(*dims, F.col("_d._b").alias("_b"))
        .agg(F.sum("_d._sw").alias("_sw"), F.sum("_d._w").alias("_w"))
        .where(F.col("_w") > 0)
        .select(*dims, (F.col("_sw") / F.col("_w")).alias("_m"))
    )
    ci = reps.groupBy(*dims).agg(F.percentile("_m", F.array(F.lit(lo), F.lit(hi))).alias("_q"))
    ci = ci.select(*dims, F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"))
    return null_safe_join(means, ci, list(dims), "left")


def group_mean_ci_binned(
    df: DataFrame,
    dims: Sequence[str],
    y: str,
    row_id: str,
    bins: int = 4096,
    boot: int = 1000,
    level: float = 0.95,
    seed: str = "boot",
) -> DataFrame:
    """A24 for any number of rows: the Poisson bootstrap over ``bins`` random sums of each group.

    Rows fall into bins by md5(seed, row) and are summed per (group, bin) in one
    aggregate; each bin, not each row, gets a Poisson(1) weight per replicate.
    The draws therefore number groups x bins x replicates, however many rows
    there are. Rows of one bin are weighted alike, which leaves the spread of the
    replicate means right on average; its relative error over the choice of
    bins is about sqrt(1 / (2 * bins)), 1.1 % of the interval's width for 4,096.
    A group with fewer rows than bins is resampled nearly row by row. NULLs in
    ``y`` are left out; a group without values has a NULL mean and interval.
    """
    lo, hi = round((1 - level) / 2, 12), round(1 - (1 - level) / 2, 12)
    digest = F.md5(F.concat(F.lit(f"{seed}/"), _c(row_id).cast("string")))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % bins
    summed = (
        df.select(key_of(dims).alias("_g"), _c(y).cast("double").alias("_y"), F.coalesce(place, F.lit(0).cast("bigint")).alias("_bin"))
        .groupBy("_g", "_bin")
        .agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"))
    )
    sums = stored(summed, f"{work_folder(df.sparkSession, 'bins')}/sums")
    means = sums.groupBy("_g").agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"), F.sum("_n").alias("n"))
    name = F.concat_ws("/", *[F.col(f"_g.k{i}").cast("string") for i in range(len(dims))])
    each = F.concat_ws("/", F.lit(seed), name, F.col("_bin").cast("string"), F.col("_b").cast("string"))
    reps = (
        # dealt out before the draws: the sums of few groups are one small file, which one task would expand
        sums.where("_n > 0").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(boot))).alias("_b"))
        .withColumn("_w", poisson1_from_uniform(md5_uniform(each)))
        .groupBy("_g", "_b")
        .agg(F.sum(F.col("_w") * F.col("_s")).alias("_sw"), F.sum(F.col("_w") * F.col("_n")).alias("_wn"))
        .where("_wn > 0")
    )
    q = reps.groupBy("_g").agg(F.percentile(F.col("_sw") / F.col("_wn"), F.array(F.lit(lo), F.lit(hi))).alias("_q"))
    return means.join(q, "_g", "left").select(
        *[F.col(f"_g.k{i}").alias(d) for i, d in enumerate(dims)], "mean", "n",
        F.col("_q")[0].alias("ci_lower"), F.col("_q")[1].alias("ci_upper"),
    )


QUANTILE_ROWS = 10_000  # distinct values around a quantile that are ranked in one window
QUANTILE_PARTS = 1024  # parts that a wider range of values is cut into


def exact_quantiles(df: DataFrame, dims: Sequence[str], y: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact linear-interpolation quantiles of ``y`` per group (same definition as ``percentile``)."""
    return _quantiles(_value_counts(df, dims, y), dims, probs, names)


def _value_counts(df: DataFrame, dims: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """``_g, _v, _c`` (and the dims): rows (or the sum of ``weight``) per group and value, counted in each task before the
    shuffle; written once."""
    each = F.col(weight) if weight else F.lit(1).cast("bigint")
    vals = df.select(key_of(dims).alias("_g"), _c(y).cast("double").alias("_v"), each.alias("_w")).where(F.col("_v").isNotNull())
    counts = vals.groupBy("_g", "_v").agg(F.sum("_w").alias("_c"))
    return stored(counts, f"{work_folder(df.sparkSession, 'values')}/counts")


def _quantiles(counts: DataFrame, dims: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Quantiles from counts per (group, value), without a sort or a window over a whole group.

    A quantile lies between two order statistics. Each is looked for in a range
    of values, at first its group's whole range. A range with more than
    ``QUANTILE_ROWS`` distinct values is cut into ``QUANTILE_PARTS`` equal parts;
    running counts over the parts (partial aggregates) say in which part the
    wanted rank falls, and that part is the next range. Only the values of the
    last range are ranked one by one.
    """
    folder = work_folder(counts.sparkSession, "quantiles")
    groups = counts.groupBy("_g").agg(
        F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_d")
    )
    side = lambda i, p, s: F.struct(
        F.lit(i).alias("i"), F.lit(s).alias("s"), (F.floor if s == 0 else F.ceil)(F.lit(float(p)) * (F.col("_n") - 1)).alias("r")
    )
    wanted = F.explode(F.array(*[side(i, p, s) for i, p in enumerate(probs) for s in (0, 1)]))
    state = stored(
        groups.select("_g", "_n", wanted.alias("_t"), "_lo", "_hi", F.lit(0).cast("bigint").alias("_below"), "_d"), f"{folder}/range"
    )
    target = ["_g", "_n", "_t"]

    def inside() -> DataFrame:
        return counts.join(state, "_g").where("_v between _lo and _hi")

    level = 0
    while (state.agg(F.max("_d")).first()[0] or 0) > QUANTILE_ROWS:
        width = F.col("_hi") - F.col("_lo")
        part = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * QUANTILE_PARTS), F.lit(QUANTILE_PARTS - 1))).otherwise(0)
        parts = (
            inside()
            .groupBy(*target, "_below", part.alias("_p"))
            .agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        )
        run = Window.partitionBy("_g", "_t").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_c").over(run), F.lit(0)))
        found = parts.where((F.col("_below") <= F.col("_t.r")) & (F.col("_t.r") < F.col("_below") + F.col("_c")))
        state = stored(found.select(*target, "_lo", "_hi", "_below", "_d"), f"{folder}/range{level}")
        level += 1
    run = Window.partitionBy("_g", "_t").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside().withColumn("_upto", F.col("_below") + F.sum("_c").over(run))
    # the first value whose running count passes the rank
    picked = ranked.where(F.col("_upto") > F.col("_t.r")).groupBy(*target).agg(F.min("_v").alias("_v"))
    at = lambda i, s: F.max(F.when((F.col("_t.i") == i) & (F.col("_t.s") == s), F.col("_v")))
    out = picked.groupBy("_g", "_n").agg(*[at(i, s).alias(f"_q{i}_{s}") for i in range(len(names)) for s in (0, 1)])
    cols = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_q{i}_0"), F.col(f"_q{i}_1")
        cols.append((low + (pos - F.floor(pos)) * (high - low)).cast("double").alias(name))
    return out.select(*[F.col(f"_g.k{i}").alias(d) for i, d in enumerate(dims)], *cols)


def group_median(df: DataFrame, dims: Sequence[str], y: str) -> DataFrame:
    """Exact median of ``y`` per group."""
    return exact_quantiles(df, dims, y, [0.5], ["median"])


def box_summary(df: DataFrame, dims: Sequence[str], y: str) -> DataFrame:
    """Quartiles and whiskers (most extreme values within 1.5 IQR of the box) per group, all from one table of value counts."""
    counts = _value_counts(df, dims, y)
    q = _quantiles(counts, dims, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    boxes = q.select(key_of(dims).alias("_g"), "q1", "median", "q3")
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("_v") >= F.col("q1") - 1.5 * iqr) & (F.col("_v") <= F.col("q3") + 1.5 * iqr)
    out = counts.join(boxes, "_g").groupBy("_g", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"), F.max(F.when(inside, F.col("_v"))).alias("whisker_high")
    )
    return out.select(*[F.col(f"_g.k{i}").alias(d) for i, d in enumerate(dims)], "q1", "median", "q3", "whisker_low", "whisker_high")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram between min and max (last bin closed), empty bins included.

    With min == max the range is widened by 0.5 on both sides.
    """
    v = df.select(_c(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    st = v.agg(F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    st = st.select(
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"),
    ).withColumn("_k", F.lit(1))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counts = (
        v.withColumn("_k", F.lit(1)).join(F.broadcast(st), "_k").groupBy(b.alias("bin")).agg(
            F.count(F.lit(1)).alias("count")
        )
    )
    edges = st.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.col("_lo"),
        F.col("_hi"),
    ).select(
        "bin",
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("bin") / F.lit(float(bins))).alias("lower"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("bin") + 1) / F.lit(float(bins))).alias("upper"),
    )
    return edges.join(counts, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )


def metric_breakdowns(df: DataFrame, metrics: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """``metric, dimension, value, n, mean, median`` of each metric per value of each dimension.

    The rows are read by one aggregate, which counts the cells of equal metrics
    and dimensions; cells, not rows, are turned to (metric, dimension, value,
    y), one for each pair of a metric and a dimension, and added up; all three
    figures come from these counts. Missing and 'no response' values are dropped
    per dimension, like the plots.
    """
    m = [f"_m{i}" for i in range(len(metrics))]
    d = [f"_d{i}" for i in range(len(dims))]
    cells = df.groupBy(
        *[_c(n).cast("double").alias(c) for n, c in zip(metrics, m)], *[_c(n).cast("string").alias(c) for n, c in zip(dims, d)]
    ).agg(F.count(F.lit(1)).alias("_n"))
    pairs = lambda names, cols: F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("v")) for n, c in zip(names, cols)]))
    long = (
        cells.select(pairs(metrics, m).alias("_m"), *d, "_n")
        .select("_m", pairs(dims, d).alias("_d"), "_n")
        .select(F.col("_m.name").alias("metric"), F.col("_d.name").alias("dimension"), F.col("_d.v").alias("value"), F.col("_m.v").alias("y"), "_n")
        .where(F.col("value").isNotNull() & (F.col("value") != NO_RESPONSE))
    )
    by = ["metric", "dimension", "value"]
    counts = _value_counts(long, by, "y", "_n")
    stats = counts.groupBy("_g").agg(F.sum("_c").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"))
    stats = stats.select(*[F.col(f"_g.k{i}").alias(c) for i, c in enumerate(by)], "n", "mean")
    return stats.join(_quantiles(counts, by, [0.5], ["median"]), by)


def answer_counts(df: DataFrame, questions: Sequence[str]) -> DataFrame:
    """(question, answer, count) for each question column, via one unpivot."""
    long = df.select(*[_c(q).cast("string").alias(q) for q in questions]).unpivot(
        [], list(questions), "question", "answer"
    )
    return long.groupBy("question", "answer").agg(F.count(F.lit(1)).alias("count"))


def compare_conditionings(
    df: DataFrame, questions: Sequence[str], first: dict[str, str], second: dict[str, str]
) -> DataFrame:
    """Answer counts and shares under two conditionings (P23), side by side (full outer join)."""
    from clicktrail.operators.survey import condition_on

    def counted(cond, tag):
        c = answer_counts(condition_on(df, **cond), questions)
        c = share_within(c, "count", ["question"])
        return c.select("question", "answer", F.col("count").alias(f"count_{tag}"), F.col("proportion").alias(f"share_{tag}"))

    a, b = counted(first, "1"), counted(second, "2")
    return a.join(b, ["question", "answer"], "full_outer").fillna(0, subset=["count_1", "count_2", "share_1", "share_2"])
