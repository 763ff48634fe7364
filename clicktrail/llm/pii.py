"""Personal data: base patterns, and bootstrapped contextual extraction, in DataFrame functions only.

Base entities (``BASE``) are found by regular expressions and checked (parts
of an address at most 255, card digits by the Luhn sum, digit counts). They
are the seeds. The one and the two words before an entity that begins a word
are its *patterns*. Patterns that at least ``support`` different seeds share,
and that introduce a seed at least a tenth of the time (``share``), are chosen
first; every word that follows one of them, whatever its characters, is an
*instance* (without the quotes, brackets and stops around it). Spark scores the bipartite pattern-instance graph in rounds: a pattern's
confidence is the smoothed share of its occurrences whose instances are
believed; an instance is believed as far as its confident patterns make it
likely (noisy-or), times the share of all its occurrences in the table that
follow such a pattern, so that an everyday word is no identifier because it
once stood where one is expected. Believed instances after a confident pattern
become spans of kind ``id``. Base spans always stay.

Hot patterns: the graph is first summed to one row per (pattern, instance),
with partial sums in each task, and scores are sums over it, so a pattern with
a third of all occurrences costs its distinct instances.

Long texts: places are running sums of piece lengths, found by doubling
(``_running``), and texts are cut from chunks (``_part``), so a text costs its
length times the logarithm of its number of matches. The regular expressions
use possessive forms so that none is quadratic in a run; ``\\G`` lets a match
begin where the one before has ended.

Defined cases: null text has no spans; empty tables give no rows; repeated
rows each get their own spans; a text may be of any length; other columns are
not read. Words that hold the control character 1 are no instances.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns: kind, guard that is cheaper than the pattern, pattern, check on the match m.
BASE = [
    (
        "email",
        "contains(text, '@')",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
    ),
    (
        "ip",
        r"text rlike '[0-9]\\.[0-9]'",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"forall(split(m, '\\.'), p -> p rlike '^0*+([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$' or p rlike '^0+$')",
    ),
    (
        "card",
        r"text rlike '[0-9](?:[ -]?[0-9]){13}'",
        r"[0-9](?:[ -]?[0-9])++",
        "length(translate(m, ' -', '')) between 14 and 19 and aggregate(transform(sequence(1, length(translate(m, ' -', ''))),"
        " i -> cast(substring(translate(m, ' -', ''), -i, 1) as int) * if(i % 2 = 0, 2, 1)), 0, (a, x) -> a + if(x > 9, x - 9, x)) % 10 = 0",
    ),
    (
        "phone",
        "contains(text, '+')",
        r"\+[0-9][ ().0-9-]+[0-9]",
        "length(translate(m, '+ ().-', '')) between 10 and 15",
    ),
]
KINDS = [b[0] for b in BASE]
FOUND = "id"

CONTEXT_CHARS = 96
BEFORE = 24  # matches (of four characters or more) that the context of a base entity can reach back over
WORD = r"[^ \t-\r]++"
#: characters that are cut from the front and the end of an instance
OPENING, CLOSING = "\"'([<{", "\"')]>},.;:!?"
MASK = "\x01"  # stands for every character of a base span when words are read
CHUNK = 1024
SPAN = "struct<start:int,kind:int,end:int,value:string>"
SEED = "struct<start:int,kind:int,end:int,value:string,patterns:array<string>>"
#: a table of at most this many patterns or instances (of some hundred bytes each) is broadcast; beyond it joins shuffle
SMALL = 100_000


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(values: str, step: str) -> str:
    """SQL: running sums (or maxima, ...) of an array of int by doubling; ``step`` joins ``x`` with the earlier ``y``."""
    earlier = step.replace("y", "a[i - shiftleft(1, j)]")
    return (
        f"aggregate(sequence(0, 30), {values}, (a, j) -> if(size(a) <= shiftleft(1, j), a,"
        f" transform(a, (x, i) -> if(i >= shiftleft(1, j), {earlier}, x))))"
    )


def _placed(pattern: str, text: str, body: str) -> str:
    """SQL: ``body`` of ``g`` (texts between the matches of ``pattern``), ``h`` (the matches) and ``e`` (where they end, code points)."""
    p = _quoted(pattern)
    ends = _running("zip_with(slice(g, 1, size(h)), h, (u, v) -> length(u) + length(v))", "x + y")
    return _let("g", f"split({text}, {p}, -1)", _let("h", f"regexp_extract_all({text}, {p}, 0)", _let("e", ends, body)))


def _before(i: str) -> str:
    """SQL: the last ``CONTEXT_CHARS`` characters before match ``i``; ``t`` holds the end of each gap with its match."""
    return f"right(concat(array_join(slice(t, greatest(1, {i} - {BEFORE - 1}), least({i}, {BEFORE})), ''), right(g[{i}], {CONTEXT_CHARS})), {CONTEXT_CHARS})"


def _patterns_of(before: str) -> str:
    """SQL: the two words and the one word that end ``before``, in lower case; none unless a word begins after it."""
    words = r"regexp_extract_all(lower(b), '[^ \\t-\\r]++', 0)"
    both = "if(size(w) > 1, array(concat_ws(' ', w[size(w) - 2], w[size(w) - 1]), w[size(w) - 1]), w)"
    opened = f"trim(TRAILING {_quoted(OPENING)} FROM {before})"
    return _let("b", opened, f"if(b rlike '[ \\\\t-\\\\r]$', {_let('w', words, both)}, cast(array() as array<string>))")


def _base_sql(k: int) -> str:
    _, guard, pattern, check = BASE[k]
    none = f"cast(array() as array<{SEED}>)"
    # a valid match needs its check; failing matches are dropped and not tried again
    valid = f"filter(transform(h, (m, i) -> struct(i, m)), x -> exists(array(x.m), m -> {check}))"
    span = f"struct(e[x.i] - length(x.m) as start, {k} as kind, e[x.i] as end, x.m as value, {_patterns_of(_before('x.i'))} as patterns)"
    tails = f"zip_with(slice(g, 1, size(h)), h, (u, v) -> right(concat(u, v), {CONTEXT_CHARS}))"
    return f"if(coalesce({guard}, false), {_placed(pattern, 'text', _let('t', tails, f'transform({valid}, x -> {span})'))}, {none})"


def base_spans() -> Column:
    """Checked base entities of column ``text``, as array of (start, kind number, end, value, patterns), by start, then kind."""
    return F.array_sort(F.concat(*[F.expr(_base_sql(k)) for k in range(len(BASE))]))


def _part(at: str, n: str) -> str:
    """SQL: ``n`` characters of the text from place ``at``, out of its chunks ``c``."""
    first, into = f"cast({at} div {CHUNK} as int)", f"({at} - ({at} div {CHUNK} + j) * {CHUNK})"
    count = f"cast(greatest(0, ({at} + {n} + {CHUNK - 1}) div {CHUNK} - {at} div {CHUNK}) as int)"
    cut = f"substring(s, cast(greatest({into}, 0) + 1 as int), cast(least({CHUNK}, {into} + {n}) - greatest({into}, 0) as int))"
    return f"array_join(transform(slice(c, {first} + 1, {count}), (s, j) -> {cut}), '')"


def _rewritten(spans: str, label: str, again: str) -> str:
    """SQL: ``text`` with each of the sorted ``spans`` replaced by ``label`` (of ``x`` and ``f``, where it begins to count),
    or by ``again`` where it goes on from one before it; spans inside others are gone."""
    ends = _running("transform(s, x -> x.end)", "greatest(x, y)")
    piece = _let("f", "if(i > 0, r[i - 1], 0)", f"struct(f as at, greatest(x.start - f, 0) as n, if(x.end <= f, '', if(x.start < f, {again}, {label})) as label)")
    cut = f"concat(array_join(transform(transform(s, (x, i) -> {piece}), p -> concat({_part('p.at', 'p.n')}, p.label)), ''), {_part('z.at', 'z.n')})"
    tail = _let("z", "struct(r[size(r) - 1] as at, length(text) - r[size(r) - 1] as n)", cut)
    chunks = f"regexp_extract_all(text, '(?s).{{1,{CHUNK}}}', 0)"
    return f"if(size({spans}) = 0, text, {_let('s', spans, _let('r', ends, _let('c', chunks, tail)))})"


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("base", F.coalesce(base_spans(), F.expr(f"cast(array() as array<{SEED}>)")))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, base`` per row: the base spans with their patterns."""
    return _rows(docs).select("doc_id", F.xxhash64("text").alias("row_key"), "base")


def seed_edges(scanned: DataFrame) -> DataFrame:
    """Edges ``pattern, instance, n`` of the base entities: how often a pattern introduces one."""
    each = scanned.select(F.explode("base").alias("x")).select(F.explode("x.patterns").alias("pattern"), F.lower("x.value").alias("instance"))
    return each.groupBy("pattern", "instance").agg(F.count("*").alias("n"))


def _sized(table: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def words(docs: DataFrame, placed: bool = False) -> DataFrame:
    """The words of all texts, base spans masked: ``instance`` (lower case, without what surrounds it), ``one`` and ``two``, the
    words before it, and, if ``placed``, ``doc_id, row_key, start, end, value``."""
    masked = _rewritten("base", f"repeat('{MASK}', x.end - x.start)", f"repeat('{MASK}', x.end - f)")
    rows = _rows(docs).select("doc_id", F.xxhash64("text").alias("row_key"), F.expr(masked).alias("text"))
    near = "if(i > 0, h[i - 1], '') as p1, if(i > 1, h[i - 2], '') as p2"
    if placed:
        found = _placed(WORD, "text", f"transform(h, (m, i) -> struct(m, e[i] - length(m) as at, {near}))")
    else:
        found = _let("h", f"regexp_extract_all(text, {_quoted(WORD)}, 0)", f"transform(h, (m, i) -> struct(m, {near}))")
    each = rows.select("doc_id", "row_key", F.explode(F.expr(found)).alias("x")).where(f"instr(x.m, '{MASK}') = 0")
    cut = f"trim(LEADING {_quoted(OPENING)} FROM x.m)"
    value = f"trim(TRAILING {_quoted(CLOSING)} FROM {cut})"
    before = [F.lower("x.p1").alias("one"), F.lower(F.when(F.col("x.p2") != "", F.concat_ws(" ", "x.p2", "x.p1"))).alias("two")]
    if not placed:
        return each.select(F.lower(F.expr(value)).alias("instance"), *before).where("instance != ''")
    start = F.expr(f"x.at + length(x.m) - length({cut})")
    out = each.select("doc_id", "row_key", F.expr(value).alias("value"), start.alias("start"), *before).where("value != ''")
    return out.withColumns({"instance": F.lower("value"), "end": F.col("start") + F.length("value")})


def _after(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """``words`` that follow one of ``patterns``, once for each: column ``pattern``. All but a few words leave before they move."""
    last = _sized(patterns.select(F.substring_index("pattern", " ", -1).alias("one")).distinct().checkpoint())
    near = found.join(last, "one", "left_semi")
    each = near.withColumn("pattern", F.explode(F.array_compact(F.array("one", "two")))).drop("one", "two")
    return each.join(_sized(patterns), "pattern", "left_semi")


def supported_patterns(docs: DataFrame, seeds: DataFrame, support: int, share: float = 0.1) -> DataFrame:
    """``pattern`` of those that at least ``support`` different seeds share and that introduce a seed at least ``share`` of the time.

    The second count keeps everyday words out of the graph: followed by some
    seeds, but nearly always by something else. It is summed in each task, so
    only one row per pattern and task moves.
    """
    enough = seeds.groupBy("pattern").agg(F.count("*").alias("k"), F.sum("n").alias("s")).where(F.col("k") >= support).checkpoint()
    if enough.isEmpty():
        return enough.select("pattern")
    others = _after(words(docs), enough.select("pattern")).groupBy("pattern").agg(F.count("*").alias("o"))
    kept = enough.join(others, "pattern", "left").where(F.col("s") >= share * (F.col("s") + F.coalesce("o", F.lit(0))))
    return kept.select("pattern")


def graph(docs: DataFrame, seeds: DataFrame, patterns: DataFrame) -> DataFrame:
    """Edges ``pattern, instance, n, seed, total`` of the chosen patterns: base entities, and every word that follows one.

    ``total`` is how often an instance stands in the whole table, after any word.
    """
    known = seeds.join(patterns, "pattern", "left_semi").select("pattern", "instance", "n", F.lit(True).alias("seed"))
    other = _after(words(docs), patterns).groupBy("pattern", "instance").agg(F.count("*").alias("n")).withColumn("seed", F.lit(False)).checkpoint()
    totals = words(docs).groupBy("instance").agg(F.count("*").alias("total"))
    return known.withColumn("total", F.col("n")).unionByName(other.join(totals, "instance"))


def score(edges: DataFrame, rounds: int = 3, support: int = 5, confident: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """After ``rounds`` of scoring: the confident patterns ``pattern, confidence`` and the believed instances ``instance, belief``.

    confidence = sum over instances of ln(1 + n) * belief / (sum of ln(1 + n) + smooth),
    smooth such that ``support`` seeds seen once and nothing else just reach
    ``confident``. A seed's belief is 1, another instance's is
    (1 - prod(1 - confidence)) over its confident patterns, times the share of its
    occurrences that follow them.
    """
    smooth = support * math.log(2) * (1 - confident) / confident
    sure = confident - 1e-9
    belief = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    patterns = None
    for _ in range(rounds):
        weight = F.log1p("n")
        patterns = (
            edges.join(belief, "instance")
            .groupBy("pattern")
            .agg((F.sum(weight * F.col("belief")) / (F.sum(weight) + smooth)).alias("confidence"))
            .where(F.col("confidence") >= sure)
            .checkpoint()
        )
        # an occurrence counts under its one word and its two: the larger of both sums never counts one twice
        inside = [F.sum(F.when(F.col("confidence").isNotNull() & (F.contains("pattern", F.lit(" ")) == two), F.col("n")).otherwise(0)) for two in (False, True)]
        likely = 1 - F.exp(F.sum(F.log(1 - F.least(F.coalesce("confidence", F.lit(0.0)), F.lit(0.999)))))
        belief = (
            edges.join(patterns, "pattern", "left")
            .groupBy("instance")
            .agg(F.greatest(F.max(F.col("seed").cast("double")), likely * F.least(F.lit(1.0), F.greatest(*inside) / F.max("total"))).alias("belief"))
            .checkpoint()
        )
    return patterns.select("pattern", "confidence"), belief.where(F.col("belief") >= sure)


def discover(docs: DataFrame, patterns: DataFrame, believed: DataFrame) -> DataFrame:
    """Believed instances after a confident pattern: ``doc_id, row_key, found`` (array of spans)."""
    near = _after(words(docs, placed=True), patterns)
    kept = near.join(_sized(believed.select("instance")), "instance", "left_semi")
    span = F.struct("start", F.lit(len(BASE)).alias("kind"), "end", "value")
    return kept.groupBy("doc_id", "row_key").agg(F.collect_set(span).alias("found"))


def find_spans(docs: DataFrame, rounds: int = 3, support: int = 5, confident: float = 0.8, share: float = 0.1) -> DataFrame:
    """``doc_id, row_key, base, spans`` for every row of ``docs`` (``doc_id, text``); ``spans`` holds the base and the discovered ones.

    Words are read only if some pattern has ``support`` seeds, the graph is made only if one keeps its ``share``, and words
    are placed only if one turns out to be confident.
    """
    scanned = scan(docs).checkpoint()
    plain = F.transform("base", lambda x: F.struct(*[x[c].alias(c) for c in ("start", "kind", "end", "value")]))
    left = scanned.select("doc_id", "row_key", plain.alias("base"))
    seeds = seed_edges(scanned).checkpoint()
    chosen = supported_patterns(docs, seeds, support, share).checkpoint()
    patterns = None
    if not chosen.isEmpty():
        patterns, believed = score(graph(docs, seeds, chosen).checkpoint(), rounds, support, confident)
    if patterns is None or patterns.isEmpty():
        return left.withColumn("spans", F.col("base"))
    more = discover(docs, patterns, believed)
    joined = left.alias("a").join(more.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.row_key = b.row_key"), "left")
    every = F.array_sort(F.concat("base", F.coalesce("found", F.expr(f"cast(array() as array<{SPAN}>)"))))
    return joined.select("a.doc_id", "a.row_key", "base", every.alias("spans"))


def as_text(spans: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in [*KINDS, FOUND]) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at({names}, x.kind + 1), x.start, x.end)), ',')")


def redact(docs: DataFrame, **scoring) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans are one, named after the first."""
    spans = find_spans(docs, **scoring).where(F.size("spans") > 0).select(F.col("doc_id").alias("_cut_id"), F.col("row_key").alias("_cut_key"), F.col("spans").alias("_cut_spans")).distinct()
    joined = docs.join(spans, F.expr("doc_id <=> _cut_id and xxhash64(cast(text as string)) = _cut_key"), "left")
    names = "array(" + ", ".join(f"'<{k}>'" for k in [*KINDS, FOUND]) + ")"
    cut = F.expr(_rewritten("_cut_spans", f"element_at({names}, x.kind + 1)", "''"))
    return joined.withColumn("text", F.when(F.col("_cut_key").isNotNull(), cut).otherwise(F.col("text"))).drop("_cut_id", "_cut_key", "_cut_spans")
