"""Registered queries of the training-data operators, one per operator, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from clicktrail.llm import ann, audit, chat, decontam, jaccard, manifest, packing, pii, quality, rollup, suffix, toxicity, windows
from clicktrail.sources import work

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(pattern: str) -> str:
    """DuckDB: the words of ``text`` after lower-casing A-Z."""
    return f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"


@query("op3_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


@query(
    "op9_benchmark_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {_words("[0-9a-z\\x{80}-\\x{10FFFF}]+")} AS w FROM documents),
    b AS (SELECT cast(item_id AS VARCHAR) AS item, {_words("[0-9a-z\\x{80}-\\x{10FFFF}]+")} AS w FROM benchmark WHERE item_id IS NOT NULL),
    sized AS (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM sized, range(1, len(w) - n + 2) r(i)),
    dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
           FROM d, (SELECT DISTINCT n FROM bw), range(1, len(w) - n + 2) r(i) WHERE len(w) >= n),
    hits AS (SELECT DISTINCT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
    covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY ALL),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
              FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY ALL)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
)
def benchmark_decontamination(spark, sf_dir):
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.judged(found).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    "op6_chat_formatting",
    """
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
        UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
    ), sized AS (
        SELECT *, sum(24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;'))
                      + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')))
                  OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           coalesce(sum(stop) FILTER (role = 'assistant'), 0)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def chat_formatting(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    return chat.digests(chat.render(turns.unionByName(probe)))


@query("op7_personal_data")
def personal_data(spark, sf_dir):
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.as_text("base"), 256).alias("base_sha256"), pii.as_text("spans").alias("spans"))


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def judged(scored: DataFrame, held_out, limit: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


@query("op4_quality_classifier")
def quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, "quality", remainder(5) != 0)
    return judged(quality.score(docs, model), remainder(5) == 0, 0.3)


@query("op8_toxicity")
def toxicity_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "toxic", remainder(3) != 1)
    return judged(toxicity.score(docs, model), remainder(3) == 1, 0.7)


@query("op10_nearest_neighbours")
def nearest_neighbours(spark, sf_dir):
    vectors = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, F.col("vec_id") % 100 == 0)


@query("op1_token_counts")
def token_counts(spark, sf_dir):
    """All documents are loaded with a quick estimate; exact counts revise it; later copies of a text are deleted and put back.

    The totals are those of every document.
    """
    folder = work.work_folder(spark, "token-rollup")
    counted = work.stored(rollup.count_tokens(table(spark, sf_dir, "documents")), f"{folder}/counted")
    changes = lambda rows, op, version, n: rows.select("doc_id", F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), F.col(n).alias("n_tokens"), F.lit(0).alias("seq"))
    rolled = rollup.TokenRollup(spark, f"{folder}/rollup")
    load = changes(counted, "insert", "byte_bpe_50k", "byte_bpe_50k").unionByName(changes(counted, "insert", "words", "space_pieces"))
    exact = changes(counted.where("words != space_pieces"), "revise", "words", "words")
    firsts = counted.groupBy("text_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = work.stored(firsts, f"{folder}/firsts")  # by itself, so that the join can be split where a text is hot
    copies = work.stored(counted.join(firsts, "text_hash").where("doc_id != first"), f"{folder}/copies")
    moved = lambda op: changes(copies, op, "byte_bpe_50k", "byte_bpe_50k").unionByName(changes(copies, op, "words", "words"))
    batches = (("1-load", load), ("2-exact-words", exact), ("3-copies", moved("delete")), ("4-copies-again", moved("insert")), ("2-exact-words", exact))
    for batch, rows in batches:
        rolled.apply(batch, rows)  # the last one is a replay and changes nothing
    return rolled.totals()


@query(
    "op5_ngram_jaccard_join",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_words("[^ \\x09-\\x0D]+")} AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
             FROM d, range(1, greatest(len(w) - 3, 1) + 1) r(i) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY ALL),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id
              JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
              GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id
    FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
    """,
)
def ngram_jaccard_join(spark, sf_dir):
    return jaccard.similar_components(table(spark, sf_dir, "documents"), jaccard.Jaccard(words=4, percent=85))


@query(
    "op2_suffix_array_dedup",
    """
    WITH t AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    strings AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM t, range(0, n - 99) r(i) WHERE n >= 100),
    later AS (SELECT doc_id, i FROM strings QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
    marked AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM later),
    numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
    spans AS (SELECT doc_id, g, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY ALL),
    gaps AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
    cut AS (SELECT doc_id, cast(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans, max(hi) AS last,
                   string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS kept
            FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
    FROM t LEFT JOIN cut USING (doc_id)
    """,
)
def suffix_array_dedup(spark, sf_dir):
    """The table in three batches by doc_id, a sixteenth, a sixteenth and the rest: the first two become one level before the third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    family = suffix.SuffixLevels(spark, work.work_folder(spark, "suffix-levels"))
    cuts = docs.approxQuantile("doc_id", [1 / 16, 1 / 8], 0.001)
    a, b = (int(x) for x in cuts) if cuts else (0, 0)
    key = F.col("doc_id")
    runs = None
    for batch in (docs.where(key.isNull() | (key <= a)), docs.where((key > a) & (key <= b)), docs.where(key > b)):
        found = family.add(batch, docs)
        runs = found if runs is None else runs.unionByName(found)
    return suffix.dedup_report(docs, runs)


def _manifest_sql(levels: int = 5, source_levels: int = 4) -> str:
    """DuckDB: leaves in windows, one aggregate a level (16^5 leaves a source, 16^4 sources), paths by left joins."""

    def grow(t: str, count: int) -> str:
        return ",\n".join(
            f"""{t}r{j} AS (SELECT k, n, i // 16 AS node, sha256(string_agg(h, '' ORDER BY i)) AS h, list(h ORDER BY i) AS hs FROM {t}n{j} WHERE n > 1 GROUP BY ALL),
    {t}n{j + 1} AS (SELECT k, (n + 15) // 16 AS n, node AS i, h FROM {t}r{j})"""
            for j in range(count)
        )

    def tops(t: str, count: int) -> str:
        return " UNION ALL ".join(f"SELECT k, h FROM {t}n{j} WHERE n = 1" for j in range(count + 1))

    def climb(t: str, begin: str, place: str, tree: str, count: int) -> str:
        steps = []
        for j in range(count):
            hs, at = f"{t}r{j}.hs", f"(b.{place} // {16**j}) % 16"
            before, after = f"array_to_string({hs}[1:{at}], '')", f"array_to_string({hs}[{at} + 2:], '')"
            steps.append(
                f"""{t}u{j + 1} AS (SELECT b.* REPLACE (CASE WHEN {hs} IS NULL THEN b.x ELSE sha256({before} || b.x || {after}) END AS x,
             b.proof || coalesce({before} || {after}, '') AS proof)
           FROM {begin if j == 0 else f"{t}u{j}"} b LEFT JOIN {t}r{j} ON {t}r{j}.k = b.{tree} AND {t}r{j}.node = b.{place} // {16 ** (j + 1)})"""
            )
        return ",\n".join(steps)

    fields = lambda text: " || ".join(
        f"coalesce(strlen(cast({c} AS VARCHAR)) || ':' || cast({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)
    )
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ids = "cast(doc_id AS VARCHAR)"
    # DuckDB has no crc32: bit by bit over the decimal digits, reflected polynomial 0xEDB88320
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({ids}, ''), lambda d: ascii(d)::BIGINT), lambda c, d: list_reduce([xor(c, d)] || range(8), lambda r, b: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384::BIGINT) ELSE r // 2 END)), 4294967295::BIGINT)"
    return f"""
    WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS k, sha256({fields("text")}) AS leaf,
                      CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND {crc} % 5 = 0 THEN sha256({fields(low)}) END AS altered FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d),
    an0 AS (SELECT k, n, i, leaf AS h FROM placed),
    {grow("a", levels)},
    subs AS (SELECT k AS source_key, h, row_number() OVER (ORDER BY encode(k)) - 1 AS j, count(*) OVER () AS n FROM ({tops("a", levels)})),
    bn0 AS (SELECT '' AS k, n, j AS i, h FROM subs),
    {grow("b", source_levels)},
    root AS ({tops("b", source_levels)}),
    start AS (SELECT p.doc_id, p.k, p.leaf, p.i, s.j, s.h AS subroot, '' AS top, coalesce(p.altered, p.leaf) AS x, '' AS proof FROM placed p JOIN subs s ON s.source_key = p.k),
    {climb("a", "start", "i", "k", levels)},
    {climb("b", f"au{levels}", "j", "top", source_levels)}
    SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = root.h AS verified
    FROM bu{source_levels}, root
    """


@query("op12_merkle_manifest", _manifest_sql())
def merkle_manifest(spark, sf_dir):
    proved = manifest.manifest(table(spark, sf_dir, "documents"), remainder(5) == 0, manifest.lowered())
    folded = manifest.folded(F.coalesce("altered", "leaf"), F.col("path"))
    shown = proved.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_ordered_packing")
def ordered_packing(spark, sf_dir):
    return windows.pack_in_order(table(spark, sf_dir, "documents"))


@query(
    "op11_filter_audit",
    """
    WITH marked AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
    m AS (SELECT part, doc_id, ((len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
             + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT)::INT AS mask FROM d),
    cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (coalesce(good, false)) AS good, count(*) FILTER (coalesce(bad, false)) AS bad
              FROM m LEFT JOIN marked USING (doc_id) GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT a.x || b.x || c.x || e.x || f.x AS filter_order FROM letters a, letters b, letters c, letters e, letters f
               WHERE len(list_distinct([a.x, b.x, c.x, e.x, f.x])) = 5),
    steps AS (SELECT filter_order, step::INT AS step, (1 << (instr('ABCDE', filter_order[step]) - 1))::INT AS own,
                     list_sum([0] || [1 << (instr('ABCDE', filter_order[j]) - 1) FOR j IN range(1, step)])::INT AS earlier FROM orders, range(1, 6) r(step))
    SELECT part, filter_order, step,
           coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & own > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
           coalesce(sum(bad) FILTER (mask & own > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
           coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own > 0), 0)::BIGINT AS shapley
    FROM cells, steps GROUP BY part, filter_order, step
    """,
)
def filter_audit(spark, sf_dir):
    return audit.report(audit.stream_counts(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels")))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
