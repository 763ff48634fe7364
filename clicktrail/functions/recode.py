"""Survey answer recoding and level lists."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clicktrail.sources import adapters as A

# ---------------------------------------------------------------------------
# Answer text -> short code for the three questions, the
# column names of the raw export, and the level lists of the coded data.
# Order of MOTIVATION_CODES is the order the texts are replaced in.
# ---------------------------------------------------------------------------
DEPTH_CODES = {
    A.A_FACT: "fact",
    A.A_OVERVIEW: "overview",
    A.A_INDEPTH: "in-depth",
    "no_response": "no response",
}
PRIOR_CODES = {
    A.A_FAMILIAR: "familiar",
    A.A_UNFAMILIAR: "unfamiliar",
    "no_response": "no response",
}
MOTIVATION_CODES = [
    (A.A_WORK, "work/school"),
    (A.A_DECISION, "personal decision"),
    (A.A_EVENT, "current event"),
    (A.A_MEDIA, "media"),
    (A.A_CONVERSATION, "conversation"),
    (A.A_BORED, "bored/random"),
    ("no_response", "no response"),
    (A.A_INTRINSIC, "intrinsic learning"),
]
MOTIVATION_LEVELS = [v for _, v in MOTIVATION_CODES]
RAW_COLUMNS = {
    A.Q_TIMESTAMP: "submit_timestamp",
    A.Q_DEPTH: "raw_information_depth",
    A.Q_PRIOR: "raw_prior_knowledge",
    A.Q_MOTIVATION: "raw_motivation",
    A.Q_TOKEN: "token",
}
# levels of the coded export used by the answer browser (values off the list become NULL)
APP_LEVELS = {
    "Information_Need": ["fact", "overview", "in-depth", "other", "no_response"],
    "Prior_Knowledge": ["familiar", "unfamiliar", "other", "no_response"],
    "Motivation": [
        "work/school", "personal_decision", "current_event", "media", "conversation",
        "bored/curios/random", "other", "no_response",
    ],
}
# motivations counted by the any-mention distribution
MENTION_LEVELS = [
    "work/school", "personal decision", "current event", "media", "conversation",
    "bored/random", "no response", "intrinsic learning", "other",
]


def _map_lit(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def recode_host(h: Column) -> Column:
    """wiki host -> 'mobile' / 'desktop' / NULL."""
    return F.when(h == A.MOBILE_HOST, F.lit("mobile")).when(h == A.DESKTOP_HOST, F.lit("desktop"))


def recode_with(d: dict[str, str], c: Column) -> Column:
    """dictionary lookup with 'other' for unknown answers."""
    return F.coalesce(F.try_element_at(_map_lit(d), c), F.lit("other"))


def recode_depth(c: Column) -> Column:
    return recode_with(DEPTH_CODES, c)


def recode_prior(c: Column) -> Column:
    return recode_with(PRIOR_CODES, c)


def recode_motivation(c: Column) -> Column:
    """multi-choice text -> sorted distinct array of codes.

    Texts are replaced by their codes first (answer texts contain ', '),
    then the string is split on ', '; parts that are not a code become
    'other'.
    """
    x = c
    for text, code in MOTIVATION_CODES:
        x = F.replace(x, F.lit(text), F.lit(code))
    levels = F.array(*[F.lit(v) for v in MOTIVATION_LEVELS])
    parts = F.split(x, ", ")
    coded = F.transform(parts, lambda p: F.when(F.array_contains(levels, p), p).otherwise(F.lit("other")))
    return F.array_sort(F.array_distinct(coded))


def join_codes(arr: Column) -> Column:
    """Array of codes -> the '|' joined text form of the exported data."""
    return F.array_join(arr, "|")


def split_codes(s: Column) -> Column:
    return F.split(s, r"\|")


def single_motivation(motivations: Column) -> Column:
    """The motivation when exactly one was given, else NULL."""
    return F.when(F.size(motivations) == 1, motivations[0])


def pair_label(motivations: Column, reverse: bool = False) -> Column:
    """canonical '|' label of a set of motivations (sorted, or reverse sorted)."""
    s = F.array_sort(motivations)
    return F.array_join(F.reverse(s) if reverse else s, "|")


def with_levels(df: DataFrame, col: str, levels: list[str], ordinal_col: str | None = None) -> DataFrame:
    """ordered factor: values off the list become NULL; optional 1-based ordinal column."""
    lv = F.array(*[F.lit(v) for v in levels])
    pos = F.array_position(lv, F.col(col))
    out = df.withColumn(col, F.when(pos > 0, F.col(col)))
    if ordinal_col:
        out = out.withColumn(ordinal_col, F.when(pos > 0, pos.cast("int")))
    return out
