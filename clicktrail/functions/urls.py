"""URL functions: decoding (F1), page key (F19) and referer key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_decode(c: Column) -> Column:
    """percent- and '+'-decoding; malformed input gives NULL instead of failing the job."""
    return F.call_function("try_url_decode", c)


def join_path(path: Column, part: Column) -> Column:
    """``os.path.join(path, part)`` for two components.

    A part that starts with '/' replaces the path; an empty path yields the
    part; otherwise exactly one '/' separates them (so an empty part leaves a
    trailing '/'). NULL in, NULL out.
    """
    return (
        F.when(path.isNull() | part.isNull(), F.lit(None).cast("string"))
        .when(part.startswith("/"), part)
        .when(path == "", part)
        .when(path.endswith("/"), F.concat(path, part))
        .otherwise(F.concat(path, F.lit("/"), part))
    )


def page_key(uri_path: Column, uri_query: Column, normalize: bool = False) -> Column:
    """key of the page a request shows: its path joined with its query.

    ``normalize=True`` drops a leading '?' of the query and decodes the path,
    so page and referer keys of the same page can meet.
    """
    if normalize:
        q = F.regexp_replace(uri_query, r"^\?", "")
        return join_path(F.coalesce(url_decode(uri_path), uri_path), q)
    return join_path(uri_path, uri_query)


def referer_path(referer: Column) -> Column:
    """Path of a URL without ';params' of its last segment; '' when absent or unparsable."""
    path = F.coalesce(F.call_function("try_parse_url", referer, F.lit("PATH")), F.lit(""))
    # keep the text before the first ';' that follows the last '/'
    return F.regexp_replace(path, r";[^/]*$", "")


def referer_query(referer: Column) -> Column:
    return F.coalesce(F.call_function("try_parse_url", referer, F.lit("QUERY")), F.lit(""))


def referer_key(referer: Column, normalize: bool = False) -> Column:
    """key of the page a referer URL points to (its host is ignored)."""
    path = referer_path(referer)
    if normalize:
        path = F.coalesce(url_decode(path), path)
    return join_path(path, referer_query(referer))
