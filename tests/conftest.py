import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from clicktrail.session import get_spark

    folder = str(tmp_path_factory.mktemp("shared"))
    yield get_spark(master="local[4]", shuffle_partitions=4, app="clicktrail-tests", checkpoint_dir=folder)


def rows(df, *cols):
    """Collected rows as sorted tuples (optionally of selected columns)."""
    d = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in d.collect())
