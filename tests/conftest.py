import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from paperloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="4", partitions=4)


def uid(n: int) -> str:
    h = f"{n:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def bodies(spark, docs):
    """Documents as a frame of JSON text."""
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "line_pos BIGINT, body STRING").selectExpr(
        "'f' AS file_path", "0L AS block_start", "line_pos", "body"
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())
