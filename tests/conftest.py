import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tesserae.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tesserae-tests")


@pytest.fixture(scope="session")
def ring(spark):
    from tesserae.sources.keyring import keyring

    return keyring(spark)


@pytest.fixture(scope="session")
def blocks(spark):
    from tesserae.session import materialize
    from tesserae.sources.carriers import vector_blocks

    return materialize(vector_blocks(spark, DATA))


def make_blocks(spark, nrows, ncols, px_of, channels=1, block=8, owner="img", key_id=0):
    """A hand-made picture; px_of(ch, idx) gives the pixels of a block."""
    from tesserae.sources.carriers import owner_id
    from pyspark.sql import functions as F

    k = nrows * ncols
    rows = [
        (owner, key_id, 0, 0, nrows * block, ncols * block, block, k, ncols, ch, i, i // ncols, i % ncols, [int(v) for v in px_of(ch, i)])
        for ch in range(channels) for i in range(k)
    ]
    df = spark.createDataFrame(
        rows,
        "stem string, key_id int, label int, page bigint, height bigint, width bigint, block int, k bigint, ncols bigint, ch int, "
        "idx bigint, r bigint, c bigint, px array<int>",
    )
    return df.withColumn("owner_id", owner_id(F.col("stem"), F.col("height"), F.col("width"), F.col("block")))
