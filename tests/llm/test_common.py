"""What Python workers keep between tasks."""

import time

import pyarrow as pa
import pytest

from stratus.llm import common

NAMES = ["id"]


def _fill(batches):
    common.worker_state("of test_common", lambda: [1])
    time.sleep(0.1)
    yield from batches


def _look(batches):
    for batch in batches:
        kept = "of test_common" in common._kept
        yield pa.RecordBatch.from_arrays([pa.array([int(kept)] * batch.num_rows, pa.int64())], NAMES)


@pytest.mark.parametrize("keep", [False, True])
def test_tidy_gives_back_what_the_worker_kept(spark, keep):
    rows = spark.range(0, 160, 1, 16)

    def kept():
        return sum(r.id for r in rows.mapInArrow(_look, "id long").collect())
    assert rows.mapInArrow(common.tidy(_fill, keep=keep), "id long").count() == 160
    assert (kept() > 0) == keep
    rows.mapInArrow(common.tidy(_fill), "id long").count()
    assert kept() == 0
