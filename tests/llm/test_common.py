"""Sums of many tasks, added in two levels."""

import numpy as np
import pytest

from loquat.llm import common


@pytest.mark.parametrize("together", [1, 4, 256])
@pytest.mark.parametrize("dtype", ["<i8", "<f8"])
def test_sums_of_many_tasks(spark, monkeypatch, together, dtype):
    monkeypatch.setattr(common, "TASKS_ADDED", together)
    blocks, size, tasks = 8, 64, 40

    def counted(batches):
        sums = np.zeros(size, np.int64)
        for rows in batches:
            for k in rows.column(0).to_pylist():
                sums[k % 24] += k  # the last blocks stay empty
        block, packed = common.pack_blocks(sums, blocks, dtype)
        if len(block):
            yield common.batch(block=block, sums=packed)

    parts = spark.range(0, 5000, 1, tasks).mapInArrow(counted, "block int, sums binary")
    got = common.add_blocks(parts, blocks, size, dtype)
    want = np.zeros(size, np.int64)
    np.add.at(want, np.arange(5000) % 24, np.arange(5000))
    assert got.dtype == np.dtype(dtype) and (got == want).all()


def test_no_sums(spark):
    parts = spark.createDataFrame([], "block int, sums binary")
    assert not common.add_blocks(parts, 4, 16).any()
