"""What Python workers remember from task to task."""

import os
import uuid

import pyarrow as pa
import pytest

pytest.importorskip("conforank.llm")

from conforank.llm import common


def test_workers_make_their_own_thing_once(spark):
    @common.alone
    def thing(name):
        return name, os.getpid(), uuid.uuid4().hex

    own = thing("x")  # what the driver remembers does not travel

    def ask(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"here": [os.getpid()], "made": [thing("x")[1]], "tag": [thing("x")[2]]})

    rows = [r for _ in range(2) for r in spark.range(0, 32, 1, 32).mapInArrow(ask, "here long, made long, tag string").collect()]
    assert len(rows) == 64 and all(r.here == r.made != os.getpid() for r in rows)
    assert len({r.tag for r in rows}) == len({r.here for r in rows})
    assert thing("x") == own
    assert thing("y") != own and thing("x") != own  # one thing at a time
