import inspect
import random
import sys

import pyarrow as pa
import pytest

from lithograph.llm.common import components, giving_back, small_batches


def _least(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in list(root)}


def test_components(spark):
    draw = random.Random(1)
    cases = [
        [(i, i + 1) for i in range(60)],
        [(60 - i, 61 - i) for i in range(0, 60, 2)] + [(i, 100) for i in range(20)],
        [(draw.randrange(-80, 80), draw.randrange(-80, 80)) for _ in range(70)],
        [(5, 5)],
        [],
    ]
    for edges in cases:
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == _least([e for e in edges if e[0] != e[1]])


def test_small_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 5, None, "", "b" * 50, "c", "d" * 9])], names=["text"])
    parts = list(small_batches(iter([batch, batch.slice(0, 0)]), most_bytes=10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 2


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


@pytest.mark.skipif(sys.platform != "linux", reason="the GNU C library's free memory")
def test_free_memory_goes_back():
    def leave_free():
        held = [b"x" * (1000 + i % 7) for i in range(100_000)]
        return held[-1000:]  # above the others, so that the heap does not shrink by itself

    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"])], names=["text"])
    for ends in (lambda: list(small_batches(iter([batch]))), lambda: giving_back(lambda rows: rows)(batch)):
        top = leave_free()
        before = _resident()
        ends()
        assert before - _resident() > 50_000_000 and len(top) == 1000


def test_giving_back_keeps_arguments():
    @giving_back
    def both(name, rows, replies):
        return rows + replies

    assert inspect.getfullargspec(both).args == ["name", "rows", "replies"] and both(0, 1, 2) == 3
