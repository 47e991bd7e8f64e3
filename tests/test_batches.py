"""Python tasks hold portions of a batch, whatever its size."""

import pyarrow as pa
import pytest

from skein.functions.batches import TEXT_AT_ONCE, texts
from skein.operators import chunking
from skein.operators.compress import compress_code, compressed

#: A batch of 24 texts of a third of a portion each, one null, one empty, one longer than a portion.
TEXTS = [*("line of a text\n" * (TEXT_AT_ONCE // 45) for _ in range(24)), None, "", "x" * (2 * TEXT_AT_ONCE)]


class Held:
    """In place of files: keeps the function that a task would run."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self

    def withColumn(self, *named):  # noqa: N802
        return self


def test_portions_keep_all_rows_in_order():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["k", "text"])
    parts = list(texts(iter([batch, batch.slice(0, 0)]), "text"))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(len(TEXTS)))
    assert max(p.num_rows for p in parts[:-1]) <= 5 and len(parts) >= 9
    assert [p.num_rows for p in texts(iter([batch.slice(24, 2)]), "text")] == [2]


@pytest.mark.parametrize("operator", [chunking.chunk_files, chunking.split_documents, chunking.build_symbols])
def test_scanners_give_back_a_portion_at_a_time(spark, operator):
    batch = pa.RecordBatch.from_arrays([pa.array(range(27)), pa.array([str(k) for k in range(27)]), pa.array(["csharp" if operator is chunking.build_symbols else "markdown"] * 27), pa.array(["class A { int F() { return 1; } int G() { return 2; } }" + (x or "") for x in TEXTS])], ["id", "path", "language", "content"])
    found = list(operator(Held()).run(iter([batch])))
    key = found[0].schema.names[0]
    assert [int(k) for b in found for k in dict.fromkeys(b.column(key).to_pylist())] == list(range(27))
    assert max(len(set(b.column(key).to_pylist())) for b in found) <= 5


def test_compressed_gives_back_a_portion_at_a_time():
    found = list(compressed.func(iter([(pa.array(TEXTS), pa.array(["a.B()"] * 26 + [None]))])))
    assert max(map(len, found)) <= 5 and [x for part in found for x in part.to_pylist()] == [compress_code(t, "a.B()") for t in TEXTS]


def test_an_index_task_holds_few_arrays():
    """numbers a word of a portion that are held at once."""
    import tracemalloc

    import numpy as np

    from skein.operators import postings

    n, per = 2000, 500
    words = pa.array([f"w{k}" for k in (np.arange(n * per) * 7919 % 30011) % 9001])
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([k % 1024 for k in range(n)], pa.int32()), pa.ListArray.from_arrays(pa.array(range(0, n * per + 1, per), pa.int32()), words)], ["id", "block", "words"])
    tracemalloc.start()
    found = sum(sum(map(len, b.column("places").to_pylist())) for b in list(postings.places(iter([batch.slice(0, 1)]))))
    tracemalloc.reset_peak()
    for _ in postings.places(iter([batch])):
        break
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == per and peak < 70 * n * per, peak / n / per
