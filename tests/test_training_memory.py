"""Training works on chunks of a bounded number of symbols, and holds the rows of one chunk at a time."""

import pyarrow as pa

from quillmill.operators import bpe_training


def test_a_task_holds_one_chunk():
    def batches():
        for _ in range(40):
            words = pa.array([[300] * 50] * 4000, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([words, pa.array([1] * 4000, pa.int64())], names=["symbols", "n"])

    before, symbols = pa.total_allocated_bytes(), 0
    for words, counts in bpe_training._chunks(batches()):
        assert len(words) == len(counts)
        symbols += len(words.flatten())
        assert pa.total_allocated_bytes() - before < 20 << 20
    assert symbols == 40 * 4000 * 50


def test_chunks_keep_the_order_of_rows():
    rows = [([i, i + 1][: i % 3], i) for i in range(50)]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows[a: a + 7]], pa.list_(pa.int32())), pa.array([n for _, n in rows[a: a + 7]], pa.int64())], names=["symbols", "n"])
        for a in range(0, 50, 7)
    ]
    chunks = list(bpe_training._chunks(iter(batches), 10))
    assert len(chunks) > 2
    assert [(w, n) for words, counts in chunks for w, n in zip(words.to_pylist(), counts.to_pylist())] == rows
