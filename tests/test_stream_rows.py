"""The stateful task of stream packing gives every token of a batch row once; inputs and targets are made after it."""

import numpy as np

from quillmill.operators.packing import BatchShape
from quillmill.streaming.corpus import _Packer


def test_the_packer_gives_tokens_once():
    shape = BatchShape(2, 4)
    frame, left = _Packer(shape, ["rank"])._cut((3,), np.arange(20, dtype="<i4"), 5)
    assert list(frame.columns) == ["rank", "batch", "row_in_batch", "tokens"]
    assert [t.tolist() for t in frame["tokens"]] == [[0, 1, 2, 3, 4], [4, 5, 6, 7, 8], [9, 10, 11, 12, 13], [13, 14, 15, 16, 17]]
    assert frame["batch"].tolist() == [5, 5, 6, 6] and frame["row_in_batch"].tolist() == [0, 1, 0, 1]
    assert left.tolist() == [18, 19]
