"""What a task of the collocations holds while it cuts text into words."""

import tracemalloc

import pyarrow as pa

from punctuo.llm import collocations as K


def test_words_of_a_large_task_are_cut_in_little_memory():
    text = b" ".join(b"word%d" % (i * 7919 % 5000) for i in range(100)) + b".\n"
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 10_000), pa.array([text] * 10_000, pa.binary())], ["lang", "text"])
    tracemalloc.start()
    n = sum(len(K._Chunk(*part).one) for part in K._chunks(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_000_000 and peak < 60_000_000
