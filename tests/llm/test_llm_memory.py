"""What a worker holds for the texts it unpacks together, whatever the size of a batch."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from mirrorkeep.llm import packing, quality_rules
from mirrorkeep.llm.common import sliced

MB = 1 << 20


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(2, 9))) for _ in range(5000)]
    return pa.array([" ".join(draw.choices(words, k=300)) for _ in range(8000)])


def peak(work):
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_quality_rules_hold_little_at_a_time(texts):
    def work():
        for _, some in sliced(texts):
            quality_rules.judge(some, np.zeros(1 << quality_rules.BUCKETS_LOG2, dtype=np.int64), quality_rules.THRESHOLD)

    assert texts.nbytes > 12 * MB
    assert peak(work) < 80 * MB


def test_packing_holds_little_at_a_time(texts):
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))

    def work():
        for _, some in sliced(texts, packing.SLICE_BYTES):
            encoder.encode(pa.array(some, pa.binary()).cast(pa.string()))

    assert peak(work) < 100 * MB
