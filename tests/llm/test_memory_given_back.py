"""What an operator leaves in a worker goes, memory and all, when the next one begins."""

import gc
import sys
import weakref

import pytest

from tidefut.llm import common, packing
from tidefut.llm.queries import vocabulary


@pytest.mark.parametrize("begin", [common.forget, lambda: common.kept("another operator", list)])
def test_an_encoder_goes_at_once(begin):
    gc.disable()
    try:
        encoder = packing.encoder_of(vocabulary("word_bpe_49k.json"))
        encoder.encode(["the tide is out"])
        left = weakref.ref(encoder)
        del encoder
        begin()
        assert left() is None
    finally:
        gc.enable()
        common.forget()


def held_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_freed_memory_goes_back_to_the_system():
    common.kept("words", lambda: [bytes(600) for _ in range(200_000)])
    later = [bytes(600) for _ in range(10)]  # above the others on the heap
    before = held_mb()
    common.forget()
    assert before - held_mb() > 80 and len(later) == 10
