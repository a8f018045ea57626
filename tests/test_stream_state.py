"""What the stateful operator asks of the state store: each call is a message to the JVM."""

import random
from collections import Counter

import pytest
from pyspark.sql import Row

from blockwise.operators import matching
from blockwise.streaming import fragments

IN = Row("stream_id", "seq", "payload", "is_last")


class State(dict):
    """A value (under the key None) or a map, and how often it is called."""

    def __init__(self, calls):
        self.calls = calls

    def __getattribute__(self, name):
        if name in ("exists", "containsKey", "getValue", "updateValue", "removeKey", "iterator", "clear"):
            self.calls[name] += 1
        return super().__getattribute__(name)

    def exists(self):
        return bool(self)

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value

    def containsKey(self, key):
        return key in self

    getValue = dict.__getitem__

    updateValue = dict.__setitem__

    removeKey = dict.__delitem__

    def iterator(self):
        return iter(list(self.items()))


def processor(bound=None, index_bound=None, wire=False):
    p, calls = fragments.FragmentProcessor("fixed", 512, bound, index_bound, None, wire), Counter()
    p.value, p.index = State(Counter()), State(calls)
    return p, calls


def blocks(seed, count, kinds):
    rnd = random.Random(seed)
    made = [rnd.randbytes(512) for _ in range(kinds)]
    return [rnd.choice(made) for _ in range(count)]


@pytest.mark.parametrize("wire", [False, True])
def test_a_stream_of_one_batch_leaves_the_map_alone(wire):
    p, calls = processor(10, wire=wire)
    data = blocks(1, 200, 30)
    out = list(p.handleInputRows((1,), iter([IN(1, 0, b"".join(data), True)]), None))
    assert len(out) == (202 if wire else 200) and not calls and p.value.get()[-1]


@pytest.mark.parametrize("bound, index_bound", [(None, None), (10, None), (1, None), (None, 8)])
def test_micro_batches_equal_one_batch_and_the_map_stays_bounded(bound, index_bound, monkeypatch):
    monkeypatch.setattr(fragments.FragmentProcessor, "SWEEP", 16)
    data, rnd = blocks(2, 400, 25), random.Random(3)
    whole, _ = processor(bound, index_bound)
    want = list(whole.handleInputRows((1,), iter([IN(1, 0, b"".join(data), True)]), None))
    index, latest = matching.EvictingIndex(8), {}
    for n, (block, r) in enumerate(zip(data, want, strict=True)):
        off = index.back_offset(block, n) if index_bound else n - latest[block] if block in latest else None
        assert r.back_offset == (off if off is None or bound is None or off <= bound else None) and r.n == n
        latest[block] = n
    p, calls = processor(bound, index_bound)
    got, at = [], 0
    while at < len(data):
        step = rnd.randint(1, 40)
        rows = [IN(1, n, data[n], n == len(data) - 1) for n in range(at, min(at + step, len(data)))]
        rnd.shuffle(rows)
        got += p.handleInputRows((1,), iter(rows), None)
        at += step
        assert len(p.index) <= (index_bound or (bound + 16 + 40 if bound else 25))
    assert got == want and not p.index
