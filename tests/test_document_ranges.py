import random
import tracemalloc

import numpy as np

from sieveline.sources import documents


def brute(data, before):
    out, run = [], len(before) - len(before.rstrip(b"\\"))
    for i, b in enumerate(data):
        if b == 34 and run % 2 == 0:
            out.append(i)
        run = run + 1 if b == 92 else 0
    return out


def test_quotes_behind_runs_of_backslashes():
    rng = random.Random(5)
    for _ in range(3000):
        data = bytes(rng.choice(b'\\\\\\"""a{[') for _ in range(rng.randrange(0, 14)))
        before = bytes(rng.choice(b"\\\\a") for _ in range(rng.randrange(0, 5)))
        got = documents.unescaped_quotes(np.frombuffer(data, np.uint8), before)
        assert got.tolist() == brute(data, before), (data, before)


def test_what_a_range_holds_is_a_few_times_its_bytes():
    """F8: s6_wrapped_document. Marks are kept, not a number for every byte."""
    row = b'{"title": "Shop \\"One\\", a name of some length", "link": "https://maps/somewhere"},'
    data = np.frombuffer(row * ((4 << 20) // len(row)), np.uint8)
    tracemalloc.start()
    at, change, inside = documents.structure(data, b"", False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 2 * (len(data) // len(row)) and change.sum() == 0 and not inside
    assert peak < 6 * len(data)
