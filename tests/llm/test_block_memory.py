"""Memory that a block of near copies takes while its pairs are sifted."""

import tracemalloc

import numpy as np
import pandas as pd

from attestra.llm import near_dedup as N


def test_pairs_of_a_large_block_are_sifted_in_small_batches():
    r = np.tile(np.arange(N.REGISTERS, dtype=np.uint16), (900, 1))
    r[:, 100:] = np.random.RandomState(1).randint(0, 60000, (900, N.REGISTERS - 100))
    unit = pd.DataFrame({"key": 1, "lane": 0, "block": 0, "band": 0, "node": range(900), "n": 100, "label": range(900), "stray": True, "whole": True, "registers": [x.tobytes() for x in r]})
    tracemalloc.start()
    found = N._partnered(unit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 900 and peak < 25_000_000
