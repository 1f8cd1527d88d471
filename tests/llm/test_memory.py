import gc
import tracemalloc

import numpy as np
import psutil
from granary.llm import toxicity
from granary.llm.common import released


def test_features_to_keep_are_chosen_without_a_second_copy_of_all():
    rng = np.random.default_rng(1)
    docs = [np.unique((rng.random(1500) ** 2 * toxicity.BUCKETS).astype(np.int32)) for _ in range(6000)]
    P, U = docs[:500], docs[500:]
    P = [np.union1d(f, [7, 8]).astype(np.int32) for f in P]
    nP, nU = (np.bincount(np.concatenate(x), minlength=toxicity.BUCKETS) for x in (P, U))
    p, u, both = nP / len(P), nU / len(U), (nP + nU) / (len(P) + len(U))
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / len(P) + 1 / len(U)))
    want = np.flatnonzero((np.abs(p - u) >= toxicity.Z * error) & (np.where(p > u, nP, nU) >= toxicity.LEAST))
    del nP, nU, p, u, both, error
    tracemalloc.start()
    got = toxicity.informative(P, U)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {7, 8} <= set(got.tolist()) and np.array_equal(got, want)
    # their sum alone takes 32 MB, and its places as 64 bits twice that
    assert peak < 100e6, peak


def test_a_task_gives_back_what_it_freed():
    """What lies between arrays that stay can only be given back page by page."""

    def fill(batches):
        for batch in batches:
            held = [np.ones(1_000) for _ in range(20_000)]
            yield batch
        kept.extend(held[::500])
        del held

    kept: list = []
    batches = iter([1])
    before = psutil.Process().memory_info().rss
    assert list(released(fill)(batches)) == [1]
    gc.collect()
    assert psutil.Process().memory_info().rss - before < 40e6
