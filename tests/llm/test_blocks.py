"""Blocks in which sets meet."""

import numpy as np

from quillgraph.llm import jaccard


def sets(seed, sizes):
    rng = np.random.default_rng(seed)
    return [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes]


def test_unlike_sets_share_no_block():
    """Else blocks grow with the number of sets, and the work with its square."""
    for percent in (80, 90):
        for low, high in ((3, 16), (17, 40), (250, 800), (3000, 9000)):
            many = sets(low, np.random.default_rng(high).integers(low, high, 200))
            each = [set(jaccard.signatures(x, percent).tolist()) for x in many]
            shared = sum(len(s) for s in each) - len(set().union(*each))
            assert shared <= sum(len(s) for s in each) * 0.01, (percent, low, shared)


def test_sets_that_just_link_share_a_block():
    rng = np.random.default_rng(5)
    for percent in (40, 60, 70, 75, 80, 90):
        for n in [*range(2, 60), *range(60, 1500, 37)]:
            for share in (0, 0.5, 1):  # what differs lies in one set, in both, or in the other
                i = -(-percent * n // 100)
                apart = n - i
                a = round(apart * share)
                x, y, both = sets(int(rng.integers(1 << 30)), [a, apart - a, i])
                x, y = np.union1d(x, both), np.union1d(y, both)
                assert 100 * i >= percent * len(np.union1d(x, y))
                met = np.intersect1d(jaccard.signatures(x, percent), jaccard.signatures(y, percent))
                assert len(met) or not apart, (percent, n, share)
