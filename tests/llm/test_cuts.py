"""Cuts against all cuttings of small records, forced places included."""

import itertools
import random

import numpy as np

from merloom.llm import splitting


def cost(total, cuts, limit, overlap):
    span = limit - overlap
    pieces = max(2, -(-(total - overlap) // span))
    want = (total + (pieces - 1) * overlap) / pieces
    return sum(((e - s - want) / limit) ** 2 for s, e in splitting.pieces_of(total, list(cuts), overlap))


def best(total, points, limit, overlap):
    """(forced cuts, imbalance) of the best of all cuttings."""
    out = None
    usable = set(p for p in points if p >= overlap)
    for k in range(1, 6):
        for cuts in itertools.combinations(range(max(1, overlap), total), k):
            if all(e - s <= limit for s, e in splitting.pieces_of(total, list(cuts), overlap)):
                got = (sum(c not in usable for c in cuts), cost(total, cuts, limit, overlap))
                out = got if out is None else min(out, got)
    return out


def test_cuts_are_the_best_of_all():
    r = random.Random(21)
    forced = 0
    for _ in range(150):
        limit, overlap = r.choice([(8, 2), (7, 0), (9, 3), (10, 1)])
        total = r.randrange(limit + 1, 3 * limit - 2 * overlap + 1)
        points = sorted(r.sample(range(1, total), r.randrange(0, min(6, total - 1))))
        cuts, ok = splitting.best_cuts(total, np.array(points, np.int64), limit, overlap)
        ps = splitting.pieces_of(total, cuts, overlap)
        assert all(0 <= s and e - s <= limit for s, e in ps) and ps[-1][1] == total
        n = sum(c not in points for c in cuts)
        want = best(total, points, limit, overlap)
        assert ok == (n == 0) == (want[0] == 0)
        assert n == want[0] and abs(cost(total, cuts, limit, overlap) - want[1]) < 1e-9, (total, points, limit, overlap, cuts)
        forced += n > 0
    assert forced > 30


def test_least_forced_cuts_without_boundaries():
    for n in range(2001, 12_000, 37):
        cuts, ok = splitting.best_cuts(n, np.array([], np.int64), 2000, 35)
        assert not ok and len(cuts) == -(-(n - 35) // 1965) - 1


def test_a_long_record_is_cut_in_time():
    at = np.arange(70, 20_000_000, 70)
    at = at[(at < 5_000_000) | (at > 5_100_000)]
    cuts, ok = splitting.best_cuts(20_000_000, at, 2000, 35)
    assert not ok and sum(c % 70 != 0 for c in cuts) <= 51
