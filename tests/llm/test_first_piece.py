import numpy as np

from merloom.llm import splitting


def test_first_piece_may_reach_the_limit():
    for n in (3931, 3960, 3965, 5896, 5930):
        cuts, ok = splitting.best_cuts(n, np.array([], np.int64), 2000, 35)
        assert not ok and len(cuts) == -(-(n - 35) // 1965) - 1
        assert all(e - s <= 2000 for s, e in splitting.pieces_of(n, cuts, 35))
