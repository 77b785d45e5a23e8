"""Confidences fitted to the graph of candidates."""

import numpy as np

from loomgraph.llm import linkage as li


def planted(n, seed=0):
    """Counts of pairs drawn from known shares of matches and known agreement, and the shares."""
    rnd = np.random.default_rng(seed)
    shares = np.array([0.99, 0.5, 0.95, 0.4, 0.02, 0.8, 0.2])
    level = lambda roles, states: np.array([[r[0], 0, 0, *(r[1] * x for x in states), *(r[2] * x for x in states)] for r in roles])
    same = level([(1, 0, 0), (0.03, 0.97, 0), (0.02, 0.1, 0.88)], (0.4, 0.3, 0.3))
    apart = level([(1, 0, 0), (0.9, 0.1, 0), (0.8, 0.15, 0.05)], (0.8, 0.15, 0.05))
    true = np.zeros((7, 3, 9))
    counts = np.zeros((7, 3, 9))
    for kind in range(7):
        for could, part in enumerate((0.1, 0.4, 0.5)):
            hits = rnd.multinomial(int(n * part * shares[kind]), same[could])
            counts[kind, could] = hits + rnd.multinomial(int(n * part * (1 - shares[kind])), apart[could])
            true[kind, could] = hits
    return counts, true


def test_fit_finds_the_planted_shares():
    for n, off in ((2_000, 0.03), (200_000, 0.003)):
        counts, true = planted(n)
        got = li.fit_confidences(counts)
        wrong = np.abs(got - true / np.maximum(counts, 1))
        assert (wrong * counts).sum() < off * counts.sum()
        assert abs((counts * got).sum() - true.sum()) < off * counts.sum()
    assert wrong[counts > 0.02 * n].max() < 0.03


def test_few_pairs_give_what_was_expected():
    got = li.fit_confidences(np.zeros((7, 3, 9)))
    kinds = list(li.KINDS)
    assert np.allclose(got[:, 0, 0], list(li.KINDS.values())) and ((got >= 0) & (got <= 1)).all()
    one = np.zeros((7, 3, 9))
    one[kinds.index("other"), 1, 0] = 1
    assert np.abs(li.fit_confidences(one) - got).max() < 0.05


def test_agreement_raises_the_confidence():
    got = li.fit_confidences(planted(5_000)[0])
    assert (got[:, 2, 8] > got[:, 2, 3]).all() and (got[:, 2, 3] > got[:, 2, 0]).all() and (got[:, 1, 3] > got[:, 1, 0]).all()
