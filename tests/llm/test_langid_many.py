"""Mixtures among more languages than START."""

import numpy as np

from webloom.llm import langid


def test_a_minority_outside_the_family_stays():
    draw = np.random.RandomState(8)
    base = draw.dirichlet(np.ones(200))
    near = [0.8 * base + 0.2 * draw.dirichlet(np.ones(200)) for _ in range(2 * langid.START)]
    far = np.concatenate([np.full(200, 1e-7), draw.dirichlet(np.ones(200))])
    p = np.stack([*(np.concatenate([q, np.full(200, 1e-7)]) for q in near), far], 1)
    p = (p / p.sum(0)).astype(np.float32)
    share = langid.mixture(p, 4000 * (0.8 * p[:, 0] + 0.2 * p[:, -1]))
    assert abs(share[-1] - 0.2) < 0.02 and int(np.argmax(share)) == 0
    assert np.count_nonzero(share) <= 4
