"""The span classifier weighs a vote pattern by its whole count."""

import numpy as np
import pytest

from tallymill.llm import personal_data


def fitted(seed):
    rng = np.random.default_rng(seed)
    patterns = sorted({f"{rank}{''.join(rng.choice(list('yn-'), 5))}{rng.integers(4)}" for rank in (2, 3) for _ in range(60)})
    n = (10 ** rng.uniform(4, 6, len(patterns))).astype(np.int64)
    post = rng.uniform(0.02, 0.98, len(patterns))
    return [personal_data.span_classifier(patterns, n * k, post) for k in (1, 10_000)], patterns, n * 10_000, post


@pytest.mark.parametrize("seed", range(4))
def test_accepted_patterns_do_not_depend_on_the_size_of_the_input(seed):
    (small, large), patterns, n, post = fitted(seed)
    clear = np.abs(small - 0.5) > 1e-3
    assert clear.sum() > 80 and ((small >= 0.5) == (large >= 0.5))[clear].all()
    for kind in "23":  # a fit by true counts keeps the expected number of spans of a kind
        own = np.array([p[0] == kind for p in patterns])
        assert (n * large)[own].sum() == pytest.approx((n * post)[own].sum(), rel=1e-6)
