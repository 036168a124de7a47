"""Induced sorting against plain sorting."""

import numpy as np
import pytest
from tessera.llm import suffix


def text(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 400)), int(rng.integers(1, 5))
    body = rng.integers(1, k + 2, n).astype(np.uint8)
    if seed % 3 == 0:
        body = np.concatenate([body, body, body[: n // 2], body])
    return np.append(body, np.uint8(0))


@pytest.mark.parametrize("seed", range(150))
def test_order_and_common_prefixes(seed):
    t, depth = text(seed), [100, 7, 20][seed % 3]
    blocks = list(suffix.sorted_suffixes(t, depth, 64 if seed % 2 else 1 << 20))
    place = np.concatenate([p for p, _ in blocks])
    lcp = np.concatenate([x for _, x in blocks])
    s = t.tobytes()
    assert sorted(place.tolist()) == list(range(len(t) - 1))
    cut = [s[p : p + depth] for p in place]
    assert cut == sorted(cut, reverse=True)
    for k in range(1, len(place)):
        a, b = cut[k - 1], cut[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, depth), (k, n)


@pytest.mark.parametrize("seed", range(60))
def test_repeats(seed):
    t, depth = text(seed), [5, 8, 30][seed % 3]
    s, seen, want = t.tobytes(), set(), []
    for p in range(len(s) - depth):
        (want.append(p) if s[p : p + depth] in seen else seen.add(s[p : p + depth]))
    got = suffix.repeats(t, depth, 200)
    assert [p for p in got.tolist() if p < len(s) - depth] == want
