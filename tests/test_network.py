import math

import numpy as np
import pytest

from tsreg.functions.network import Adam, Sizes, loss_and_gradient, predict

SMALL = Sizes(hidden=(4, 3, 2), dense=3)


def plain_forward(sizes, flat, xs):
    """One sequence, one number at a time."""
    w = sizes.unpack(flat)
    sig = lambda v: 1 / (1 + math.exp(-v))
    seq = [[v] for v in xs]
    for n, size in enumerate(sizes.hidden, start=1):
        name = f"lstm{n}"
        h, c, out = [0.0] * size, [0.0] * size, []
        for x in seq:
            pre = [
                sum(w[name, "weight_ih"][r, j] * x[j] for j in range(len(x)))
                + sum(w[name, "weight_hh"][r, j] * h[j] for j in range(size))
                + w[name, "bias_ih"][r]
                + w[name, "bias_hh"][r]
                for r in range(4 * size)
            ]
            c = [sig(pre[size + j]) * c[j] + sig(pre[j]) * math.tanh(pre[2 * size + j]) for j in range(size)]
            h = [sig(pre[3 * size + j]) * math.tanh(c[j]) for j in range(size)]
            out.append(h)
        seq = out
    d = [max(0.0, float(w["fc1", "weight"][r] @ np.array(seq[-1]) + w["fc1", "bias"][r])) for r in range(sizes.dense)]
    return float(w["fc2", "weight"][0] @ np.array(d) + w["fc2", "bias"][0])


def test_weight_count_of_the_default_layers():
    assert Sizes().count() == 129_825


def test_forward_equals_plain_loops():
    rng = np.random.default_rng(0)
    flat, x = SMALL.initial(3) * 2, rng.normal(size=(300, 6, 1))
    got = predict(SMALL, flat, x)
    for i in (0, 7, 255, 256, 299):
        assert got[i] == pytest.approx(plain_forward(SMALL, flat, x[i, :, 0]), abs=1e-12)
    single = predict(SMALL, flat.astype(np.float32), x.astype(np.float32))
    assert single.dtype == np.float32 and np.allclose(single, got, atol=1e-5)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    flat, x, y = SMALL.initial(5) * 2, rng.normal(size=(300, 4, 1)), rng.normal(size=300)
    loss, gradient = loss_and_gradient(SMALL, flat, x, y)
    assert loss == pytest.approx(float(((predict(SMALL, flat, x) - y) ** 2).sum()))
    for k in rng.choice(SMALL.count(), 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        slope = (loss_and_gradient(SMALL, up, x, y)[0] - loss_and_gradient(SMALL, down, x, y)[0]) / 2e-6
        assert gradient[k] == pytest.approx(slope, rel=1e-4, abs=1e-4)


def test_adam_first_step_has_the_size_of_the_rate():
    moved = Adam(3, rate=0.1).step(np.zeros(3), np.array([5.0, -0.2, 0.0]))
    assert moved == pytest.approx([-0.1, 0.1, 0.0], abs=1e-6)
