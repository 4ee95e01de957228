"""The sequence network as SQL, one step of one layer at a time, for the oracle."""

from __future__ import annotations

import numpy as np

from tsreg.functions.network import Sizes


def _weighted(weights: np.ndarray, columns: list[str]) -> str:
    return " + ".join(f"({float(w)!r}::DOUBLE) * {c}" for w, c in zip(weights, columns))


def _sigmoid(x: str) -> str:
    return f"1 / (1 + exp(-({x})))"


def _tanh(x: str) -> str:
    return f"(1 - 2 / (exp(2 * ({x})) + 1))"


def network_sql(sizes: Sizes, flat: np.ndarray, steps: int, source: str) -> str:
    """CTEs from ``source`` (columns ``x0 …`` hold the steps) to ``network``, which adds
    ``network_output``."""
    w, ctes = sizes.unpack(flat), []
    table, inputs = source, [[f"x{t}"] for t in range(steps)]
    for n, size in enumerate(sizes.hidden, start=1):
        layer = f"lstm{n}"
        bias = w[layer, "bias_ih"] + w[layer, "bias_hh"]
        h, c = ["0"] * size, ["0"] * size
        outputs = []
        for t in range(steps):
            at = f"{n}_{t}"
            gates = [
                f"{_weighted(w[layer, 'weight_ih'][r], inputs[t])} + "
                f"{_weighted(w[layer, 'weight_hh'][r], h)} + ({float(bias[r])!r}::DOUBLE)"
                for r in range(4 * size)
            ]
            cells = [
                f"{_sigmoid(gates[size + j])} * {c[j]} + {_sigmoid(gates[j])} * "
                f"{_tanh(gates[2 * size + j])} AS c{at}_{j}, {_sigmoid(gates[3 * size + j])} AS o{at}_{j}"
                for j in range(size)
            ]
            ctes.append(f"cell{at} AS (SELECT *, {', '.join(cells)} FROM {table})")
            states = [f"o{at}_{j} * {_tanh(f'c{at}_{j}')} AS h{at}_{j}" for j in range(size)]
            ctes.append(f"state{at} AS (SELECT *, {', '.join(states)} FROM cell{at})")
            table = f"state{at}"
            h, c = [f"h{at}_{j}" for j in range(size)], [f"c{at}_{j}" for j in range(size)]
            outputs.append(h)
        inputs = outputs
    dense = [
        f"greatest({_weighted(w['fc1', 'weight'][r], inputs[-1])} + ({float(w['fc1', 'bias'][r])!r}::DOUBLE), 0) AS d{r}"
        for r in range(sizes.dense)
    ]
    ctes.append(f"dense AS (SELECT *, {', '.join(dense)} FROM {table})")
    out = _weighted(w["fc2", "weight"][0], [f"d{r}" for r in range(sizes.dense)])
    ctes.append(
        f"network AS (SELECT *, {out} + ({float(w['fc2', 'bias'][0])!r}::DOUBLE) AS network_output FROM dense)"
    )
    return ",\n".join(ctes)
