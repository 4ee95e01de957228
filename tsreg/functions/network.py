"""Arithmetic of the sequence network on one batch: three LSTM layers, two dense layers.

Small enough to ship with each task. Weights live in one flat vector; ``shapes`` names its parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

CHUNK = 256


@dataclass(frozen=True)
class Sizes:
    """Width of the input, of each LSTM layer, of the dense layer and of the output."""

    inputs: int = 1
    hidden: tuple[int, ...] = (128, 64, 32)
    dense: int = 16
    outputs: int = 1

    def shapes(self) -> list[tuple[str, str, tuple[int, ...]]]:
        """``(layer, name, shape)`` of all weights. Gates are stacked input, forget, cell, output."""
        found, width = [], self.inputs
        for i, h in enumerate(self.hidden, start=1):
            layer = f"lstm{i}"
            found += [
                (layer, "weight_ih", (4 * h, width)),
                (layer, "weight_hh", (4 * h, h)),
                (layer, "bias_ih", (4 * h,)),
                (layer, "bias_hh", (4 * h,)),
            ]
            width = h
        found += [
            ("fc1", "weight", (self.dense, width)),
            ("fc1", "bias", (self.dense,)),
            ("fc2", "weight", (self.outputs, self.dense)),
            ("fc2", "bias", (self.outputs,)),
        ]
        return found

    def count(self) -> int:
        return sum(int(np.prod(shape)) for _, _, shape in self.shapes())

    def unpack(self, flat: np.ndarray) -> dict[tuple[str, str], np.ndarray]:
        parts, at = {}, 0
        for layer, name, shape in self.shapes():
            size = int(np.prod(shape))
            parts[layer, name] = flat[at : at + size].reshape(shape)
            at += size
        return parts

    def initial(self, seed: int = 42) -> np.ndarray:
        """Uniform start values within 1 / sqrt(fan), the fan being the layer's state or input width."""
        rng = np.random.default_rng(seed)
        parts = []
        for layer, _, shape in self.shapes():
            if layer.startswith("lstm"):
                fan = self.hidden[int(layer[4:]) - 1]
            else:
                fan = self.hidden[-1] if layer == "fc1" else self.dense
            bound = 1.0 / np.sqrt(fan)
            parts.append(rng.uniform(-bound, bound, int(np.prod(shape))))
        return np.concatenate(parts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _lstm(x: np.ndarray, w: dict, layer: str) -> tuple[np.ndarray, list]:
    """States of one layer over (rows, steps, inputs), and what its gradient needs."""
    rows, steps, _ = x.shape
    recurrent = w[layer, "weight_hh"]
    size = recurrent.shape[1]
    drive = x @ w[layer, "weight_ih"].T + (w[layer, "bias_ih"] + w[layer, "bias_hh"])
    h = np.zeros((rows, size), x.dtype)
    c = np.zeros((rows, size), x.dtype)
    states = np.empty((rows, steps, size), x.dtype)
    tape = []
    for t in range(steps):
        gates = drive[:, t] + h @ recurrent.T
        squashed = _sigmoid(gates)
        i, f, o = squashed[:, :size], squashed[:, size : 2 * size], squashed[:, 3 * size :]
        g = np.tanh(gates[:, 2 * size : 3 * size])
        c_next = f * c + i * g
        shape = np.tanh(c_next)
        tape.append((h, c, i, f, g, o, shape))
        h, c = o * shape, c_next
        states[:, t] = h
    return states, tape


def _lstm_back(
    x: np.ndarray, d_states: np.ndarray, w: dict, layer: str, tape: list, grad: dict
) -> np.ndarray:
    """Add the layer's weight gradients to ``grad``; return the gradient of its input."""
    recurrent = w[layer, "weight_hh"]
    rows, steps, _ = x.shape
    size = recurrent.shape[1]
    d_h = np.zeros((rows, size))
    d_c = np.zeros((rows, size))
    d_gates = np.empty((rows, steps, 4 * size))
    for t in range(steps - 1, -1, -1):
        h, c, i, f, g, o, shape = tape[t]
        d_h = d_h + d_states[:, t]
        d_c = d_c + d_h * o * (1.0 - shape * shape)
        step = d_gates[:, t]
        step[:, :size] = d_c * g * i * (1.0 - i)
        step[:, size : 2 * size] = d_c * c * f * (1.0 - f)
        step[:, 2 * size : 3 * size] = d_c * i * (1.0 - g * g)
        step[:, 3 * size :] = d_h * shape * o * (1.0 - o)
        grad[layer, "weight_hh"] += step.T @ h
        d_h = step @ recurrent
        d_c = d_c * f
    bias = d_gates.sum(axis=(0, 1))
    grad[layer, "bias_ih"] += bias
    grad[layer, "bias_hh"] += bias
    grad[layer, "weight_ih"] += np.tensordot(d_gates, x, axes=((0, 1), (0, 1)))
    return d_gates @ w[layer, "weight_ih"]


def predict(sizes: Sizes, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    """First output of the network for (rows, steps, inputs), computed in the type of ``x``."""
    w = sizes.unpack(flat.astype(x.dtype, copy=False))
    out = np.empty(len(x), x.dtype)
    for start in range(0, len(x), CHUNK):
        states = x[start : start + CHUNK]
        for n in range(1, len(sizes.hidden) + 1):
            states, _ = _lstm(states, w, f"lstm{n}")
        dense = np.maximum(states[:, -1] @ w["fc1", "weight"].T + w["fc1", "bias"], 0)
        out[start : start + CHUNK] = (dense @ w["fc2", "weight"].T + w["fc2", "bias"])[:, 0]
    return out


def loss_and_gradient(
    sizes: Sizes, flat: np.ndarray, x: np.ndarray, y: np.ndarray
) -> tuple[float, np.ndarray]:
    """Sum of squared errors over the batch, and its gradient in the order of ``flat``."""
    w = sizes.unpack(flat)
    total = np.zeros_like(flat)
    grad = sizes.unpack(total)
    loss = 0.0
    for start in range(0, len(x), CHUNK):
        states, wanted = x[start : start + CHUNK], y[start : start + CHUNK]
        inputs, tapes = [], []
        for n in range(1, len(sizes.hidden) + 1):
            inputs.append(states)
            states, tape = _lstm(states, w, f"lstm{n}")
            tapes.append(tape)
        last = states[:, -1]
        raw = last @ w["fc1", "weight"].T + w["fc1", "bias"]
        dense = np.maximum(raw, 0)
        error = (dense @ w["fc2", "weight"].T + w["fc2", "bias"])[:, 0] - wanted
        loss += float(error @ error)
        d_out = np.zeros((len(states), sizes.outputs))
        d_out[:, 0] = 2.0 * error
        grad["fc2", "weight"] += d_out.T @ dense
        grad["fc2", "bias"] += d_out.sum(axis=0)
        d_raw = (d_out @ w["fc2", "weight"]) * (raw > 0)
        grad["fc1", "weight"] += d_raw.T @ last
        grad["fc1", "bias"] += d_raw.sum(axis=0)
        d_states = np.zeros_like(states)
        d_states[:, -1] = d_raw @ w["fc1", "weight"]
        for n in range(len(sizes.hidden), 0, -1):
            d_states = _lstm_back(inputs[n - 1], d_states, w, f"lstm{n}", tapes[n - 1], grad)
    return loss, total


class Adam:
    """Step rule with running means of the gradient and of its square."""

    def __init__(self, size: int, rate: float = 0.001, decay: Sequence[float] = (0.9, 0.999)):
        self.rate, self.decay, self.steps = rate, tuple(decay), 0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def step(self, flat: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        a, b = self.decay
        self.steps += 1
        self.mean = a * self.mean + (1 - a) * gradient
        self.square = b * self.square + (1 - b) * gradient**2
        mean = self.mean / (1 - a**self.steps)
        square = self.square / (1 - b**self.steps)
        return flat - self.rate * mean / (np.sqrt(square) + 1e-8)
