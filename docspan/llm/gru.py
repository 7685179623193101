"""A small bidirectional gated recurrent network over bytes, in numpy.

Every position of a window of bytes gets a label from the states of a forward and a backward pass. Training is
back-propagation through time over whole windows with Adam."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Direction:
    """One pass: per byte the inputs of the update gate, the reset gate and the candidate; recurrent weights of all three."""

    inputs: np.ndarray  # 256 x 3H
    recurrent: np.ndarray  # H x 3H


@dataclass
class Network:
    forward: Direction
    backward: Direction
    output: np.ndarray  # 2H x K
    bias: np.ndarray  # K

    @property
    def arrays(self) -> list[np.ndarray]:
        return [self.forward.inputs, self.forward.recurrent, self.backward.inputs, self.backward.recurrent, self.output, self.bias]


def fresh(hidden: int, labels: int, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    part = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    one = lambda: Direction(part(256, 3 * hidden, scale=0.3), part(hidden, 3 * hidden, scale=hidden**-0.5))
    return Network(one(), one(), part(2 * hidden, labels, scale=0.3), np.zeros(labels, np.float32))


def _squash(x: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: between -1 and 1 like tanh, at a tenth of its cost. Its slope is (1 - |y|)^2."""
    np.abs(x, out=scratch)
    scratch += 1
    return np.divide(x, scratch, out=x)


def states(d: Direction, steps: np.ndarray, trace: list | None = None) -> np.ndarray:
    """Hidden states (time, window, H) over ``steps`` (time, window); ``trace`` keeps what the backward pass needs."""
    hidden = d.recurrent.shape[0]
    h = np.zeros((steps.shape[1], hidden), np.float32)
    out = np.empty((len(steps), *h.shape), np.float32)
    gates, wide, narrow = np.empty((len(h), 2 * hidden), np.float32), np.empty((len(h), 2 * hidden), np.float32), np.empty_like(h)
    for t in range(len(steps)):
        a, b = np.take(d.inputs, steps[t], axis=0), h @ d.recurrent
        if trace is not None:
            gates = np.empty_like(gates)
        np.add(a[:, :2 * hidden], b[:, :2 * hidden], out=gates)
        _squash(gates, wide)
        gates *= 0.5
        gates += 0.5
        z, r, u = gates[:, :hidden], gates[:, hidden:], b[:, 2 * hidden:]
        n = np.multiply(r, u)
        n += a[:, 2 * hidden:]
        _squash(n, narrow)
        if trace is not None:
            trace.append((h, z, r, n, u))
        h = np.subtract(h, n, out=out[t])
        h *= z
        h += n
    return out


def probabilities(net: Network, steps: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Label probabilities (time, window, K) of every position; zero where ``mask`` is false. States lie between -1 and 1, so
    the exponents stay far from overflow."""
    hidden, kinds = net.forward.recurrent.shape[0], len(net.bias)
    p = states(net.forward, steps).reshape(-1, hidden) @ net.output[:hidden]
    p += states(net.backward, steps[::-1])[::-1].reshape(-1, hidden) @ net.output[hidden:]
    p += net.bias
    np.exp(p, out=p)
    total = p @ np.ones(kinds, np.float32)
    total[~mask.reshape(-1)] = np.inf
    p /= total[:, None]
    return p.reshape(*steps.shape, kinds)


def _gate_slope(gate: np.ndarray) -> np.ndarray:
    return 0.5 * (1 - np.abs(2 * gate - 1)) ** 2


def _through_time(d: Direction, steps: np.ndarray, trace: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of one direction's weights from the gradients of its states."""
    d_inputs, d_recurrent = np.zeros_like(d.inputs), np.zeros_like(d.recurrent)
    carried, sums = np.zeros_like(grad[0]), np.empty((*steps.shape, d.inputs.shape[1]), np.float32)
    for t in range(len(steps) - 1, -1, -1):
        h, z, r, n, u = trace[t]
        g = grad[t] + carried
        pre_n = g * (1 - z) * (1 - np.abs(n)) ** 2
        pre_z = g * (h - n) * _gate_slope(z)
        pre_r = pre_n * u * _gate_slope(r)
        own = np.concatenate([pre_z, pre_r, pre_n], 1)
        rec = np.concatenate([pre_z, pre_r, pre_n * r], 1)
        sums[t] = own
        d_recurrent += h.T @ rec
        carried = g * z + rec @ d.recurrent.T
    flat, own = steps.reshape(-1), sums.reshape(-1, sums.shape[-1])
    for j in range(own.shape[1]):
        d_inputs[:, j] = np.bincount(flat, own[:, j], len(d_inputs))
    return d_inputs, d_recurrent


def gradients(net: Network, steps: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over the marked positions, and its gradients in the order of ``Network.arrays``."""
    hidden = net.forward.recurrent.shape[0]
    tf, tb = [], []
    hf, hb = states(net.forward, steps, tf), states(net.backward, steps[::-1], tb)[::-1]
    both = np.concatenate([hf, hb], -1)
    logits = both @ net.output + net.bias
    p = np.exp(logits - logits.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    total = max(float(mask.sum()), 1.0)
    chosen = np.take_along_axis(p, np.broadcast_to(labels, steps.shape)[..., None], -1)[..., 0]
    loss = float(-(np.log(chosen + 1e-12) * mask).sum() / total)
    p -= np.eye(p.shape[-1], dtype=np.float32)[labels]
    p *= (mask / total)[..., None]
    d_output = both.reshape(-1, 2 * hidden).T @ p.reshape(-1, p.shape[-1])
    d_both = p @ net.output.T
    f = _through_time(net.forward, steps, tf, d_both[..., :hidden])
    b = _through_time(net.backward, steps[::-1], tb, d_both[::-1, :, hidden:])
    return loss, [*f, *b, d_output, p.sum((0, 1))]


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, kinds: int, hidden: int, rounds: int, batch: int, rate: float, seed: int) -> Network:
    """Fits a network to ``windows`` (window, time) of bytes; positions from ``lengths`` on are padding."""
    net, rng = fresh(hidden, kinds, seed), np.random.default_rng(seed + 1)
    first, second = [np.zeros_like(a) for a in net.arrays], [np.zeros_like(a) for a in net.arrays]
    of = [np.flatnonzero(labels == k) for k in range(kinds)]
    for step in range(1, rounds + 1):
        rows = np.concatenate([rng.choice(x, -(-batch // kinds)) for x in of])  # as many of each label
        mask = (np.arange(windows.shape[1])[:, None] < lengths[rows][None, :]).astype(np.float32)
        _, grads = gradients(net, windows[rows].T.astype(np.intp), labels[rows], mask)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for a, g, m, v in zip(net.arrays, grads, first, second):
            g = g * min(1.0, 1.0 / (size + 1e-12))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net
