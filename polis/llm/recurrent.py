"""Gated recurrent layers in numpy, forwards and backwards through time, one or several side by side."""

from __future__ import annotations

import numpy as np

#: Gradients of one row that are added place by place; more are added at once.
LAYERS = 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def forward(x: np.ndarray, u: np.ndarray, h: np.ndarray, mask: np.ndarray, keep: bool = False):
    """(states (T, B, H), what backward needs) for x (T, B, 3H), the inputs' share of the reset, update and new gates.

    u: (H, 3H). h: the state (B, H) to start from. mask: (T, B); the state after a step is multiplied by it.
    """
    steps, size = len(x), u.shape[0]
    states = np.empty((steps, *h.shape), np.float32)
    saved = [np.empty((steps, h.shape[0], size * k), np.float32) for k in (2, 1, 1)] if keep else None
    mask = mask[..., None]
    g, a, n = np.empty((len(h), 3 * size), np.float32), np.empty((len(h), 2 * size), np.float32), np.empty_like(h)
    for t in range(steps):
        np.matmul(h, u, out=g)
        np.add(x[t, :, : 2 * size], g[:, : 2 * size], out=a)
        np.negative(a, out=a)
        np.exp(a, out=a)
        a += 1
        np.reciprocal(a, out=a)
        own = g[:, 2 * size :]
        np.multiply(a[:, :size], own, out=n)
        n += x[t, :, 2 * size :]
        np.tanh(n, out=n)
        if keep:
            saved[0][t], saved[1][t], saved[2][t] = a, n, own
        now = states[t]
        np.subtract(h, n, out=now)
        now *= a[:, size:]
        now += n
        now *= mask[t]
        h = now
    return states, saved


def backward(d: np.ndarray, states: np.ndarray, saved, u: np.ndarray, h0: np.ndarray, mask: np.ndarray):
    """(gradient of x, gradient of u) from d, the gradient of the states."""
    gates, new, own = saved
    steps, size = len(d), u.shape[0]
    dx, dg = np.empty((*d.shape[:2], 3 * size), np.float32), np.empty((*d.shape[:2], 3 * size), np.float32)
    dh = np.zeros_like(h0)
    before = np.concatenate([h0[None], states[:-1]])
    # What does not depend on dh, for all steps at once.
    r, z = gates[..., :size], gates[..., size:]
    to_new = 1 - new * new
    to_new *= 1 - z
    to_reset = own * r
    to_reset *= 1 - r
    to_update = before - new
    to_update *= z
    to_update *= 1 - z
    back = np.ascontiguousarray(u.T)
    for t in range(steps - 1, -1, -1):
        dh += d[t]
        dh *= mask[t][:, None]
        dn, g = dx[t, :, 2 * size :], dg[t]
        np.multiply(dh, to_new[t], out=dn)
        np.multiply(dn, to_reset[t], out=g[:, :size])
        np.multiply(dh, to_update[t], out=g[:, size : 2 * size])
        np.multiply(dn, r[t], out=g[:, 2 * size :])
        dh *= z[t]
        dh += g @ back
    dx[..., : 2 * size] = dg[..., : 2 * size]
    return dx, before.reshape(-1, size).T @ dg.reshape(-1, 3 * size)


def gates_forward(inputs: np.ndarray, rows: np.ndarray, u: np.ndarray, h: np.ndarray, ends: list[tuple[np.ndarray, np.ndarray]], keep: bool = False):
    """(states (T + 1, K, B, H) before each step and after the last, what gates_backward needs) of K layers side by side, with B lanes each.

    rows (T, 3, K, B) of inputs (N, H) are the inputs' share of the reset, update and new gates. u: (3, K, H, H). h: the states
    (K, B, H) to start from. ends: for each step, the layers and lanes whose state is nothing after it.
    """
    steps, shape = len(rows), h.shape
    states = np.empty((steps + 1, *shape), np.float32)
    states[0] = h
    gates, own = (np.empty((steps if keep else 1, *k, *shape), np.float32) for k in ((3,), ()))
    less = np.stack([-u[0], -u[1], u[2]])
    g = np.empty((3, *shape), np.float32)
    for t in range(steps):
        h, now, x = states[t], states[t + 1], gates[t if keep else 0]
        inputs.take(rows[t], 0, out=x, mode="clip")
        np.matmul(h, less, out=g)
        a, n = x[:2], x[2]
        np.subtract(g[:2], a, out=a)
        np.exp(a, out=a)
        a += 1
        np.reciprocal(a, out=a)
        if keep:
            own[t] = g[2]
        g[2] *= x[0]
        n += g[2]
        np.tanh(n, out=n)
        np.subtract(h, n, out=now)
        now *= x[1]
        now += n
        if len(ends[t][0]):
            now[ends[t]] = 0
    return states, (gates, own)


def gates_backward(d: np.ndarray, states: np.ndarray, saved, u: np.ndarray, ends: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(gradients (T, 3, K, B, H) of the inputs' share of the gates, which take the place of what was saved; gradient of u) from d,
    the gradient of the states after each step (T, K, B, H)."""
    gates, own = saved
    dh, part, a, b = np.zeros_like(d[0]), np.empty_like(gates[0]), np.empty_like(d[0]), np.empty_like(d[0])
    back, du, more = np.ascontiguousarray(u.swapaxes(2, 3)), np.zeros_like(u), np.empty_like(u)
    for t in range(len(d) - 1, -1, -1):
        x, h, dr = gates[t], states[t], own[t]
        r, z, n = x
        dh += d[t]
        if len(ends[t][0]):
            dh[ends[t]] = 0
        np.subtract(1, z, out=a)
        a *= dh
        np.subtract(h, n, out=b)
        b *= z
        dh *= z
        np.multiply(a, b, out=z)
        n *= n
        np.subtract(1, n, out=n)
        a *= n
        dr *= a
        dr *= r
        np.multiply(a, r, out=n)
        np.subtract(1, r, out=r)
        r *= dr
        # Now x holds the gradients of the state's share of the gates, and a that of the input's share of the new one.
        np.matmul(x, back, out=part)
        dh += part[0]
        dh += part[1]
        dh += part[2]
        np.matmul(h.swapaxes(1, 2), x, out=more)
        du += more
        x[2] = a
    return gates, du


class Adagrad:
    """Steps that shrink where gradients have been large; rows touched seldom keep their pace."""

    def __init__(self, rate: float):
        self.rate, self.sums = rate, {}

    def step(self, name: str, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        if name not in self.sums:
            self.sums[name] = np.full(value.shape, 1e-6, np.float32)
        total = self.sums[name]
        if rows is None or len(rows) == len(value):  # rows are distinct and in order
            total += gradient * gradient
            value -= self.rate * gradient / np.sqrt(total)
        else:
            now = total.take(rows, 0)
            now += gradient * gradient
            total[rows] = now
            np.sqrt(now, out=now)
            np.divide(gradient, now, out=now)
            now *= np.float32(self.rate)
            value[rows] = value.take(rows, 0) - now


def by_row(ids: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, their summed gradients)."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    head = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[head], np.add.reduceat(gradient[order], head, axis=0)


def sums_by_row(ids: np.ndarray, gradient: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids in order, their summed gradients): the gradient of the id at i is the rows parts[i] of gradient, end to end."""
    order = np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")
    ids, parts = ids.take(order), parts.take(order, 0)
    head = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    count = np.diff(np.r_[head, len(ids)])
    by = np.argsort(-count, kind="stable")
    first, count = head[by], count[by]
    # First places of all, second places of those with two, and so on; the few with many more at once.
    total = gradient.take(parts.take(first, 0), 0).reshape(len(first), -1)
    for k in range(1, LAYERS):
        n = int(np.searchsorted(-count, -k))
        if not n:
            break
        total[:n] += gradient.take(parts.take(first[:n] + k, 0), 0).reshape(n, -1)
    for k in range(int(np.searchsorted(-count, -LAYERS))):
        own = gradient.take(parts[first[k] + LAYERS : first[k] + count[k]], 0)
        total[k] += np.ones(len(own), np.float32) @ own.reshape(len(own), -1)
    return ids[head], total.take(np.argsort(by), 0)
