"""A bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A step reads ``BLOCK`` bytes; each byte of the block has its own input table and
each pair of bytes a row of a shared table, so a step's input is a sum of table
rows. Every step gets a label distribution
(which holds for its positions), and the pooled distribution of a text is the
softmax of the mean logits of its positions.
"""

from __future__ import annotations

import numpy as np

BLOCK = 8
PAD_BYTE = 0


def to_blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts, steps, BLOCK) bytes padded with 0, and the steps of every text (at least 1)."""
    steps = np.array([max(1, -(-len(t) // BLOCK)) for t in texts])
    width = int(steps.max()) * BLOCK
    flat = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8)
    return flat.reshape(len(texts), -1, BLOCK), steps


def pairs_of(texts: list[bytes], least: int = 2) -> np.ndarray:
    """Row numbers of the byte pairs, at either phase, that occur at least ``least`` times in the texts."""
    n = np.zeros(65536, np.int64)
    for t in texts:
        b = np.frombuffer(t, np.uint8).astype(np.int64)
        np.add.at(n, b[:-1] * 256 + b[1:], 1)
    out = np.zeros(65536, np.int32)
    used = np.flatnonzero(n >= least)
    out[used] = np.arange(1, len(used) + 1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGRU:
    """Parameters: tables E (BLOCK, 256, 2, 3h) and P (pairs, 2, 3h), recurrent U (2, h, 3h), biases b (2, 3h), c (2, h), output V (2h, L), d (L).

    ``pair_id`` maps a pair of bytes to its row of P; pairs not in it share the
    row 0, which stays zero.
    """

    def __init__(self, labels: list[str], hidden: int = 16, seed: int = 7, pair_id: np.ndarray | None = None):
        self.labels, self.h = list(labels), hidden
        self.pair_id = np.zeros(65536, np.int32) if pair_id is None else pair_id
        self._pairs: list[np.ndarray] | None = None
        r = np.random.default_rng(seed)
        h, f = hidden, np.float32
        self.p = {
            "E": (r.standard_normal((BLOCK, 256, 2, 3 * h)) * 0.1).astype(f),
            "P": np.zeros((int(self.pair_id.max()) + 1, 2, 3 * h), f),
            "U": (r.standard_normal((2, h, 3 * h)) / np.sqrt(h)).astype(f),
            "b": np.zeros((2, 3 * h), f),
            "c": np.zeros((2, h), f),
            "V": (r.standard_normal((2 * h, len(labels))) / np.sqrt(2 * h)).astype(f),
            "d": np.zeros(len(labels), f),
        }

    # -- training ---------------------------------------------------------

    def loss_and_grads(self, x: np.ndarray, steps: np.ndarray, y: np.ndarray, pos_weight: float = 0.3) -> tuple[float, dict[str, np.ndarray]]:
        p, h = self.p, self.h
        n, t_max, _ = x.shape
        live = (np.arange(t_max)[None, :] < steps[:, None]).astype(np.float32)
        xi = sum(p["E"][o][x[:, :, o]] for o in range(BLOCK))  # n, t, 2, 3h
        pairs = self.pair_id[x[:, :, 0::2].astype(np.int64) * 256 + x[:, :, 1::2]]
        for o in range(BLOCK // 2):
            xi = xi + p["P"][pairs[:, :, o]]
        xi = xi + p["b"]
        hid = np.zeros((2, t_max, n, h), np.float32)
        keep: list[list] = [[None] * t_max, [None] * t_max]
        for d in range(2):
            s = np.zeros((n, h), np.float32)
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                a = s @ p["U"][d]
                zr = _sigmoid(xi[:, t, d, : 2 * h] + a[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                q = a[:, 2 * h :] + p["c"][d]
                g = np.tanh(xi[:, t, d, 2 * h :] + r * q)
                m = live[:, t : t + 1]
                new = s + m * (1 - z) * (g - s)
                keep[d][t] = (s, z, r, q, g)
                s = new
                hid[d, t] = s
        out = np.concatenate([hid[0], hid[1]], axis=2).transpose(1, 0, 2)  # n, t, 2h
        logit = out @ p["V"] + p["d"]
        one = np.eye(len(self.labels), dtype=np.float32)[y]
        share = live / steps[:, None]
        pooled = (logit * share[:, :, None]).sum(1)
        soft = lambda v: (lambda e: e / e.sum(-1, keepdims=True))(np.exp(v - v.max(-1, keepdims=True)))
        pp, pl = soft(pooled), soft(logit)
        loss = float(-np.log((pp * one).sum(-1) + 1e-9).mean())
        dl = ((pp - one)[:, None, :] + pos_weight * (pl - one[:, None, :])) * share[:, :, None] / n
        g = {"V": np.einsum("nth,ntl->hl", out, dl, optimize=True), "d": dl.sum((0, 1))}
        dout = dl @ p["V"].T
        dxi = np.zeros_like(xi)
        g["U"], g["c"] = np.zeros_like(p["U"]), np.zeros_like(p["c"])
        for d in range(2):
            ds = np.zeros((n, h), np.float32)
            for t in range(t_max - 1, -1, -1) if d == 0 else range(t_max):
                s, z, r, q, gg = keep[d][t]
                ds = ds + dout[:, t, d * h : (d + 1) * h]
                m = live[:, t : t + 1]
                dg = ds * m * (1 - z) * (1 - gg * gg)
                dz = ds * m * (s - gg) * z * (1 - z)
                dr = dg * q * r * (1 - r)
                dq = dg * r
                dxi[:, t, d, :h], dxi[:, t, d, h : 2 * h], dxi[:, t, d, 2 * h :] = dz, dr, dg
                da = np.concatenate([dz, dr, dq], 1)
                g["U"][d] += s.T @ da
                g["c"][d] += dq.sum(0)
                ds = ds * (1 - m * (1 - z)) + da @ p["U"][d].T
        g["b"] = dxi.sum((0, 1))
        g["E"] = np.zeros_like(p["E"])
        flat = dxi.reshape(n * t_max, -1)

        def scatter(ids: np.ndarray, into: np.ndarray) -> None:
            order = np.argsort(ids, kind="stable")
            used, at = np.unique(ids[order], return_index=True)
            into[used] += np.add.reduceat(flat[order], at, axis=0).reshape(len(used), 2, -1)

        g["P"] = np.zeros_like(p["P"])
        for o in range(BLOCK):
            scatter(x[:, :, o].reshape(-1), g["E"][o])
        for o in range(BLOCK // 2):
            scatter(pairs[:, :, o].reshape(-1), g["P"])
        g["P"][0] = 0
        return loss, g

    def train(self, batches, rate: float = 0.01) -> None:
        """Adam over an iterable of (x, steps, y, progress), progress from 0 to 1."""
        self._pairs = None
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i, (x, steps, y, progress) in enumerate(batches, 1):
            _, grads = self.loss_and_grads(x, steps, y)
            norm = np.sqrt(sum(float((v * v).sum()) for v in grads.values()))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            lr = rate * (1 - progress) + 1e-4
            for k, v in grads.items():
                v = v * scale
                m1[k] += 0.1 * (v - m1[k])
                m2[k] += 0.01 * (v * v - m2[k])
                self.p[k] -= (lr * (m1[k] / (1 - 0.9**i)) / (np.sqrt(m2[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)

    # -- use ----------------------------------------------------------------

    def logits(self, texts: list[bytes], batch: int = 1024) -> np.ndarray:
        """Mean logits of the positions of every text."""
        out = np.zeros((len(texts), len(self.labels)), np.float32)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x, steps = to_blocks([texts[i] for i in part])
            out[part] = self._pooled(x, steps)
        return out

    def block_logits(self, texts: list[bytes], batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Logits of every step of every text, one after the other, and the steps of each: they hold for the BLOCK positions of the step."""
        steps = np.array([max(1, -(-len(t) // BLOCK)) for t in texts], np.int64)
        first = np.cumsum(steps) - steps
        out = np.empty((int(steps.sum()), len(self.labels)), np.float32)
        order = np.argsort(steps, kind="stable")
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            x, own = to_blocks([texts[i] for i in part])
            hid = self._hidden(x, own).transpose(1, 0, 2)
            live = np.arange(hid.shape[1])[None, :] < own[:, None]
            to = np.repeat(first[part] - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
            out[to] = hid[live] @ self.p["V"] + self.p["d"]
        return out, steps

    def position_logits(self, text: bytes) -> np.ndarray:
        """Logits of every position (byte) of one text."""
        x, steps = to_blocks([text])
        at = self._hidden(x, steps)
        return np.repeat((at @ self.p["V"] + self.p["d"])[:, 0], BLOCK, axis=0)[: len(text)]

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        """Sums of table rows, two bytes at a time: the sums of each pair are computed once."""
        if self._pairs is None:
            table = self.p["E"].reshape(BLOCK, 256, 6 * self.h)
            shared = self.p["P"].reshape(len(self.p["P"]), -1)[self.pair_id]
            self._pairs = [(table[o][:, None, :] + table[o + 1][None, :, :]).reshape(65536, -1) + shared for o in range(0, BLOCK, 2)]
            self._pairs[0] += self.p["b"].reshape(-1)
        xt = np.ascontiguousarray(x.transpose(1, 0, 2)).astype(np.int64)  # steps first
        xi = np.take(self._pairs[0], xt[:, :, 0] * 256 + xt[:, :, 1], axis=0, mode="clip")
        for o in range(2, BLOCK, 2):
            xi += np.take(self._pairs[o // 2], xt[:, :, o] * 256 + xt[:, :, o + 1], axis=0, mode="clip")
        return xi

    def _run(self, xi: np.ndarray, steps: np.ndarray, d: int, sink) -> None:
        """Texts are in order of length: at step t only those from first[t] on are live."""
        h, n = self.h, len(steps)
        lo = 3 * h * d
        # whole arrays for the gates and for the state: slices of columns are slow to work on
        u_zr, u_g = (np.ascontiguousarray(x) for x in (self.p["U"][d][:, : 2 * h], self.p["U"][d][:, 2 * h :]))
        c = self.p["c"][d]
        first = np.searchsorted(steps, np.arange(len(xi)), "right")
        s = np.zeros((n, h), np.float32)
        for t in range(len(xi)) if d == 0 else range(len(xi) - 1, -1, -1):
            f = first[t]
            sv = s[f:]
            row = xi[t, f:]
            zr = sv @ u_zr
            zr += row[:, lo : lo + 2 * h]
            _sigmoid(zr)
            g = sv @ u_g
            g += c
            g *= zr[:, h:]
            g += row[:, lo + 2 * h : lo + 3 * h]
            np.tanh(g, out=g)
            sv -= g
            sv *= zr[:, :h]
            sv += g
            sink(t, f, sv)

    def _pooled(self, x: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """The mean of logits is the logits of the mean state, so states are summed."""
        xi = self._inputs(x)
        total = np.zeros((2, len(steps), self.h), np.float32)
        for d in range(2):

            def add(t, f, s, d=d):
                total[d, f:] += s

            self._run(xi, steps, d, add)
        mean = np.concatenate([total[0], total[1]], 1) / steps[:, None]
        return mean @ self.p["V"] + self.p["d"]

    def _hidden(self, x: np.ndarray, steps: np.ndarray) -> np.ndarray:
        xi = self._inputs(x)
        out = np.zeros((len(xi), len(steps), 2 * self.h), np.float32)  # steps first
        for d in range(2):

            def put(t, f, s, d=d):
                out[t, f:, d * self.h : (d + 1) * self.h] = s

            self._run(xi, steps, d, put)
        return out
