"""Linear-chain conditional random fields over many sequences at once, in numpy.

Sequences lie one after another in one array of emissions. Forward and backward messages run over blocks of BLOCK items
in parallel: each block's transfer matrix first, then the blocks of a sequence in turn, then all items within blocks.
The result is that of the plain recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 32


@dataclass
class Chain:
    """Log scores of first labels (K) and of label pairs (K, K)."""

    start: np.ndarray
    trans: np.ndarray


def messages(em: np.ndarray, off: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages (N, K), each summing to 1, and exp(emissions) up to a factor.

    off: the n + 1 places at which sequences begin and end; sequences may be empty.
    """
    n, k = em.shape
    e = np.exp(em - em.max(axis=1, keepdims=True)) if n else em
    fwd, bwd = np.empty((n, k)), np.empty((n, k))
    if not n:
        return fwd, bwd, e
    t, s = np.exp(chain.trans - chain.trans.max()), np.exp(chain.start - chain.start.max())
    size = np.diff(off)
    seqs = np.flatnonzero(size)
    blocks = -(-size[seqs] // BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    c = first_block[-1]
    nth = np.arange(c) - np.repeat(first_block[:-1], blocks)
    begin = np.repeat(off[seqs], blocks) + nth * BLOCK
    length = np.minimum(BLOCK, np.repeat(off[seqs + 1], blocks) - begin)
    head = nth == 0
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)

    p = np.broadcast_to(np.eye(k), (c, k, k)).copy()
    steps = int(length.max())
    at = begin[:, None] + np.minimum(np.arange(steps), length[:, None] - 1)
    e_at = e[at]
    for i in range(steps):
        live = length > i
        q = p.reshape(-1, k) @ t
        q = q.reshape(c, k, k)
        if i == 0:
            q[head] = s
        q *= e_at[:, i, None, :]
        q /= q.sum(axis=(1, 2), keepdims=True)
        p = q if live.all() else np.where(live[:, None, None], q, p)
    into, out_of = np.full((c, k), 1.0 / k), np.full((c, k), 1.0 / k)
    for j in range(1, int(blocks.max())):
        b = first_block[:-1][blocks > j] + j
        into[b] = norm(np.einsum("bi,bij->bj", into[b - 1], p[b - 1]))
    for j in range(1, int(blocks.max())):
        b = first_block[1:][blocks > j] - 1 - j
        out_of[b] = norm(np.einsum("bij,bj->bi", p[b + 1], out_of[b + 1]))
    a, back = into, out_of
    for i in range(steps):
        live = length > i
        nxt = a @ t
        if i == 0:
            nxt[head] = s
        nxt = norm(nxt * e_at[:, i])
        a = nxt
        fwd[begin[live] + i] = a[live]
    for i in range(steps - 1, -1, -1):
        live = length > i
        bwd[begin[live] + i] = back[live]
        prev = norm((e_at[:, i] * back) @ t.T)
        back = np.where(live[:, None], prev, back)
    return fwd, bwd, e


def marginals(em: np.ndarray, off: np.ndarray, chain: Chain) -> np.ndarray:
    """Posterior of each label at each item (N, K)."""
    fwd, bwd, _ = messages(em, off, chain)
    post = fwd * bwd
    return post / post.sum(axis=1, keepdims=True) if len(post) else post


def gradients(em: np.ndarray, off: np.ndarray, chain: Chain, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log likelihood of the gold labels: by emissions, start scores and pair scores."""
    n, k = em.shape
    fwd, bwd, e = messages(em, off, chain)
    post = fwd * bwd
    post /= post.sum(axis=1, keepdims=True)
    d_em = -post
    d_em[np.arange(n), gold] += 1
    firsts = off[:-1][np.diff(off) > 0]
    d_start = d_em[firsts].sum(axis=0)
    later = np.ones(n, bool)
    later[firsts] = False
    i = np.flatnonzero(later)
    t = np.exp(chain.trans - chain.trans.max())
    pair = fwd[i - 1][:, :, None] * t * (e[i] * bwd[i])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    d_trans = -pair.sum(axis=0)
    np.add.at(d_trans, (gold[i - 1], gold[i]), 1)
    return d_em, d_start, d_trans


class Adam:
    """Ascent steps on a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.n = params, rate, decay, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.n += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            g = g - self.decay * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-8)
