"""A linear-chain conditional random field of two tags over many texts at once, in numpy.

Tag 1 is the one looked for. A token's score for tag 1 (against 0 for tag 0) and the weights of the steps 0-1, 1-0 and
1-1 (against 0 for 0-0) give the probabilities of all taggings of a text. Chains run over whole texts, of any length: they
are cut into blocks, whose products of 2 x 2 matrices carry the messages across, so all blocks advance together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 64


@dataclass
class Marginals:
    tag: np.ndarray  # of each token, the probability of tag 1
    steps: np.ndarray  # expected number of steps, 2 x 2
    log_z: float  # of all texts


def _rows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(first block of each text, its number of blocks, place of each token in blocks x BLOCK, number of blocks)."""
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return first, blocks, np.repeat(first * BLOCK, lengths) + inside, int(blocks.sum())


def _normal(x: np.ndarray, axes) -> tuple[np.ndarray, np.ndarray]:
    size = x.sum(axis=axes, keepdims=True)
    return x / size, size


def marginals(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> Marginals:
    """scores: of all tokens, text after text; lengths: of the texts, in tokens, none empty; steps: 2 x 2 weights."""
    if not len(lengths):
        return Marginals(np.zeros(0), np.zeros((2, 2)), 0.0)
    first, blocks, place, total = _rows(lengths)
    # Potentials are divided by the larger of the two, which log_z gets back; padding is the identity.
    top = np.maximum(scores, 0)
    psi = np.ones((2, total * BLOCK))
    psi[:, place] = np.exp(np.array([-top, scores - top]))
    begins = np.zeros(total * BLOCK, bool)
    begins[first * BLOCK] = True
    padding = np.ones(total * BLOCK, bool)
    padding[place] = False
    move = np.exp(steps)
    edge = np.where(begins, 1.0, move[:, :, None]) * psi[None]  # from, to, place
    edge[:, :, padding] = np.eye(2)[:, :, None]
    edge = edge.reshape(2, 2, total, BLOCK)

    product = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, total)).copy()
    for t in range(BLOCK):
        e = edge[:, :, :, t]
        product = np.stack([np.stack([product[i, 0] * e[0, j] + product[i, 1] * e[1, j] for j in (0, 1)]) for i in (0, 1)])
        product, _ = _normal(product, (0, 1))
    # Messages at the ends of blocks: forward in the order of blocks of a text, backward against it.
    ahead, back = np.zeros((2, total)), np.ones((2, total))
    ahead[0, first] = 1.0
    order = np.argsort(-blocks, kind="stable")
    sizes = blocks[order]
    for k in range(1, int(blocks.max())):
        own = first[order[: np.searchsorted(-sizes, -k)]] + k  # texts that have a block k
        a, p = ahead[:, own - 1], product[:, :, own - 1]
        ahead[:, own], _ = _normal(a[0] * p[0] + a[1] * p[1], 0)
    last = first + blocks - 1
    for k in range(1, int(blocks.max())):
        own = last[order[: np.searchsorted(-sizes, -k)]] - k
        b, p = back[:, own + 1], product[:, :, own + 1]
        back[:, own], _ = _normal(np.stack([p[0, 0] * b[0] + p[0, 1] * b[1], p[1, 0] * b[0] + p[1, 1] * b[1]]), 0)

    forward, before = np.empty((2, total, BLOCK)), np.empty((2, total, BLOCK))
    log_z, a = 0.0, ahead
    for t in range(BLOCK):
        before[:, :, t] = a
        e = edge[:, :, :, t]
        a, size = _normal(a[0] * e[0] + a[1] * e[1], 0)
        forward[:, :, t] = a
        log_z += float(np.log(size).sum())
    backward, b = np.empty((2, total, BLOCK)), back
    for t in reversed(range(BLOCK)):
        backward[:, :, t] = b
        e = edge[:, :, :, t]
        b, _ = _normal(np.stack([e[0, 0] * b[0] + e[0, 1] * b[1], e[1, 0] * b[0] + e[1, 1] * b[1]]), 0)
    tag, _ = _normal(forward * backward, 0)
    joint = before[:, None] * edge * backward[None]  # from, to
    joint, _ = _normal(joint, (0, 1))
    inner = (~begins & ~padding).reshape(total, BLOCK)
    return Marginals(tag[1].reshape(-1)[place], joint[:, :, inner].sum(axis=2), log_z + float(top.sum()))


def tagged_score(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray]:
    """(score of the given tagging of all texts, how often it takes each step, 2 x 2)."""
    taken = np.zeros((2, 2))
    if len(tags):
        inner = np.ones(len(tags), bool)
        inner[np.cumsum(lengths) - lengths] = False
        at = np.flatnonzero(inner)
        taken += np.bincount(2 * tags[at - 1] + tags[at], minlength=4).reshape(2, 2)
    return float(scores[tags == 1].sum() + (taken * steps).sum()), taken


def minimise(function, start: np.ndarray, rounds: int = 25, memory: int = 8, tolerance: float = 1e-4) -> np.ndarray:
    """L-BFGS with backtracking. function: a point to (value, gradient)."""
    x, (value, slope) = start, function(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = slope.copy(), []
        for s, y in reversed(steps):
            alphas.append(s @ q / (s @ y))
            q -= alphas[-1] * y
        q *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(1.0, float(np.abs(slope).max()))
        for (s, y), a in zip(steps, reversed(alphas)):
            q += (a - y @ q / (s @ y)) * s
        rate = 1.0
        while True:
            new, (lower, gradient) = x - rate * q, (0.0, slope)
            lower, gradient = function(new)
            if lower <= value - 1e-4 * rate * (q @ slope) or rate < 1e-3:
                break
            rate /= 2
        if lower >= value:
            break
        s, y, gain = new - x, gradient - slope, value - lower
        if s @ y > 1e-10:
            steps = [*steps[-(memory - 1) :], (s, y)]
        x, value, slope = new, lower, gradient
        if gain < tolerance * max(1.0, abs(value)):
            break
    return x
