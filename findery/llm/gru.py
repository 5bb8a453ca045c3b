"""A small gated recurrent language model in numpy: class-factored softmax, truncated back-propagation.

Output: P(word | h) = P(class | h) P(word | class, h) for words of the head; a word outside the head has a class
for itself and its like, and the model gives the class alone. Documents lie one after another in parallel
streams; the state is carried over windows, in training and scoring alike, and cleared where a document starts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

#: Width of embedding and state, steps in a window, words in a head class, streams at most.
WIDTH, STEPS, CLASS_WORDS, STREAMS = 12, 32, 32, 512
#: Rows of class logits at once.
ROWS = 2048
RATE, CLIP = 0.15, 1.0


def init(head: int, tails: int, head_counts: np.ndarray, tail_counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters; biases start at the unigram model. head is a multiple of CLASS_WORDS."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    groups = np.maximum(head_counts.reshape(-1, CLASS_WORDS), 0.1)
    classes = np.concatenate([groups.sum(axis=1), np.maximum(tail_counts, 0.1)])
    return {
        "emb": normal(head + tails, WIDTH, scale=0.3),
        "wx": normal(WIDTH, 3 * WIDTH, scale=0.25),
        "wh": normal(WIDTH, 3 * WIDTH, scale=0.25),
        "b": np.concatenate([np.full(WIDTH, 1.0), np.zeros(2 * WIDTH)]).astype(np.float32),
        "cls": normal(WIDTH, len(classes), scale=0.05),
        "cls_b": np.log(classes / classes.sum()).astype(np.float32),
        "word": normal(len(groups), WIDTH, CLASS_WORDS, scale=0.05),
        "word_b": np.log(groups / groups.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def shaped(vector: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = vector[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def streams(docs: list[np.ndarray], end: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows (inputs, targets, document index), each (steps, streams); index -1 is padding.

    The longest document goes first to the shortest stream, so that streams are of like length.
    """
    sizes = np.array([len(d) for d in docs])
    if not len(docs):
        return
    n = int(min(STREAMS, max(1, sizes.sum() // max(1, sizes.max()))))
    heap = [(0, s) for s in range(n)]
    lanes: list[list[int]] = [[] for _ in range(n)]
    for d in np.argsort(-sizes, kind="stable").tolist():
        filled, s = heapq.heappop(heap)
        lanes[s].append(d)
        heapq.heappush(heap, (filled + int(sizes[d]), s))
    steps = max(f for f, _ in heap)
    target = np.full((steps, n), end, dtype=np.int32)
    index = np.full((steps, n), -1, dtype=np.int32)
    first = np.zeros((steps, n), dtype=bool)
    for s, lane in enumerate(lanes):
        at = 0
        for d in lane:
            target[at : at + sizes[d], s] = docs[d]
            index[at : at + sizes[d], s] = d
            first[at, s] = True
            at += int(sizes[d])
    given = np.concatenate([np.full((1, n), end, np.int32), target[:-1]])
    given[first] = -1  # a document starts: no word before it, and no state
    for at in range(0, steps, STEPS):
        yield given[at : at + STEPS], target[at : at + STEPS], index[at : at + STEPS]


class Model:
    """Forward and backward over windows; end is the id that also stands before a document."""

    def __init__(self, params: dict[str, np.ndarray], end: int) -> None:
        self.p, self.end = params, end
        self.head = params["word"].shape[0] * CLASS_WORDS
        self.g2 = {k: np.full_like(v, 1e-3) for k, v in params.items()}

    def run(self, given: np.ndarray, h: np.ndarray) -> tuple:
        """States of a window, and what the backward step needs. Features lead: arrays are (features, streams)."""
        p, w = self.p, WIDTH
        steps, n = given.shape
        ids = np.where(given < 0, self.end, given)
        carry = (given >= 0).astype(np.float32)
        # the input's share of every word at once, then of all steps
        shares = (p["emb"] @ p["wx"] + p["b"]).take(ids.ravel(), axis=0)
        shares = np.ascontiguousarray(shares.reshape(steps, n, 3 * w).transpose(0, 2, 1))
        wh = np.ascontiguousarray(p["wh"].T)
        out = np.empty((steps, w, n), np.float32)
        kept = []
        for t in range(steps):
            before = h * carry[t]
            a = wh @ before
            x = shares[t]
            gates = x[: 2 * w]
            gates += a[: 2 * w]
            np.negative(gates, out=gates)
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            z, r = gates[:w], gates[w:]
            new = r * a[2 * w :]
            new += x[2 * w :]
            np.tanh(new, out=new)
            h = out[t]
            np.subtract(before, new, out=h)
            h *= z
            h += new
            kept.append((before, a[2 * w :], z, r, new))
        return h, out.transpose(0, 2, 1).reshape(-1, w), (ids, carry, kept)

    def output(self, states: np.ndarray, targets: np.ndarray, learn: bool = False) -> tuple:
        """Natural log-probabilities of (class, and word in its class for the head), and gradients."""
        p = self.p
        kind = np.where(targets < self.head, targets // CLASS_WORDS, targets - self.head + self.head // CLASS_WORDS)
        # logits of this size need no shift by their maximum: |h| < 1 and the weights are clipped
        logp, grads, dh = np.empty(len(targets), np.float32), {}, None
        if learn:
            grads = {k: np.zeros_like(p[k]) for k in ("cls", "cls_b", "word", "word_b")}
            dh = np.empty_like(states)
        ones = np.ones(max(p["cls"].shape[1], ROWS), np.float32)
        for at in range(0, len(targets), ROWS):  # so many rows' logits stay near the processor
            part = slice(at, at + ROWS)
            e = states[part] @ p["cls"]
            e += p["cls_b"]
            np.exp(e, out=e)
            total = e @ ones[: e.shape[1]]
            picked = (np.arange(len(e)), kind[part])
            logp[part] = np.log(e[picked] / total)
            if learn:
                e *= (-1 / total)[:, None]
                e[picked] += 1
                grads["cls"] += states[part].T @ e
                grads["cls_b"] += ones[: len(e)] @ e
                np.matmul(e, p["cls"].T, out=dh[part])
        # words of one class lie together, so that each class of the head is one slice; what is not a product is done for all at once
        order = np.argsort(kind.astype(np.uint16), kind="stable")
        edges = np.searchsorted(kind[order], np.arange(self.head // CLASS_WORDS + 1))
        order = order[: edges[-1]]
        near, words = states[order], targets[order] % CLASS_WORDS
        e = p["word_b"].take(kind[order], axis=0)
        used = np.flatnonzero(np.diff(edges)).tolist()
        for c in used:
            mine = slice(edges[c], edges[c + 1])
            e[mine] += near[mine] @ p["word"][c]
        np.exp(e, out=e)
        total = e @ np.ones(CLASS_WORDS, np.float32)
        picked = (np.arange(len(e)), words)
        more = np.log(e[picked] / total)
        if learn and used:
            e *= (-1 / total)[:, None]
            e[picked] += 1
            dnear = np.empty_like(near)
            for c in used:
                mine = slice(edges[c], edges[c + 1])
                grads["word"][c] = near[mine].T @ e[mine]
                np.matmul(e[mine], p["word"][c].T, out=dnear[mine])
            grads["word_b"][used] = np.add.reduceat(e, edges[used], axis=0)
            dh[order] += dnear
        logp[order] += more
        return logp, grads, dh

    def learn(self, given: np.ndarray, targets: np.ndarray, index: np.ndarray, h: np.ndarray) -> np.ndarray:
        """One step of ascent on a window; returns the state to carry on."""
        p, w = self.p, WIDTH
        steps, n = given.shape
        last, states, (ids, carry, kept) = self.run(given, h)
        real = np.flatnonzero((index >= 0).ravel())
        n_real = max(1, len(real))
        dstates = np.zeros_like(states)
        _, grads, dstates[real] = self.output(states[real], targets.ravel()[real], learn=True)
        dstates = np.ascontiguousarray(dstates.reshape(steps, n, w).transpose(0, 2, 1))
        da = np.empty((3 * w, steps, n), np.float32)  # of the input's share
        dah = np.empty((steps, 3 * w, n), np.float32)  # of the state's share
        dh = np.zeros_like(h)
        for t in range(steps - 1, -1, -1):
            before, an, z, r, new = kept[t]
            dh += dstates[t]
            keep = 1 - z
            dn = dh * keep
            dn *= 1 - new * new
            dz = before - new
            dz *= dh
            dz *= z
            dz *= keep
            dr = dn * an
            dr *= r
            dr *= 1 - r
            da[:w, t], da[w : 2 * w, t], da[2 * w :, t] = dz, dr, dn
            dn *= r
            dah[t, :w], dah[t, w : 2 * w], dah[t, 2 * w :] = dz, dr, dn
            dh *= z
            dh += p["wh"] @ dah[t]
            dh *= carry[t]
        dwh = np.matmul(dah, np.stack([k[0] for k in kept]).transpose(0, 2, 1)).sum(axis=0)
        # gradients of the words' shares, summed by word
        order = np.argsort(ids.ravel().astype(np.uint16), kind="stable")
        who, starts = np.unique(ids.ravel()[order], return_index=True)
        dx = np.zeros((len(p["emb"]), 3 * w), np.float32)
        dx[who] = np.add.reduceat(da.reshape(3 * w, -1).take(order, axis=1), starts, axis=1).T
        grads |= {"wx": p["emb"].T @ dx, "wh": dwh.T, "b": dx.sum(axis=0), "emb": dx @ p["wx"].T}
        for k, g in grads.items():
            g = g / np.float32(n_real) ** 0.5
            np.clip(g, -CLIP, CLIP, out=g)
            self.g2[k] += g * g
            p[k] += RATE * g / np.sqrt(self.g2[k])
            np.clip(p[k], -12, 12, out=p[k])
        return last

    def train(self, docs: list[np.ndarray]) -> None:
        h = None
        for given, targets, index in streams(docs, self.end):
            h = np.zeros((WIDTH, given.shape[1]), np.float32) if h is None else h
            h = self.learn(given, targets, index, h)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each whole document."""
        out = np.zeros(len(docs))
        h = None
        for given, targets, index in streams(docs, self.end):
            h = np.zeros((WIDTH, given.shape[1]), np.float32) if h is None else h
            h, states, _ = self.run(given, h)
            real = np.flatnonzero((index >= 0).ravel())
            logp, _, _ = self.output(states[real], targets.ravel()[real])
            out += np.bincount(index.ravel()[real], weights=logp, minlength=len(docs))
        return out
