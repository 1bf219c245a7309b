"""A small gated recurrent language model in numpy with a class-factored output.

The probability of a token is that of its class given the state, times that of
the token in its class: a softmax given the state for the modelled words, a fixed
share for the members of an open class (the caller adds it).
"""

from __future__ import annotations

import numpy as np

HIDDEN, EMBED = 16, 16
WINDOW = 16  # steps of truncated backpropagation


class Vocabulary:
    """Ids 0..words-1 are modelled words (0 the end of a text), then one id for each open class.

    Modelled words, given by falling count, are cut into classes of equal size.
    """

    def __init__(self, words: int, classes: int, open_classes: int):
        self.words, self.size = words, words + open_classes
        self.width = -(-words // classes)
        self.closed = -(-words // self.width)
        self.classes = self.closed + open_classes
        ids = np.arange(self.size)
        self.class_of = np.where(ids < words, ids // self.width, self.closed + ids - words).astype(np.int64)


def initial(vocab: Vocabulary, counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Small random weights; output biases at the log of the counts, so that training starts from the unigram model."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    smooth = counts.astype(np.float64) + 0.5
    mass = np.bincount(vocab.class_of, smooth, vocab.classes)
    return {
        "E": draw(vocab.size, EMBED), "W": draw(EMBED, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32), "U": draw(HIDDEN, 3 * HIDDEN),
        "C": draw(HIDDEN, vocab.classes) * 0.1, "c": np.log(mass / mass.sum()).astype(np.float32),
        "V": draw(vocab.words, HIDDEN) * 0.1, "v": np.log(smooth[: vocab.words]).astype(np.float32),
    }


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def step(p: dict, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step from projected inputs a: the new state and what backpropagation needs."""
    g = h @ p["U"]
    zr = sigmoid(a[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = np.tanh(a[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
    return n + z * (h - n), z, r, n, g[:, 2 * HIDDEN :]


def log_likelihood(p: dict, vocab: Vocabulary, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probability of each target, its class's fixed share aside."""
    order = np.argsort(vocab.class_of[y].astype(np.uint16), kind="stable")
    h, y = h[order], y[order]  # a class's states are one slice
    cls = vocab.class_of[y]
    rows = np.arange(len(y))

    def log_share(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        x -= x.max(axis=1, keepdims=True)
        own = x[rows[: len(x)], at]
        return own - np.log(np.exp(x, out=x).sum(axis=1))

    found = log_share(h @ p["C"] + p["c"], cls)
    edges = np.searchsorted(cls, np.arange(vocab.closed + 1))
    for k in range(vocab.closed):
        i, j = edges[k], edges[k + 1]
        if i < j:
            lo = k * vocab.width
            hi = min(lo + vocab.width, vocab.words)
            found[i:j] += log_share(h[i:j] @ p["V"][lo:hi].T + p["v"][lo:hi], y[i:j] - lo)
    out = np.empty_like(found)
    out[order] = found
    return out


def score(p: dict, vocab: Vocabulary, texts: list[np.ndarray]) -> np.ndarray:
    """Log likelihood (natural) of every whole text; the texts go in step, the longest first, and states pass from window to window."""
    total = np.zeros(len(texts))
    if not texts:
        return total
    size = np.array([len(t) for t in texts])
    order = np.argsort(-size, kind="stable")
    size = size[order]
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    project = p["E"] @ p["W"] + p["b"]
    h = np.zeros((len(texts), HIDDEN), np.float32)
    last = np.zeros(len(texts), np.int64)
    got = np.zeros(len(texts))
    for t0 in range(0, int(size[0]), WINDOW):
        states, targets, owners = [], [], []
        for t in range(t0, min(t0 + WINDOW, int(size[0]))):
            m = int(np.searchsorted(-size, -t, side="left"))  # texts longer than t
            h = h[:m]
            h = step(p, project[last[:m]], h)[0]
            last = flat[start[:m] + t]
            states.append(h)
            targets.append(last)
            owners.append(np.arange(m))
        found = log_likelihood(p, vocab, np.concatenate(states), np.concatenate(targets))
        got += np.bincount(np.concatenate(owners), found, len(texts))
    total[order] = got
    return total


def output_gradients(p: dict, vocab: Vocabulary, hs: np.ndarray, ys: np.ndarray, g: dict) -> tuple[np.ndarray, float]:
    """Gradient of the mean loss by the states hs, with those of the output weights put into g, and the loss."""
    n = len(ys)
    scale = hs.dtype.type(1.0 / n)
    order = np.argsort(vocab.class_of[ys].astype(np.uint16), kind="stable")
    hs, ys = hs[order], ys[order]  # a class's states are one slice
    cls = vocab.class_of[ys]
    rows = np.arange(n)

    def softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
        """x becomes the scaled difference of the softmax and the targets."""
        x -= x.max(axis=1, keepdims=True)
        loss = -float(x[rows[: len(x)], at].sum())
        np.exp(x, out=x)
        total = x.sum(axis=1, keepdims=True)
        loss += float(np.log(total).sum())
        x *= scale / total
        x[rows[: len(x)], at] -= scale
        return x, loss

    d, loss = softmax(hs @ p["C"] + p["c"], cls)
    g["C"], g["c"] = hs.T @ d, d.sum(axis=0)
    dh = d @ p["C"].T
    edges = np.searchsorted(cls, np.arange(vocab.closed + 1))
    for k in range(vocab.closed):
        i, j = edges[k], edges[k + 1]
        if i < j:
            lo = k * vocab.width
            hi = min(lo + vocab.width, vocab.words)
            d, more = softmax(hs[i:j] @ p["V"][lo:hi].T + p["v"][lo:hi], ys[i:j] - lo)
            loss += more
            g["V"][lo:hi], g["v"][lo:hi] = d.T @ hs[i:j], d.sum(axis=0)
            dh[i:j] += d @ p["V"][lo:hi]
    out = np.empty_like(dh)
    out[order] = dh
    return out, loss / n


def gradients(p: dict, vocab: Vocabulary, x: np.ndarray, y: np.ndarray, h: np.ndarray, starts: np.ndarray | None = None) -> tuple[dict, np.ndarray, float]:
    """Gradients of the mean loss of one window (streams by steps), the state after it, and the loss.

    Negative targets are padding at a stream's end and have no loss; where ``starts``
    is true a text begins and the state before it counts as zero.
    """
    n, steps = x.shape
    x = np.ascontiguousarray(x.T)
    project = p["E"] @ p["W"] + p["b"]
    a = project[x]
    keep = None if starts is None else (~starts.T[:, :, None]).astype(h.dtype)
    saved, states = [], []
    for t in range(steps):
        if keep is not None:
            h = h * keep[t]
        new, *rest = step(p, a[t], h)
        saved.append((h, *rest))
        states.append(new)
        h = new
    hs, ys = np.concatenate(states), y.T.reshape(-1)
    g = {k: np.zeros_like(w) for k, w in p.items()}
    real = np.flatnonzero(ys >= 0)
    dh_all = np.zeros_like(hs)
    dh_all[real], loss = output_gradients(p, vocab, hs[real], ys[real], g)
    dh_all = dh_all.reshape(steps, n, HIDDEN)
    da = np.empty_like(a)
    dh = np.zeros((n, HIDDEN), a.dtype)
    for t in range(steps - 1, -1, -1):
        before, z, r, cand, gn = saved[t]
        dh = dh + dh_all[t]
        rest = dh * (1 - z)
        dcand = rest * (1 - cand * cand)
        da[t, :, :HIDDEN] = rest * (before - cand) * z
        da[t, :, HIDDEN : 2 * HIDDEN] = dcand * gn * r * (1 - r)
        da[t, :, 2 * HIDDEN :] = dcand
        dg = da[t].copy()
        dg[:, 2 * HIDDEN :] *= r
        g["U"] += before.T @ dg
        dh = dh * z + dg @ p["U"].T
        if keep is not None:
            dh = dh * keep[t]
    # sums over equal inputs: one row of the projection each
    flat, inputs = da.reshape(-1, 3 * HIDDEN), x.reshape(-1)
    order = np.argsort(inputs.astype(np.uint16), kind="stable")
    inputs = inputs[order]
    first = np.flatnonzero(np.concatenate([[True], inputs[1:] != inputs[:-1]]))
    sums, at = np.add.reduceat(flat[order], first, axis=0), inputs[first]
    g["b"] = sums.sum(axis=0)
    g["W"] = p["E"][at].T @ sums
    g["E"][at] = sums @ p["W"].T
    return g, h, loss


def lanes(texts: list[np.ndarray], streams: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and starts (streams by tokens) of texts laid end to end and cut into equal streams; each token is a target once, the last stream is padded.

    A text's first input is the end before it, id 0. A text that is cut goes on in the
    next stream from a zero state.
    """
    ids = np.concatenate([np.zeros(0, np.int64), *texts]).astype(np.int64)
    begins = np.zeros(len(ids), dtype=bool)
    if len(texts):
        begins[np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])] = True
    width = -(-len(ids) // streams)
    pad = width * streams - len(ids)
    before = np.where(begins, 0, np.concatenate([[0], ids[:-1]]) if len(ids) else ids)
    shaped = lambda v, fill: np.pad(v, (0, pad), constant_values=fill).reshape(streams, width)
    return shaped(before, 0), shaped(ids, -1), shaped(begins, False)


def train(p: dict, vocab: Vocabulary, batches, rate: float = 0.01) -> tuple[dict, int]:
    """Adam over batches of lanes (inputs, targets, starts), window by window; the state passes from window to window. Returns the tokens seen."""
    p = {k: w.copy() for k, w in p.items()}
    m = {k: np.zeros_like(w) for k, w in p.items()}
    s = {k: np.zeros_like(w) for k, w in p.items()}
    seen = n = 0
    for inputs, targets, starts in batches:
        h = np.zeros((len(inputs), HIDDEN), np.float32)
        for t in range(0, inputs.shape[1], WINDOW):
            y = targets[:, t : t + WINDOW]
            if not (y >= 0).any():
                break
            g, h, _ = gradients(p, vocab, inputs[:, t : t + WINDOW], y, h, starts[:, t : t + WINDOW])
            n += 1
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            for k, x in g.items():
                x = x * np.float32(clip)
                m[k] += 0.1 * (x - m[k])
                s[k] += 0.01 * (x * x - s[k])
                p[k] -= np.float32(rate) * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.99**n)) + 1e-6)
            seen += int((y >= 0).sum())
    return p, seen
