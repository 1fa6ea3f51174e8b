"""A bidirectional LSTM in numpy that labels the blocks of a page as main text or not."""

from __future__ import annotations

import numpy as np

from pagelathe.llm.html_blocks import NUMBERS, PATH_SLOTS, WORD_SLOTS, Block, Features, blocks_of, features
from pagelathe.llm.page_samples import Pages

EMBED, HIDDEN = 32, 24
TRAIN_PAGES, EPOCHS, BATCH, SEED = 1400, 8, 32, 5
Weights = dict[str, np.ndarray]


def _fresh(rng: np.random.Generator) -> Weights:
    near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"slots": rng.normal(0, 0.15, (PATH_SLOTS + WORD_SLOTS, EMBED)).astype(np.float32), "numbers": near(NUMBERS, EMBED), "bias": np.zeros(EMBED, np.float32)}
    for d in "fb":
        w |= {f"x{d}": near(EMBED, 4 * HIDDEN), f"h{d}": near(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
        w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1
    return w | {"out": near(2 * HIDDEN + EMBED, 1), "out_bias": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _embed(w: Weights, f: Features) -> np.ndarray:
    e = np.zeros((len(f.numbers), EMBED), np.float32)
    order = np.argsort(f.block, kind="stable")
    if len(order):
        rows = w["slots"][f.slot[order]] * f.weight[order, None]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(f.block[order]) > 0]))
        e[f.block[order][heads]] = np.add.reduceat(rows, heads, axis=0)
    return np.tanh(e + f.numbers @ w["numbers"] + w["bias"])


def _run(w: Weights, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = False):
    """x (T, pages, EMBED) to hidden states (T, pages, HIDDEN); masked steps leave the state as it is."""
    steps, n, _ = x.shape
    gates_x = x @ w[f"x{d}"] + w[f"c{d}"]
    h = c = np.zeros((n, HIDDEN), np.float32)
    out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        g = gates_x[t] + h @ w[f"h{d}"]
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c_new = f * c + i * u
        th = np.tanh(c_new)
        if keep:
            tape.append((t, i, f, o, u, c, th, h, m))
        c = np.where(m, c_new, c)
        h = np.where(m, o * th, h)
        out[t] = h
    return out, tape


def _back(w: Weights, x: np.ndarray, tape: list, d_out: np.ndarray, d: str, grad: Weights) -> np.ndarray:
    n = x.shape[1]
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    dg_all = np.zeros((x.shape[0], n, 4 * HIDDEN), np.float32)
    for t, i, f, o, u, c, th, h, m in reversed(tape):
        dh = dh + d_out[t]
        live, kept = np.where(m, dh, 0), np.where(m, 0, dh)
        dcn = np.where(m, dc, 0) + live * o * (1 - th**2)
        dg = np.concatenate([dcn * u * i * (1 - i), dcn * c * f * (1 - f), live * th * o * (1 - o), dcn * i * (1 - u**2)], 1)
        dg_all[t] = dg
        grad[f"h{d}"] += h.T @ dg
        dh = dg @ w[f"h{d}"].T + kept
        dc = np.where(m, dcn * f, dc)
    flat = dg_all.reshape(-1, 4 * HIDDEN)
    grad[f"x{d}"] += x.reshape(-1, EMBED).T @ flat
    grad[f"c{d}"] += flat.sum(0)
    return dg_all @ w[f"x{d}"].T


def _padded(e: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = int(counts.max())
    mask = np.arange(steps)[:, None] < counts[None, :]
    x = np.zeros((steps, len(counts), e.shape[1]), np.float32)
    x.transpose(1, 0, 2)[mask.T] = e
    return x, mask


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Weights from made-up pages labelled by construction; the same for the same arguments."""
    rng, maker = np.random.default_rng(seed), Pages(seed)
    data = [(blocks_of(h), truth) for h, truth in (maker.page() for _ in range(pages))]
    data = [(b, np.array([y for _, y in t], np.float32)) for b, t in data if len(b) == len(t)]
    w = _fresh(rng)
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for a in range(0, len(order), BATCH):
            some = [data[k] for k in order[a : a + BATCH]]
            f, y = features([b for b, _ in some]), np.concatenate([y for _, y in some])
            hide = rng.random(len(f.slot)) < 0.1
            f.weight[hide] = 0
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            e = _embed(w, f)
            x, mask = _padded(e, np.array([len(b) for b, _ in some]))
            (hf, tf), (hb, tb) = (_run(w, x, mask, d, True) for d in "fb")
            z = np.concatenate([hf, hb, x], 2)
            p = _sigmoid(z @ w["out"] + w["out_bias"])[:, :, 0]
            target = np.zeros_like(p)
            target.T[mask.T] = y
            dz = np.where(mask, p - target, 0)[:, :, None] / len(y)
            grad["out"] += z.reshape(-1, z.shape[2]).T @ dz.reshape(-1, 1)
            grad["out_bias"] += dz.sum((0, 1))
            back = dz @ w["out"].T
            dx = back[:, :, 2 * HIDDEN :] + _back(w, x, tf, back[:, :, :HIDDEN], "f", grad) + _back(w, x, tb, back[:, :, HIDDEN : 2 * HIDDEN], "b", grad)
            de = dx.transpose(1, 0, 2)[mask.T] * (1 - e**2)
            grad["numbers"] += f.numbers.T @ de
            grad["bias"] += de.sum(0)
            np.add.at(grad["slots"], f.slot, de[f.block] * f.weight[:, None])
            step += 1
            rate = 0.01 * (1 - epoch / epochs * 0.8)
            for k in w:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                w[k] = w[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in w.items()}


_trained: dict[tuple, Weights] = {}


def trained(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """train(), once a process."""
    key = (pages, epochs, seed)
    if key not in _trained:
        _trained[key] = train(*key)
    return _trained[key]


def label(w: Weights, pages: list[list[Block]], most_cells: int = 40_000) -> list[np.ndarray]:
    """Probability that each block is main text. Pages of like length run together; each is read whole."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    while order:
        n = 1
        while n < min(len(order), 256) and (n + 1) * len(pages[order[-1]]) <= most_cells and 2 * len(pages[order[-n - 1]]) >= len(pages[order[-1]]):
            n += 1
        some, order = order[-n:], order[:-n]
        e = _embed(w, features([pages[k] for k in some]))
        counts = np.array([len(pages[k]) for k in some])
        x, mask = _padded(e, counts)
        z = np.concatenate([_run(w, x, mask, "f")[0], _run(w, x, mask, "b")[0], x], 2)
        p = _sigmoid(z @ w["out"] + w["out_bias"])[:, :, 0]
        for j, k in enumerate(some):
            out[k] = p[: counts[j], j]
    return out
