"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Two LSTMs read a window of characters in both directions; their states give
each character a score per tag, and the CRF scores whole tag sequences. The
gradient is that of the exact negative log-likelihood.
"""

from __future__ import annotations

import numpy as np

TAGS = ["", "email", "ip", "card", "phone"]
HIDDEN = 16

# Symbols: 0 pads; letters, digits and signs that matter have one each.
_SIGNS = "@.-_+() \n:/,%'\"=|"
SYMBOLS = 1 + 26 + 1 + 1 + 1 + len(_SIGNS) + 1


def _symbol_table() -> np.ndarray:
    table = np.full(128, SYMBOLS - 1, dtype=np.int64)
    for i in range(26):
        table[ord("a") + i], table[ord("A") + i] = 1 + i, 27
    table[ord("0"):ord("9") + 1] = 28
    for i, sign in enumerate(_SIGNS):
        table[ord(sign)] = 30 + i
    return table


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes < 128, _TABLE[np.minimum(codes, 127)], 29)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int = 7, hidden: int = HIDDEN, tags: int = len(TAGS)) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = {"out": rng.normal(0, 0.3, (2 * hidden, tags)), "out_b": np.zeros(tags),
             "turn": np.zeros((tags, tags))}
    for side in ("f", "b"):
        model[f"in_{side}"] = rng.normal(0, 0.3, (SYMBOLS, 4 * hidden))
        model[f"re_{side}"] = rng.normal(0, 0.2, (hidden, 4 * hidden))
        model[f"bias_{side}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]
    return model


def _read(model: dict, side: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one LSTM over ``x`` (steps, windows)."""
    size = model[f"re_{side}"].shape[0]
    given, again = model[f"in_{side}"] + model[f"bias_{side}"], model[f"re_{side}"]
    h = np.zeros((x.shape[1], size), dtype=given.dtype)
    c = np.zeros_like(h)
    states = np.empty((*x.shape, size), dtype=given.dtype)
    for t in range(len(x)):
        z = given[x[t]] + h @ again
        gates = _sigmoid(z[:, :3 * size])
        i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
        g = np.tanh(z[:, 3 * size:])
        before, new = c, f * c + i * g
        squashed = np.tanh(new)
        if keep is not None:
            keep.append((i, f, o, g, before, squashed, h))
        c, h = new, o * squashed
        states[t] = h
    return states


def _read_back(model: dict, side: str, x: np.ndarray, keep: list, d_states: np.ndarray,
               grads: dict) -> None:
    """Gradient of one LSTM, from the last step to the first."""
    again = model[f"re_{side}"]
    d_h = np.zeros_like(d_states[0])
    d_c = np.zeros_like(d_h)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, before, squashed, h = keep[t]
        d_h = d_h + d_states[t]
        d_c = d_c + d_h * o * (1 - squashed * squashed)
        d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f),
                              d_h * squashed * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
        grads[f"re_{side}"] += h.T @ d_z
        np.add.at(grads[f"in_{side}"], x[t], d_z)
        grads[f"bias_{side}"] += d_z.sum(axis=0)
        d_h, d_c = d_z @ again.T, d_c * f


def emissions(model: dict, x: np.ndarray) -> np.ndarray:
    """Tag scores (steps, windows, tags) of symbol windows ``x`` (steps, windows)."""
    both = np.concatenate([_read(model, "f", x), _read(model, "b", x[::-1])[::-1]], axis=2)
    return both @ model["out"] + model["out_b"]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf(scores: np.ndarray, turn: np.ndarray, tags: np.ndarray):
    """Negative log-likelihood of ``tags`` summed over windows, and its gradients."""
    steps, wide, _ = scores.shape
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = scores[t] + _log_sum(alpha[t - 1][:, :, None] + turn, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(turn + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _log_sum(alpha[-1], 1)
    rows = np.arange(wide)
    said = sum(scores[t][rows, tags[t]] for t in range(steps))
    said = said + sum(turn[tags[t - 1], tags[t]] for t in range(1, steps))
    d_scores = np.exp(alpha + beta - total[None, :, None])
    d_turn = np.zeros_like(turn)
    for t in range(1, steps):
        d_turn += np.exp(alpha[t - 1][:, :, None] + turn + (scores[t] + beta[t])[:, None, :]
                         - total[:, None, None]).sum(axis=0)
        np.add.at(d_turn, (tags[t - 1], tags[t]), -1)
    for t in range(steps):
        d_scores[t][rows, tags[t]] -= 1
    return float((total - said).sum()), d_scores, d_turn


def loss(model: dict, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    kept: dict[str, list] = {"f": [], "b": []}
    forward = _read(model, "f", x, kept["f"])
    backward = _read(model, "b", x[::-1], kept["b"])[::-1]
    both = np.concatenate([forward, backward], axis=2)
    value, d_scores, d_turn = crf(both @ model["out"] + model["out_b"], model["turn"], tags)
    grads = {k: np.zeros_like(v) for k, v in model.items()}
    grads["turn"] = d_turn
    grads["out"] = np.einsum("tbh,tbk->hk", both, d_scores)
    grads["out_b"] = d_scores.sum(axis=(0, 1))
    d_both = d_scores @ model["out"].T
    size = forward.shape[2]
    _read_back(model, "f", x, kept["f"], d_both[:, :, :size], grads)
    _read_back(model, "b", x[::-1], kept["b"], d_both[::-1, :, size:], grads)
    return value, grads


def train(x: np.ndarray, tags: np.ndarray, passes: int = 8, batch: int = 64,
          rate: float = 0.02, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over shuffled batches of windows; ``x`` and ``tags`` are (windows, steps)."""
    model = initial(seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    rng, done = np.random.default_rng(seed), 0
    for _ in range(passes if len(x) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at:at + batch]
            _, grads = loss(model, x[pick].T, tags[pick].T)
            done += 1
            for k, g in grads.items():
                g = g / len(pick)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] = model[k] - rate * (first[k] / (1 - 0.9 ** done)) / (
                    np.sqrt(second[k] / (1 - 0.99 ** done)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in model.items()}


def decode(model: dict, x: np.ndarray) -> np.ndarray:
    """Best tag sequences (steps, windows) by Viterbi."""
    scores, turn = emissions(model, x), model["turn"]
    best, back = scores[0], []
    for t in range(1, len(x)):
        ways = best[:, :, None] + turn
        back.append(ways.argmax(axis=1).astype(np.int8))
        best = scores[t] + ways.max(axis=1)
    tags = np.empty(x.shape, dtype=np.int8)
    tags[-1] = best.argmax(axis=1)
    rows = np.arange(x.shape[1])
    for t in range(len(x) - 1, 0, -1):
        tags[t - 1] = back[t - 1][rows, tags[t]]
    return tags
