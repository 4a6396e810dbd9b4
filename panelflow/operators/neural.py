"""Small trained models of influence: attention over leaders' lags, and recurrent Granger tests.

Both are plain numpy with hand-written gradients; targets are dealt to tasks in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from panelflow.operators.discovery import on_targets


class Adam:
    def __init__(self, rate: float):
        self.rate, self.turn, self.held = rate, 0, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.turn += 1
        for name, g in grads.items():
            m, v = self.held.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[name] -= self.rate * (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.999**self.turn)) + 1e-8)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def rank_loss(guess: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean logistic loss of the order of all pairs with different targets, and its gradient."""
    sign = np.sign(y[:, None] - y[None])
    n = np.count_nonzero(sign)
    if not n:
        return 0.0, np.zeros_like(guess)
    z = -sign * (guess[:, None] - guess[None])
    loss = np.where(sign != 0, np.logaddexp(0, z), 0.0).sum() / n
    g = np.where(sign != 0, -sign / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)
    return float(loss), (g.sum(1) - g.sum(0)) / n


class LagAttention:
    """A target as the sum of leaders' returns, each at softly chosen lags with a positive scale.

    It starts from zeros, so a fit depends on nothing but the data. top: lags of a leader that take
    part (with those that are level with the last of them; 0: all).
    """

    def __init__(self, leaders: int, max_lag: int = 10, top: int = 0, temperature: float = 1.0):
        self.top, self.temperature = top, temperature
        self.p = {"logit": np.zeros((leaders, max_lag)), "scale": np.zeros(leaders), "bias": np.zeros(1)}

    def attention(self) -> np.ndarray:
        x = self.p["logit"] / self.temperature
        if self.top and self.top < x.shape[1]:
            x = np.where(x >= np.sort(x, 1)[:, -self.top][:, None], x, -np.inf)
        return softmax(x)

    def scale(self) -> np.ndarray:
        return np.logaddexp(0, self.p["scale"])

    @staticmethod
    def tensor(x: np.ndarray, max_lag: int) -> np.ndarray:
        """[time, leader, lag]: row t has the leaders' returns 1 … max_lag steps before."""
        return np.stack([x[max_lag - k : len(x) - k] for k in range(1, max_lag + 1)], 2)

    def predict(self, tensor: np.ndarray) -> np.ndarray:
        if tensor.shape[1:] != self.p["logit"].shape:
            raise ValueError("the tensor isn't of this model's leaders and lags")
        return np.einsum("tnl,nl,n->t", tensor, self.attention(), self.scale()) + self.p["bias"][0]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 200, rate: float = 0.05, l1: float = 1e-3, loss: str = "rank") -> LagAttention:
        max_lag = self.p["logit"].shape[1]
        if len(y) <= max_lag + 10:
            raise ValueError("too few bars for this many lags")
        tensor, y = self.tensor(x, max_lag), y[max_lag:]
        adam = Adam(rate)
        for _ in range(epochs):
            a, s = self.attention(), self.scale()
            seen = np.einsum("tnl,nl->tn", tensor, a)
            guess = seen @ s + self.p["bias"][0]
            if loss == "rank":
                self.loss, g = rank_loss(guess, y)
            else:
                self.loss, g = float(((guess - y) ** 2).mean()), 2 * (guess - y) / len(y)
            by_leader = g @ seen
            ga = np.einsum("t,tnl->nl", g, tensor) * s[:, None]
            self_grads = {
                "logit": a * (ga - (ga * a).sum(1, keepdims=True)) / self.temperature,
                "scale": (by_leader + l1) / (1 + np.exp(-self.p["scale"])),
                "bias": np.array([g.sum()]),
            }
            adam.step(self.p, self_grads)
        guess = self.predict(tensor)
        spread = guess.std() * y.std()
        self.ic = float(((guess - guess.mean()) * (y - y.mean())).mean() / spread) if spread > 1e-15 else 0.0
        return self

    def lags(self) -> np.ndarray:
        return self.attention().argmax(1) + 1


def attention_edges(returns: DataFrame, targets: list[str] | None = None, max_lag: int = 10, epochs: int = 200, rate: float = 0.05, l1: float = 1e-3, loss: str = "rank", top: int = 0, min_weight: float = 1e-3, temperature: float = 1.0) -> DataFrame:
    """(source, target, lag, attention, scale, weight, loss, ic): the leaders and lags of each target's fit whose
    weight, attention times scale, is at least min_weight.
    """

    def fit(names: list[str], x: np.ndarray, at: int) -> pd.DataFrame:
        others = [i for i in range(len(names)) if i != at]
        model = LagAttention(len(others), max_lag, top, temperature).fit(x[:, others], x[:, at], epochs, rate, l1, loss)
        attention, scale = model.attention(), np.repeat(model.scale(), max_lag)
        out = pd.DataFrame({"source": np.repeat([names[i] for i in others], max_lag), "target": names[at], "lag": np.tile(np.arange(1, max_lag + 1), len(others)), "attention": attention.ravel(), "scale": scale, "weight": attention.ravel() * scale, "loss": model.loss, "ic": model.ic})
        return out[out["weight"] >= min_weight]

    return on_targets(returns, fit, "source string, target string, lag int, attention double, scale double, weight double, loss double, ic double", targets)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def lstm(x: list[np.ndarray], w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[list[np.ndarray], list[tuple]]:
    """The hidden states of one layer over the steps x, and what its gradients need."""
    h = c = np.zeros((len(x[0]), len(u)))
    out, tape = [], []
    for e in x:
        i, f, o, g = np.split(e @ w + h @ u + b, 4, 1)
        i, f, o, g = _sigmoid(i), _sigmoid(f), _sigmoid(o), np.tanh(g)
        new = f * c + i * g
        tape.append((e, h, c, i, f, o, g, new))
        h, c = o * np.tanh(new), new
        out.append(h)
    return out, tape


def lstm_gradient(tape: list[tuple], above: list[np.ndarray], w: np.ndarray, u: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the steps' inputs and of w, u and b, from those of the hidden states."""
    gw, gu, gb, below = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1]), [None] * len(tape)
    dh = dc = np.zeros_like(above[0])
    for t in range(len(tape) - 1, -1, -1):
        e, h, c, i, f, o, g, new = tape[t]
        bent, dh = np.tanh(new), dh + above[t]
        dc = dc + dh * o * (1 - bent**2)
        z = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - g**2)], 1)
        gw, gu, gb, below[t] = gw + e.T @ z, gu + h.T @ z, gb + z.sum(0), z @ w.T
        dh, dc = z @ u.T, dc * f
    return below, gw, gu, gb


class RecurrentNet:
    """Inputs embedded one by one, layers of LSTM over the window, a linear head; gradients through time.

    dropout: of the states that go from one layer to the next, while it is trained.
    """

    def __init__(self, inputs: int, embed: int = 16, hidden: int = 64, seed: int = 0, layers: int = 2, dropout: float = 0.1):
        rng = np.random.default_rng(seed)
        unit = lambda size, *shape: rng.uniform(-1, 1, shape) / np.sqrt(size)
        self.layers, self.dropout = layers, dropout
        self.p = {"e": unit(1, inputs, embed), "eb": unit(1, inputs, embed), "o": unit(hidden, hidden, 1), "ob": unit(hidden, 1)}
        for k in range(layers):
            self.p |= {f"w{k}": unit(hidden, hidden if k else inputs * embed, 4 * hidden), f"u{k}": unit(hidden, hidden, 4 * hidden), f"b{k}": unit(hidden, 4 * hidden)}

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        """Guesses, and each layer's tape and dropout masks; rng: of the dropout, where it trains."""
        steps = [(x[:, t, :, None] * self.p["e"] + self.p["eb"]).reshape(len(x), -1) for t in range(x.shape[1])]
        tapes = []
        for k in range(self.layers):
            masks = None
            if k and rng is not None and self.dropout:
                masks = [(rng.random(s.shape) >= self.dropout) / (1 - self.dropout) for s in steps]
                steps = [s * m for s, m in zip(steps, masks, strict=True)]
            steps, tape = lstm(steps, *(self.p[f"{name}{k}"] for name in "wub"))
            tapes.append((tape, masks))
        return (steps[-1] @ self.p["o"] + self.p["ob"])[:, 0], [tapes, steps[-1]]

    def gradient(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, dict[str, np.ndarray]]:
        guess, (tapes, last) = self.forward(x, rng)
        d = 2 * (guess - y)[:, None] / len(y)
        grads = {"o": last.T @ d, "ob": d.sum(0)}
        above = [np.zeros_like(last)] * (x.shape[1] - 1) + [d @ self.p["o"].T]
        for k in range(self.layers - 1, -1, -1):
            tape, masks = tapes[k]
            above, *found = lstm_gradient(tape, above, self.p[f"w{k}"], self.p[f"u{k}"])
            grads |= dict(zip((f"w{k}", f"u{k}", f"b{k}"), found, strict=True))
            if masks:
                above = [a * m for a, m in zip(above, masks, strict=True)]
        de = np.stack(above, 1).reshape(*x.shape, -1)
        grads |= {"e": (de * x[..., None]).sum((0, 1)), "eb": de.sum((0, 1))}
        return float(((guess - y) ** 2).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float, batch: int, seed: int) -> None:
        rng, adam = np.random.default_rng(seed), Adam(rate)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                part = order[at : at + batch]
                adam.step(self.p, self.gradient(x[part], y[part], rng)[1])


def granger_scores(panel: np.ndarray, history: int = 20, epochs: int = 200, hidden: int = 64, embed: int = 16, rate: float = 1e-3, batch: int = 32, held_out: float = 0.2, seed: int = 0) -> np.ndarray:
    """Of a panel with the target in column 0: each other column's relative gain, as the held-out error
    grows when that input is silenced; never below 0.
    """
    x = np.stack([panel[i : len(panel) - history + i] for i in range(history)], 1)
    y = panel[history:, 0]
    cut = int(len(y) * (1 - held_out))
    net = RecurrentNet(panel.shape[1], embed, hidden, seed)
    net.fit(x[:cut], y[:cut], epochs, rate, batch, seed)
    test, truth = x[cut:], y[cut:]
    base = float(((net.forward(test)[0] - truth) ** 2).mean())
    out = []
    for j in range(1, panel.shape[1]):
        mute = test.copy()
        mute[:, :, j] = 0
        out.append(max(0.0, (float(((net.forward(mute)[0] - truth) ** 2).mean()) - base) / max(base, 1e-12)))
    return np.array(out)


def neural_granger(returns: DataFrame, targets: list[str] | None = None, **options) -> DataFrame:
    """(source, target, score) of each target's trained network."""

    def fit(names: list[str], x: np.ndarray, at: int) -> pd.DataFrame:
        x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-12)
        order = [at, *(i for i in range(len(names)) if i != at)]
        return pd.DataFrame({"source": [names[i] for i in order[1:]], "target": names[at], "score": granger_scores(x[:, order], **options)})

    return on_targets(returns, fit, "source string, target string, score double", targets)
