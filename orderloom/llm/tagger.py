"""A character tagger: bidirectional LSTM with CRF transitions, trained in numpy.

Labels are O, and B and I of each type. Characters and word flags enter by table lookups. Arrays are laid out with the
windows of a batch last, so that each gate is one block of memory. The backward direction reads each window from its own
end, so no direction ever reads padding before text. Training maximises the CRF likelihood of labelled windows by Adam
with hand-written gradients.
"""

from dataclasses import dataclass

import numpy as np

PAD = 0
CLASSES = 104
FLAGS = 16
BAR = np.float32(-1e4)


def char_classes(codes: np.ndarray) -> np.ndarray:
    """Class of each code point: printable ASCII each its own (but the digits from 2 share one), line end, tab, other letters by case
    (small, capital, of scripts without case), the rest."""
    out = np.full(len(codes), 101, np.uint8)
    ascii_ = (codes >= 32) & (codes < 127)
    out[ascii_] = (codes[ascii_] - 31).astype(np.uint8)
    digit = (codes >= 48) & (codes <= 57)
    out[digit] = np.where(codes[digit] <= 49, codes[digit] - 31, 102)
    out[(codes == 10) | (codes == 13)] = 96
    out[codes == 9] = 97
    far = np.flatnonzero(codes >= 127)
    if len(far):
        known = np.unique(codes[far])
        kinds = np.array([_kind(chr(c)) if c < 0xD800 or c > 0xDFFF else 101 for c in known.tolist()], np.uint8)
        out[far] = kinds[np.searchsorted(known, codes[far])]
    return out


def _kind(c: str) -> int:
    if not c.isalpha():
        return 101
    return 99 if c.isupper() else 98 if c.islower() else 100


@dataclass
class Tagger:
    weights: dict[str, np.ndarray]
    types: tuple[str, ...]

    @property
    def labels(self) -> int:
        return 1 + 2 * len(self.types)

    @classmethod
    def fresh(cls, types: tuple[str, ...], hidden: int, seed: int) -> "Tagger":
        rng = np.random.default_rng(seed)
        k, h = 1 + 2 * len(types), hidden
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        w = {
            "chars": f(2, 4 * h, CLASSES, scale=0.3),
            "flags": f(2, 4 * h, FLAGS, scale=0.1),
            "inner": f(2, 4 * h, h, scale=1 / np.sqrt(h)),
            "out": f(k, 2 * h, scale=1 / np.sqrt(2 * h)),
            "prior": np.zeros(k, np.float32),
            "step": np.zeros((k, k), np.float32),
        }
        w["chars"][:, h : 2 * h] += 1.0  # forget gates begin open
        return cls(w, types)

    def allowed(self) -> np.ndarray:
        """0 where label i may be followed by j, else very small: I follows B or I of its type."""
        k = self.labels
        bar = np.zeros((k, k), np.float32)
        for j in range(2, k, 2):
            bar[:, j] = BAR
            bar[j - 1, j] = bar[j, j] = 0
        return bar

    def _inputs(self, chars: np.ndarray, flags: np.ndarray):
        """Of both directions: the table of gate inputs, (flag, character) numbers (length, batch); and where the backward
        direction meets each character."""
        w = self.weights
        h = w["inner"].shape[2]
        half = np.where(np.arange(4 * h) < 3 * h, np.float32(0.5), np.float32(1))[:, None]  # sigmoid by tanh
        table = ((w["flags"][:, :, :, None] + w["chars"][:, :, None, :]).reshape(2, 4 * h, -1)) * half
        ct, ft = np.ascontiguousarray(chars.T), np.ascontiguousarray(flags.T)
        n = ct.shape[0]
        size = (ct != PAD).sum(0)
        back = np.maximum(size - 1 - np.arange(n)[:, None], 0)
        ahead = ft.astype(np.int32) * CLASSES + ct
        return table, w["inner"] * half, (ahead, np.take_along_axis(ahead, back, 0)), back, size

    def emissions(self, chars: np.ndarray, flags: np.ndarray, keep: bool = False):
        """Emissions (length, labels, batch) of windows (batch, length), padded with PAD at the end."""
        w = self.weights
        table, inner, ids, back, size = self._inputs(chars, flags)
        n, b = ids[0].shape
        h = inner.shape[2]
        cell = np.zeros((2, h, b), np.float32)
        out = np.zeros((2, h, b), np.float32)
        outs = np.empty((n, 2, h, b), np.float32)
        g = np.empty((2, 4 * h, b), np.float32)
        x = np.empty_like(g)
        kept = []
        for t in range(n):
            np.matmul(inner, out, out=g)
            for d in (0, 1):
                np.take(table[d], ids[d][t], axis=1, out=x[d], mode="clip")
            g += x
            np.tanh(g, out=g)
            gate = g[:, : 3 * h]
            gate += 1
            gate *= 0.5
            old = cell
            cell = g[:, h : 2 * h] * old
            cell += g[:, :h] * g[:, 3 * h :]
            bent = np.tanh(cell)
            if keep:
                kept.append((g, old, bent, out))
                g = np.empty_like(g)
                out = kept[-1][0][:, 2 * h : 3 * h] * bent
            else:
                out = g[:, 2 * h : 3 * h] * bent
            outs[t] = out
        # the backward direction's states, put to the characters they belong to
        behind = np.take_along_axis(outs[:, 1], back[:, None, :], 0)
        both = np.concatenate([outs[:, 0], behind], axis=1)
        emit = w["out"] @ both + w["prior"][:, None]
        return (emit, both, kept, ids, back, size) if keep else emit

    def decode(self, chars: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """The best label of each character (batch, length)."""
        return self._viterbi(self.emissions(chars, flags), self.weights["step"] + self.allowed(), (chars != PAD).T).T

    @staticmethod
    def _viterbi(emit: np.ndarray, step: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Best labels (length, batch) for emissions (length, labels, batch).

        Only I labels are barred after others, so O and B labels are reached from the best of all labels by a table of
        their own, and all are found in one maximum over the labels before.
        """
        n, _, b = emit.shape
        scores = np.empty_like(emit)
        scores[0] = emit[0]
        scores[0, 2::2] += BAR
        steps = np.ascontiguousarray(step.T)[:, :, None]
        for t in range(1, n):
            new = (scores[t - 1][None] + steps).max(1)
            new += emit[t]
            scores[t] = new if real[t].all() else np.where(real[t], new, scores[t - 1])
        best = np.empty((n, b), np.int8)
        best[n - 1] = scores[n - 1].argmax(0)
        for t in range(n - 1, 0, -1):
            at = (scores[t - 1] + step[:, best[t]]).argmax(0)
            best[t - 1] = np.where(real[t], at, best[t])
        best[~real] = 0
        return best

    def gradient(self, chars: np.ndarray, flags: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per window, and its gradient."""
        w = self.weights
        emit, both, kept, ids, back, _ = self.emissions(chars, flags, keep=True)
        n, k, b = emit.shape
        h = w["inner"].shape[2]
        real = (chars != PAD).T
        loss, d_emit, d_step = self._crf(emit, np.ascontiguousarray(gold.T), real)
        g = {"step": d_step, "prior": d_emit.sum((0, 2))}
        g["out"] = np.einsum("nkb,nhb->kh", d_emit, both, optimize=True)
        d_both = w["out"].T @ d_emit
        d_outs = np.zeros((n, 2, h, b), np.float32)
        d_outs[:, 0] = d_both[:, :h]
        # each real character is met once by the backward direction
        t, r = np.nonzero(real)
        d_outs[back[t, r], 1, :, r] = d_both[t, h:, r]
        inner = np.ascontiguousarray(w["inner"].transpose(0, 2, 1))
        d_x = np.empty((2, 4 * h, n, b), np.float32)
        d_out = np.zeros((2, h, b), np.float32)
        d_cell = np.zeros((2, h, b), np.float32)
        d_inner = np.zeros_like(w["inner"])
        d = np.empty((2, 4 * h, b), np.float32)
        for t in range(n - 1, -1, -1):
            gate, old, bent, before = kept[t]
            i, f, o, c = (gate[:, q * h : (q + 1) * h] for q in range(4))
            d_o = d_outs[t] + d_out
            d_c = d_cell + d_o * o * (1 - bent * bent)
            d[:, :h] = d_c * c * i * (1 - i)
            d[:, h : 2 * h] = d_c * old * f * (1 - f)
            d[:, 2 * h : 3 * h] = d_o * bent * o * (1 - o)
            d[:, 3 * h :] = d_c * i * (1 - c * c)
            d_x[:, :, t] = d
            d_cell = d_c * f
            d_out = inner @ d
            d_inner += d @ before.transpose(0, 2, 1)
        g["inner"] = d_inner
        # both directions' inputs by character of the text, so that one table of ones sums them
        flat = np.zeros((4 * h * 2, n, b), np.float32)
        flat[: 4 * h] = d_x[0]
        t, r = np.nonzero(real)
        flat[4 * h :, t, r] = d_x[1][:, back[t, r], r]
        flag, char = np.divmod(ids[0].ravel(), CLASSES)
        for name, at, many in (("chars", char, CLASSES), ("flags", flag, FLAGS)):
            hot = np.zeros((n * b, many), np.float32)
            hot[np.arange(n * b), at] = 1
            g[name] = (flat.reshape(8 * h, n * b) @ hot).reshape(2, 4 * h, many)
        return loss, g

    def _crf(self, emit: np.ndarray, gold: np.ndarray, real: np.ndarray):
        """Mean negative log-likelihood of the gold labels (length, batch), its gradients by emission and by transition."""
        n, k, b = emit.shape
        step = self.weights["step"] + self.allowed()
        grow = np.exp(step)
        top = emit.max(1, keepdims=True)
        peak = np.exp(emit - top)
        start = np.ones((k, 1), np.float32)
        start[2::2] = 0
        ahead = np.empty((n, k, b), np.float32)
        scale = np.zeros((n, b), np.float32)
        a = peak[0] * start
        for t in range(n):
            if t:
                a = np.where(real[t], (grow.T @ a) * peak[t], a)
            s = a.sum(0)
            a = a / s
            ahead[t] = a
            scale[t] = np.log(s) + np.where(real[t], top[t, 0], 0)
        behind = np.ones((k, b), np.float32)
        d_emit = np.empty_like(emit)
        d_step = np.zeros((k, k), np.float32)
        for t in range(n - 1, -1, -1):
            p = ahead[t] * behind
            d_emit[t] = np.where(real[t], p / p.sum(0), 0)
            if t:
                right = np.where(real[t], peak[t] * behind, 0)
                new = grow @ right
                all_ = np.maximum((ahead[t - 1] * new).sum(0), 1e-30)
                d_step += ahead[t - 1] @ (right / all_).T
                behind = np.where(real[t], new / np.maximum(new.sum(0), 1e-30), behind)
        d_step *= grow
        t, r = np.nonzero(real)
        lab = gold[t, r]
        score = emit[t, lab, r].sum(dtype=np.float64)
        d_emit[t, lab, r] -= 1
        t, r = np.nonzero(real[1:])
        score += step[gold[t, r], gold[t + 1, r]].sum(dtype=np.float64)
        np.subtract.at(d_step, (gold[t, r], gold[t + 1, r]), 1)
        return float((scale.sum(dtype=np.float64) - score) / b), d_emit / b, d_step / b

    def fresh_state(self) -> dict[str, np.ndarray]:
        """Adam's moments before the first step."""
        return {f"{m} {k}": np.zeros_like(w) for m in ("mean", "square") for k, w in self.weights.items()}

    def train(self, draw, steps: int, state: dict[str, np.ndarray], first: int = 0, of: int = 0, rate: float = 0.02) -> list[float]:
        """Adam over steps batches of draw(step): (chars, flags, gold), after so many steps before, of so many in all.

        The moments in state are carried on. Returns the losses.
        """
        losses = []
        for t in range(first + 1, first + steps + 1):
            loss, g = self.gradient(*draw(t))
            losses.append(loss)
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            cut = min(1.0, 5.0 / max(size, 1e-9))
            now = rate * (1 - t / ((of or steps) + 1)) ** 0.7
            for key, x in g.items():
                m, v = state[f"mean {key}"], state[f"square {key}"]
                x = x * cut
                m += 0.1 * (x - m)
                v += 0.01 * (x * x - v)
                self.weights[key] -= now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        return losses


def spans(labels: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(window, first, after last, type number) of the labels (batch, length)."""
    found = []
    rows, at = np.nonzero(labels % 2 == 1)
    for r, a in zip(rows.tolist(), at.tolist()):
        kind = (int(labels[r, a]) + 1) // 2
        b = a + 1
        while b < labels.shape[1] and labels[r, b] == 2 * kind:
            b += 1
        found.append((r, a, b, kind - 1))
    return found
