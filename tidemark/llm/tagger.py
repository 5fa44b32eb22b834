"""A character tagger in numpy: bidirectional LSTM with CRF transitions, decoded over overlapping windows."""

from __future__ import annotations

import io
from functools import lru_cache
from importlib import resources

import numpy as np

from tidemark.llm.pii_labels import KINDS

#: Tags: 0 is outside, 1 + 2 k begins kind k, 2 + 2 k continues it.
N_TAGS = 1 + 2 * len(KINDS)
#: Characters of a window, and those it shares with the next one.
WINDOW, OVERLAP = 256, 96
BATCH = 256
#: Steps a unit, and the range, of the table from which the hyperbolic tangent is read; it is exact to a thousandth.
GRAIN, REACH = 512, 8
TANH = np.tanh((np.arange(2 * REACH * GRAIN) - REACH * GRAIN) / GRAIN).astype(np.float32)

PAD, SPACE, BREAK, DIGIT, HAN, KANA, LATIN, OTHER = range(8)
RESERVED = 8


def char_class(c: str) -> int:
    """The class of a character that has no number of its own."""
    if c.isdigit():
        return DIGIT
    if c.isspace():
        return BREAK if c in "\r\n" else SPACE
    n = ord(c)
    if 0x3040 <= n < 0x3100:
        return KANA
    if 0x3400 <= n < 0xA000 or 0x20000 <= n < 0x32000:
        return HAN
    return LATIN if n < 0x250 and c.isalpha() else OTHER


class Alphabet:
    """Numbers of characters; digits are one class, rare characters share that of their script."""

    def __init__(self, chars: str):
        self.chars = chars
        self.low = np.array([char_class(chr(n)) if not 0xD800 <= n < 0xE000 else OTHER for n in range(0x10000)], np.int32)
        for k, c in enumerate(chars):
            self.low[ord(c)] = RESERVED + k
        self.size = RESERVED + len(chars)

    def encode(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(codes) and codes.max() >= 0x10000:
            return np.where(codes < 0x10000, self.low[np.minimum(codes, 0xFFFF)], np.where(codes < 0x20000, OTHER, HAN)).astype(np.int32)
        return self.low[codes]


def _reversed(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each column of (time, batch) back to front within its own length."""
    t = np.arange(len(ids))[:, None]
    at = np.where(t < lengths, lengths - 1 - t, t)
    return np.take_along_axis(ids, at if ids.ndim == 2 else at[:, :, None], 0)


class Tagger:
    """The trained model; ``weights`` has emb, w, u, b (two directions), out, bias, trans, first, last."""

    def __init__(self, weights: dict[str, np.ndarray], chars: str):
        self.alphabet = Alphabet(chars)
        self.hidden = weights["u"].shape[1]
        h = self.hidden
        # A logistic gate is (1 + tanh(x / 2)) / 2. The table's scale and that half go into the weights, and since
        # states are kept doubled, as (1 + t) tanh(cell), another half into all that reads them.
        scale = np.full(4 * h, GRAIN, np.float32)
        scale[: 3 * h] /= 2
        table = (np.einsum("ve,deg->dvg", weights["emb"], weights["w"]) + weights["b"][:, None]) * scale + (REACH * GRAIN + 0.5)
        self.table = np.ascontiguousarray(table, np.float32)
        self.u = (weights["u"] * scale / 2).astype(np.float32)
        self.out, self.bias = (weights["out"] / 2).astype(np.float32), weights["bias"].astype(np.float32)
        self.trans, self.first, self.last = (weights[k].astype(np.float32) for k in ("trans", "first", "last"))
        stay = self.trans[0, 0]
        enter = max(self.trans[0, 1:].max() - stay, self.first[1:].max() - self.first[0])
        leave = max(self.trans[1:, 0].max() - stay, self.last[1:].max() - self.last[0])
        #: What m characters of a path inside a span gain by transitions is at most enter + leave + (m - 1) within;
        #: where "outside" leads by this much at every character, no other path can be better.
        self.lead = float(max(enter + leave, self.trans[1:, 1:].max() - stay, 0.0))

    def emissions(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores (time, batch, tag) of padded columns of character numbers."""
        steps, batch, h = ids.shape[0], ids.shape[1], self.hidden
        both = np.stack([ids, _reversed(ids, lengths)], axis=1)
        states = np.zeros((steps + 1, 2, batch, h), np.float32)
        cell, inner, add = np.zeros((2, batch, h), np.float32), np.empty((2, batch, h), np.float32), np.empty((2, batch, h), np.float32)
        z, looked = np.empty((2, batch, 4 * h), np.float32), np.empty((2, batch, 4 * h), np.float32)
        at, at_cell = np.empty((2, batch, 4 * h), np.int32), np.empty((2, batch, h), np.int32)
        for t in range(steps):
            np.matmul(states[t], self.u, out=z)
            np.take(self.table[0], both[t, 0], axis=0, out=looked[0], mode="clip")
            np.take(self.table[1], both[t, 1], axis=0, out=looked[1], mode="clip")
            z += looked
            np.copyto(at, z, casting="unsafe")
            np.take(TANH, at, out=z, mode="clip")
            gates = z[:, :, : 3 * h]
            gates += 1
            cell *= gates[:, :, h : 2 * h]
            np.multiply(gates[:, :, :h], z[:, :, 3 * h :], out=add)
            cell += add
            cell *= 0.5
            np.multiply(cell, GRAIN, out=inner)
            inner += REACH * GRAIN + 0.5
            np.copyto(at_cell, inner, casting="unsafe")
            np.take(TANH, at_cell, out=inner, mode="clip")
            np.multiply(gates[:, :, 2 * h :], inner, out=states[t + 1])
        ahead = states[1:, 0] @ self.out[:h]
        back = states[1:, 1] @ self.out[h:]
        return ahead + _reversed(back, lengths) + self.bias

    def best_path(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tags (time, batch) under the transitions."""
        steps, batch, _ = scores.shape
        by_tag = np.ascontiguousarray(scores.transpose(0, 2, 1))
        values = np.empty_like(by_tag)  # the best score of each tag so far; it stands still once a column has ended
        values[0] = by_tag[0] + self.first[:, None]
        step = np.ascontiguousarray(self.trans.T)[:, :, None]  # new, old
        every = np.empty((N_TAGS, N_TAGS, batch), np.float32)
        ends = int(lengths.min())
        for t in range(1, steps):
            np.add(values[t - 1], step, out=every)
            np.max(every, axis=1, out=values[t])
            values[t] += by_tag[t]
            if t >= ends:
                np.copyto(values[t], values[t - 1], where=t >= lengths)
        path = np.zeros((steps, batch), np.int8)
        tag = (values[-1] + self.last[:, None]).argmax(axis=0)
        for t in range(steps - 1, -1, -1):
            path[t] = np.where(t < lengths, tag, 0)
            if t:
                tag = np.where(t < lengths, (values[t - 1] + self.trans[:, tag]).argmax(axis=0), tag)
        return path

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """The tags of every character of every text.

        Texts longer than a window are cut into windows that overlap; where they do, each character takes its
        tag from the window in which it stands farther from an edge.
        """
        coded = [self.alphabet.encode(t) for t in texts]
        out = [np.zeros(len(c), np.int8) for c in coded]
        windows: list[tuple[int, int, int]] = []
        for k, c in enumerate(coded):
            a = 0
            while a < len(c):
                windows.append((k, a, min(len(c), a + WINDOW)))
                if a + WINDOW >= len(c):
                    break
                a += WINDOW - OVERLAP
        windows.sort(key=lambda w: w[2] - w[1])
        for s in range(0, len(windows), BATCH):
            part = windows[s : s + BATCH]
            lengths = np.array([b - a for _, a, b in part])
            ids = np.zeros((lengths.max(), len(part)), np.int32)
            for j, (k, a, b) in enumerate(part):
                ids[: b - a, j] = coded[k][a:b]
            scores = self.emissions(ids, lengths)
            inside = np.arange(len(ids))[:, None] < lengths
            lead = scores[:, :, 0] - scores[:, :, 1:].max(axis=2)
            busy = np.flatnonzero(((lead < self.lead) & inside).any(axis=0))
            if not len(busy):
                continue
            path = self.best_path(np.ascontiguousarray(scores[:, busy]), lengths[busy])
            for col, j in enumerate(busy):
                k, a, b = part[j]
                lo = a if a == 0 else a + OVERLAP // 2
                hi = b if b == len(coded[k]) else b - OVERLAP // 2
                out[k][lo:hi] = path[lo - a : hi - a, col]
        return out


def load(raw: bytes) -> Tagger:
    with np.load(io.BytesIO(raw)) as z:
        return Tagger({k: z[k].astype(np.float32) for k in z.files if k != "chars"}, str(z["chars"]))


@lru_cache(maxsize=1)
def model_bytes() -> bytes:
    """The weights that ``python -m tidemark.llm.tagger_training`` wrote."""
    return resources.files("tidemark.llm").joinpath("pii_model.npz").read_bytes()
