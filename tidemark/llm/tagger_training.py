"""Training of the character tagger: ``python -m tidemark.llm.tagger_training TABLES OUT [EPOCHS [MODEL]]``, from new weights or those of MODEL.

It reads at most MAX_ROWS texts of ``memories`` and ``scenarios``, labels them with the listed names and the
shapes in ``pii_labels``, and fits the weights by gradient descent on the CRF's negative log-likelihood.
"""

from __future__ import annotations

import glob
import re
import sys
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm.pii_labels import KINDS, Labeller
from tidemark.llm.tagger import N_TAGS, RESERVED, WINDOW, Alphabet, Tagger, _reversed, char_class

#: Texts that are labelled at most, and texts without any span among those trained on: of any kind, and with
#: long numbers or capitalised words in a row.
MAX_ROWS, PLAIN, HARD = 90_000, 3_000, 6_000
HIDDEN, EMBED, RATE = 24, 16, 4e-3
#: Rewritten copies of each text with spans.
VARIANTS = 3


def tag_row(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    tags = np.zeros(len(text), np.int8)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return tags


def start_weights(alphabet: Alphabet, rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, e = HIDDEN, EMBED
    w = {
        "emb": rng.normal(0, 0.5, (alphabet.size, e)), "w": rng.normal(0, 1 / np.sqrt(e), (2, e, 4 * h)), "u": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)),
        "b": np.zeros((2, 4 * h)), "out": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, N_TAGS)), "bias": np.zeros(N_TAGS), "trans": np.zeros((N_TAGS, N_TAGS)), "first": np.zeros(N_TAGS), "last": np.zeros(N_TAGS),
    }
    w["b"][:, h : 2 * h] = 1.0
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def step(w: dict[str, np.ndarray], ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss per character and gradients of one batch of (time, batch) columns."""
    steps, batch = ids.shape
    h = HIDDEN
    both = np.stack([ids, _reversed(ids, lengths)], axis=1)
    x = w["emb"][both]  # time, direction, batch, embedding
    pre = np.einsum("tdbe,deg->tdbg", x, w["w"]) + w["b"][None, :, None]
    hs, cs = np.zeros((steps + 1, 2, batch, h), np.float32), np.zeros((steps + 1, 2, batch, h), np.float32)
    gs = np.empty((steps, 2, batch, 4 * h), np.float32)
    for t in range(steps):
        z = pre[t] + np.matmul(hs[t], w["u"])
        z[..., : 3 * h] = _sigmoid(z[..., : 3 * h])
        z[..., 3 * h :] = np.tanh(z[..., 3 * h :])
        gs[t] = z
        cs[t + 1] = z[..., h : 2 * h] * cs[t] + z[..., :h] * z[..., 3 * h :]
        hs[t + 1] = z[..., 2 * h : 3 * h] * np.tanh(cs[t + 1])
    ahead, back = hs[1:, 0], _reversed(np.ascontiguousarray(hs[1:, 1]), lengths)
    feats = np.concatenate([ahead, back], axis=2)
    scores = feats @ w["out"] + w["bias"]
    # CRF: forward and backward sums, marginals
    live = np.arange(steps)[:, None] < lengths
    trans, who = w["trans"], np.arange(batch)
    alpha, beta = np.empty_like(scores), np.empty_like(scores)
    alpha[0] = scores[0] + w["first"]
    for t in range(1, steps):
        alpha[t] = np.where(live[t][:, None], _lse(alpha[t - 1][:, :, None] + trans, 1) + scores[t], alpha[t - 1])
    total = _lse(alpha[-1] + w["last"], 1)
    beta[-1] = w["last"]
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(live[t + 1][:, None], _lse(trans + (scores[t + 1] + beta[t + 1])[:, None, :], 2), w["last"])
    marginal = np.exp(alpha + beta - total[:, None]) * live[:, :, None]
    g: dict[str, np.ndarray] = {}
    d_scores = marginal.copy()
    d_scores[np.arange(steps)[:, None], who, tags] -= live
    d_trans = np.zeros_like(trans)
    gold = scores[0, who, tags[0]] + w["first"][tags[0]]
    for t in range(1, steps):
        pair = np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - total[:, None, None])
        d_trans += (pair * live[t][:, None, None]).sum(axis=0)
        np.subtract.at(d_trans, (tags[t - 1][live[t]], tags[t][live[t]]), 1)
        gold += np.where(live[t], scores[t, who, tags[t]] + trans[tags[t - 1], tags[t]], 0)
    end = tags[lengths - 1, who]
    gold += w["last"][end]
    loss = float((total - gold).sum())
    g["trans"] = d_trans
    g["first"] = marginal[0].sum(axis=0) - np.bincount(tags[0], minlength=N_TAGS)
    final = np.exp(alpha[-1] + w["last"] - total[:, None])
    g["last"] = final.sum(axis=0) - np.bincount(end, minlength=N_TAGS)
    # back through the outputs and the two directions
    g["out"], g["bias"] = np.einsum("tbf,tbk->fk", feats, d_scores), d_scores.sum(axis=(0, 1))
    d_feats = d_scores @ w["out"].T
    d_h = np.stack([d_feats[..., :h], _reversed(np.ascontiguousarray(d_feats[..., h:]), lengths) * live[:, :, None]], axis=1)
    d_z = np.empty_like(gs)
    nh, nc = np.zeros((2, batch, h), np.float32), np.zeros((2, batch, h), np.float32)
    back_u = w["u"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        z, tc = gs[t], np.tanh(cs[t + 1])
        dh = d_h[t] + nh
        dc = dh * z[..., 2 * h : 3 * h] * (1 - tc * tc) + nc
        i, f, o, c = z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h], z[..., 3 * h :]
        d = d_z[t]
        d[..., :h] = dc * c * i * (1 - i)
        d[..., h : 2 * h] = dc * cs[t] * f * (1 - f)
        d[..., 2 * h : 3 * h] = dh * tc * o * (1 - o)
        d[..., 3 * h :] = dc * i * (1 - c * c)
        nc = dc * f
        nh = np.matmul(d, back_u)
    g["u"] = np.einsum("tdbh,tdbg->dhg", hs[:-1], d_z)
    g["b"] = d_z.sum(axis=(0, 2))
    g["w"] = np.einsum("tdbe,tdbg->deg", x, d_z)
    d_x = np.einsum("tdbg,deg->tdbe", d_z, w["w"])
    g["emb"] = np.zeros_like(w["emb"])
    np.add.at(g["emb"], both.reshape(-1), d_x.reshape(-1, EMBED))
    n = lengths.sum()
    return loss / n, {k: (v / n).astype(np.float32) for k, v in g.items()}


def texts_of(tables: str) -> tuple[list[str], list[str]]:
    """Distinct texts in the order of their hash, at most MAX_ROWS, and the listed persons."""
    import hashlib

    def column(name: str, cols: list[str]) -> list:
        path = f"{tables}/{name}.parquet"
        files = sorted(glob.glob(path + "/*.parquet")) or [path]
        return [r for f in files for r in pq.read_table(f, columns=cols).to_pylist()]

    texts = {r["content"] for t in ("memories", "scenarios") for r in column(t, ["content"]) if r["content"]}
    people = sorted({r["name"] for r in column("entities", ["name", "entity_type"]) if r["entity_type"] == "person" and r["name"]})
    return sorted(texts, key=lambda t: hashlib.md5(t.encode()).digest())[:MAX_ROWS], people


def evaluate(tagger: Tagger, rows: list[tuple[str, list]], starts: bool = True) -> str:
    """Precision and recall of (start, kind) against the labels."""
    hit = Counter()
    tags = tagger.tags([t for t, _ in rows])
    for (_, spans), got in zip(rows, tags, strict=True):
        want = {(a, k) for a, _, k in spans}
        have = {(int(p), KINDS[(got[p] - 1) // 2]) for p in np.flatnonzero(got) if got[p] % 2 == 1}
        for k in KINDS:
            hit[k, "hit"] += len({x for x in want & have if x[1] == k})
            hit[k, "want"] += len({x for x in want if x[1] == k})
            hit[k, "have"] += len({x for x in have if x[1] == k})
    return ", ".join(f"{k} p {hit[k, 'hit'] / max(1, hit[k, 'have']):.3f} r {hit[k, 'hit'] / max(1, hit[k, 'want']):.3f}" for k in KINDS)


def main(tables: str, out: str, epochs: int = 14, model: str | None = None) -> None:
    rng = np.random.default_rng(11)
    texts, people = texts_of(tables)
    label = Labeller(people)
    rows = [(t, label(t)) for t in texts]
    spanned, plain = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    held = spanned[::8] + plain[:400]
    hard = [r for r in plain[400 + PLAIN :] if re.search(r"\d[\d .\-]{5,}\d|[A-Z]\w+ [A-Z]\w+|\d{5}", r[0])][:HARD]
    train = [r for k, r in enumerate(spanned) if k % 8] + plain[400 : 400 + PLAIN] + hard
    train += [label.varied(t, rng) for t, spans in train if spans for _ in range(VARIANTS)]
    count = Counter(c for t, _ in train for c in t)
    alphabet = Alphabet("".join(sorted(c for c, n in count.items() if n >= 12 and not c.isspace() and not c.isdigit() and ord(c) < 0x10000)))
    if model:
        with np.load(model) as before:
            alphabet, w = Alphabet(str(before["chars"])), {k: before[k].astype(np.float32) for k in before.files if k != "chars"}
    else:
        w = start_weights(alphabet, rng)
    cut = []
    for t, spans in train:
        coded, tags = alphabet.encode(t), tag_row(t, spans)
        for a in range(0, len(t), WINDOW):
            cut.append((coded[a : a + WINDOW], tags[a : a + WINDOW]))
    print(len(rows), "texts,", len(spanned), "with spans,", len(cut), "windows,", alphabet.size - RESERVED, "characters", flush=True)
    shared = np.array([*range(RESERVED), *[char_class(c) for c in alphabet.chars]], np.int32)
    m, v, n = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    for epoch in range(epochs):
        began, losses = time.time(), []
        order = np.argsort([len(c) + rng.normal(0, 12) for c, _ in cut])
        batches = [order[a : a + 48] for a in range(0, len(order), 48)]
        rng.shuffle(batches)
        for who in batches:
            lengths = np.array([len(cut[k][0]) for k in who])
            ids, tags = np.zeros((lengths.max(), len(who)), np.int32), np.zeros((lengths.max(), len(who)), np.int64)
            for j, k in enumerate(who):
                ids[: lengths[j], j], tags[: lengths[j], j] = cut[k]
            drop = rng.random(ids.shape) < 0.01  # rare characters must get along without a number of their own
            ids = np.where(drop, shared[ids], ids)
            loss, g = step(w, ids, tags, lengths)
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            n += 1
            rate = RATE * (0.5 if model else 1.0) * min(1, n / 50) * (0.5 * (1 + np.cos(np.pi * n / (epochs * len(batches)))) + 0.02)
            for k in w:
                d = g[k] * min(1, 0.5 / norm)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                w[k] -= rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
        print(epoch, f"{np.mean(losses):.5f}", f"{time.time() - began:.0f} s", evaluate(Tagger(w, alphabet.chars), held) if epoch % 3 == 2 or epoch == epochs - 1 else "", flush=True)
        np.savez_compressed(out, chars=np.array(alphabet.chars), **{k: x.astype(np.float16) for k, x in w.items()})


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], int(sys.argv[3]) if len(sys.argv) > 3 else 14, sys.argv[4] if len(sys.argv) > 4 else None)
