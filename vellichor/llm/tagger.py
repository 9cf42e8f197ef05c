"""Character-level bidirectional LSTM with CRF transitions, in numpy.

Characters become a small alphabet (letters of one script share hashed ids,
accents and widths are folded, every digit is one id), two LSTMs read a window
from either end, a linear layer scores the tags of each character, and a CRF
adds transitions between neighbouring tags. ``train`` fits it by stochastic
gradients of the CRF likelihood on labelled windows, ``decode`` tags windows.
"""

from __future__ import annotations

import itertools
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np

TYPES = ["email", "phone", "id_number", "address", "person"]
TAGS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
ALPHABET = 96 + 48 + 48 + 24 + 24 + 8
WINDOW = 256
OVERLAP = 16
PAD = 8
MODEL_FILE = Path(__file__).with_name("tagger.npz")


@lru_cache(maxsize=70_000)
def char_id(ch: str) -> int:
    code = ord(ch)
    if code >= 0x80:
        plain = unicodedata.normalize("NFKD", ch)[0]
        if ord(plain) < 0x80:
            code = ord(plain)
    if 48 <= code <= 57:
        return 16
    if 32 <= code < 127:
        return code - 32
    if code < 0x80:
        return 95
    if 0xAC00 <= code <= 0xD7A3 or 0x1100 <= code < 0x1200:
        return 96 + code % 48
    if 0x3400 <= code <= 0x9FFF:
        return 144 + code % 48
    if 0x3040 <= code <= 0x30FF:
        return 192 + code % 24
    if 0x400 <= code <= 0x42F:
        return 232 + code % 8
    if 0x430 <= code <= 0x4FF:
        return 216 + code % 16
    return 240 + code % 8


_TABLE: list[np.ndarray] = []


def encode(text: str) -> np.ndarray:
    """Alphabet ids of a text's code points."""
    if not _TABLE:
        _TABLE.append(np.array([char_id(chr(c)) for c in range(0x10000)], dtype=np.uint8))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes < 0x10000, _TABLE[0][np.minimum(codes, 0xFFFF)], 240).astype(np.uint8)


def _squash(z: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """``z / (1 + |z|)`` in place, a stand-in for tanh at a fraction of its cost."""
    np.absolute(z, out=spare)
    spare += 1.0
    z /= spare
    return z


def _slope(z: np.ndarray) -> np.ndarray:
    """Derivative of the squash."""
    return 1.0 / np.square(1.0 + np.absolute(z))


class Tagger:
    """Parameters by name: per direction an input table ``T`` (alphabet x 4H), recurrent ``U`` (H x 4H); output ``W``, ``b``; transitions ``A``."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.hidden = params["U0"].shape[0]

    @classmethod
    def fresh(cls, hidden: int = 16, seed: int = 7) -> Tagger:
        rng = np.random.default_rng(seed)
        f = np.float32
        p = {}
        for d in "01":
            p["T" + d] = rng.normal(0, 0.3, (ALPHABET, 4 * hidden)).astype(f)
            p["T" + d][:, hidden : 2 * hidden] += 1
            p["U" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(f)
        p["W"] = rng.normal(0, 0.2, (2 * hidden, len(TAGS))).astype(f)
        p["b"] = np.zeros(len(TAGS), f)
        p["A"] = np.zeros((len(TAGS), len(TAGS)), f)
        for i, left in enumerate(TAGS):
            for j, right in enumerate(TAGS):
                if right[0] == "I" and left[1:] != right[1:]:
                    p["A"][i, j] = -8.0  # an inside tag only follows its own type
        return cls(p)

    @classmethod
    def load(cls, path: Path = MODEL_FILE) -> Tagger:
        with np.load(path) as stored:
            return cls({k: stored[k].astype(np.float32) for k in stored.files})

    def save(self, path: Path = MODEL_FILE) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    # reading

    def _lstm(self, x: np.ndarray, d: str, keep: bool, ahead: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, H) of one direction; with ``keep`` also what the gradient needs, without it the states come out doubled; ``ahead``: ``x`` is turned round already.

        Gates i, f, o, n are stacked in front, so that each is contiguous.
        """
        steps, batch = x.shape
        hid = self.hidden
        split = lambda m: np.ascontiguousarray(m.reshape(-1, 4, hid).transpose(1, 0, 2))
        half = np.array([0.5, 0.5, 0.5, 1.0], np.float32)[:, None, None]  # sigmoid(z) = (squash(z / 2) + 1) / 2
        table, rec = split(self.p["T" + d]) * half, split(self.p["U" + d]) * half * np.float32(1 if keep else 0.5)
        h = np.zeros((batch, hid), np.float32)
        c = np.zeros((batch, hid), np.float32)
        out = np.empty((steps, batch, hid), np.float32)
        spare = np.empty((4, batch, hid), np.float32)
        saved = []
        for t in range(steps) if ahead or d == "0" else range(steps - 1, -1, -1):
            g = np.matmul(h, rec)
            g += table.take(x[t], axis=1)
            if not keep:  # the halves of the three gates are taken together, and that of the output in what reads it
                _squash(g, spare)
                g[:3] += 1.0
                c *= g[1]
                g[0] *= g[3]
                c += g[0]
                c *= 0.5
                h = out[t]
                h[:] = c
                _squash(h, spare[0])
                h *= g[2]
                continue
            slope = _slope(g)
            _squash(g, spare)
            g[:3] += 1.0
            g[:3] *= 0.5
            before = c
            c = g[1] * c
            c += g[0] * g[3]
            tc = _squash(c.copy(), spare[0])
            slope[:3] *= 0.25
            saved.append((t, h, before, g, slope, tc, _slope(c)))
            h = out[t]
            np.multiply(g[2], tc, out=h)
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (time, tags, batch) of windows ``x`` (time, batch)."""
        hid = self.hidden
        half = self.p["W"] * np.float32(0.5)
        e = self._lstm(x, "0", False)[0] @ half[:hid]
        e += self._lstm(x, "1", False)[0] @ half[hid:]
        e += self.p["b"]
        return np.ascontiguousarray(e.transpose(0, 2, 1))

    def scores_of(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Tag scores (tags, place * pieces + piece) of pieces of text, read side by side but each as if alone, with some blanks behind it."""
        hid, sizes = self.hidden, np.array([len(p) for p in pieces])
        steps, batch = int(sizes.max()) + PAD, len(pieces)
        x, turned = np.zeros((2, steps, batch), np.uint8)
        for col, piece in enumerate(pieces):
            x[: len(piece), col] = piece
            turned[PAD : PAD + len(piece), col] = piece[::-1]
        one = self._lstm(x[:-PAD], "0", False)[0].reshape(-1, hid)
        two = self._lstm(turned, "1", False, True)[0].reshape(-1, hid)
        back = np.maximum(sizes + PAD - 1 - np.arange(steps - PAD)[:, None], 0) * batch + np.arange(batch)
        half = self.p["W"] * np.float32(0.5)
        scores = half[:hid].T @ one.T
        scores += half[hid:].T @ two.take(back.ravel(), axis=0).T
        return scores

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Most likely tags (time, batch) of windows on their own."""
        return self.best_path(self.emissions(x))

    def best_path(self, score: np.ndarray) -> np.ndarray:
        """Most likely tags (time, batch) for scores (time, tags, batch), which are overwritten, by Viterbi; the step back is found again from the sums, which is cheaper than keeping it."""
        steps, k, batch = score.shape
        trans = self.p["A"]
        through = np.empty((k, k, batch), np.float32)
        for t in range(1, steps):
            np.add(score[t - 1][:, None, :], trans[:, :, None], out=through)
            score[t] += through.max(axis=0)
        tags = np.empty((steps, batch), np.uint8)
        best = score[-1].argmax(axis=0)
        tags[-1] = best
        for t in range(steps - 2, -1, -1):
            best = (score[t] + trans[:, best]).argmax(axis=0)
            tags[t] = best
        return tags

    # learning

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood per character of tags ``y`` and its gradients."""
        steps, batch = x.shape
        hid, p = self.hidden, self.p
        hf, sf = self._lstm(x, "0", True)
        hb, sb = self._lstm(x, "1", True)
        both = np.concatenate((hf, hb), axis=2)
        e = both @ p["W"] + p["b"]
        trans = p["A"]
        alpha = np.empty_like(e)
        alpha[0] = e[0]
        soft = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        for t in range(1, steps):
            alpha[t] = soft(alpha[t - 1][:, :, None] + trans, 1) + e[t]
        beta = np.zeros_like(e)
        for t in range(steps - 2, -1, -1):
            beta[t] = soft(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = soft(alpha[-1], 1)
        rows = np.arange(batch)
        gold = e[np.arange(steps)[:, None], rows, y].sum(axis=0) + trans[y[:-1], y[1:]].sum(axis=0)
        scale = 1.0 / (steps * batch)
        de = np.exp(alpha + beta - log_z[:, None])
        de[np.arange(steps)[:, None], rows, y] -= 1
        de *= scale
        pair = np.zeros_like(trans)
        for t in range(1, steps):
            pair += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - log_z[:, None, None]).sum(axis=0)
        np.subtract.at(pair, (y[:-1], y[1:]), 1)
        g = {"A": pair * scale, "W": np.tensordot(both, de, ([0, 1], [0, 1])), "b": de.sum(axis=(0, 1))}
        dh = de @ p["W"].T
        for d, saved, part in (("0", sf, dh[:, :, :hid]), ("1", sb, dh[:, :, hid:])):
            g["T" + d], g["U" + d] = self._backward(x, d, saved, part)
        return float((log_z - gold).sum() * scale), g

    def _backward(self, x: np.ndarray, d: str, saved: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rec = self.p["U" + d]
        dt, du = np.zeros_like(self.p["T" + d]), np.zeros_like(rec)
        dh = np.zeros_like(dout[0])
        dc = np.zeros_like(dh)
        for t, h, before, g, slope, tc, c_slope in reversed(saved):
            dh = dh + dout[t]
            dc = dc + dh * g[2] * c_slope
            dz = np.concatenate((dc * g[3] * slope[0], dc * before * slope[1], dh * tc * slope[2], dc * g[0] * slope[3]), axis=1)
            np.add.at(dt, x[t], dz)
            du += h.T @ dz
            dh = dz @ rec.T
            dc = dc * g[1]
        return dt, du


def train(windows: np.ndarray, tags: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, hidden: int = 20, seed: int = 7, report=None) -> Tagger:
    """Fit a tagger on windows and tags (windows x time) with Adam and a falling rate."""
    model = Tagger.fresh(hidden, seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    total = epochs * (len(windows) // batch)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        losses = []
        for start in range(0, len(order) - batch + 1, batch):
            pick = order[start : start + batch]
            loss, grads = model.gradients(windows[pick].T, tags[pick].T.astype(np.int64))
            losses.append(loss)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            clip = min(1.0, 1.0 / (norm + 1e-9))
            now = rate * (1 - step / (total + 1)) + 1e-4
            for k, g in grads.items():
                g = g * clip
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if report:
            report(epoch, float(np.mean(losses)))
    return model


def windows_of(lengths: list[int], window: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(text number, start) of overlapping windows that cover every text."""
    out = []
    for i, n in enumerate(lengths):
        start = 0
        while True:
            out.append((i, start))
            if start + window >= n:
                break
            start += window - 2 * overlap
    return out


def tag_texts(model: Tagger, ids: list[np.ndarray], window: int = WINDOW, overlap: int = OVERLAP, rows: int = 512) -> list[np.ndarray]:
    """Tags of whole texts."""
    return _tag(model, ids, window, overlap, rows)[0]


def find_runs(model: Tagger, ids: list[np.ndarray], marks: list[list[tuple[int, int]]] | None = None) -> list[list[tuple[int, int, str, float]]]:
    """Tagged runs of whole texts, with the mean lead of their own tags over 'O'.

    With ``marks``, only of the windows that touch one; windows that follow each other are one stretch.
    """
    stretches: list[list[int]] = []
    if marks is None:
        stretches = [[i, 0, len(x)] for i, x in enumerate(ids)]
    else:
        for i, start in _touch(windows_of([len(x) for x in ids]), WINDOW, marks):
            if stretches and stretches[-1][0] == i and start < stretches[-1][2]:
                stretches[-1][2] = start + WINDOW
            else:
                stretches.append([i, start, start + WINDOW])
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in ids]
    if stretches:
        for (i, at, _), tags, leads in zip(stretches, *_tag(model, [ids[i][a:b] for i, a, b in stretches], WINDOW, OVERLAP, 512)):
            out[i] += [(at + a, at + b, kind, float(leads[a:b].mean())) for a, b, kind in spans_of(tags)]
    return out


def _touch(places: list[tuple[int, int]], window: int, marks: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """Windows (text, start) that touch a mark of their text."""
    first = [np.array([m[0] for m in own], np.int64) for own in marks]
    last = [np.maximum.accumulate(np.array([m[1] for m in own], np.int64)) for own in marks]
    return [(i, start) for i, start in places if (n := int(np.searchsorted(first[i], start + window))) and last[i][n - 1] > start]


def _tag(model: Tagger, ids: list[np.ndarray], window: int, overlap: int, rows: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Tags of whole texts, and how much each character's tag leads over 'O'.

    Overlapping windows are scored side by side; each character takes its scores
    from the window in which it lies farther from an edge. Then one best path is
    found through each whole text, so that a mention over the edge of a window is
    one. Texts lie side by side, the longest first: at each place, only those
    that reach it are walked.
    """
    lengths = np.array([len(x) for x in ids], np.int64)
    order = np.argsort(-lengths, kind="stable")
    column = np.empty(len(ids), np.int64)
    column[order] = np.arange(len(ids))
    reach = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), side="left")  # texts longer than a place
    begins = np.concatenate(([0], np.cumsum(reach)))
    scores = np.empty((len(TAGS), int(begins[-1])), np.float32)
    places = sorted(windows_of(lengths.tolist(), window, overlap), key=lambda p: min(window, int(lengths[p[0]]) - p[1]))
    for at in range(0, len(places), rows):
        part = places[at : at + rows]
        own = model.scores_of([ids[i][start : start + window] for i, start in part])
        text, start = np.array(part, np.int64).T
        place = np.arange(own.shape[1] // len(part))[:, None]
        last = np.minimum(window, lengths[text] - start) - np.where(start + window < lengths[text], overlap, 0)
        inside = np.flatnonzero((place >= np.where(start > 0, overlap, 0)) & (place < last))
        spot = (begins[(place + start).ravel()[inside]] + np.broadcast_to(column[text], (len(place), len(part))).ravel()[inside]) if len(inside) else inside
        for k in range(len(TAGS)):
            scores[k, spot] = own[k].take(inside)
    scores += model.p["b"][:, None]
    tags, leads = _packed_path(scores, begins.tolist(), model.p["A"])
    flat = [begins[:n] + c for n, c in zip(lengths.tolist(), column.tolist())]
    return [tags[f] for f in flat], [leads[f] for f in flat]


def _packed_path(scores: np.ndarray, begins: list[int], trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most likely tag at each place of texts that lie side by side, the longest first (place ``t`` from ``begins[t]``), and its lead over the first tag."""
    k, steps = len(trans), len(begins) - 1
    sums = scores.copy()
    trans = trans.copy()
    for i, j in itertools.product(range(k), range(2, k, 2)):
        if i not in (j - 1, j):
            trans[i, j] = -np.inf  # inside tags follow their own type alone
    free = [0, *range(1, k, 2)]
    into, own, stay = trans[:, free, None], trans[range(1, k, 2), range(2, k, 2), None], trans[range(2, k, 2), range(2, k, 2), None]
    through = np.empty((k, len(free), max(1, begins[1] if steps else 1)), np.float32)
    for t in range(1, steps):
        a, b, n = begins[t - 1], begins[t], begins[t + 1] - begins[t]
        before, now, view = sums[:, a : a + n], sums[:, b : b + n], through[:, :, :n]
        np.add(before[:, None], into, out=view)
        most = np.maximum.reduce(view, axis=0)
        now[0] += most[0]
        now[1::2] += most[1:]
        now[2::2] += np.maximum(before[1::2] + own, before[2::2] + stay)
    tags = np.empty(scores.shape[1], np.uint8)
    best = np.empty(0, np.int64)
    for t in range(steps - 1, -1, -1):
        b, n = begins[t], begins[t + 1] - begins[t]
        now = sums[:, b : b + n].copy()
        now[:, : len(best)] += trans.take(best, axis=1)
        best = now.argmax(axis=0)
        tags[b : b + n] = best
    leads = np.zeros(len(tags), np.float32)
    some = np.flatnonzero(tags)
    leads[some] = scores[tags[some], some] - scores[0, some]
    return tags, leads


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs of one type; a beginning tag opens a new one."""
    out = []
    if not tags.any():
        return out
    kinds = (tags.astype(np.int64) + 1) // 2
    i, n = 0, len(tags)
    for i in np.flatnonzero((kinds > 0) & ((np.concatenate(([0], kinds[:-1])) != kinds) | (tags % 2 == 1))).tolist():
        j = i + 1
        while j < n and kinds[j] == kinds[i] and tags[j] % 2 == 0:
            j += 1
        out.append((i, j, TYPES[kinds[i] - 1]))
    return out
