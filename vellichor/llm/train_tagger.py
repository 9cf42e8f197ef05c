"""Fit the tagger and store it: ``python -m vellichor.llm.train_tagger DOCUMENTS.parquet``.

It learns from ``MADE`` made-up texts whose spans are known (``pii_samples``), and from
at most ``FIT_TEXTS`` texts of a table (those of least hash), whose spans the forms and
phrases of ``pii_rules`` label; a tenth of either is held out.
"""

from __future__ import annotations

import random
import sys
import zlib

import numpy as np
import pyarrow.parquet as pq

from vellichor.llm import pii_rules, pii_samples, tagger

FIT_TEXTS = 6_000
MADE = 4_500
PLAIN_WINDOWS = 2
EPOCHS = 7
HIDDEN = 16


Labelled = tuple[str, list[tuple[int, int, str]]]


def windows(texts: list[Labelled], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Training windows: around every labelled span, at random offsets, and plain ones beside them."""
    rng = np.random.default_rng(seed)
    size = 128
    xs, ys = [], []
    for text, spans in texts:
        ids = tagger.encode(text)
        y = np.zeros(len(ids), np.uint8)
        for a, b, kind in spans:
            k = tagger.TYPES.index(kind)
            y[a:b] = 2 * k + 2
            y[a] = 2 * k + 1
        starts = [max(0, a - int(rng.integers(0, 90))) for a, _, _ in spans]
        if len(ids) > size:
            starts += rng.integers(0, len(ids) - size, PLAIN_WINDOWS).tolist()
        for s in starts:
            x = np.zeros(size, np.uint8)
            t = np.zeros(size, np.uint8)
            n = len(ids[s : s + size])
            x[:n], t[:n] = ids[s : s + size], y[s : s + size]
            if t[0] and t[0] % 2 == 0:  # never begin inside a span
                t[0] -= 1
            xs.append(x)
            ys.append(t)
    return np.array(xs), np.array(ys)


def main(path: str) -> None:
    texts = sorted({t for t in pq.read_table(path, columns=["text"]).column(0).to_pylist() if t}, key=lambda t: zlib.crc32(t.encode("utf-8", "surrogatepass")))[:FIT_TEXTS]
    rng = random.Random(11)
    sources = {"table": [(t, pii_rules.labels(t)) for t in texts], "made-up": [pii_samples.sample(rng) for _ in range(MADE)]}
    held = {k: v[: len(v) // 10] for k, v in sources.items()}
    xs, ys = windows([t for k, v in sources.items() for t in v[len(held[k]) :]])
    print(f"{len(xs)} windows", flush=True)
    model = tagger.train(xs, ys, epochs=EPOCHS, hidden=HIDDEN, report=lambda e, loss: print(f"epoch {e}: {loss:.5f}", flush=True))
    model.save()
    for name, rows in held.items():
        found = wanted = right = 0
        for (_, gold), tags in zip(rows, tagger.tag_texts(tagger.Tagger.load(), [tagger.encode(t) for t, _ in rows])):
            got = set(tagger.spans_of(tags))
            found, wanted, right = found + len(got), wanted + len(gold), right + len(got & set(gold))
        print(f"held-out {name} texts: {wanted} labelled spans, {found} found, {right} exactly")


if __name__ == "__main__":
    main(sys.argv[1])
