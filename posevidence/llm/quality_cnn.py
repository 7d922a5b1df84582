"""A byte-level convolutional network that scores the quality of a text.

Every byte has a learned vector. Chunks of ``CHUNK`` bytes, each overlapping the
next by half, cover the whole text; learned filters answer to each chunk, every
filter keeps its highest answer over the text, and the kept answers are combined
into one probability. The last chunk is filled up with a code that no byte has;
an empty (or NULL) text is one chunk of it.

The network is fitted on a sample of labelled rows, bounded by ``SAMPLE_ROWS``
and ``SAMPLE_BYTES``; scoring reads every byte of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import text_bytes
from posevidence.llm.labelled import labelled_sample

HALF = 8
CHUNK = 2 * HALF
WIDTH = 6
FILTERS = 16
_PAD = 256
#: Bounds of the fitting sample: rows, and bytes of one text.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 1 << 15


def _laid_out(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each filled up to half chunks, and where texts begin
    in half chunks."""
    sizes = np.diff(at)
    halves = np.maximum(-(-sizes // HALF), 2)
    begin = np.concatenate([[0], np.cumsum(halves)])
    codes = np.full(begin[-1] * HALF, _PAD, np.int16)
    place = np.arange(len(data)) + np.repeat(begin[:-1] * HALF - at[:-1], sizes)
    codes[place] = data
    return codes, begin


@dataclass
class Network:
    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def answers(self, codes: np.ndarray) -> np.ndarray:
        """Of each half chunk with the next one: every filter's answer."""
        halves = self.vectors[codes].reshape(-1, HALF * WIDTH)
        both = self.filters.reshape(2, HALF * WIDTH, FILTERS)
        return halves[:-1] @ both[0] + halves[1:] @ both[1]

    def pooled(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        codes, begin = _laid_out(data, at)
        answers = np.concatenate([self.answers(codes), np.zeros((1, FILTERS), np.float32)])
        answers[begin[1:] - 1] = -np.inf  # half in the next text
        return np.maximum.reduceat(answers, begin[:-1])

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        kept = np.maximum(self.pooled(data, at) + self.bias, 0)
        return 1 / (1 + np.exp(-(kept @ self.weights + self.offset).astype(np.float64)))


def fitted(texts: list[bytes], labels: np.ndarray, epochs: int = 14, batch: int = 32, seed: int = 11) -> Network:
    random = np.random.default_rng(seed)
    parameters = [
        random.normal(0, 0.5, (_PAD + 1, WIDTH)).astype(np.float32),
        random.normal(0, 1 / np.sqrt(CHUNK * WIDTH), (CHUNK * WIDTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        random.normal(0, 0.3, FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    ]
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():  # nothing to tell apart
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Network(*parameters[:3], np.zeros(FILTERS, np.float32), float(np.log(share / (1 - share))))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            net = Network(*parameters[:4], float(parameters[4][0]))
            sizes = [len(arrays[i]) for i in some]
            at = np.concatenate([[0], np.cumsum(sizes)])
            codes, begin = _laid_out(np.concatenate([arrays[i] for i in some]), at)
            answers = net.answers(codes)
            best = np.stack([answers[a : b - 1].argmax(axis=0) + a for a, b in zip(begin, begin[1:])])
            top = answers[best, np.arange(FILTERS)]
            kept = np.maximum(top + net.bias, 0)
            p = 1 / (1 + np.exp(-(kept @ net.weights + net.offset)))
            error = ((p - labels[some]) / len(some)).astype(np.float32)
            down = error[:, None] * net.weights * (top + net.bias > 0)
            spots = codes[best[..., None] * HALF + np.arange(CHUNK)]  # text, filter, byte
            seen = net.vectors[spots].reshape(len(some), FILTERS, -1)
            vectors = np.zeros_like(net.vectors)
            np.add.at(
                vectors, spots.ravel(),
                (down[..., None] * net.filters.T).reshape(-1, WIDTH),
            )
            gradients = [
                vectors,
                np.einsum("tf,tfc->cf", down, seen),
                down.sum(axis=0),
                kept.T @ error,
                np.array([error.sum()], np.float32),
            ]
            step += 1
            rate = 0.01 * (1 - step / (steps + 1)) + 1e-4
            for p_, g, (m, v) in zip(parameters, gradients, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Network(*parameters[:4], float(parameters[4][0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, left_out: int = 1) -> Network:
    rows = labelled_sample(docs, labels, label, SAMPLE_ROWS, SAMPLE_BYTES, folds, left_out).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return fitted([r["text"].encode("utf-8") for r in rows], np.array([r["label"] for r in rows]))


def score(text: Column, network: Network) -> Column:
    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        data, at = text_bytes(texts)
        out, a = [], 0
        while a < len(at) - 1:
            b = max(a + 1, int(np.searchsorted(at, at[a] + (1 << 19), "right")) - 1)
            out.append(network.score(data[at[a] : at[b]], at[a : b + 1] - at[a]))
            a = b
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return scored(text)
