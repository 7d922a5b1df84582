"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Every text is a TF-IDF vector over all terms of the labelled examples; terms that
no example holds can meet none and do not count. Document frequencies are those
of the whole corpus. A term's weight grows with the log-likelihood ratio of the
term and the label; none is left out for it. The examples nearest to a text by
cosine vote with a weight that falls with their distance; the vote is turned
into a probability by a monotone curve fitted on the examples themselves, each
judged by the others. The nearest examples are returned as evidence.

The search is exact: all postings of a text's terms are summed, those of terms
that many examples hold as whole rows. Ties go to the example that comes first.
NULL and empty texts, and those of unknown terms only, have cosine 0 with all.

The examples are a sample of labelled rows, bounded by ``SAMPLE_ROWS`` and
``SAMPLE_BYTES``, so the index that is sent to every task is bounded as well;
scoring reads every word of every text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posevidence.llm.common import strings
from posevidence.llm.labelled import labelled_sample

#: Bounds of the examples: rows, and bytes of one text.
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 1 << 15
NEAREST = 25
EVIDENCE = 3
#: Terms that one in so many examples holds are kept as rows over all examples.
COMMON = 16
_TERM = re.compile(r"\w+")


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def association(clean: np.ndarray, toxic: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """Log-likelihood ratio of each term's document frequencies and the label."""
    total, seen = n[0] + n[1], clean + toxic
    ratio = np.zeros(len(seen))
    for observed, share in (
        (clean, seen * n[0] / total), (toxic, seen * n[1] / total),
        (n[0] - clean, (total - seen) * n[0] / total), (n[1] - toxic, (total - seen) * n[1] / total),
    ):
        some = observed > 0
        ratio[some] += 2 * observed[some] * np.log(observed[some] / share[some])
    return np.maximum(ratio, 0.0)


def monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of a non-decreasing curve through y."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    values, start = np.unique(x[order], return_index=True)
    sums = np.add.reduceat(y[order].astype(float), start)
    sizes = np.diff(np.r_[start, len(x)])
    for v, s, n in zip(values, sums, sizes):
        pools.append([v, v, s, float(n)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            low = pools.pop(-2)
            pools[-1] = [low[0], pools[-1][1], low[2] + pools[-1][2], low[3] + pools[-1][3]]
    ends, levels = [], []
    for low, high, s, n in pools:
        share = (s + 0.5) / (n + 1)
        ends += [low, high]
        levels += [share, share]
    return np.array(ends), np.maximum.accumulate(np.array(levels))


class Examples:
    """Labelled examples under an inverted index.

    ``corpus`` has the number of documents and, by term, how many hold it;
    without it the examples are the corpus.
    """

    def __init__(self, ids: list[int], texts: list[str], labels: np.ndarray, corpus: tuple[int, dict[str, int]] | None = None):
        self.ids, self.labels = np.array(ids, np.int64), np.asarray(labels, np.float64)
        self.count = len(ids)
        bags = [Counter(terms_of(t)) for t in texts]
        self.number = {t: k for k, t in enumerate(sorted(set().union(*bags)))}
        seen = np.zeros((2, len(self.number)))
        for bag, label in zip(bags, self.labels):
            seen[int(label), [self.number[t] for t in bag]] += 1
        n = int((self.labels == 0).sum()), int((self.labels == 1).sum())
        documents, held = self.count, seen.sum(axis=0)
        if corpus is not None:
            documents, held = corpus[0], np.array([corpus[1].get(t, 0) for t in self.number], np.float64)
        self.idf = np.log((1 + documents) / (1 + held)) + 1
        self.scale = self.idf * (1 + (association(*seen, n) if all(n) else 0.0))
        self._index([self.vector(b) for b in bags])
        votes = np.array([
            self._vote(*self.nearest(self._own[k], without=k)) for k in range(self.count)
        ]) if self.count > 1 else np.zeros(0)
        if len(votes):
            self.curve = monotone(votes, self.labels)
        else:
            share = float(self.labels.mean()) if self.count else 0.5
            self.curve = np.array([0.0, 1.0]), np.array([share, share])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_own", "_rows")}

    def vector(self, bag: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms that examples hold, and unit-length weights."""
        known = sorted((self.number[t], c) for t, c in bag.items() if t in self.number)
        numbers = np.array([k for k, _ in known], np.int64)
        weights = (1 + np.log(np.array([c for _, c in known], np.float64))) * self.scale[numbers]
        return numbers, weights / np.sqrt((weights**2).sum()) if len(weights) else weights

    def _index(self, vectors: list) -> None:
        self._own = vectors
        numbers = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in vectors)])
        order = np.argsort(numbers, kind="stable")
        self.who = np.repeat(np.arange(self.count), [len(k) for k, _ in vectors])[order]
        self.weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])[order]
        self.cut = np.searchsorted(numbers[order], np.arange(len(self.number) + 1))

    def _row(self, term: int) -> np.ndarray:
        rows = self.__dict__.setdefault("_rows", {})
        if term not in rows:
            own = slice(self.cut[term], self.cut[term + 1])
            rows[term] = np.zeros(self.count)
            rows[term][self.who[own]] = self.weight[own]
        return rows[term]

    def nearest(self, vector, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples and their cosines, nearest first."""
        numbers, weights = vector
        first, sizes = self.cut[numbers], self.cut[numbers + 1] - self.cut[numbers]
        common = COMMON * sizes >= self.count
        rare = sizes[~common]
        at = np.repeat(first[~common] - (np.cumsum(rare) - rare), rare) + np.arange(rare.sum())
        sums = np.bincount(self.who[at], np.repeat(weights[~common], rare) * self.weight[at], self.count).astype(np.float64)
        for t, w in zip(numbers[common].tolist(), weights[common].tolist()):
            sums += w * self._row(t)
        cosine = np.round(sums, 12)
        if without >= 0:
            cosine[without] = -1.0
        found = np.arange(self.count)
        if self.count > NEAREST:
            found = np.flatnonzero(cosine >= np.partition(cosine, -NEAREST)[-NEAREST])
        found = found[found != without]
        found = found[np.lexsort((found, -cosine[found]))[:NEAREST]]
        return found, cosine[found]

    def _vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        if not len(found):
            return 0.0
        weight = 1 / (1.02 - np.minimum(cosine, 1.0))
        return float(np.round((weight * self.labels[found]).sum() / weight.sum(), 9))

    def judge(self, text: str) -> tuple[float, list[tuple[int, float]]]:
        """The probability that a text is toxic, and its nearest examples."""
        found, cosine = self.nearest(self.vector(Counter(terms_of(text))))
        score = float(np.interp(self._vote(found, cosine), *self.curve))
        return score, list(zip(self.ids[found[:EVIDENCE]].tolist(), cosine[:EVIDENCE].tolist()))


def corpus_counts(docs: DataFrame, terms: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents, and how many of them hold each of ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        number = {t: k for k, t in enumerate(shared.value, 1)}
        held = np.zeros(len(number) + 1, np.int64)
        for batch in batches:
            held[0] += batch.num_rows
            for text in strings(batch.column(0)):
                held[[number[t] for t in set(terms_of(text)) if t in number]] += 1
        some = np.flatnonzero(held)
        yield pa.record_batch([pa.array(some), pa.array(held[some])], ["term", "held"])

    found = docs.select("text").mapInArrow(count, "term long, held long").groupBy("term").agg(F.sum("held").alias("held")).collect()
    held = {r["term"]: r["held"] for r in found}
    return held.pop(0, 0), {terms[k - 1]: n for k, n in held.items()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, left_out: int = 1) -> Examples:
    rows = labelled_sample(docs, labels, label, SAMPLE_ROWS, SAMPLE_BYTES, folds, left_out).collect()
    rows.sort(key=lambda r: r["doc_id"])
    texts = [r["text"] for r in rows]
    corpus = corpus_counts(docs, sorted(set().union(*(terms_of(t) for t in texts))))
    return Examples([r["doc_id"] for r in rows], texts, np.array([r["label"] for r in rows]), corpus)


def judged(text: Column, examples: Examples, shared=None) -> Column:
    """struct(score, nearest): ``nearest`` has the evidence, nearest first."""
    from pyspark.sql import SparkSession

    shared = shared or SparkSession.active().sparkContext.broadcast(examples)

    @F.arrow_udf("struct<score:double,nearest:array<struct<doc_id:bigint,cosine:double>>>")
    def judge(texts: pa.Array) -> pa.Array:
        own = shared.value
        found = [own.judge(t) for t in strings(texts)]
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
        nearest = pa.array([[{"doc_id": d, "cosine": c} for d, c in e] for _, e in found], kind)
        return pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.float64()), nearest], ["score", "nearest"])

    return judge(text)
