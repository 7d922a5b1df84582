"""Secrets, source divergence and hard negatives against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from posevidence.llm import hard_negatives, secret_scan, source_divergence

KEY = "Zk9" + "aQ2x" * 2 + "Lw7pR4vB1mN8"
OTHER = "Hj3" + "sT6u" * 2 + "Yc5dE0gF2kW9"


def found_secrets(make_docs, rows):
    return {r["doc_id"]: r["spans"] for r in secret_scan.secrets(make_docs(rows).repartition(3)).collect()}


def spans(row):
    return [(secret_scan.KINDS[s["kind"]], s["start"], s["end"], s["verdict"]) for s in row]


def test_base_patterns(make_docs):
    texts = {
        1: "my Password = 'hunter22' and token:abc then api-key: x, API_KEY=abcdef",
        2: "AKIA" + "B" * 15 + " AKIA" + "B" * 16,
        3: "0" * 23 + "g" + "a1" * 12,
        4: "secret=token : abcdef",
        5: "paſsword=abcdefgh toKen=abcdefgh",
        6: "😀😀 token=abcdefgh",
        7: None,
        8: "",
        9: "passwdsecret:= abcdef token\t=abcdef",
    }
    found = found_secrets(make_docs, [(d, t) for d, t in texts.items()])
    named = {d: [s[:3] for s in spans(row)] for d, row in found.items()}
    assert named[1] == [("assign", 3, 23), ("assign", 56, 70)]
    assert named[2] == [("access", 20, 40)]
    assert named[3] == [("hex", 24, 48)]
    assert named[4] == [] and named[5] == [] and named[7] == [] and named[8] == []
    assert named[6] == [("assign", 3, 17)]
    # The value of the first is "=" alone, and a tab is no space.
    assert named[9] == []


def test_ownership_separates_copies_from_own(make_docs):
    rows = [(k, f"see token={KEY} here", "en", f"s{k % 3}") for k in range(9)]
    rows += [(20, f"only {OTHER} here", "en", "s1"), (21, f"and {OTHER} again", "de", "s1")]
    rows += [(30, f"key {KEY[:-1]}Q", "en", "s2"), (31, f"key {KEY[:-1]}Q", "en", "s3")]
    rows += [(40, "secret: changeme", "en", "s4"), (None, f"lost {KEY[::-1]}", None, None)]
    found = found_secrets(make_docs, rows)
    assert spans(found[0]) == [("assign", 4, 4 + 6 + len(KEY), "copied")]
    assert spans(found[20]) == [("live", 5, 5 + len(OTHER), "live")]
    assert spans(found[21]) == [("live", 4, 4 + len(OTHER), "live")]
    assert found[30] == [] and found[31] == []
    assert spans(found[40]) == [("assign", 0, 16, "found")]
    assert spans(found[None]) == [("live", 5, 5 + len(KEY), "live")]


def test_every_row_stays(make_docs, hard_rows):
    rows = hard_rows + [(50, f"token={KEY} " * 3000), (50, f"token={KEY} " * 3000)]
    docs = make_docs(rows)
    found = secret_scan.secrets(docs).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    assert [len(r["spans"]) for r in found if r["doc_id"] == 50] == [3000, 3000]
    assert secret_scan.secrets(docs.limit(0)).count() == 0


def divergence(rows, least, most):
    """The report in plain Python."""
    counts, whole, kept = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    within = defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in terms]
        counts[lang, source].update(terms)
        within[lang].update(set(terms))
        groups[lang].add(source)
    for lang, seen in within.items():
        kept[lang] = {t for t, n in seen.items() if n >= least}
    out = []

    def shares(column, terms):
        n = sum(column[t] for t in terms) + 5 * len(terms)
        return {t: 1 + 10**9 * (column[t] + 5) // n for t in terms}

    for lang, sources in groups.items():
        for s in sources:
            whole[lang].update(counts[lang, s])
        q = shares(whole[lang], kept[lang])
        p = {s: shares(counts[lang, s], kept[lang]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept[lang]), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept[lang] if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, most)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


def audited(docs, **options):
    return sorted(tuple(r) for r in source_divergence.audit(docs, **options).collect())


@pytest.mark.parametrize("block", [8192, 3])
def test_divergence_against_plain_python(make_docs, block):
    r = random.Random(5)
    vocabulary = [w + t for w in ("alpha", "Beta", "GAMMA", "élan", "über", "日本") for t in ("", "x", "Y", "zz")]
    rows = []
    for k in range(160):
        lang, source = r.choice(["en", "de", None, "fr"]), f"s{r.randrange(40)}" if k % 9 else None
        rows.append((k, "1 ".join(r.choices(vocabulary, k=r.randrange(0, 30))), lang, source))
    rows += [(200, None, "en", "empty"), (201, "", "xx", "one"), (202, "solo", "xx", "two"), (None, "alpha alpha", "en", "s1")]
    rows += [rows[3], rows[3], (203, "Beta " * 20000, "de", "s2")]
    expected = divergence(rows, 3, 4)
    assert audited(make_docs(rows).repartition(5), least_documents=3, most_terms=4, block=block) == expected
    assert any(v == 0 for lang, *_, v, _ in expected if lang == "xx")


def test_divergence_without_rows(make_docs):
    assert audited(make_docs([(1, "a")]).limit(0)) == []
    assert audited(make_docs([(1, "a")])) == []


def test_runs_of_different_lengths():
    a, b = np.array([5, 5, 5, 0, 0, 9]), np.array([1, 5, 5, 5, 0, 0])

    def runs(column):
        ends = np.r_[np.flatnonzero(column[1:] != column[:-1]) + 1, len(column)]
        return ends, column[ends - 1]

    assert source_divergence.intersected(*runs(a), *runs(b)) == int(np.abs(a - b).sum())
    big = np.array([10**12, 3, 0])
    whole = int(big.sum()) + 15
    assert source_divergence._shares(big, whole).tolist() == [1 + 10**9 * (int(c) + 5) // whole for c in big]


VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        T.StructField("score", T.StringType()),
        T.StructField("rank", T.StringType()),
    ]
)


def hard(rows):
    """The windows in plain Python."""
    known = {}
    for d, vector, label in rows:
        if d is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if d % 7 == 0 else label
        row = (label, [int(np.floor(256 * float(np.float32(x)))) for x in vector])
        known[d] = min(known.get(d, row), row)
    out = []
    for a, (label, vector) in known.items():
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(vector, v)), d, other) for d, (other, v) in known.items() if d != a)
        for p, positive, _ in [s for s in scores if s[2] == label][:5]:
            window = [s for s in scores if s[2] != label and -80 * p <= -100 * s[0] <= -100 * p][:5]
            out += [(a, positive, k, d, -p, -n) for k, (n, d, _) in enumerate(window, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame([(d, v, c, "x", "x") for d, v, c in rows], VECTORS).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mined(df).collect())


def vectors(n, seed, width=24, spread=0.2):
    g = np.random.default_rng(seed)
    base = g.normal(size=(4, width))
    return [(int(k), [float(x) for x in base[k % 4] * 0.5 + g.normal(size=width) * spread], int(k % 3)) for k in range(n)]


def test_hard_negatives_against_plain_python(spark, monkeypatch):
    rows = vectors(701, 1)
    rows += [(1000, None, 1), (1100, [0.5, None], 1), (1200, [float("nan")] * 24, 1), (1300, [float("inf")] * 24, 2)]
    rows += [(None, rows[0][1], 0), (1400, rows[0][1], None), (1500, rows[0][1][:7], 0), (1600, [], 2), (1700, [0.0] * 24, 9)]
    rows += [(2000 + k, rows[100][1], k % 2) for k in range(30)] + [rows[200], (200, rows[200][1][::-1], 1)]
    rows += [(1800, [-x for x in rows[4][1]], 77), (1801, rows[4][1], 77), (1900, rows[5][1], 99)]
    expected = hard(rows)
    assert mined(spark, rows) == expected
    # A grid of many cells gives the same.
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 100)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    assert mined(spark, rows) == expected


def test_hard_negatives_of_large_components(spark):
    rows = [(k, [float(np.float32(x * 3e5)) for x in v], c) for k, v, c in vectors(230, 2, spread=0.4)]
    assert mined(spark, rows) == hard(rows)


def test_hard_negatives_without_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_bounds_lose_no_pair():
    g = np.random.default_rng(3)
    rows = np.floor(g.normal(size=(300, 40)) * g.exponential(60, 40))
    queries = np.floor(g.normal(size=(20, 40)) * g.exponential(60, 40))
    scores = queries @ rows.T
    for share in (0.5, 0.9, 0.99, 1.0):
        least = np.floor(np.quantile(scores, share, 1))
        q, r, s = hard_negatives._reaching(queries, rows, least)
        expected = {(a, b): scores[a, b] for a, b in zip(*np.nonzero(scores >= least[:, None]))}
        assert dict(zip(zip(q.tolist(), r.tolist()), s)) == expected and len(q) == len(expected)
