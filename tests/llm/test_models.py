import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from posevidence.llm import decontamination, pitman_yor, quality_cnn, quality_rules, toxicity
from posevidence.llm.common import text_bytes, word_names, word_spans
from posevidence.llm.labelled import labelled_sample
from posevidence.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = "/root/testdata/sf0.01"


def counts_of(text):
    text = text or ""
    words = WORD.findall(text)
    places = {}
    for k in range(len(words) - 4):
        places.setdefault(tuple(words[k : k + 5]), []).append(k)
    repeated = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(5)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated)
    )


def test_quality_counts_against_brute_force(make_docs, hard_rows):
    extra = [(500, "one two three four five " * 3), (501, "l\nl\n\n \nl x\nl"), (502, "a b c d e f a b c d e"), (503, "###"),
             (504, "same " * 9), (505, "w1 w2 w3 w4 w5"), (506, " lead and trail \n")]
    rows = hard_rows + extra
    found = quality_rules.verdicts(make_docs(rows)).collect()
    assert len(found) == len(rows)
    expected = sorted(((d is not None, d or 0), counts_of(t)) for d, t, *_ in rows)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), tuple(r[c] for c in quality_rules.COUNTS)) for r in found)
    assert got == expected
    for r in found:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_fences_follow_each_group(make_docs, words):
    plain = [(k, " ".join(words(k, 40)), "en", "web") for k in range(40)]
    marked = [(100 + k, " ".join(w + "###" for w in words(k, 40)), "en", "code") for k in range(40)]
    stray = [(200, " ".join(w + "###" for w in words(200, 40)), "en", "web"), (201, " ".join(words(201, 40)), None, None)]
    kept = {r["doc_id"] for r in quality_rules.verdicts(make_docs(plain + marked + stray)).filter("kept").collect()}
    assert kept == {r[0] for r in plain + marked} | {201}


def test_fences_alone_reject(make_docs, words):
    """Rates that other groups hold throughout, and that no fixed bound meets."""
    def text(k, times=1, lines=1):
        own = [w * times for w in words(k, 60)]
        return "\n".join([*(" ".join(own[i : i + 3]) for i in range(0, 60, 3)), *["same line"] * lines])

    plain = [(k, text(k), "en", "web") for k in range(40)]
    long = [(100 + k, text(k, times=2), "de", "web") for k in range(40)]
    listed = [(200 + k, text(k, lines=6), "en", "lists") for k in range(40)]
    stray = [(300, text(300, times=2), "en", "web"), (301, text(301), "de", "web"), (302, text(302, lines=6), "en", "web")]
    found = quality_rules.verdicts(make_docs(plain + long + listed + stray)).collect()
    assert not any(r["base_failed"] for r in found)
    assert {r["doc_id"] for r in found if not r["kept"]} == {300, 301, 302}


def test_quality_rules_of_an_empty_table(make_docs):
    assert quality_rules.verdicts(make_docs([])).count() == 0


def test_quality_rules_stay_native(spark):
    plan = QUERIES["op7_quality_rules"](spark, TABLES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sample_is_bounded_and_leaves_the_fold_out(spark, make_docs):
    docs = make_docs([(k, "t" * (k + 1)) for k in range(60)] + [(61, None), (None, "n")])
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(70)] + [(4, 1, None), (None, 1, None)], "doc_id long, quality int, toxic int")
    found = labelled_sample(docs, labels, "quality", 20, 40).collect()
    assert 0 < len(found) <= 20
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and len(r["text"]) <= 40 for r in found)
    assert labelled_sample(docs, labels, "toxic", 20, 40).count() == 0


def test_network_covers_the_whole_text():
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(97, 123, r.integers(1, 400)).astype(np.uint8)) for _ in range(120)]
    labels = np.array([k % 2 for k in range(120)])
    texts = [t if y else t + b"#!#" * 6 for t, y in zip(texts, labels)]
    net = quality_cnn.fitted(texts, labels, epochs=30)

    def score(*some):
        at = np.cumsum([0, *map(len, some)])
        return net.score(np.frombuffer(b"".join(some), np.uint8), at)

    assert ((score(*texts) >= 0.5) == labels).mean() > 0.95
    # The sign counts wherever it stands, and a text's score is its own.
    plain = bytes(r.integers(97, 123, 30_000).astype(np.uint8))
    far = plain + b"#!#" * 6
    assert score(far)[0] < 0.5 and score(far)[0] < score(plain)[0]
    assert np.allclose(score(*texts[:5], b"", far)[:5], score(*texts[:5]), atol=1e-6)
    assert 0 <= score(b"")[0] <= 1


def test_network_answers_against_plain_loops():
    texts = [b"abcdefghijklmnopqrstuvwxyz!", b"", b"0123456789abcdef0123"]
    net = quality_cnn.fitted([b"aa", b"bb"], np.array([0, 1]), epochs=1)
    at = np.cumsum([0, *map(len, texts)])
    pooled = net.pooled(np.frombuffer(b"".join(texts), np.uint8), at)
    for text, own in zip(texts, pooled):
        length = max(16, -(-len(text) // 8) * 8)
        codes = [*text, *[256] * (length - len(text))]
        chunks = [np.concatenate([net.vectors[c] for c in codes[k : k + 16]]) @ net.filters for k in range(0, length - 15, 8)]
        assert np.allclose(np.max(chunks, axis=0), own, atol=1e-5)


def test_fits_without_labels_to_tell_apart():
    for labels in ([], [1, 1]):
        net = quality_cnn.fitted([b"a"] * len(labels), np.array(labels))
        assert 0 <= net.score(np.zeros(0, np.uint8), np.array([0, 0]))[0] <= 1


@pytest.mark.parametrize("name,label,limit,column", [("op4_quality_cnn", "quality", 0.5, "quality"), ("op8_toxicity", "toxic", 0.7, "toxic")])
def test_held_out_accuracy(spark, name, label, limit, column):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    found = QUERIES[name](spark, TABLES).collect()
    assert len(found) == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
    own = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in labels]
    accuracy = np.mean([p == y for p, y in own])
    base = max(np.mean([y for _, y in own]), 1 - np.mean([y for _, y in own]))
    assert accuracy > base + 0.02


def test_nearest_examples_are_exact():
    r = np.random.default_rng(9)
    signs = ["bad", "worse", "worst", "fine", "good"]
    texts, labels = [], []
    for k in range(300):
        toxic = int(r.random() < 0.3)
        own = list(r.choice(signs[:3] if toxic else signs[3:], r.integers(1, 4))) + [f"w{x}" for x in r.integers(0, 50, 9)]
        texts.append(" ".join(own))
        labels.append(toxic)
    examples = toxicity.Examples(list(range(0, 600, 2)), texts, np.array(labels))
    assert examples.number
    dense = np.zeros((300, len(examples.idf)))
    for k, (numbers, weights) in enumerate(examples._own):
        dense[k, list(numbers)] = weights
    for k in range(300):
        cosine = np.round(dense @ dense[k], 12)
        order = np.lexsort((np.arange(300), -cosine))[: toxicity.NEAREST]
        found, own = examples.nearest(examples._own[k])
        assert np.allclose(own, cosine[order], atol=1e-11)
        order = [x for x in np.lexsort((np.arange(300), -cosine)) if x != k][: toxicity.NEAREST]
        _, own = examples.nearest(examples._own[k], without=k)
        assert np.allclose(own, cosine[order], atol=1e-11)
    assert examples.judge("bad worse worst bad")[0] > 0.7 > 0.3 > examples.judge("fine good")[0]
    for text in ("", "unseen words only"):
        score, evidence = examples.judge(text)
        assert 0 <= score <= 1 and len(evidence) == toxicity.EVIDENCE


def test_every_term_of_the_examples_counts(spark, make_docs, words):
    rows = [(k, " ".join([*words(k, 30), *(["vile"] * (k % 4 == 0)), *(["rarest"] * (k == 80))])) for k in range(120)]
    docs = make_docs(rows + [(500 + k, "rarest elsewhere") for k in range(50)]).select("doc_id", "text")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id long, toxic int")
    examples = toxicity.fit(docs, labels)
    for doc_id in examples.ids.tolist():
        (first, cosine), *others = examples.judge(rows[doc_id][1])[1]
        assert first == doc_id and cosine == pytest.approx(1) and all(c < 0.999 for _, c in others)
    assert 80 in examples.ids and examples.idf[examples.number["rarest"]] == pytest.approx(math.log(171 / 52) + 1)
    assert examples.judge("zzz rarest")[1][0][0] == 80


def test_examples_without_rows():
    for ids, texts, labels in (([], [], []), ([1], ["a"], [1])):
        score, _ = toxicity.Examples(ids, texts, np.array(labels)).judge("a b")
        assert 0 <= score <= 1


def test_curve_does_not_fall():
    x, y = np.array([0.1, 0.2, 0.3, 0.4, 0.4]), np.array([1, 0, 1, 0, 1])
    at, level = toxicity.monotone(x, y)
    assert (np.diff(at) >= 0).all() and (np.diff(level) >= 0).all()


QUESTION = "Maria buys 12 apples for 3.50 dollars and gives Tomas a third of the apples before lunch."


def test_contamination(spark, make_docs, words):
    bench = spark.createDataFrame(
        [(1, QUESTION), (2, "short item of five"), (3, None), (4, ""), (1, QUESTION), (5, "12 13 14 15 16 17 18 19 20 21")],
        "item_id long, text string",
    )
    fill = lambda k: " ".join(words(k, 30))
    rows = [
        (1, f"{fill(1)} {QUESTION} {fill(2)}"),
        (2, f"{fill(3)} Ingrid buys 40 apples for 1,200.75 euros and gives Pedro a third of the apples before lunch. {fill(4)}"),
        (3, f"{fill(5)} {QUESTION.upper()} {fill(6)}"),
        # Names that do not correspond: one stands for two.
        (4, "Maria buys 12 apples"),
        (5, fill(7)),
        (6, None), (7, ""), (8, "short item of five"), (None, QUESTION), (9, "12 13 14 15 16 17 18 19 20 21"),
        (10, QUESTION), (10, QUESTION), (11, f"{fill(8)} short item of five {fill(9)}"),
    ]
    found = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(make_docs(rows), bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 1), (8, 2), (9, 5), (10, 1), (11, 2)}
    assert found[1, 1]["exact"] and not found[2, 1]["exact"]
    none = make_docs([])
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(make_docs(rows), bench.limit(0)).count() == 0


def test_query_finds_short_and_slot_rich_questions(spark, make_docs, words, shared_dir):
    numbers, people = "12 13 14 15 16 17 18 19 20 21", "Ann Bob Carl Dora Emil Fay Gus Hal Ida 3.50"
    bench = spark.createDataFrame(
        [(1, "What is the capital of France?"), (2, numbers), (3, people), (4, "7 + 5"), (5, "Quito"), (6, "?!")],
        "item_id long, text string",
    )
    fill = lambda k: " ".join(words(k, 30))
    rows = [
        (1, f"{fill(1)} What is the capital of France? {fill(2)}"),
        (2, f"{fill(3)} what is the capital of spain {fill(4)} What is the capital of Spain?"),
        (3, f"{fill(5)} {numbers} {fill(6)}"), (4, numbers), (5, numbers.replace("15", "51")),
        (6, f"{fill(7)} {people}. {fill(8)}"), (7, people.lower()), (8, people.replace("3.50", "3,50").replace("Dora", "Dan")),
        (9, f"{fill(9)} 7 + 5 {fill(10)}"), (10, f"{fill(11)} 5 + 7 {fill(12)}"), (11, f"{fill(13)} QUITO"), (12, "Lima ?!"),
        (13, "France"), (14, ""), (15, None), (None, numbers),
    ]
    folder = f"{shared_dir}/short-questions"
    make_docs(rows).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]): r for r in QUERIES["op9_decontamination"](spark, folder).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 2), (4, 2), (6, 3), (7, 3), (9, 4), (11, 5)}
    assert found[1, 1]["exact"] and not found[2, 1]["exact"] and found[3, 2]["n_covered"] == 10


def test_slots_correspond_one_to_one():
    def row(at, item_at, item, doc):
        return {"at": at, "item_at": item_at, "item_slots": item, "slots": doc}

    a = row(5, 0, ["anna", None, "ben"], ["eva", None, "jan"])
    assert decontamination._consistent([a]) == (3, False)
    swapped = row(8, 3, ["anna", None, None], ["jan", None, None])
    assert decontamination._consistent([a, swapped]) == (3, False)
    merged = row(8, 3, ["carl", None, None], ["eva", None, None])
    assert decontamination._consistent([a, merged])[0] == 3
    again = row(8, 3, ["ben", None, None], ["jan", None, None])
    assert decontamination._consistent([a, again])[0] == 6


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_base_score_against_brute_force(make_docs, hard_rows):
    rows = hard_rows
    found = pitman_yor.scored(make_docs(rows).repartition(3)).collect()
    assert len(found) == len(rows)
    key = lambda d: "" if d is None else str(d)
    tokens = [(d, WORD.findall(lower(t)) + [None]) for d, t, *_ in rows]
    held = {d: zlib.crc32(key(d).encode()) % 5 == 1 for d, _ in tokens}
    counts = Counter(w for d, own in tokens if not held[d] for w in own)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (key(d), held[d], len(own), sum(counts[w] > 0 for w in own),
         round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6))
        for d, own in tokens
    )
    got = sorted((key(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in found)
    assert got == expected
    assert {r["train_tokens"] for r in found} == {n}
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in found)
    assert pitman_yor.scored(make_docs([])).count() == 0


def test_score_against_brute_force(make_docs, hard_rows, words):
    """Every token is a restaurant of its own, whatever its digest, and its
    totals are those of all buckets."""
    rows = hard_rows + [(100 + k, " ".join(words(60, 30 + k)[k:] + words(61 + k % 3, 20))) for k in range(30)]
    found = pitman_yor.scored(make_docs(rows).repartition(3)).select("doc_id", "score").collect()
    known = sorted({w for _, t, *_ in rows for w in WORD.findall(t or "")})
    data, at = text_bytes(pa.array(known))
    names = dict(zip(known, word_names(data, *word_spans(data, at)[:2], lower=True).tolist()))
    end = int(pitman_yor._END)
    assert len({(n >> 7) % 4096 for n in names.values()}) < len(set(names.values()))
    key = lambda d: "" if d is None else str(d)
    texts = [(key(d), [names[w] for w in WORD.findall(t or "")] + [end]) for d, t, *_ in rows]
    bigrams = lambda own: list(zip(own, [end, *own[:-1]]))
    cells = Counter(b for d, own in texts if zlib.crc32(d.encode()) % 5 != 1 for b in bigrams(own))
    of_word, customers = Counter(w for w, _ in cells), Counter()
    for (_, c), n in cells.items():
        customers[c] += n
    once, twice = (sum(n == k for n in cells.values()) for k in (1, 2))
    root_once, root_twice = (sum(n == k for n in of_word.values()) for k in (1, 2))
    discounts = [min(max(a / (a + 2 * b), 0.05), 0.95) for a, b in ((once, twice), (root_once, root_twice))]
    tables, root, seats, parents = Counter(c for _, c in cells), float(len(of_word)), {}, {}
    for sweeps, keep, seed in ((pitman_yor.BURN_IN, 1, 1), (pitman_yor.BURN_IN + pitman_yor.SAMPLES, pitman_yor.SAMPLES, 2)):
        before, whole, roots = dict(tables), float(sum(tables.values())), 0.0
        for bucket in range(pitman_yor.LEAST_BUCKETS):
            own = sorted(b for b in cells if int(pitman_yor._bucket(np.array([b[0]], np.uint64), pitman_yor.LEAST_BUCKETS)[0]) == bucket)
            met = sorted({c for _, c in own})
            totals = pitman_yor.Totals(
                np.array([customers[c] for c in met], float), np.array([before[c] for c in met], float), root, len(of_word),
                *discounts, all_tables=whole,
            )
            if own:
                head, sat, parent, root_sat = pitman_yor._sampled(
                    np.array([w for w, _ in own], np.uint64), np.array([met.index(c) for _, c in own]),
                    np.array([cells[b] for b in own]), totals, sweeps, keep, seed + bucket,
                )
                seats |= dict(zip(own, sat))
                parents |= dict(zip([own[k][0] for k in head], parent))
                roots += root_sat
        if seed == 1:
            tables = Counter()
            for (_, c), n in seats.items():
                tables[c] += n
            root = roots
    unknown = float(totals.parent(0.0, 0.0))

    def log_p(w, c):
        cell = cells[w, c] - discounts[0] * seats[w, c] if (w, c) in cells else 0.0
        return math.log10((cell + (1 + discounts[0] * before.get(c, 0)) * parents.get(w, unknown)) / (1 + customers[c]))

    expected = sorted((d, sum(log_p(*b) for b in bigrams(own))) for d, own in texts)
    got = sorted((key(r["doc_id"]), r["score"]) for r in found)
    assert [d for d, _ in got] == [d for d, _ in expected]
    assert [s for _, s in got] == pytest.approx([s for _, s in expected], rel=1e-9)


def test_model_beats_single_tokens(make_docs, words):
    """Texts that follow a pattern of neighbours; held-out texts follow it too."""
    r = np.random.default_rng(6)
    vocabulary = sorted(set(words(1, 60)))
    follows = {w: r.choice(vocabulary, 3) for w in vocabulary}

    def text():
        own = [str(r.choice(vocabulary))]
        for _ in range(40):
            own.append(str(r.choice(follows[own[-1]])))
        return " ".join(own)

    found = pitman_yor.scored(make_docs([(k, text()) for k in range(200)])).filter("held_out").agg(
        F.sum("score").alias("model"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")
    ).first()
    assert found["model"] > found["base"] + 0.3 * found["n"]


def test_probabilities_of_a_context_sum_to_one():
    r = np.random.default_rng(3)
    words = np.repeat(np.arange(1, 31).astype(np.uint64), 2)
    contexts = np.tile(np.array([5, 9], np.uint16), 30)
    counts = r.integers(1, 200, 60)
    totals = pitman_yor.Totals(
        np.bincount(contexts, weights=counts, minlength=pitman_yor.CONTEXTS),
        np.bincount(contexts, minlength=pitman_yor.CONTEXTS).astype(float), 30.0, 30, 0.6, 0.5,
    )
    for _ in range(4):  # rounds bring the totals to what was sampled
        _, tables, parent, root = pitman_yor._sampled(words, contexts, counts, totals, 1, 1, 4)
        totals.tables = np.bincount(contexts, weights=tables, minlength=pitman_yor.CONTEXTS)
        totals.root_tables = root
    below = np.add.reduceat(tables, np.arange(0, 60, 2))
    root_each = np.ones(30)
    totals.root_tables = 30.0
    parent = totals.parent(below, root_each)
    unknown = totals.parent(0.0, 0.0)
    assert parent.sum() + unknown == pytest.approx(1)
    for k in (5, 9):
        fresh, whole = totals.fresh(np.array([k]))
        own = contexts == k
        known = (counts[own] - totals.discount * tables[own] + fresh * parent) / whole
        assert known.sum() + fresh * unknown / whole == pytest.approx(1)


def test_tables_lie_between_one_and_the_customers():
    r = np.random.default_rng(1)
    customers = np.array([1, 2, 5, 64, 65, 1000, 1_000_000])
    low = pitman_yor.seated(customers, np.full(7, 1e-9), 0.5, r)
    high = pitman_yor.seated(customers, np.full(7, 1e12), 0.5, r)
    assert (low == 1).all() and (high == customers).all()
