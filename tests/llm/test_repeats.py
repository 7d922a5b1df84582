import random
import re
import time
from pathlib import Path

import numpy as np
import pytest

from posevidence.llm import ngram_join, recompression, repeats, suffix_dedup
from posevidence.llm.common import stored
from posevidence.llm.components import components
from tests_llm_reference import bytes_removed, linked, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_removed(rows, length):
    first, out = {}, {}
    for d, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        found = WORD.findall(text or "")
        gone = np.zeros(len(found), bool)
        for k in range(len(found) - length + 1):
            if first.setdefault(tuple(found[k : k + length]), d) < d:
                gone[k : k + length] = True
        out[d] = found, gone
    return out


def with_many_contexts(words):
    """One passage in many documents, which differ next to it, and its copies."""
    passage = " ".join(words(50, 70))
    rows = [(100 + k, " ".join(words(60 + k, 12)) + " " + passage + " " + " ".join(words(90 + k, 9))) for k in range(24)]
    return rows + [(200 + k, passage * 2) for k in range(3)] + [(300, "ab" * 400), (301, "ab" * 300)]


@pytest.mark.parametrize("block", [4096, 5])
def test_bytes_against_brute_force(make_docs, hard_rows, words, block):
    rows = hard_rows + with_many_contexts(words)
    expected = bytes_removed(rows, 100)
    found = suffix_dedup.without_repeats(make_docs(rows).repartition(4), 100, block=block).collect()
    assert len(found) == len(rows)
    for row in found:
        if row["doc_id"] is None:
            assert row["n_removed"] == 0
            continue
        raw, gone = expected[row["doc_id"]]
        assert (row["n_bytes"], row["n_removed"]) == (len(raw), int(gone.sum()))
        assert bytes(row["kept"]) == np.frombuffer(raw, np.uint8)[~gone].tobytes()
        assert row["n_spans"] == int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())


def test_whole_characters_and_carried_columns(make_docs, hard_rows):
    found = suffix_dedup.without_repeats(
        make_docs(hard_rows), 100, whole_characters=True, carried=["lang", "kept"]
    )
    assert found.columns[-1] == "kept" or "lang" in found.columns
    for kept in [r[1] for r in found.collect()]:
        kept.decode("utf-8")


@pytest.mark.parametrize("block", [4096, 5])
def test_passages_against_brute_force(make_docs, hard_rows, words, block):
    rows = hard_rows + with_many_contexts(words)
    expected = words_removed(rows, 50)
    found = recompression.without_passages(make_docs(rows).repartition(4), 50, block=block).collect()
    assert len(found) == len(rows)
    for row in found:
        if row["doc_id"] is None:
            assert row["n_removed"] == 0
            continue
        own, gone = expected[row["doc_id"]]
        assert (row["n_words"], row["n_removed"]) == (len(own), int(gone.sum()))
        assert row["kept"] == " ".join(w for w, g in zip(own, gone) if not g)


def test_equal_passages_are_parsed_alike():
    r = np.random.default_rng(4)
    passage = r.integers(1, 40, 60).astype(np.uint64)
    passage[20:27] = passage[20]
    seen = []
    for k in range(200):
        before, after = (r.integers(1, 40, r.integers(0, 30)).astype(np.uint64) for _ in range(2))
        if k % 3 == 0 and len(before):
            before[-5:] = passage[0]
        names = np.concatenate([before, passage, after])
        first = recompression.highest_symbols(names, np.zeros(len(names), np.int64)) - len(before)
        seen.append(tuple(x for x in first.tolist() if recompression.EDGE <= x < len(passage) - recompression.EDGE))
    assert len(set(seen)) == 1 and seen[0]


def test_empty_tables(make_docs):
    none = make_docs([])
    assert suffix_dedup.without_repeats(none, 100).count() == 0
    assert recompression.without_passages(none, 50).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0


def chains(words):
    """Near copies in chains: neighbours link, the ends do not."""
    rows, text = [], words(70, 160)
    for k in range(14):
        rows.append((400 + (k * 5) % 14, " ".join(text)))
        text = text[3:] + words(700 + k, 3)
    # A common passage in otherwise different documents.
    common = words(71, 40)
    rows += [(430 + k, " ".join(words(800 + k, 60) + common + words(900 + k, 50))) for k in range(12)]
    # Copies with one word changed, of one text.
    base = words(72, 120)
    for k in range(12):
        own = list(base)
        own[k * 9] = "changed"
        rows.append((460 + k, " ".join(own)))
    return rows + [(480 + k, " ".join(words(73, 3 + k))) for k in range(12)]


@pytest.mark.parametrize("width,percent,block", [(3, 90, 512), (5, 80, 512), (3, 90, 3), (2, 60, 4)])
def test_join_against_brute_force(make_docs, hard_rows, words, width, percent, block):
    rows = hard_rows + chains(words)
    expected = linked(rows, width, percent)
    found = ngram_join.near_duplicates(make_docs(rows).repartition(3), width, percent, block=block).collect()
    assert len(found) == len(rows)
    sizes = {(d, len(shingles(t, width))) for d, t, *_ in rows}
    for row in found:
        assert (row["doc_id"], row["n_shingles"]) in sizes
        assert row["component_id"] == (None if row["doc_id"] is None else expected[row["doc_id"]])


def rows_written(monkeypatch):
    """How many rows each written table has, by its purpose."""
    written = {}

    def counted(df, purpose):
        found = stored(df, purpose)
        written.setdefault(purpose, []).append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "stored", counted)
    return written


def test_near_copies_that_do_not_link_are_not_listed_in_pairs(make_docs, words, monkeypatch):
    # Two copies differ in 16 of 142 shingles each, one too many for a link; the
    # first 20 have their last word from the one before, and link with it.
    base, rows = words(75, 146), []
    for k in range(100):
        own = list(base)
        own[20], own[60], own[100], own[145] = f"one{k}", f"two{k}", f"three{k}", f"end{k // 2 if k < 20 else k}"
        rows.append((1 + k, " ".join(own)))
    expected = linked(rows, 5, 80)
    assert len(set(expected.values())) == 90
    written = rows_written(monkeypatch)
    found = ngram_join.near_duplicates(make_docs(rows).repartition(3), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert sum(sum(n) for to, n in written.items() if to in ("open-pairs", "open-sets")) <= written["open-members"][0]


def test_near_copies_are_linked_from_the_text_they_were_made_from(make_docs, words, monkeypatch):
    base, rows, r = words(75, 146), [], random.Random(7)
    for k in range(60):
        own = list(base)
        for n, at in enumerate(r.sample(range(5, 140), 1 + k % 3)):
            own[at] = f"edit{k}x{n}"
        rows.append((1 + k, " ".join(own)))
    rows.append((900, " ".join(base)))
    expected = linked(rows, 5, 80)
    assert set(expected.values()) == {1}
    written = rows_written(monkeypatch)
    found = ngram_join.near_duplicates(make_docs(rows).repartition(3), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert written["open-groups"][0] == 0 and written["links"][0] < 4 * len(rows)


def test_unlike_texts_do_not_meet_for_what_most_have(make_docs, words, monkeypatch):
    # Parts without a shingle, and of one passage, are the same in many texts.
    passage = words(79, 12)
    rows = [(1 + k, " ".join(words(2000 + k, 60) + passage * (k % 2))) for k in range(300)]
    expected = linked(rows, 5, 80)
    written = rows_written(monkeypatch)
    found = ngram_join.near_duplicates(make_docs(rows).repartition(3), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert written["shared-parts"][0] > len(rows) and written["open-members"][0] < len(rows) // 10


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_of_a_block_join_what_pairs_join(spark, seed):
    """Sets of one block, some already of one component, and repeated blocks."""
    r = np.random.default_rng(seed)
    base = np.sort(r.choice(1 << 40, 120, replace=False)).astype(np.uint64)
    sets = [
        np.unique(np.r_[base[r.random(120) > 0.06], r.choice(1 << 40, 3).astype(np.uint64)]) for _ in range(40)
    ]
    component = [k if k % 5 else 0 for k in range(40)]
    rows = [(g, 0, k, component[k], sets[k].tobytes()) for g in (1, 2) for k in range(40)]
    schema = "group long, block int, whole long, component long, shingles binary"
    found = ngram_join.search_in_blocks(spark.createDataFrame(rows, schema).repartition(3), 80).collect()

    def joined(pairs):
        root = list(component)
        for a, b in pairs:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if x == old else x for x in root]
        return root

    every = [
        (a, b) for a in range(40) for b in range(a)
        if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
    ]
    assert joined([(f["a"], f["b"]) for f in found]) == joined(every)
    assert len(found) == 2 * (len(set(component)) - len(set(joined(every))))


def test_search_finds_what_counting_finds():
    r = np.random.default_rng(2)
    base = np.sort(r.choice(1 << 40, 300, replace=False)).astype(np.uint64)
    sets = []
    for k in range(60):
        own = base[r.random(300) > r.choice([0.02, 0.08, 0.3])]
        sets.append(np.unique(np.concatenate([own, r.choice(1 << 40, r.integers(0, 30)).astype(np.uint64)])))
    sets.append(np.zeros(0, np.uint64))
    index = ngram_join.Inverted(sets)
    for percent in (50, 80, 90, 100):
        for query in sets:
            expected = [
                k for k, s in enumerate(sets)
                if len(s) and len(query) and 100 * len(np.intersect1d(s, query)) >= percent * len(np.union1d(s, query))
            ]
            assert sorted(index.search(query, percent).tolist()) == expected


def test_linked_sets_share_a_part():
    r = np.random.default_rng(8)
    for percent in (80, 90):
        parts = ngram_join.Parts(percent)
        for size in (1, 5, 9, 12, 30, 200, 900):
            for _ in range(20):
                own = r.integers(1, 1 << 60, size, dtype=np.uint64)
                other = own.copy()
                change = r.integers(0, size // 8 + 1)
                other[:change] = r.integers(1, 1 << 60, change, dtype=np.uint64)
                other = other[: size - r.integers(0, size // 12 + 1)]
                both = len(np.intersect1d(own, other))
                if 100 * both < percent * (len(own) + len(other) - both):
                    continue
                names, at = parts.names(np.concatenate([own, other]), np.array([0, len(own), len(own) + len(other)]))
                assert len(np.intersect1d(names[at[0] : at[1]], names[at[1] : at[2]]))


def test_linked_sets_share_more_parts_than_they_can_do_without():
    r = np.random.default_rng(8)
    for percent in (60, 80, 90):
        parts = ngram_join.Parts(percent)
        for size in (5, 9, 12, 30, 200, 900):
            own = r.integers(1, 1 << 60, size, dtype=np.uint64)
            # As many shingles changed as a link bears.
            other = np.r_[own[: -(-2 * percent * size // (100 + percent))], own[:0]]
            other = np.r_[other, r.integers(1, 1 << 60, size - len(other), dtype=np.uint64)]
            both = len(np.intersect1d(own, other))
            assert 100 * both >= percent * (2 * size - both)
            names, at = parts.names(np.r_[own, other], np.array([0, size, 2 * size]))
            shared = np.intersect1d(names[at[0] : at[1]], names[at[1] : at[2]])
            for odd in {int(n & np.uint64(1)) for n in names}:
                assert (shared & np.uint64(1) == odd).sum() > parts.spares(np.array([size]), np.array([odd]))[0]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (3, 1), (20, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7}
    assert components(edges.limit(0)).count() == 0


def test_components_of_long_paths_settle(spark):
    order = list(range(90))
    random.Random(2).shuffle(order)
    edges = list(zip(order, order[1:60])) + list(zip(order[60:], order[61:])) + [(order[3], order[3])]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    least = {n: min(order[:60]) for n in order[:60]} | {n: min(order[60:]) for n in order[60:]}
    assert {r["node"]: r["component"] for r in found.collect()} == least
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_contexts_make_two_rows_a_round(spark, make_docs, words):
    """Not one for each of their windows; copies of a half go after its first."""
    windows = repeats.Windows(100, 69, 32, "place", suffix_dedup._byte_units, "u1")
    passage = " ".join(words(50, 70)).encode()[:100]
    left = [" ".join(words(60 + k, 20)).encode()[-34:] for k in range(8)]
    # The gram stands at 68 of a context; right of it all have the same bytes.
    contexts = [(7, k, 0, 168, left[k] + passage + passage[:34], 0, 68) for k in range(8)]
    schema = f"{repeats.CONTEXT_SCHEMA}, lo int, hi int"
    halves = spark.createDataFrame([(*c[:4], bytearray(c[4]), *c[5:]) for c in contexts], schema).mapInArrow(
        repeats._halves(windows), f"near long, whole long, {repeats._HALF_SCHEMA}"
    )
    rows = halves.collect()
    assert sorted((r["lo"], r["hi"]) for r in rows) == [(0, 34)] * 8 + [(35, 68)] * 8
    assert len({r["near"] for r in rows}) == 2
    assert len({r["whole"] for r in rows if r["lo"] == 35}) == 1
    found = repeats.settled_and_open(halves, windows).collect()
    assert sorted(r["doc_id"] for r in found if r["lo"] == 35) == list(range(1, 8))
    assert all(r["settled"] == (r["lo"] == 35) for r in found)
    spans = repeats.compared(spark.createDataFrame([(*c[:4], bytearray(c[4])) for c in contexts], repeats.CONTEXT_SCHEMA), windows, 3)
    covered = {d: set() for d in range(8)}
    for r in spans.collect():
        covered[r["doc_id"]] |= set(range(r["first"], r["last"]))
    assert covered[0] == set() and all(covered[d] >= set(range(34, 168)) for d in range(1, 8))


def test_nothing_shuffled_stays_once_written(spark):
    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for f in folders for p in Path(f.getPath()).rglob("shuffle_*.data")}

    before = files()
    rows = stored(spark.range(0, 100_000, 1, 4).repartition("id").groupBy("id").count(), "written")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert rows.count() == 100_000
