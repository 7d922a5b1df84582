import hashlib
import random
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from posevidence.llm import sentencepiece_bpe, token_files
from posevidence.llm.common import portions
from posevidence.llm.queries import tokenizer_file

MODEL = tokenizer_file("piece_bpe_32k.model")
WORDS = tokenizer_file("word_bpe_49k.json")

ODD = ["", " ", "  two  gaps ", "\n\n", "tab\tand\rreturn", "é́漢😀\x00a", "▁mark▁", "a" * 300, " " * 40, "!!..,,;;a.b,c",
       "<s> </s> <unk> <0x0A>", "it's I'LL", "<|endoftext|> x", "ΑΣ ΣΑΣ", "x\x1cy", "no break", "１２ ½"]


def odd_texts(n=400):
    r = random.Random(5)
    letters = list("abcdefgh  \n\té漢😀▁.,1ñß!#'")
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 50))) for _ in range(n)]


def test_pieces_equal_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = sentencepiece_bpe.table(MODEL)
    decoder = sentencepiece_bpe.Decoder(own)
    for text in odd_texts():
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text)
        assert decoder.decode(ids) == library.decode(ids.tolist())


@pytest.mark.parametrize("ids", [[], [0], [1, 2], [300, 2, 300], [3 + 0xE4], [3 + 0xE4, 3 + 0xBD, 3 + 0xA0, 3 + 0xFF], [259, 259]])
def test_decoding_of_any_ids(ids):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    decoder = sentencepiece_bpe.Decoder(sentencepiece_bpe.table(MODEL))
    assert decoder.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_every_prefix_has_the_last_piece_of_its_encoding():
    own = sentencepiece_bpe.table(MODEL)
    for segment in ("▁internationalisation", "▁aaaaaaa", "xyz"):
        last = own.last_pieces(segment)
        for k in range(1, len(segment) + 1):
            assert last[k] == own.merged(segment[:k])[-1]


def test_the_cache_forgets_and_encodes_the_same(monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(sentencepiece_bpe, "CACHE", 16)
    monkeypatch.setattr(sentencepiece_bpe, "PAIR_CACHE", 16)
    own = sentencepiece_bpe.PrefixTable(MODEL)
    for text in odd_texts():
        assert own.encode("often " + text).tolist() == library.encode("often " + text)
        for cache in (own.word_ids, own.compatible):
            assert len(cache) + len(cache.before) <= 16
    made = []
    cache = sentencepiece_bpe._Cache(lambda key: made.append(key) or key, 16)
    for k in range(100):
        assert cache["often"] == "often" and cache[str(k)] == str(k)
    assert made.count("often") == 1


def test_another_operator_in_the_process_ends_the_table():
    own = weakref.ref(sentencepiece_bpe.table(MODEL))
    assert sentencepiece_bpe.table(MODEL) is own()
    batch = pa.record_batch([pa.array(["a text"])], ["text"])
    assert list(portions([batch], "text")) == [batch]
    assert own() is None


def test_encoded_and_decoded_columns(make_docs, hard_rows):
    docs = make_docs(hard_rows)
    found = sentencepiece_bpe.decoded(sentencepiece_bpe.encoded(docs, MODEL), MODEL).collect()
    assert len(found) == len(hard_rows)
    for row in found:
        assert row["decoded"] == (row["text"] or "")
        assert (len(row["ids"]) == 0) == (not row["text"])
    assert sentencepiece_bpe.encoded(docs.limit(0), MODEL).count() == 0


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    own = token_files._tokenizer(WORDS)
    texts = odd_texts()
    for text, found in zip(texts, own.encode(texts)):
        assert np.frombuffer(found, own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_of_letters_and_signs_are_cut_as_the_library_cuts_them():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    own = token_files.WordTokenizer(WORDS)
    texts = ["Straße,Straße!! İstanbul, İ. ŉ ſ; Kelvin", "Å, é.", "don't. DON'T'", None, "", "a-b a- -b --", "Zoo, " * 3000]
    for _ in range(2):  # the second time from the cache
        for text, found in zip(texts, own.encode(texts)):
            assert np.frombuffer(found, own.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_words_in_use_outlast_a_full_cache(monkeypatch):
    """A word of every portion is encoded once, however many others pass by."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "PART_CACHE", 40)
    library, own = Tokenizer.from_file(WORDS), token_files.WordTokenizer(WORDS)
    learn, learned = own._learn, []
    monkeypatch.setattr(own, "_learn", lambda new: (learned.extend(new), learn(new)))
    for k in range(12):
        texts = [f"often seen, {'l' * 60} " + " ".join("abcdefghij"[k % 7] * (n + 1) for n in range(9)) + f" p{'q' * k}", None]
        found = own.encode(texts)
        assert np.frombuffer(found[0], own.dtype).tolist() == library.encode(texts[0], add_special_tokens=False).ids
        assert found[1] == b"" and len(own.parts) + len(own.older) <= 40 + 2 * 16
    assert learned.count("often") == 1 and learned.count("seen") == 1
    assert learned.count("l" * 60) == 12


def test_packed_values_come_back():
    r = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (r.integers(0, 1 << 32, n, dtype=np.uint64) >> r.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(values), n) == values).all()
    control, data = token_files.pack(np.array([0, 255, 256, 65536, 1 << 24]))
    assert len(control) == 2 and len(data) == 1 + 1 + 2 + 3 + 4


def test_files_hold_all_ids_in_order(spark, make_docs, hard_rows, shared_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    folder = f"file://{shared_dir}/files"
    token_files.write_ids(make_docs(hard_rows).repartition(3), folder, WORDS, end_id=2)
    found = token_files.read_ids(spark, folder).withColumn("crc", token_files.ids_crc32(F.col("ids"))).collect()
    sums = token_files.read_checksums(spark, folder).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["start"], len(r["ids"]), r["crc"]) for r in found) == sorted(
        (r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["n_tokens"], r["ids_crc32"]) for r in sums
    )
    found.sort(key=lambda r: r["start"])
    order = sorted(hard_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for row, (d, text, *_) in zip(found, order, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row["doc_id"], row["start"], row["ids"]) == (d, start, ids)
        assert row["crc"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    ranks = spark.read.parquet(f"{folder}/ranks").count()
    assert ranks == len({i for r in found for i in r["ids"]})


def test_files_of_an_empty_table(spark, make_docs, shared_dir):
    folder = f"file://{shared_dir}/none"
    token_files.write_ids(make_docs([]), folder, WORDS, end_id=2)
    assert token_files.read_ids(spark, folder).count() == 0
    assert token_files.read_checksums(spark, folder).count() == 0


def test_digests_of_the_query(spark):
    import sentencepiece

    from posevidence.llm.queries import QUERIES

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for row in QUERIES["op1_sentencepiece"](spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[row["doc_id"]] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
