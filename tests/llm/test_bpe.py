"""Byte-level BPE against the tokenizers library."""
import hashlib
import random
import string

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from promptloom.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids array<int>, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(11)
    alphabets = ["abcdefgh", "aab", string.printable, "éüßñ ", "中文😀ि‍", " \t\n", "-=_ ", "etaoinshrdlu", "0123456789 ,."]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 2, 3, 7, 40, 300)]
    texts += ["", None, "a" * 50_000, " " * 5_001, "".join(rng.choice("etaoinshrdlu") for _ in range(60_000)), "it's we'll I'd", "a<|endoftext|>b <|endoftext|><|endoftext|>",
              "<|endoftext|", "　x y\x85z", "\x00\x01", "ΑΒΓ ١٢٣ ⅷ x²"]
    return texts


def test_merge_rounds(library):
    """Words of any length give the ids of merging one lowest pair after the other."""
    table, letters = bpe.Table(bpe.read_table(PATH)), bpe.byte_letters()
    pieces = [p for t in odd_texts() if t for p, _ in library.pre_tokenizer.pre_tokenize_str(t)]
    ids, bounds = bpe.merge_words(table, [bytes(letters[c] for c in p) for p in pieces])
    for k, piece in enumerate(pieces):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == [t.id for t in library.model.tokenize(piece)]
    ids, bounds = bpe.merge_words(table, [b"", b"a", b""])
    assert bounds.tolist() == [0, 0, 1, 1] and len(ids) == 1
    assert bpe.merge_words(table, [])[1].tolist() == [0]


def test_small_blocks():
    """Places far apart in one word merge in one round, with the same ids."""
    table = bpe.Table(bpe.read_table(PATH))
    word = b"".join(random.Random(4).choice([b"the", b"ing", b"x", b"aa", b" "]) for _ in range(3_000))
    want, _ = bpe.merge_words(table, [word])
    table.block = len(word)
    assert np.array_equal(bpe.merge_words(table, [word])[0], want)


def test_round_trip(spark, library):
    """Nulls, empty, very long and repeated rows, strings of special tokens and clashing columns."""
    texts = odd_texts()
    rows = [(i, t, [1], "x") for i, t in enumerate(texts)] + [(None, "no id", None, None), (3, texts[3], [1], "x")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    encoded = bpe.encode(docs, PATH, keep=["doc_id", "n_tokens"], decoded=True)
    assert all(r.decoded == ("no id" if r.doc_id is None else texts[r.doc_id] or "") for r in encoded.collect())
    out = bpe.decode(encoded, PATH, keep=["doc_id", "ids"]).collect()
    assert len(out) == len(rows)
    for row in out:
        text = "no id" if row.doc_id is None else texts[row.doc_id] or ""
        assert row.ids == library.encode(text, add_special_tokens=False).ids
        assert row.text == library.decode(row.ids, skip_special_tokens=False) == text
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH, keep=["doc_id", "ids"]).count() == 0


def test_decode_of_any_ids(spark, library):
    """Ids that do not make UTF-8, unknown and null ids and null lists."""
    rng = random.Random(2)
    lists = [[rng.randrange(50_257) for _ in range(rng.randrange(30))] for _ in range(300)] + [[rng.randrange(256) for _ in range(20)] for _ in range(100)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "doc_id long, ids array<int>")
    for skip in (False, True):
        got = {r.doc_id: r.text for r in bpe.decode(df, PATH, skip_special_tokens=skip).collect()}
        assert got == {i: library.decode(v, skip_special_tokens=skip) for i, v in enumerate(lists)}
    odd = spark.createDataFrame([(1, None), (2, [None, 64, 99_999, -5])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, PATH).collect()} == {1: "", 2: library.decode([64])}


def test_cache_limits(spark, monkeypatch):
    """A worker that keeps forgetting its words gives the same ids."""
    table = bpe.Table(bpe.read_table(PATH))
    words = bpe.Words(table)
    first = [words.number(w) for w in ("a", " the", "a")]
    words.settle()
    assert first == [0, 1, 0] and len(words.bounds) == 3 and not words.full()
    monkeypatch.setattr(bpe, "CACHE_WORDS", 1)
    assert words.full()
    words.clear()
    assert words.number(" the") == 0


def test_other_tables_are_refused(tmp_path):
    spec = '{"normalizer": null, "pre_tokenizer": null, "added_tokens": [], "model": {"type": "WordPiece", "vocab": {}}}'
    (tmp_path / "t.json").write_text(spec)
    with pytest.raises(ValueError, match="not a plain byte-level"):
        bpe.read_table(str(tmp_path / "t.json"))


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op11_bpe_round_trip"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "", add_special_tokens=False).ids
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
