"""Operator 11 against the library, on texts that are hard to cut and merge."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from textindex.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(PATH)


def hard_texts(library):
    rng = random.Random(3)
    vocabulary = [library.id_to_piece(i) for i in range(259, 32000)]
    signs = "abcdeéè ▁  \n\tthing.,;:!<>012日本①ß"
    texts = ["", " ", "a", " a  b ", "▁x", "\0a", "<s></s><unk><0x0A>", "x" * 3000, "a" + " " * 33 + "b" + " " * 32,
             " " * 100_000 + "w", "abc" * 40_000, "日本語①②\U0001F600 fin" * 20]
    for n in range(80):
        texts += [" " * n, "a" + " " * n + "the", "▁" * n + "\n"]
    for _ in range(500):
        texts.append("".join(rng.choice(signs) for _ in range(rng.randint(0, 60))))
        texts.append("".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 20))).replace(
            "▁", rng.choice([" ", "", "▁"])))
        texts.append("".join(chr(rng.choice([rng.randint(1, 127), rng.randint(128, 0x2FFF), rng.randint(
            0x10000, 0x1FFFF)])) for _ in range(40)))
    return texts


def test_encodes_as_the_library(library, model):
    texts = hard_texts(library)
    assert model.space_run == 16
    assert model.encode(pa.array(texts)).to_pylist() == [library.encode(t) for t in texts]


def test_slices_do_not_matter(library, model, monkeypatch):
    texts = hard_texts(library)[:12] + ["one two three " * 50]
    monkeypatch.setattr(pieces, "SLICE_BYTES", 64)
    coded = model.encode(pa.array(texts))
    assert coded.to_pylist() == [library.encode(t) for t in texts]
    assert model.decode(coded, model.surfaces()).to_pylist() == [library.decode(library.encode(t)) for t in texts]


def test_decodes_as_the_library(library, model):
    rng = random.Random(4)
    lists = [[rng.randrange(top) for _ in range(rng.randint(0, 30))] for top in (32000, 400) for _ in range(1500)]
    got = model.decode(pa.array(lists, pa.list_(pa.int32())), model.surfaces()).to_pylist()
    assert got == [library.decode(x) for x in lists]


def test_one_merge_at_a_time_for_equal_and_better_ranks():
    """A toy vocabulary whose longer pieces are merged before shorter ones."""
    names = ["<unk>"] + [f"<0x{b:02X}>" for b in range(256)] + ["▁", "a", "b", "ab", "aba", "ba", "bab"]
    kinds = [2] + [6] * 256 + [1] * 7
    scores = [0.0] * 257 + [-9.0, -9.0, -9.0, -3.0, -1.0, -3.0, -2.0]
    toy = pieces.PieceModel.build(names, scores, kinds)
    ids = {n: i for i, n in enumerate(names)}

    def one_by_one(text):
        word = ["▁", *text.replace(" ", "▁")]
        while True:
            ranked = [(-scores[ids[a + b]], i) for i, (a, b) in enumerate(zip(word, word[1:])) if a + b in ids]
            if not ranked:
                return [ids[w] for w in word]
            _, i = min(ranked)
            word[i:i + 2] = [word[i] + word[i + 1]]

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    assert toy.encode(pa.array(texts)).to_pylist() == [one_by_one(t) for t in texts]


def test_columns(spark, library, model):
    rows = [(1, "one two", "x", 5), (None, None, None, None), (1, "", "y", 6), (3, "word " * 200_000, "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int")
    got = pieces.decode(pieces.encode(df, model), model).collect()
    assert [(r.doc_id, r.lang, r.n_tokens) for r in got] == [(r[0], r[2], r[3]) for r in rows]
    assert [r.decoded for r in got] == [None if r[1] is None else r[1] for r in rows]
    assert [r.ids for r in got] == [None if r[1] is None else library.encode(r[1]) for r in rows]
    none = pieces.decode(pieces.encode(df.limit(0), model), model)
    assert none.collect() == [] and none.columns[-2:] == ["ids", "decoded"]


def test_query(spark, library, tmp_dir):
    rows = [(i, t) for i, t in enumerate(hard_texts(library)[:60])] + [(60, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    got = {r.doc_id: r for r in pieces.op11_sentence_pieces(spark, tmp_dir).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        ids = library.encode(text or "")
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query_on_given_table(spark, library):
    got = pieces.op11_sentence_pieces(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, len(library.encode(d.text or ""))) for d in docs}
    assert {(r.doc_id, r.n_tokens) for r in got.select("doc_id", F.col("n_tokens")).collect()} == want
