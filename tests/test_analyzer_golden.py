"""Analyzer cases with expected terms, and stems published with the algorithms."""

import pytest
from pyspark.sql import functions as F

from textindex.functions.stopwords import stopwords
from textindex.operators.analyze import analyze, query_term_counts
from textindex.operators.stemming import stem_words

# Texts and the terms expected of them.
CASES = [
    ("spanish", stopwords("spanish"), "Este es un TEXTO de prueba, ¡genial!", ["text", "prueb", "genial"]),
    ("english", [], "A simple text with running words to test.",
     ["a", "simpl", "text", "with", "run", "word", "to", "test"]),
    ("english", stopwords("english"), "It is a she or he", []),
    ("english", stopwords("english"), "123.45, -¡!@#$%^&*()_+", []),
    ("english", stopwords("english"), "running runner runs", ["run", "runner", "run"]),
    ("spanish", stopwords("spanish"), "corriendo corredores corren", ["corr", "corredor", "corr"]),
]


@pytest.mark.parametrize("language,words,text,expected", CASES)
def test_analysis(spark, language, words, text, expected):
    df = spark.createDataFrame([(0, text)], "doc_id int, text string")
    got = analyze(df, language=language, stopword_list=list(words), stem=True).orderBy("pos").collect()
    assert [r["term"] for r in got] == expected
    counts = query_term_counts(spark, text, language, list(words), stem=True)
    assert counts == {t: expected.count(t) for t in expected}


# Words and stems from the algorithms' published vocabularies.
STEMS = {
    "english": {"consign": "consign", "consigned": "consign", "consistency": "consist", "knightly": "knight",
                "knots": "knot", "skies": "sky", "generously": "generous", "generate": "generat",
                "hopping": "hop", "hoping": "hope", "say": "say", "cry": "cri", "by": "by", "agreed": "agre",
                "relational": "relat", "hopefulness": "hope", "adjustment": "adjust", "controll": "control",
                "succeeding": "succeed", "yes": "yes", "is": "is"},
    "spanish": {"chicas": "chic", "chicharrones": "chicharron", "torneado": "torn", "torneos": "torne",
                "tormenta": "torment", "rápidamente": "rapid", "comiéndolo": "com", "averigüe": "averigü"},
}


def test_published_stems(spark):
    rows = [(language, word) for language, words in STEMS.items() for word in words]
    df = spark.createDataFrame(rows, "language string, term string")
    got = {(r["language"], r["term"]): r["stem"] for r in stem_words(df).collect()}
    assert got == {(language, w): stem for language, words in STEMS.items() for w, stem in words.items()}


def test_tokenizer_is_ascii_only(spark):
    assert query_term_counts(spark, "Aquí aren't x-y", "english", []) == dict.fromkeys(
        ["aqu", "aren", "t", "x", "y"], 1)


def test_positions_follow_filtered_stream(spark):
    df = spark.createDataFrame([(1, "the cat and the hat")], "doc_id long, text string")
    rows = analyze(df, "text", ("doc_id",)).orderBy("pos").collect()
    assert [(r.pos, r.term) for r in rows] == [(0, "cat"), (1, "hat")]


def test_unreachable_stopwords():
    en = [w for w in stopwords("english") if not w.isascii() or not w.isalpha()]
    es = [w for w in stopwords("spanish") if not w.isascii() or not w.isalpha()]
    assert len(stopwords("english")) == 175 and len(en) == 50
    assert len(stopwords("spanish")) == 237 and len(es) == 56
