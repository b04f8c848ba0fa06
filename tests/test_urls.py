"""URL resolution and parts on an inline href fixture."""

from pyspark.sql import functions as F

from textindex.functions import urls as U

BASE = "https://h.example.com/a/b/c?x=1#top"
CASES = [
    ("https://other.org/p", "https://other.org/p"),
    ("httpfoo", "httpfoo"),
    ("mailto:me@h.example.com", "mailto:me@h.example.com"),
    ("//cdn.example.com/p", "https://cdn.example.com/p"),
    ("/p", "https://h.example.com/p"),
    ("p/q", "https://h.example.com/a/b/p/q"),
    ("../p", "https://h.example.com/a/p"),
    ("./p", "https://h.example.com/a/b/p"),
    ("../../../../p", "https://h.example.com/p"),
    ("/a/b/../c", "https://h.example.com/a/c"),
    ("/a/b/..", "https://h.example.com/a/"),
    ("?q=2", "https://h.example.com/a/b/c?q=2"),
    ("#f", "https://h.example.com/a/b/c?x=1#f"),
    ("", "https://h.example.com/a/b/c?x=1"),
    ("/p?y=2#z", "https://h.example.com/p?y=2#z"),
]


def test_resolve(spark):
    df = spark.createDataFrame([(BASE, h) for h, _ in CASES], "base string, href string")
    got = [r.link for r in df.select(U.resolve("base", "href").alias("link")).collect()]
    assert got == [e for _, e in CASES]


def test_parts_and_encoding(spark):
    df = spark.createDataFrame([("https://user@Host.example.com:8080/èê ñ?a=1#f",)], "url string")
    r = df.select(U.hostname("url").alias("h"), U.path("url").alias("p"),
                  U.robots_path("url").alias("rp"),
                  U.encode_non_ascii(F.col("url")).alias("e")).first()
    assert r.h == "Host.example.com"
    assert r.p == "/èê ñ"
    assert r.rp == "/èê ñ?a=1"
    assert r.e == "https://user@Host.example.com:8080/%C3%A8%C3%AA%20%C3%B1?a=1#f"
