"""Hand-written pages: odd quoting, missing tags, hidden markup and character references."""

from textindex.functions import html as H
from textindex.functions import urls as U

# Html and the visible text and links expected of it.
PAGES = [
    ("<body><p>caf&eacute; &#233;&#xE9;&#x41; &amp;lt; &nosuch; &#150;&#0;&#x110000;</p>",
     "café ééA &lt; &nosuch; –\ufffd\ufffd", []),
    ("<html><head><title>T</title></head>no body <b>tag</b></html>", "no body tag", []),
    ("<body><script>var s='</body>';</script><p>kept?</p></body>", "kept?", []),
    ("<body>a<!-- <script> -->b<script>x", "a b", []),
    ("<body><a href='/q'>1</a> <a class=x href=/bare>2</a> <A HREF=\"/d&eacute;f\">3</a><!-- <a href=/no> -->",
     "1 2 3", ["/q", "/bare", "/déf"]),
    ("<ul><li>a</li><li>b</li></ul><noscript><a href=/n>n</a></noscript>", "a b", []),
    ('<body><a title="a>b" href="/z">link</a> <img alt=\'<a href="/no">\' src=x>', "link", ["/z"]),
    ("<body><p title=don't>it</p><p>isn't</p>", "it isn't", []),
    ("<body><textarea><a href=/in>t&amp;</a></textarea><iframe><a href=/f>f</a></iframe>",
     "<a href=/in>t&</a><a href=/f>f</a>", []),
    ("<body>&copy 2020 caf&eacute; caf&eacute &copy2020 &notit; &#233 &amp&lt <b>&am</b>p;",
     "© 2020 café café ©2020 ¬it; é &< &amp;", []),
    ('<body><a href="?a=1&copy=2&lt;&reg">x</a><a name=n>y</a><a href>z</a><a data-href=/n href = "/s" href=/t>w</a>',
     "xyzw", ["?a=1&copy=2<®", "", "/s"]),
    ("<!doctype html><!-- <body> --><html><head><meta a='>'><script>if (a<b) '<p>'</script></head>\n <p>in</p> x",
     "in x", []),
    ("plain <b>text</b> 1 < 2 </ x> <", "plain text 1 < 2 <", []),
    ("<head><title>T</title>\n early <body>late", "early late", []),
    ('<body>a<p class="never closed>b</p>', "a", []),
    ("<svg><title>icon</title></svg><TITLE>u</TITLE>end", "iconuend", []),
    ("", "", []),
    (None, None, None),
]
# Html and the title expected of it.
TITLES = [
    ("<!-- <title>old</title> --><title>new</title>", "new"),
    ("<script>var t='<title>js</title>';</script><title lang='a>b'> x &amp\ty </title>", "x &\ty"),
    ("<title>not <b>closed</b>", "not <b>closed</b>"), ("<p>none</p>", ""), ("<TITLE>a</title><title>b</title>", "a"),
    ("<textarea><title>t</title></textarea>", ""), ("", ""), (None, None),
]


def test_titles(spark):
    df = spark.createDataFrame([(h,) for h, _ in TITLES], "html string")
    assert [r.t for r in df.select(H.html_title("html").alias("t")).collect()] == [t for _, t in TITLES]


def test_large_pages(spark):
    """Pages whose tags, scripts, comments and texts are long need no deep recursion."""
    many = "<p a='>' b=\"<\">w</p>" * 50_000
    long = "<body><!--" + "-" * 3_000_000 + "--><script>" + "<" * 3_000_000 + "</script><i t='" + "x" * 3_000_000 + "'>end"
    wide = "<body><a " + "x='>' " * 2_000 + "href=/w>wide"
    df = spark.createDataFrame([(many,), (long,), (wide,)], "html string")
    got = [(len(r.t), r.l) for r in df.select(H.visible_text("html").alias("t"), H.hrefs("html").alias("l")).collect()]
    assert got == [(99_999, []), (3, []), (4, ["/w"])]




def test_text_and_links(spark):
    df = spark.createDataFrame([(h,) for h, _, _ in PAGES], "html string")
    got = [(r.t, r.l) for r in df.select(H.visible_text("html").alias("t"), H.hrefs("html").alias("l")).collect()]
    assert got == [(t, l) for _, t, l in PAGES]


# References on a page of https://h.example.com/a/b, whether they
# parse, and where they lead.
REFERENCES = [
    ("%zz", False, None), (":foo", False, None), ("1a:b", False, None),
    ("http://h:bad port/", False, "http://h:bad port/"), ("http://h.x/%zz", False, "http://h.x/%zz"),
    ("/ok é", True, "https://h.example.com/ok%20%C3%A9"), ("/a%41", True, "https://h.example.com/a%41"),
    ("p/q r#fr ag", True, "https://h.example.com/a/p/q%20r#fr%20ag"),
    ("//cdn.x/é?q=é", True, "https://cdn.x/%C3%A9?q=é"), ("?x=%zz", True, "https://h.example.com/a/b?x=%zz"),
]


def test_references_that_do_not_parse(spark):
    df = spark.createDataFrame([("https://h.example.com/a/b", r) for r, _, _ in REFERENCES],
                               "base string, ref string")
    got = [(r.v, r.u) for r in df.select(U.is_valid("ref").alias("v"), U.resolve("base", "ref").alias("u")).collect()]
    assert got == [(v, u) for _, v, u in REFERENCES]
