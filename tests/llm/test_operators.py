"""Operators against brute force on small tables with nulls, ties, repeated rows,
long texts, empty tables and columns of clashing names."""

import base64
import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from textindex.llm import (chat, decontaminate, fingerprints, jaccard, language, linededup, mixing,
                           secrets, substrings, warc)
from textindex.llm.common import block_of

WORDS = "the of and lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def make_texts():
    rng = random.Random(11)
    passage = sentence(rng, 60)
    base = sentence(rng, 120)
    texts = [None, "", " \t\n ", "short", "one two three", base, base, base.upper()]
    for _ in range(6):                      # near copies, each with one word changed
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [sentence(rng, 30) + ".\n" + passage + ". " + sentence(rng, 20) for _ in range(4)]
    texts += ["shared line of words\n" * 3 + sentence(rng, 9) for _ in range(3)]
    texts += ["  SHARED line OF words \nÉtroite ligne\n\nétroite ligne", "a" * 9 + "\n" + "a" * 9]
    texts += [sentence(rng, 4000), "x" * 50_000, "é" * 300 + " \U0001F600 fin"]
    return texts


TEXTS = make_texts()
ROWS = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, -1, "x", 2.0, 3, "y")
        for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "en", "s0", -1, "x", 2.0, 3, "y")]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, lang_pred string, "
          "score double, block long, kept string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows, n=len(ROWS)):
    assert len(rows) == n
    return {r["doc_id"]: r for r in rows}


# -- 1 ---------------------------------------------------------------------

def brute_units(rows, least=3):
    """Places to remove: every unit of a text that an earlier place holds."""
    def spoken(text):
        return " ".join(re.findall(r"[^\W_]+", text.lower()))

    def size(text):
        return len(spoken(text).split())

    seen, gone = {}, collections.defaultdict(list)
    for doc, text in sorted({(r[0], r[1] or "") for r in rows}):
        found = set()
        for line in re.finditer(r"[^\n]+", text):
            cuts = [(m.start() + line.start(), m.end() + line.start())
                    for m in re.finditer(r"[^.!?]+[.!?]*", line[0]) if size(m[0])]
            if size(line[0]) >= least:
                found.add(line.span())
            heads = [i for i, (a, b) in enumerate(cuts) if size(text[a:b]) >= 5]
            inner = {cuts[i] for i in heads}
            for i, after in zip(heads, heads[1:] + [len(cuts)]):
                inner.add((cuts[0 if i == heads[0] else i][0], cuts[after - 1][1]))
            found |= {(a, b) for a, b in inner if size(text[a:b]) < size(line[0])}
        for a, b in sorted(found):
            if seen.setdefault(spoken(text[a:b]), (doc, a)) != (doc, a):
                gone[doc].append((a, b))
        gone[doc] = [(a, b) for a, b in gone[doc]
                     if not any(c <= a and b <= d and (a, b) != (c, d) for c, d in gone[doc])]
    return gone


def test_substrings(docs, empty):
    got = by_id(substrings.remove_repeats(docs).collect())
    gone = brute_units(ROWS)
    assert gone
    for doc, text in enumerate(TEXTS):
        text = text or ""
        assert got[doc]["removed"] == ",".join(f"{a}:{b}" for a, b in gone[doc])
        left = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in gone[doc]))
        assert got[doc]["text"] == left and got[doc]["removed_chars"] == len(text) - len(left)
    assert substrings.remove_repeats(empty).collect() == []


def test_substrings_of_rows_that_share_an_id(spark):
    texts = ["alpha beta gamma delta epsilon. one two three four five six.",
             "one two three four five six. zulu yankee xray whiskey victor uniform."]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    got = substrings.remove_repeats(df).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 1]
    assert all(sum(part in r["text"] for r in got) == 1
               for part in ("alpha beta gamma", "one two three four five six", "zulu yankee"))


def test_substrings_leave_no_repeated_passage(spark):
    rng = random.Random(5)
    short = ["Yes.", "So it is!", "Why not?"]
    passage = " ".join(f"{sentence(rng, 9)}. {rng.choice(short)} {rng.choice(short)}" for _ in range(8))
    lines = "\n".join(f"{sentence(rng, 3)}" for _ in range(20))
    texts = []
    for i in range(12):
        own = [sentence(rng, 12) for _ in range(4)]
        texts.append(f"{own[0]}. {passage} {own[1]}.\n{lines if i % 2 else own[2]}\n{own[3]}")
    texts += [None, "", texts[3], "x. x x x x x. x. x x x x x x x", "yes\nyes\nso be it\nso be it"]
    rows = [(i if i != 7 else None, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(df).collect()}
    assert len(got) == len(rows) and not got[14].strip() and got[16] == "yes\nyes\nso be it\n"
    assert got[15] == "x. x x x x x. x."      # the line ends in the seven words it began with
    held = collections.Counter()
    for text in got.values():
        words = re.findall(r"[^\W_]+", text.lower())
        held.update({" ".join(words[i:i + 50]) for i in range(len(words) - 49)})
    assert max(held.values()) == 1
    everything = " ".join(got.values())
    assert all(s in everything for s in passage.split(". ")) and all(s in everything for s in lines.split("\n"))
    whole = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(df, min_line_words=1).collect()}
    assert whole[16] == "yes\n\nso be it\n"


def test_substrings_split_a_hot_line(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("one line that very many documents hold\n"), F.col("id").cast("string"),
        F.lit(" alone")).alias("text"))
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
           "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {key: spark.conf.get(key, None) for key in low}
    try:
        for key, value in low.items():
            spark.conf.set(key, value)
        base = df.select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("h"), "text")
        found = substrings.repeated_units(base)
        assert len(found.collect()) == 29_999
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


# -- 2 ---------------------------------------------------------------------

def test_mixing_positions_and_deviation(docs, empty):
    weights = {"s0": 0.6, "s1": 0.3}
    out = mixing.mix(docs, weights, block_docs=2).collect()
    assert sorted(r["position"] for r in out) == list(range(len(ROWS)))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    assert collections.Counter(r["source"] for r in out) == collections.Counter(r[3] for r in ROWS)
    assert mixing.mix(empty).collect() == []
    slots = {r["slot"]: r["source"] for r in out if r["phase"] == 0}
    whole = {"s0": 0.6, "s1": 0.3, "s2": 0.3, None: 0.3}       # without a weight: the smallest
    for t in range(len(slots) + 1):
        for s, w in whole.items():
            assert abs(sum(slots[i] == s for i in range(t)) - w / 1.5 * t) < 1
    by_slot = sorted((r["slot"], r["position"]) for r in out)
    assert [p for _, p in by_slot] == sorted(p for _, p in by_slot)
    few = mixing.mix(docs, weights, block_docs=2, max_blocks=3).collect()
    assert len({r["slot"] for r in few}) <= 3 + len(whole)
    assert sorted(r["position"] for r in few) == list(range(len(ROWS)))


# -- 3 ---------------------------------------------------------------------

# The base patterns, as the contract of the query states them.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secrets_base_spans_and_added_ones(spark, empty):
    rng = random.Random(2)
    hexes = ["".join(rng.choices("0123456789abcdef", k=32)) for _ in range(40)]
    mixed = ["".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz0123456789", k=32)) for _ in range(20)]
    texts = [None, "", "é password: token: abcdefgh", "SECRET='abc' passwd = \"hunter22\" ſecret: abcdefgh",
             "AKIAAKIA0123456789 AKIA" + "X" * 16, "api_key=\U0001F600 apikey:a.b/c+d==", hexes[0] + "g" + hexes[1][:20]]
    texts += [f"the {h} is token = \"{m}\" é deadbeef" for h, m in zip(hexes, mixed * 2)]
    texts += [" ".join("".join(rng.choices(["ing", "tion", "ment", "er", "the", "on"], k=7)) for _ in range(20))
              for _ in range(30)]
    hidden = "Qz7Lk2Vx9Rt4Wm8Yp3Hd6Nc1Bf5Gj0Xs"
    texts += [f"look {hidden} here", "token=" + "ab1" * 9000]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    model = secrets.fit(df.filter(F.col("doc_id") < len(texts) - 2))
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df, model).collect()}
    for i, text in enumerate(texts):
        base = brute_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [
            sum(b[0] == k for b in base) for k in ("assign", "access", "hex")]
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("random")] == [s for s in said.split(",") if s]
    assert got[texts.index(f"look {hidden} here")]["spans"] == f"random:5:{5 + len(hidden)}"
    assert all(got[i]["n_random"] == 0 for i, t in enumerate(texts) if t and "tion" in t)
    assert secrets.scan_secrets(empty, secrets.fit(empty)).collect() == []


def test_log_ratio_is_the_sum_over_pairs_of_the_likeliest_alphabet(spark):
    samples = spark.createDataFrame([("hex", "0a1b2c", 1), ("base32", "AZ2B", 2), (secrets.ORDINARY, "lorem", 3),
                                     (secrets.ORDINARY, "ipsum", 1)], "label string, token string, weight long")
    model = secrets.train(samples)
    size = secrets.ALPHABET_SIZE
    for token in ("lorem", "0a1b", "AZ2B", "x", ""):
        cells = [(ord(a) - 43) * size + ord(b) - 43 for a, b in itertools.pairwise(token)]
        got = spark.createDataFrame([(token,)], "t string").select(secrets.log_ratio(F.col("t"), model)).first()[0]
        assert math.isclose(got, max(sum(r[c] for c in cells) for r in model.ratios), abs_tol=1e-4)


def test_secrets_recall_and_false_positives_on_held_out_tokens(spark):
    from tests.conftest import SF01
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    model = secrets.fit(docs.filter("doc_id % 4 <> 2"))
    rng = random.Random(8)
    keys = {name: ["".join(rng.choices(alphabet, k=rng.randint(20, 44))) for _ in range(500)]
            for name, alphabet in secrets.ALPHABETS.items()}
    words = sorted({w for r in docs.filter("doc_id % 4 = 2").collect()
                    for w in re.findall(r"[A-Za-z]{3,}", r["text"] or "")})
    ordinary = [w for w in words if len(w) >= secrets.MIN_LENGTH]
    for _ in range(6_000):
        a, b, c = rng.choices(words, k=3)
        ordinary.append(rng.choice([f"{a}_{b}_{c}", f"{a}-{b}/{c}", a.lower() + b.title() + c.title(),
                                    f"{a}_{b}".upper(), f"{a}-{b}-{rng.randint(1990, 2030)}"]))
    ordinary = [w for w in ordinary if len(w) >= secrets.MIN_LENGTH]
    ordinary += [c * n for c in "-=_xA0f/" for n in (12, 40, 5000)]
    rows = [(name, t) for name, ts in keys.items() for t in ts] + [("ordinary", t) for t in ordinary]
    got = collections.defaultdict(list)
    for r in (spark.createDataFrame(rows, "label string, t string")
              .select("label", "t", secrets.log_ratio(F.col("t"), model).alias("score")).collect()):
        got[r["label"]].append((r["score"] > model.threshold, r["t"]))
    for name in secrets.ALPHABETS:
        assert sum(hit for hit, _ in got[name]) >= 0.9 * len(got[name]), name
    wrong = [t for hit, t in got["ordinary"] if hit]
    assert len(wrong) <= 0.001 * len(ordinary), wrong[:20]


# -- 4 ---------------------------------------------------------------------

def brute_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    holders = collections.defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = {}
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        out[doc] = (len(lines), [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == doc])
    return out


def test_lines(docs, empty):
    got = by_id(linededup.kept_lines(docs).collect())
    for doc, (n, kept) in brute_lines(ROWS).items():
        assert (got[doc]["n_lines"], got[doc]["n_dropped"]) == (n, n - len(kept))
        assert got[doc]["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    whole = linededup.dedup_lines(docs)
    assert whole.columns == docs.columns and whole.count() == len(ROWS)
    assert {r["kept"] for r in whole.collect()} == {"y"}
    assert linededup.kept_lines(empty).collect() == [] and linededup.dedup_lines(empty).collect() == []


def test_line_index_is_stored_and_probed_by_other_documents(spark):
    """Documents outside the index lose what it holds before them, and nothing that it does not hold."""
    rng = random.Random(23)
    lines = [sentence(rng, 5) for _ in range(900)]
    old = [(i, "\n".join(rng.sample(lines[:600], 7))) for i in range(100, 400)]
    new = [(i, "\n".join(rng.sample(lines, 7))) for i in [*range(0, 30), *range(1000, 1300)]]
    index = linededup.build_index(spark.createDataFrame(old, "doc_id long, text string"))
    stored = index.rows.collect()
    holders = collections.defaultdict(set)
    for doc, text in old:
        for line in text.split("\n"):
            holders[line].add(doc)
    shards = [linededup.LineShard.of_row(r.asDict()) for r in stored]
    assert sum(len(s.counts) for s in shards) == len(holders) and index.rows.columns[0] == "shard"
    assert sorted(n for s in shards for n in s.counts.tolist()) == sorted(map(len, holders.values()))
    assert not any(line.encode() in bytes(r["fingerprints"]) for r in stored for line in lines)
    for least in (1, 3):
        got = linededup.kept_lines(spark.createDataFrame(new, "doc_id long, text string"),
                                   index=index, min_holders=least).collect()
        assert {r["doc_id"]: r["kept"] for r in got} == {
            doc: "\n".join(x for x in text.split("\n")
                           if len(holders.get(x, ())) < least or min(holders[x]) >= doc)
            for doc, text in new}


def test_a_fingerprint_rejects_lines_that_were_not_indexed():
    rng = random.Random(5)
    known = [linededup.key_hashes(sentence(rng, 6))[1][0] for _ in range(3000)]
    other = [linededup.key_hashes(sentence(rng, 7))[1][0] for _ in range(3000)]
    high, low = linededup._halves(known)
    shard = linededup.LineShard.build(high, low, [1] * 3000, range(3000))
    a, b = linededup._halves(other)
    placed = shard.index(a, b) >= 0
    assert placed.sum() > 1000                        # the hash alone gives them a number
    assert (shard.probe(a, b)[0] == 0).all()          # the fingerprints reject them
    assert (shard.probe(high, low)[0] == 1).all()


def test_lines_of_null_and_shared_ids(spark):
    shared, other = "a line that several hold", "another line, held twice"
    rows = [(None, f"{shared}\n{i}") for i in range(300)] + [(7, shared), (7, f"{other}\nx"), (7, other), (9, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = linededup.kept_lines(df).collect()
    assert sorted((r["doc_id"] is None, r["kept"]) for r in got) == sorted(
        [(True, str(i)) for i in range(300)] + [(False, shared), (False, f"{other}\nx"), (False, other), (False, "")])
    blocks = df.filter("doc_id IS NULL").select(block_of(F.struct("doc_id", "text"), 8)).distinct().count()
    assert blocks == 8


def test_lines_of_long_texts(spark):
    """4 MB of lines, and one line of 5 MB, each in two documents."""
    df = spark.sql("""SELECT id AS doc_id, CASE
        WHEN id <= 2 THEN concat(array_join(transform(sequence(1, 100000),
            i -> concat('this is a line, the one of number ', i)), '\\n'), if(id = 1, '', '\\nend'))
        ELSE repeat('word ', 1000000) END AS text FROM range(1, 5, 1, 4)""")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in linededup.kept_lines(df).drop("kept").collect()}
    assert got == {1: (100_000, 0), 2: (100_001, 100_000), 3: (1, 0), 4: (1, 1)}


# -- 5 ---------------------------------------------------------------------

def test_warc(spark, tmp_dir):
    pages = [(3, "http://h/3", "<p>same</p>" * 9), (1, None, "<p>same</p>" * 9), (7, "http://h/\r\nx: y é", None),
             (2, "http://h/2", ""), (9, "http://h/9", "<p>é</p>" + "z" * 200_000), (9, "http://h/9", "again"),
             (None, "http://h/n", "no id")]
    pages += [(100 + i, f"http://h/{i}", f"<html>{i} page</html>" * 20) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    archives = warc.write_archives(df, "page_id", "url", "html", archive_bytes=2000)
    assert archives.count() > 2
    rows = warc.read_archives(archives).collect()
    assert len(rows) == len(pages) and not any(r["error"] for r in rows)
    first = {}
    for i, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        first.setdefault((html or ""), i)
    want = collections.Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        same = first[html or ""] == i
        want[("null" if i is None else str(i), len(data), sha, "response" if same else "revisit",
              None if same else str(first[html or ""]), data if same else None)] += 1
    assert collections.Counter((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"],
                                r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] else
                                (b"" if r["record_type"] == "response" else None)) for r in rows) == want
    assert all("\r" not in r["target_uri"] and "\n" not in r["target_uri"] for r in rows)
    # the same as files, read through the file source
    folder = os.path.join(tmp_dir, "warc")
    os.makedirs(folder)
    paths = [r["path"] for r in warc.export_files(archives, "file://" + folder).collect()]
    assert sorted(os.path.basename(p) for p in paths) == sorted(os.listdir(folder))
    files = spark.read.format("binaryFile").load(folder)
    assert warc.read_archives(files).count() == len(pages)
    none = df.limit(0)
    assert warc.read_archives(warc.write_archives(none, "page_id", "url", "html")).collect() == []


def test_warc_refers_by_id_and_payload(spark):
    """One payload in most rows, ids that repeat with several payloads, null ids."""
    rows = [(i % 500 if i % 11 else None, "u", "error page" if i % 3 else f"page {i % 40}") for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = collections.Counter((r["record_id"], r["payload_digest"], r["record_type"], r["refers_to"])
                              for r in warc.read_archives(warc.write_archives(df, "page_id", "url", "html")).collect())
    first = {}
    for i, _, html in sorted(rows, key=lambda p: (p[0] is None, p[0])):
        first.setdefault(html, i)
    want = collections.Counter()
    for i, _, html in rows:
        same = first[html] == i
        want["null" if i is None else str(i), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode(),
             "response" if same else "revisit", None if same else str(first[html])] += 1
    assert got == want


def test_warc_splits_a_hot_payload(spark):
    df = spark.range(90_000).select("id", F.sha1(F.when(F.col("id") % 3 > 0, F.lit("error")).otherwise(
        F.concat(F.lit("p"), (F.col("id") % 6000).cast("string")))).alias("sha")).repartition(4)
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
           "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
           "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
           "spark.sql.adaptive.coalescePartitions.enabled": "false",
           "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {key: spark.conf.get(key, None) for key in low}
    try:
        for key, value in low.items():
            spark.conf.set(key, value)
        found = warc.revisits(df)
        assert len(found.collect()) == 90_000 - 2001
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_warc_minimum_size_and_damage(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")],
                               "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(df, "page_id", "url", "html", min_bytes=3)
    got = {r["record_id"]: r["record_type"] for r in warc.read_archives(archives).collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    cut = archives.select("path", F.expr("substring(content, 1, length(content) - 5)").alias("content"))
    errors = [r["error"] for r in warc.read_archives(cut).collect()]
    assert any(errors) and None in errors


# -- 6 ---------------------------------------------------------------------

def test_chat_parts_and_masks(spark):
    part = chat.PART
    rows = [
        (1, 0, "user", [("text", "see & <image/> ", None, None, None, None), ("image", None, "i.png", None, 57, 28),
                        ("audio", None, "a.wav", 2.0, None, None), ("text", " </turn>\n", None, None, None, None)]),
        (1, 1, "assistant", [("text", "\\### é \U0001F600 &lt; ", None, None, None, None), ("document", None, "d.pdf", 3.0, None, None)]),
        (1, 1, "assistant", [("text", "tie", None, None, None, None)]), (1, None, None, None), (1, 2, 'ro"le<', []),
        (None, 0, "assistant", [(None, "no id", None, None, None, None), ("odd", None, "x", None, None, None)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    out = {r["conv_id"]: r for r in chat.format_conversations(df).withColumn(
        "turns", chat.parse_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    one = out[1]
    assert [(t["role"], t["text"]) for t in one["turns"]] == [
        ("", ""), ("user", "see & <image/>  </turn>\n"), ("assistant", "\\### é \U0001F600 &lt; "), ("assistant", "tie"), ('ro"le<', "")]
    assert [(a["type"], a["ref"], a["tokens"]) for a in one["attachments"]] == [
        ("image", "i.png", 3), ("audio", "a.wav", 25), ("document", "d.pdf", 768)]
    assert one["loss"] == "\\### é \U0001F600 &lt; tie"
    text = one["formatted"]
    assert text.count("<image/>") == 1 and text.count("<audio/>") == 1 and text.count("</turn>") == 5
    assert [text[m["start"]:m["end"]] for m in one["loss_mask"]] == ["\\### é \U0001F600 &amp;lt; <document/>", "tie"]
    assert [t["text"] for t in out[None]["turns"]] == ["no id"]
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_chat_long_conversation(spark):
    df = spark.range(2000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("<t> "), F.col("id")).alias("text"))
    r = chat.format_conversations(chat.text_turns(df)).select(
        "formatted", "loss_mask", chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).first()
    assert r["loss"] == "".join(f"<t> {i}" for i in range(1, 2000, 2))


# -- 7 ---------------------------------------------------------------------

def brute_links(rows, words=4, threshold=85):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words
                    else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = collections.Counter()
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= threshold * len(a | b):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least[find(i)], links[i]) for i, r in enumerate(rows)]


def test_jaccard(docs, empty):
    got = sorted(map(tuple, jaccard.jaccard_components(docs).collect()))
    assert got == sorted(brute_links(ROWS))
    assert len({g[2] for g in got}) < len(got)
    assert jaccard.jaccard_components(empty).collect() == []
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c, _ in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_family_over_many_blocks(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", 8)
    monkeypatch.setattr(jaccard, "SHARD_BYTES", 4000)
    rng = random.Random(seed)
    base = sentence(rng, 60).split()
    rows = []
    for i in range(70):           # a cloud in which some pairs link and others do not
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words))
            if rng.random() < 0.5:
                words[at] = f"new{rng.randint(0, 3)}"
            else:
                del words[at]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, sentence(rng, rng.randint(1, 12))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect())) == sorted(brute_links(rows))


def test_jaccard_of_the_smallest_sets_that_link(spark):
    """Texts of 7 to 9 words and the same with one word added, at the pipeline's 80."""
    rows = []
    for n in (7, 8, 9):
        text = [f"w{n}x{i}" for i in range(n)]
        rows += [(10 * n, " ".join(text)), (10 * n + 1, " ".join([*text, "added"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = sorted(brute_links(rows, 5, 80))
    assert [c for _, _, c, _ in want] == [70, 71, 80, 80, 90, 90]
    assert sorted(map(tuple, jaccard.jaccard_components(df, words=5, threshold=80).collect())) == want


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    from textindex.llm.graph import components

    rng = random.Random(seed)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(330)]
    edges += [(1000 + i, 1000 + (i + 1) % 60) for i in range(60)] + [(5000, i) for i in range(5001, 5200)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in root)


# -- 8 ---------------------------------------------------------------------

def test_language(spark, docs, empty):
    rng = random.Random(3)
    sounds = {"aa": ["ka", "lo", "mi", "taa"], "bb": ["scht", "ung", "keit", "ver"], "cc": ["ção", "nho", "lhe", "dos"]}
    rows = [(i, " ".join("".join(rng.choices(sounds[lang], k=3)) for _ in range(30)), lang)
            for i, lang in enumerate(list(sounds) * 60)]
    rows += [(900, None, "aa"), (901, "12 34 !", "aa"), (902, "kalomi", None), (None, "taaka", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.languages == ("aa", "bb", "cc")
    got = language.identify(df, model).withColumn("out", language.held_out(F.col("doc_id"))).collect()
    test = [r for r in got if r["out"] and r["doc_id"] < 900]
    assert {r["doc_id"] for r in test} == {i for i, _, _ in rows[:180] if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang"] == r["lang_pred"] for r in test) >= 0.95 * len(test)
    assert all(0 <= r["score"] <= 1 for r in got)
    ids = {r["doc_id"]: r for r in got}
    assert (ids[900]["lang_pred"], ids[900]["score"]) == ("und", 0) and ids[901]["lang_pred"] == "und"
    again = language.identify(docs, model)
    assert set(again.columns) == set(docs.columns) and again.count() == len(ROWS)
    assert language.identify(docs, language.fit(empty)).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language.identify(empty, model).collect() == []


def test_language_stage_drops_unknown_languages_and_keeps_short_texts(spark):
    import corpus_pipeline
    from conftest import SF01

    rng = random.Random(9)
    letters = ["abcdefghijklmnopqrstuvwxyz", "bcdfghjklmnpqrstvwxz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"]
    foreign = [(10 ** 9 + i, " ".join("".join(rng.choices(letters[i % 3], k=rng.randint(2, 9))) for _ in range(n)))
               for i, n in enumerate([10, 30, 100, 300] * 75)]
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang")
    df = docs.unionByName(spark.createDataFrame(foreign, "doc_id long, text string").withColumn(
        "lang", F.lit(None).cast("string")).coalesce(1))
    stayed = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, df, SF01).select("doc_id").collect()}
    # all documents with a letter stay, of 4 characters up
    assert {r["doc_id"] for r in docs.collect() if any(map(str.isalpha, r["text"] or ""))} <= stayed
    assert len(stayed & {i for i, _ in foreign}) <= 0.03 * len(foreign)


# -- 9 ---------------------------------------------------------------------

def test_fingerprints(docs, empty):
    rows = fingerprints.document_fingerprints(docs).collect()
    got = by_id(rows)
    ids = list(range(len(TEXTS)))
    for i in ids:
        text, following = TEXTS[i] or "", TEXTS[(i + 1) % len(ids)] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[5]["fingerprint"] == got[6]["fingerprint"] != got[7]["fingerprint"]
    assert got[5]["near_next"] == 1.0 and got[0]["fingerprint"] == got[1]["fingerprint"]
    assert fingerprints.document_fingerprints(empty).collect() == []
    alone = fingerprints.document_fingerprints(docs.filter("doc_id = 5")).collect()
    assert alone[0]["near_next"] == 1.0


def test_fingerprints_null_and_shared_ids(spark):
    df = spark.createDataFrame([(None, "a b. c d"), (4, "x"), (4, "y y"), (9, "zz")], "doc_id long, text string")
    got = sorted(fingerprints.document_fingerprints(df).collect(), key=lambda r: (r["doc_id"] or -1, r["n_chars"]))
    assert [r["doc_id"] for r in got] == [None, 4, 4, 9]
    sha = {r["n_chars"]: r["edited_sha256"] for r in got}
    assert sha[3] == hashlib.sha256(b"y yz"[:2] + b"z").hexdigest()


def test_fingerprint_does_not_depend_on_order_and_adds_up(spark):
    df = spark.createDataFrame([("a b\nc d\ne f\na b",)], "t string")

    def fp(text):
        return fingerprints.fingerprint(fingerprints.paragraphs(F.lit(text)))

    r = df.select(fp("a b\nc d\ne f\na b").alias("x"), fp("e f\na b\na b\nc d").alias("y"), fp("a b\nc d").alias("p"),
                  fp("e f\na b").alias("q"), fp("a b\nc d\ne f").alias("z")).select(
        "x", "y", "z", fingerprints.combine(F.col("p"), F.col("q")).alias("sum"),
        fingerprints.combine(F.col("x"), F.col("z"), -1).alias("less"), fp("a b").alias("one")).first()
    assert r["x"] == r["y"] == r["sum"] != r["z"] and r["less"] == r["one"]


def test_likeness_follows_the_cosine(spark):
    rng = random.Random(8)
    pool = [sentence(rng, 6) for _ in range(120)]
    rows = []
    for _ in range(60):
        a, b = rng.choices(pool, k=40), rng.choices(pool, k=20)
        rows.append(("\n".join(a), "\n".join(a[:20] + b)))
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(fingerprints.likeness(
        *[fingerprints.fingerprint(fingerprints.paragraphs(F.col(c))) for c in "ab"])).collect()]
    off = []
    for (a, b), g in zip(rows, got):
        x, y = collections.Counter(a.split("\n")), collections.Counter(b.split("\n"))
        dot = sum(x[k] * y[k] for k in x)
        off.append(g - dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())))
    assert abs(sum(off) / len(off)) < 0.03 and max(map(abs, off)) < 0.25


# -- 10 --------------------------------------------------------------------

def brute_contained(rows, items):
    def found(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    out = collections.Counter()
    for doc, text, *_ in rows:
        have = found(text)
        for item, wanted in items:
            s = found(wanted)
            if s and 5 * len(s & have) >= 4 * len(s):
                out[doc, item, len(s & have), len(s)] += 1
    return out


@pytest.mark.parametrize("per_block", [20_000, 5])
def test_contamination(spark, docs, empty, per_block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", per_block)
    rng = random.Random(6)
    items = [(i, " ".join(TEXTS[14 + i % 4].split()[8 * i % 70:][:rng.randint(8, 40)])) for i in range(12)]
    items += [(20, None), (21, ""), (22, "one two three"), (23, sentence(rng, 20)), (24, "SHORT!"),
              (25, " ".join(TEXTS[5].split()[10:20] + TEXTS[5].split()[60:75])), (None, TEXTS[14][:150]),
              (0, items[0][1])]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter(tuple(r)[:4] for r in decontaminate.contaminated(docs, df).collect())
    want = brute_contained(ROWS, items)
    assert want and got == want
    clean = decontaminate.remove_contaminated(docs, df)
    assert clean.columns == docs.columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(
        r[0] for r in ROWS if not any(d == r[0] for d, *_ in want))
    assert decontaminate.contaminated(empty, df).collect() == []
    assert decontaminate.contaminated(docs, df.limit(0)).collect() == []


# -- pipeline ----------------------------------------------------------------

def test_pipeline_against_brute_force(spark, tmp_dir):
    """Each stage against brute force on what the stage before kept."""
    import corpus_pipeline
    from test_units import edf

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    items = [(0, " ".join(TEXTS[15].split()[31:80])), (1, sentence(random.Random(1), 30)), (2, None)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, tmp_dir).write.parquet(f"{tmp_dir}/{name}")
        docs = spark.read.parquet(f"{tmp_dir}/{name}")
        seen.append(docs.collect())
        assert name == "mixing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    spoken, lines, single, clean, mixed = ([tuple(r)[:5] for r in sorted(rs)] for rs in seen)
    assert {r[0] for r in rows if sum(map(str.isalpha, r[1] or "")) > 60} <= {r[0] for r in spoken}
    assert not {r[0] for r in rows if not any(map(str.isalpha, r[1] or ""))} & {r[0] for r in spoken}
    assert set(spoken) <= set(rows)
    left = {d: "\n".join(kept) for d, (_, kept) in brute_lines(spoken).items()}
    assert {r[0]: r[1] for r in lines} == {d: t for d, t in left.items() if t.strip(" ")}
    assert all(r[4] == len(r[1]) for r in lines)
    assert {r[0] for r in single} == {c for _, _, c, _ in brute_links(lines, 5, 80)} < {r[0] for r in lines}
    bad = {d for d, *_ in brute_contained(single, items)}
    assert bad and {r[0] for r in clean} == {r[0] for r in single} - bad
    assert set(mixed) == set(clean)
    counts = collections.Counter(r[3] for r in clean)
    blocks = {s: -(-n // mixing.BLOCK_DOCS) for s, n in counts.items()}
    order = edf(blocks, mixing.target_weights(counts))
    slots = {r["slot"]: r["source"] for r in seen[-1]}
    assert [slots[i] for i in range(len(slots))] == order
    assert sorted(r["position"] for r in seen[-1]) == list(range(len(clean)))
    assert sorted(map(tuple, corpus_pipeline.run(spark, tmp_dir).collect())) == sorted(map(tuple, seen[-1]))


def test_pipeline_on_an_empty_table(spark, tmp_dir):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).collect() == []
