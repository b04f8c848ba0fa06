"""Operator 13 against one recursive tree on the driver."""

import hashlib
import random
import zlib

import duckdb
import pytest

from textindex.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, idx int, node string, way int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    doc_id, text, lang, source, n_chars = row[:5]
    n_chars = n_chars if n_chars is None else n_chars + add
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """Top, and for each node its (sibling, side) steps."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            pair = nodes[a // 2 * 2:a // 2 * 2 + 2]
            steps[i].append((None, None) if len(pair) == 1 else (pair[1 - a % 2], a % 2))
        nodes = [sha(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [a // 2 for a in at]
    return nodes[0], steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    found = {}
    for lang in langs:
        members = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        found[lang] = members, *tree([leaf(r) for r in members])
    root, above = tree([found[x][1] for x in langs])
    out = []
    for lang, way in zip(langs, above):
        members, subroot, ways = found[lang]
        for r, own in zip(members, ways):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, int(tampered))
            for sibling, side in own + way:
                node = sha(node) if sibling is None else sha(sibling, node) if side else sha(node, sibling)
            out.append((r[0], leaf(r), subroot, root, sha(*[s for s, _ in own + way if s]), node, node == root))
    return sorted(out, key=str)


def query(spark, rows, tmp_dir, height):
    path = f"{tmp_dir}/documents.parquet"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    keep = merkle.manifest.__defaults__
    merkle.manifest.__defaults__ = (height,)
    try:
        return sorted((tuple(r) for r in merkle.op13_merkle_manifest(spark, tmp_dir).collect()), key=str)
    finally:
        merkle.manifest.__defaults__ = keep


def make_rows(sizes, seed=1):
    rng = random.Random(seed)
    rows, key = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            key += rng.randint(1, 3)
            rows.append((key, rng.choice([None, "", "é text ", "word " * 9, "日本"]) , lang, rng.choice([None, "s", "t"]),
                         rng.choice([None, 0, 7, 123]), "k", 1, "n", 2))
    return rows


@pytest.mark.parametrize("sizes, height", [
    ({"en": 1}, 10), ({"en": 2, None: 3}, 10), ({"en": 77, "fr": 1, None: 33, "": 5, "é": 16, "z": 17}, 2),
    ({"en": 129, "de": 64, "it": 65}, 3), ({f"l{i}": 1 + i % 3 for i in range(21)}, 2), ({"en": 40, "fr": 9}, 1)])
def test_against_one_tree(spark, tmp_dir, sizes, height):
    rows = make_rows(sizes)
    assert query(spark, rows, tmp_dir, height) == brute(rows)


def test_ties_nulls_and_repeats(spark, tmp_dir):
    rows = make_rows({"en": 30, None: 5})
    rows += rows[:7] + [(None, "a", "en", "s", 5, "k", 1, "n", 2)] * 2 + [(rows[0][0], "other", "en", "s", 1, "k", 1, "n", 2)]
    rows += [(2 ** 62 + 1, "x" * 3_000_000, "en", None, 2 ** 63 - 1, None, None, None, None)]
    got = query(spark, rows, tmp_dir, 2)
    want = brute(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert got == want or zlib.crc32(str(2 ** 62 + 1).encode()) % 7 == 0


def test_empty(spark, tmp_dir):
    assert query(spark, [], tmp_dir, 10) == []


def test_tampering_is_found(spark, tmp_dir):
    rows = make_rows({"en": 200, "fr": 50})
    for r in query(spark, rows, tmp_dir, 4):
        n_chars = next(x[4] for x in rows if x[0] == r[0])
        assert r[6] == (n_chars is None or zlib.crc32(str(r[0]).encode()) % 7 != 0)


def test_proofs_lead_to_the_root(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in merkle.manifest(docs, 3).collect():
        assert merkle.fold(r.leaf, r.proof) == r.root


def test_sql_on_small_rows(spark, tmp_dir):
    rows = make_rows({"en": 37, None: 3, "fr": 16, "de": 1})
    got = query(spark, rows, tmp_dir, 3)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_dir}/documents.parquet/*.parquet')")
    assert sorted((tuple(r) for r in con.execute(merkle.OP13_SQL).fetchall()), key=str) == got
