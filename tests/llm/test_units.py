"""Brute-force checks of the operators' own parts (no Spark session needed)."""

import hashlib
import itertools
import random
import time
from fractions import Fraction

import numpy as np
import pytest

from textindex.llm import decontaminate, jaccard, language, linededup, mixing, shingles, warc


def test_shingles_tell_apart_and_agree():
    words = [b"a", b"b", b"c", b"d", b"a", b"b", b"c", b"d"]
    got = shingles.shingle_hashes(words, 4)
    assert len(got) == 5 and got[0] == got[4] and len(set(got.tolist())) == 4
    assert len(shingles.shingle_hashes([b"a", b"b"], 4)) == 1
    assert shingles.shingle_hashes([b"a", b"b"], 4) != shingles.shingle_hashes([b"b", b"a"], 4)
    assert len(shingles.shingle_hashes([], 4)) == 0


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    high, low = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
    counts, first = rng.integers(1, 9, n), rng.integers(0, 1 << 40, n)
    shard = linededup.LineShard.build(high, low, counts, first)
    index = shard.index(high, low)
    assert sorted(index.tolist()) == list(range(n))
    got_counts, got_first = shard.probe(high, low)
    assert got_counts.tolist() == counts.tolist() and got_first.tolist() == first.tolist()
    other = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    assert (shard.probe(other, other)[0] == 0).all()


def test_same_high_half_is_settled():
    high = np.zeros(50, np.uint64)
    low = np.arange(50, dtype=np.uint64) * np.uint64(7919)
    shard = linededup.LineShard.build(high, low, np.ones(50), np.arange(50))
    assert sorted(shard.index(high, low).tolist()) == list(range(50))


def held_to_targets(plan, weights):
    """Every phase of a plan against its exact targets: windows and deviation, slot by slot."""
    for phase, rows in itertools.groupby(enumerate(plan), key=lambda r: r[1][2]):
        rows = list(rows)
        start = rows[0][0]
        live = {row[0] for _, row in enumerate(plan[start:])} if len(plan) < 20_000 else set(weights)
        total = sum(Fraction(weights[s]) for s in live)
        mine = {}
        for slot, (s, _, _, released, due) in rows:
            mine.setdefault(s, []).append((slot - start, released - start, due - start))
        for s in live:
            w = Fraction(weights[s]) / total
            for i, (slot, released, due) in enumerate(mine.get(s, [])):
                assert released == i / w // 1 and due == -(-(i + 1) / w // 1)
                assert released <= slot < due
                assert abs(i - slot * w) < 1 and abs(i + 1 - (slot + 1) * w) < 1
            n = len(mine.get(s, []))
            assert abs(n - len(rows) * w) < 1


def test_schedule_stays_within_a_block_of_unrounded_targets():
    rng = random.Random(4)
    for _ in range(40):
        names = [*"abcdefghij"[:rng.randint(1, 10)], None]
        blocks = {s: rng.choice([1, 2, rng.randint(1, 150)]) for s in names}
        weights = {s: rng.choice([rng.random() + 1e-6, 10.0 ** -rng.randint(0, 5), 3.0]) for s in names}
        plan = mixing.schedule(blocks, weights)
        for s in names:
            assert [b for source, b, *_ in plan if source == s] == list(range(blocks[s]))
        held_to_targets(plan, weights)


def test_a_million_slots_of_very_unequal_sources():
    """No drift: one phase of natural weights, 10 M to 10 k documents a source."""
    weights = {"a": 10_000_000, "b": 1_000_000, "c": 100_000, "d": 10_000}
    plan = mixing.schedule({"a": 900_300, "b": 10 ** 6, "c": 10 ** 6, "d": 10 ** 6}, weights)[:1_000_000]
    slots = {s: np.array([t for t, row in enumerate(plan) if row[0] == s]) for s in weights}
    assert plan[-1][2] == 0 and len(plan) == 1_000_000
    total = sum(weights.values())
    for s, mine in slots.items():
        i, p = np.arange(len(mine)), weights[s]
        for done, t in ((i, mine), (i + 1, mine + 1)):
            assert np.abs(done * total - t * p).max() < total
        assert ((i * total // p <= mine) & (mine < -(-(i + 1) * total // p))).all()


def test_ten_thousand_sources():
    counts = {f"s{i}": 1 + i % 7 for i in range(10_000)}
    began = time.perf_counter()
    plan = mixing.schedule(counts, mixing.target_weights(counts))
    assert len(plan) == sum(counts.values()) and time.perf_counter() - began < 20


def test_weights_that_are_none():
    assert mixing.integer_weights({"a": 0.5, "b": 0, "c": float("nan"), "d": 2}, "abcde") == {
        "a": 1, "b": 1, "c": 1, "d": 4, "e": 1}
    assert mixing.integer_weights({}, [None, "x"]) == {None: 1, "x": 1}
    assert mixing.schedule({}, {}) == []


def edf(blocks, weights):
    """Slot by slot over all sources, with fractions."""
    left, out = dict(blocks), []
    while any(left.values()):
        live = [s for s in left if left[s]]
        total = sum(Fraction(weights[s]) for s in live)
        w, used, t = {s: Fraction(weights[s]) / total for s in live}, dict.fromkeys(live, 0), 0
        while all(left[s] for s in live):
            ready = [s for s in live if used[s] / w[s] // 1 <= t]
            s = min(ready, key=lambda s: (-(-(used[s] + 1) / w[s] // 1), -w[s], (s is not None, str(s))))
            out.append(s)
            used[s] += 1
            left[s] -= 1
            t += 1
    return out


def test_phases_equal_slot_by_slot_scheduling():
    rng = random.Random(4)
    for _ in range(12):
        names = "abcdef"[:rng.randint(1, 6)]
        blocks = {s: rng.randint(1, 150) for s in names}
        weights = {s: rng.choice([1.0, rng.random() + 0.01]) for s in names}
        assert [row[0] for row in mixing.schedule(blocks, weights)] == edf(blocks, weights)


def test_trigrams_do_not_depend_on_slices(monkeypatch):
    text = "Der Süße  Käse, 12 und x. " * 40
    whole = language.trigram_counts(text)
    monkeypatch.setattr(language, "_SLICE", 7)
    parts = language.trigram_counts(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_bundles_in_one_product_equal_single_ones():
    space = language.Space(256)
    counted = [language.trigram_counts(t) for t in ("abc abd", "die der das", "x")]
    together = space.texts(counted)
    for row, (g, n) in zip(together, counted):
        assert np.allclose(row, space.bundle(g, np.sqrt(n)), atol=1e-3)


def test_common_counts_intersections(monkeypatch):
    monkeypatch.setattr(jaccard, "_COLUMNS", 16)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 120, rng.integers(1, 60))).astype(np.uint64) for _ in range(20)]
    got = jaccard._common(sets)
    for i, j in itertools.combinations(range(20), 2):
        assert got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


@pytest.mark.parametrize("threshold", [50, 67, 75, 80, 85, 90, 95])
def test_small_sets_that_can_link_are_not_settled(threshold):
    import pyarrow as pa

    texts = [" ".join(f"w{n}x{i}" for i in range(n + more)) for n in range(1, 25) for more in (0, 1)]
    table = pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    asked = jaccard._ask(1, 1)((pa.scalar(0),), table)
    done = jaccard._settle(1, threshold, 1)((pa.scalar(0),), table, jaccard._answer((), asked))
    kept = [s is not None for s in done.column("shingles").to_pylist()]
    for n in range(1, 25):          # n words and the same n with one more: similarity n / (n + 1)
        assert 100 * n < threshold * (n + 1) or kept[2 * n - 2] and kept[2 * n - 1]


def test_window_search_finds_items_anywhere():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 90)))) for i in range(300)]
    index = decontaminate.ItemIndex.build(items)
    missed = 0
    for item, text in items:
        words = rng.choices(vocabulary, k=rng.randint(0, 3000))
        at = rng.randint(0, len(words))
        full = " ".join(words[:at] + text.split() + words[at:])
        found = shingles.shingle_hashes(shingles.plain_words(full), decontaminate.SHINGLE_WORDS)
        seen = {i for _, _, hit in index.candidates(found) for i in hit.tolist()}
        missed += item not in seen
    assert missed <= 1        # below 1e-5 each


@pytest.mark.parametrize("threshold", [(4, 5), (1, 2), (1, 1)])
def test_short_items_are_never_missed(threshold):
    """Items of one to three shingles, or with enough of them, in long documents."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=1 + i % 7))) for i in range(1500)]
    index = decontaminate.ItemIndex.build(items, threshold)
    assert index.short and not index.classes
    for start in range(0, len(items), 50):
        words = []
        for _, text in items[start:start + 50]:
            part = text.split()
            words += rng.choices(vocabulary, k=40) + part[:len(part) if threshold != (1, 2) else max(5, len(part) - 1)]
        found = shingles.shingle_hashes(words := [w.encode() for w in words], decontaminate.SHINGLE_WORDS)
        held = np.unique(found)
        want = {i for i in range(len(items)) if index.contained(i, held) * threshold[1]
                >= threshold[0] * len(index.shingles[i])}
        seen = {i for _, _, hit in index.candidates(found) for i in hit.tolist()}
        assert want <= seen and len(want) > 10


def archive(records, dictionary=b""):
    import zstandard

    packer = zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.archive_head(dictionary) + b"".join(packer.compress(r) for r in records)


def test_warc_round_trip_with_dictionary():
    import zstandard

    texts = [f"<html><p>{i} page of words {i * i}</p></html>".encode() * 3 for i in range(400)]
    dictionary = zstandard.train_dictionary(4096, texts).as_bytes()
    records = [warc.record(str(i), f"http://h/{i} ä", t, None, "2020-01-01T00:00:00Z")
               for i, t in enumerate([*texts, b"", b"x" * 300_000])]
    records.append(warc.record("900", None, texts[3], "3", "2020-01-01T00:00:00Z"))
    data = archive(records, dictionary)
    assert data[:4] == warc.SKIPPABLE_MAGIC
    back = [warc.parse(r) for r in warc.frames(data)]
    assert [b["payload"] for b in back[:-1]] == [*texts, b"", b"x" * 300_000]
    assert back[-1]["record_type"] == "revisit" and back[-1]["refers_to"] == "3"
    assert back[-1]["payload_bytes"] == len(texts[3]) and back[-1]["payload_digest"] == warc.digest(texts[3])


def test_damaged_records_are_refused():
    good = warc.record("1", "http://h/", b"payload", None, "2020-01-01T00:00:00Z")
    for bad in (good[:-3], good.replace(b"payload\r\n", b"paXload\r\n"), b"HTTP" + good,
                good.replace(b"WARC-Date", b"WARC-Dat"), good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc.DamagedArchive):
            warc.parse(bad)
    with pytest.raises(warc.DamagedArchive):
        list(warc.frames(archive([good])[:-4]))
    with pytest.raises(warc.DamagedArchive):
        list(warc.frames(b"not an archive"))


def test_line_keys():
    lines, hashes = linededup.key_hashes("  ABCÉ def ghij\t\nabcÉ DEF ghij\nshort\n")
    assert len(lines) == 4 and hashes[0] == hashes[1] and hashes[2] is None and hashes[3] is None
    assert linededup.key_hashes("é" * 10)[1][0] is not None
    assert linededup.key_hashes("é" * 9)[1][0] is None
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
