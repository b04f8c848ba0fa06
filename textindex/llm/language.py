"""Operator 8: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from its three
letters' vectors, each permuted (rolled) by its place, and multiplied; a text is
the bundle (sum) of its trigrams' vectors, each counted by the square root of its
frequency. A language's prototype is the bundle over all its training documents,
less the mean of the prototypes, which all languages share. A document goes to
the prototype with the largest cosine.

Cosines of unrelated random vectors scatter by ``1 / sqrt(DIMENSIONS)``, so a score
tells languages apart but not a text of none of them. ``likeness`` does: the largest
cosine of the trigram weights themselves, what the score tends to with ever more
dimensions.

Training counts trigrams per language over every training document. What reaches
the driver is one vector of counts for each language, of a size that the folded
alphabet fixes; languages are named by ``lang`` values, of which there are few.

Edge cases: null text, or text without a letter, is ``und`` with score 0; with no
training documents every document is ``und``; a negative best cosine scores 0;
equal cosines go to the smaller language name; empty tables yield no rows. Only
``doc_id``, ``text`` and ``lang`` are read, and a prediction sees the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from textindex.llm.common import read

DIMENSIONS = 1024
LETTERS = 64          # folded alphabet: 0 is a gap, 1-26 a-z, the rest other letters
SEED = 20241
UNDETERMINED = "und"
_TOGETHER = 128       # documents whose trigrams are bundled in one product
_PART = 1 << 13       # trigram numbers whose counts are summed in one group
_SLICE = 1 << 20      # characters of a text that are turned to numbers at a time


def _letter_codes(text: str) -> np.ndarray:
    """Folded letter numbers of a text, lower-cased; runs of other characters are one gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = np.zeros(len(points), dtype=np.int32)
    plain = (points >= 97) & (points <= 122)
    codes[plain] = points[plain] - 96
    other = np.flatnonzero(points >= 0xAA)
    if len(other):
        wide, where = np.unique(points[other], return_inverse=True)
        folded = np.array([27 + (int(p) * 2654435761 >> 7) % (LETTERS - 27) if chr(p).isalpha() else 0
                           for p in wide], dtype=np.int32)
        codes[other] = folded[where]
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram numbers of a whole text, and how often each occurs."""
    total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    carry = np.zeros(1, dtype=np.int32)
    for at in range(0, len(text), _SLICE):
        codes = np.concatenate([carry, _letter_codes(text[at:at + _SLICE])])
        if at + _SLICE >= len(text):
            codes = np.append(codes, 0)
        a = codes[:-2].astype(np.int64)
        grams = (a * LETTERS + codes[1:-1]) * LETTERS + codes[2:]
        middle = codes[1:-1] != 0
        found, n = np.unique(grams[middle], return_counts=True)
        if len(total[0]):
            merged, where = np.unique(np.concatenate([total[0], found]), return_inverse=True)
            total = merged, np.bincount(where, np.concatenate([total[1], n])).astype(np.int64)
        else:
            total = found, n
        carry = codes[-2:]
    return total


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Space:
    """The letters' random vectors, and the vectors bound from them."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        drawn = np.random.default_rng(seed).integers(0, 2, (LETTERS, dimensions))
        letters = (2 * drawn - 1).astype(np.float32)
        self.places = [np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters]

    def trigrams(self, grams: np.ndarray) -> np.ndarray:
        first, second, third = self.places
        return first[grams // LETTERS ** 2] * second[grams // LETTERS % LETTERS] * third[grams % LETTERS]

    def bundle(self, grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.places[0].shape[1], dtype=np.float64)
        for at in range(0, len(grams), 8192):
            out += weights[at:at + 8192] @ self.trigrams(grams[at:at + 8192])
        return out

    def texts(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One bundle a text; all their distinct trigrams are bound once."""
        grams = np.unique(np.concatenate([g for g, _ in counted]))
        table = np.zeros((len(counted), len(grams)), dtype=np.float32)
        for row, (g, n) in zip(table, counted):
            row[np.searchsorted(grams, g)] = np.sqrt(n)
        return table @ self.trigrams(grams)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    prototypes: np.ndarray      # one unit row a language
    grams: np.ndarray           # the trigrams of all languages, sorted
    weights: np.ndarray         # their weights, one centred unit row a language


def best_of(prototypes: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest prototype, and their cosine (0 if negative)."""
    norms = np.linalg.norm(vectors, axis=1)
    cosines = vectors @ prototypes.T / np.maximum(norms, 1e-9)[:, None]
    best = cosines.argmax(axis=1)
    return best, np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0)


def likeness(grams: np.ndarray, weights: np.ndarray, found: np.ndarray, n: np.ndarray) -> float:
    """The largest cosine of a text's counted trigrams with a language's weights."""
    at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
    known = grams[at] == found
    cosines = weights[:, at[known]] @ np.sqrt(n[known]) / max(1.0, np.sqrt(n.sum()))
    return float(np.clip(cosines.max(), 0.0, 1.0))


def _centred(rows: np.ndarray) -> np.ndarray:
    """Unit rows, less what all of them share."""
    units = rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-9)[:, None]
    if len(units) > 1:
        units = units - units.mean(axis=0)
        units /= np.maximum(np.linalg.norm(units, axis=1), 1e-9)[:, None]
    return units.astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that training leaves out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(samples: DataFrame, dimensions: int = DIMENSIONS) -> LanguageModel:
    """Prototypes from ``(text, lang)``: trigrams are counted in the tasks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams, n = trigram_counts(text)
                held = sums.setdefault(lang, np.zeros(LETTERS ** 3))
                # a text counts as a whole: its trigrams' weights are of length one
                held[grams] += np.sqrt(n) / max(1.0, np.sqrt(n.sum()))
        for lang, held in sums.items():
            for part in range(0, len(held), _PART):
                grams = part + np.flatnonzero(held[part:part + _PART])
                if len(grams):
                    yield pa.RecordBatch.from_pydict({
                        "lang": [lang], "part": pa.array([part], pa.int32()),
                        "grams": pa.array([grams.astype("<i4").tobytes()], pa.binary()),
                        "weights": pa.array([held[grams].astype("<f8").tobytes()], pa.binary())})

    def add(key: tuple, table: pa.Table) -> pa.Table:
        part = key[1].as_py()
        held = np.zeros(_PART)
        for g, w in zip(table.column("grams"), table.column("weights")):
            held[np.frombuffer(g.as_py(), "<i4") - part] += np.frombuffer(w.as_py(), "<f8")
        grams = np.flatnonzero(held)
        return pa.table({"lang": [key[0].as_py()], "part": pa.array([part], pa.int32()),
                         "grams": pa.array([(part + grams).astype("<i4").tobytes()], pa.binary()),
                         "weights": pa.array([held[grams].astype("<f8").tobytes()], pa.binary())})

    schema = "lang string, part int, grams binary, weights binary"
    counted = (samples.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
               .select("text", "lang").mapInArrow(count, schema)
               .groupBy("lang", "part").applyInArrow(add, schema))
    rows: dict[str, list] = {}
    for r in sorted(counted.collect(), key=lambda r: (r["lang"], r["part"])):
        rows.setdefault(r["lang"], []).append(
            (np.frombuffer(r["grams"], "<i4").astype(np.int64), np.frombuffer(r["weights"], "<f8")))
    space = Space(dimensions)
    bundles = [sum(space.bundle(g, w) for g, w in parts) for parts in rows.values()]
    if not bundles:
        return LanguageModel((), np.zeros((0, dimensions), np.float32),
                             np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    grams = np.unique(np.concatenate([g for parts in rows.values() for g, _ in parts]))
    weights = np.zeros((len(rows), len(grams)))
    for row, parts in zip(weights, rows.values()):
        for g, w in parts:
            row[np.searchsorted(grams, g)] = w
    return LanguageModel(tuple(rows), _centred(np.array(bundles)), grams, _centred(weights))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text",
             with_likeness: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, and ``likeness`` if asked for
    (columns of these names are replaced)."""
    added = ["lang_pred", "score", *(["likeness"] if with_likeness else [])]
    languages, prototypes = model.languages, model.prototypes
    profile = (model.grams, model.weights) if with_likeness else None

    @pandas_udf("lang_pred string, score double" + (", likeness double" if with_likeness else ""))
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        space = Space(prototypes.shape[1])
        for series in texts:
            names = np.full(len(series), UNDETERMINED, dtype=object)
            scores, likes = np.zeros(len(series)), np.zeros(len(series))
            known = [i for i, t in enumerate(series) if _has_letter(t)] if languages else []
            for at in range(0, len(known), _TOGETHER):
                part = known[at:at + _TOGETHER]
                counted = [trigram_counts(series.iloc[i]) for i in part]
                best, score = best_of(prototypes, space.texts(counted))
                names[part] = np.array(languages, dtype=object)[best]
                scores[part] = score
                if profile:
                    likes[part] = [likeness(*profile, *c) for c in counted]
            yield pd.DataFrame(dict(zip(added, (names, scores, likes))))

    kept = [c for c in docs.columns if c not in added]
    predicted = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                            guess(F.col(f"`{text}`")).alias("guess"))
    return predicted.select("row.*", *[f"guess.{c}" for c in added])


def fit(docs: DataFrame) -> LanguageModel:
    """A model from all documents that are not held out."""
    return train(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn the languages from the documents not held out; predict all documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.drop("lang"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
