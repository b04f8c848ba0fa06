"""Operator 3: secret scan with character Markov models.

Fixed patterns find the base spans. First-order character models then score every
long token that no base span touches: one model for each alphabet that keys are
written in, one of ordinary identifiers. A token's score is its log-likelihood ratio,
random over ordinary, under the likeliest alphabet; tokens above the threshold are
reported as ``random`` spans.

The models are trained on labelled samples. Random ones are drawn here, uniformly and
from a fixed seed, a documented number for each alphabet. Ordinary ones are the words
and tokens of all documents outside the base spans, as often as they occur, and
identifiers made of each (snake, kebab, camel and upper case, with a number or a date).
Training counts have a fixed size (the square of the token alphabet for each label),
whatever the corpus. A run of one character is ordinary with a fixed share.

The threshold follows from the wanted rate of false positives: an ordinary token's
likelihood ratio exceeds r with probability 1/r at most, for each of the alphabets. The
sum over a token's pairs is compared, so a long token needs less evidence a character.

Edge cases: null text is the empty text and yields no spans; empty tables yield
no rows; without ordinary samples that model is uniform; a token shorter than
``min_length`` is not scored; repeated rows are scanned each. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textindex.llm.common import materialize, read
from textindex.llm.native import let, running

# The base patterns. A hex run or an access key is as long as it
# can be, so a minimum length in the pattern finds the same spans as a filter
# after matching; a short assigned value still uses up its match, and is dropped.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6

TOKEN_CLASS = r"A-Za-z0-9+/_=\-"
ALPHABET_FROM, ALPHABET_SIZE = ord("+"), ord("z") - ord("+") + 1


# The alphabets that keys are written in.
HEX_DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ALPHABETS = {"hex": HEX_DIGITS, "base32": BASE32, "base62": BASE62, "base64": BASE62 + "+/"}
ORDINARY, JOINT = "ordinary", "joint"
DIGITS, LETTERS = BASE62[:10], BASE62[10:]

MIN_LENGTH = 12              # characters of a token that is scored
FALSE_POSITIVES = 1e-4       # wanted share of ordinary tokens that are reported, at most
RANDOM_SAMPLES, RANDOM_LENGTH = 4_000, 64      # strings drawn for each alphabet, and their length
RUN_SHARE = 0.1              # share of ordinary pairs that repeat their character, beside the counted ones


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios of character pairs for each alphabet, random over ordinary, row-major."""

    ratios: tuple[tuple[float, ...], ...]
    min_length: int = MIN_LENGTH
    threshold: float = math.log(len(ALPHABETS) / FALSE_POSITIVES)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points, by start.

    The pieces between the matches and the matches themselves make up the text,
    so running sums of their lengths give the places.
    """
    def place(found: Column, pieces: Column) -> Column:
        between = F.slice(pieces, F.lit(1), F.size(found))
        lengths = F.zip_with(between, found, lambda p, m: (F.length(p) + F.length(m)).cast("long"))
        return F.zip_with(
            F.zip_with(running(lengths), between, lambda at, p: at + F.length(p)), found,
            lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("value")))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: let(F.split(text, pattern, -1), lambda pieces: place(found, pieces)))
    ).otherwise(empty)


def _token_pattern(min_length: int) -> str:
    return f"[{TOKEN_CLASS}]{{{min_length},}}"


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind, failing matches dropped."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(
        F.regexp_extract(m["value"], ASSIGN, 2)) >= MIN_VALUE)
    return {"assign": assign, "access": matches(text, ACCESS), "hex": matches(text, HEX)}


def _pairs(token: Column) -> Column:
    """Cell numbers (previous, next character) of a token's character pairs."""
    def cells(codes: Column) -> Column:
        return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1),
                          F.slice(codes, F.lit(2), F.size(codes) - 1),
                          lambda a, b: a * ALPHABET_SIZE + b)

    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - ALPHABET_FROM)
    return F.when(F.length(token) >= 2, let(codes, cells)).otherwise(F.array().cast("array<int>"))


def random_tokens(spark: SparkSession, samples: int = RANDOM_SAMPLES, length: int = RANDOM_LENGTH,
                  seed: int = 1) -> DataFrame:
    """``(label, token, weight)``: strings drawn uniformly from each alphabet."""
    def drawn(alphabet: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substring(
            F.lit(alphabet), (F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(len(alphabet))) + 1).cast("int"),
            F.lit(1))), "")

    both = F.array(*[F.struct(F.lit(name).alias("label"), drawn(alphabet).alias("token"))
                     for name, alphabet in ALPHABETS.items()])
    return (spark.range(samples).select(F.explode(both).alias("s"))
            .select("s.label", "s.token", F.lit(1).cast("long").alias("weight")))


def ordinary_tokens(docs: DataFrame) -> DataFrame:
    """``(label, token, weight)``: the tokens of all documents outside the base spans."""
    rest = F.array_join(F.split(F.coalesce("text", F.lit("")), f"{ASSIGN}|{ACCESS}|{HEX}", -1), " ")
    return (docs.select(F.explode(F.regexp_extract_all(rest, F.lit(_token_pattern(2)), F.lit(0))).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("weight"))
            .select(F.lit(ORDINARY).alias("label"), "token", "weight"))


def joints(tokens: DataFrame) -> DataFrame:
    """A token of letters as the pair of its last and first character: where identifiers join words."""
    return tokens.filter(F.col("token").rlike("^[A-Za-z]+$")).select(
        F.lit(JOINT).alias("label"), F.concat(F.expr("right(token, 1)"), F.expr("left(token, 1)")).alias("token"), "weight")


def with_identifiers(cells: list[int], joint: list[int]) -> list[int]:
    """Counts of the ordinary pairs and of identifiers made of the words.

    The words are written in lower and upper case, joined in snake, kebab and camel
    case, and followed by numbers, once each; all follow from the counted pairs.
    """
    def cell(a: str, b: str) -> int:
        return (ord(a) - ALPHABET_FROM) * ALPHABET_SIZE + ord(b) - ALPHABET_FROM

    out = list(cells)
    for a in LETTERS:
        for b in LETTERS:
            n = cells[cell(a, b)]
            out[cell(a.lower(), b.lower())] += 3 * n
            out[cell(a.upper(), b.upper())] += n
            n = joint[cell(a, b)]                  # a word ends in a, one begins with b
            low, first = a.lower(), b.lower()
            for before, after in ((low, first), (a.upper(), b.upper())):
                out[cell(before, "_")] += n
                out[cell("_", after)] += n
            out[cell(low, "-")] += n
            out[cell("-", first)] += n
            out[cell(low, first.upper())] += n
            out[cell(first.upper(), first)] += n // 26
            for digit in DIGITS:
                out[cell("_", digit)] += n // 10
                out[cell("-", digit)] += n // 10
                out[cell(digit, "-")] += n // 10
                out[cell(low, digit)] += n // 100
                for other in DIGITS:
                    out[cell(digit, other)] += n // 25
    return out


def train(samples: DataFrame, min_length: int = MIN_LENGTH, false_positives: float = FALSE_POSITIVES,
          smoothing: float = 0.5) -> MarkovModel:
    """Fit the models to labelled tokens, ``(label, token, weight)``.

    A pair's probability is smoothed towards its second character's own frequency,
    so after a character that a model has not seen the next one still counts. At
    most one count for each label and cell of the alphabet's square reaches the driver.
    Pairs labelled ``joint`` add identifiers to the ordinary samples.
    """
    counts = (samples.select("label", "weight", F.explode(_pairs(F.col("token"))).alias("cell"))
              .groupBy("label", "cell").agg(F.sum("weight").alias("n")).collect())
    size = ALPHABET_SIZE
    held = {label: [0] * (size * size) for label in (ORDINARY, JOINT, *ALPHABETS)}
    for row in counts:
        if 0 <= row["cell"] < size * size:
            held[row["label"]][row["cell"]] += row["n"]
    held[ORDINARY] = with_identifiers(held[ORDINARY], held.pop(JOINT))
    logs = {}
    for label, cells in held.items():
        total = sum(cells) + smoothing * size
        single = [(sum(cells[c::size]) + smoothing) / total for c in range(size)]
        run = RUN_SHARE if label == ORDINARY else 0.0
        logs[label] = []
        for a in range(size):
            line = cells[a * size:(a + 1) * size]
            weight = smoothing * size
            logs[label] += [math.log((1 - run) * (n + weight * p) / (sum(line) + weight) + run * (a == b))
                            for b, (n, p) in enumerate(zip(line, single))]
    return MarkovModel(tuple(tuple(r - o for r, o in zip(logs[name], logs[ORDINARY])) for name in ALPHABETS),
                       min_length, math.log(len(ALPHABETS) / false_positives))


def fit(docs: DataFrame, min_length: int = MIN_LENGTH, false_positives: float = FALSE_POSITIVES) -> MarkovModel:
    """The models of drawn random strings and of the documents' ordinary tokens."""
    tokens = materialize(ordinary_tokens(docs), "tokens")
    return train(random_tokens(docs.sparkSession).unionByName(tokens).unionByName(joints(tokens)),
                 min_length, false_positives)


def log_ratio(token: Column, model: MarkovModel) -> Column:
    """Log-likelihood ratio of a token, random over ordinary, under the likeliest alphabet."""
    def ratio(pairs: Column, ratios: tuple[float, ...]) -> Column:
        table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
        return let(table, lambda t: F.aggregate(
            pairs, F.lit(0.0), lambda s, cell: s + F.coalesce(F.get(t, cell), F.lit(0.0))))

    return let(_pairs(token), lambda pairs: F.greatest(*[ratio(pairs, r) for r in model.ratios]))


def scan_secrets(docs: DataFrame, model: MarkovModel) -> DataFrame:
    """Per document: base span counts, and all spans as text.

    ``n_random`` counts the added spans, which touch no base span.
    """
    text = F.coalesce("text", F.lit(""))
    base = base_spans(text)
    token = matches(text, _token_pattern(model.min_length))
    found = docs.select("doc_id", *[c.alias(k) for k, c in base.items()], token.alias("tokens"))

    def touches(t: Column, kind: str) -> Column:
        return F.exists(kind, lambda m: (m["start"] < t["end"]) & (t["start"] < m["end"]))

    added = F.filter("tokens", lambda t: ~(touches(t, "assign") | touches(t, "access") | touches(t, "hex"))
                     & (log_ratio(t["value"], model) > model.threshold))
    found = found.select("doc_id", "assign", "access", "hex", added.alias("random"))

    def said(kind: str, order: int) -> Column:
        return F.transform(kind, lambda m: F.struct(
            m["start"].alias("start"), F.lit(order).alias("order"),
            F.concat_ws(":", F.lit(kind), m["start"].cast("string"),
                        m["end"].cast("string")).alias("said")))

    def listed(kinds: list[str]) -> Column:
        spans = F.concat(*[said(k, i) for i, k in enumerate(kinds)])
        return F.array_join(F.transform(F.array_sort(spans), lambda s: s["said"]), ",")

    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.encode(listed(["assign", "access", "hex"]), "UTF-8"), 256).alias("base_sha256"),
        listed(["assign", "access", "hex", "random"]).alias("spans"),
        F.size("random").cast("long").alias("n_random"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit the models with the tokens of all documents, then scan every document."""
    docs = read(spark, sf_dir, "documents")
    return scan_secrets(docs, fit(docs))
