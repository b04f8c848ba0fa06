"""Operator 11: SentencePiece encoding and decoding by vectorised merge rounds.

A batch of texts is cut into words where no piece of the vocabulary can span the
cut, and each distinct word is encoded once. The symbols of all words lie in one
flat array. A round finds every word's best (smallest) pair rank with a segmented
minimum, merges all leftmost occurrences of it at once, and compacts the arrays;
words without a pair that a piece could span leave. Rounds end when none is left.

Merging all occurrences in one round equals the library's one merge at a time,
unless a piece that holds the merged one has the same or a better rank: it would
be merged before the next occurrence. For such pieces, which the vocabulary tells,
a round merges the word's leftmost occurrence alone.

A pair that no piece spans cuts its word in two, so a long word soon falls into
short ones. The cost is the number of rounds (merges of the longest undivided run)
times the symbols still open.

Edge cases: ``encode`` gives a null text a null list and an empty text an empty
one; characters outside the vocabulary become byte pieces; strings of control
symbols in a text are plain characters. ``decode`` gives null for a null list,
skips null entries, and turns bytes that are no UTF-8 into U+FFFD, one a byte.
Both add one column and keep all others, whatever their names. The batch of rows
that Spark hands over is worked in slices of ``SLICE_BYTES`` of text cut between
words, so one very long text is no larger step than many short ones.
"""

from __future__ import annotations

import codecs
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from textindex.llm.common import read

SPACE = "▁"
SLICE_BYTES = 8 << 20
_CHARACTERS = 0x110000
_NONE = np.iinfo(np.int32).max      # rank of a pair that is no piece
# kinds of pieces in a model file (fixed values of its format)
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, data[at:at + n]
        at += n


@dataclass(frozen=True)
class PieceModel:
    """What a model file says, and the tables that encoding and decoding look up."""
    pieces: tuple[str, ...]
    kinds: np.ndarray
    ranks: np.ndarray           # of each piece: 0 is merged first; equal scores share a rank
    first_only: np.ndarray      # pieces of which a round merges one occurrence a word
    byte_ids: np.ndarray        # ids of the 256 byte pieces
    pairs: np.ndarray           # sorted keys of the pairs that some piece spans
    merged: np.ndarray          # what each becomes, -1 if that is no piece itself
    characters: np.ndarray      # symbol of each code point that is a piece, else -1
    dummy_prefix: bool
    unknown_surface: str
    space_run: int              # runs of spaces are cut in blocks of so many; 0: they are not

    @property
    def base(self) -> int:
        return len(self.pieces) + _CHARACTERS

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a BPE model with byte pieces whose normalisation is the identity."""
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if (trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normalizer.get(2)
                or normalizer.get(4, 1) or not normalizer.get(5, 1) or set(kinds) - {1, 2, 3, 6}):
            raise ValueError(f"{path} is not a BPE model with byte pieces and identity normalisation")
        return cls.build(pieces, scores, kinds, bool(normalizer.get(3, 1)),
                         trainer.get(44, " ⁇ ".encode()).decode())

    @classmethod
    def build(cls, pieces: list[str], scores: list[float], kinds: list[int], dummy_prefix: bool = True,
              unknown_surface: str = " ⁇ ") -> PieceModel:
        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        ranks = np.full(len(pieces), _NONE, np.int32)
        for i in ids.values():
            ranks[i] = order[scores[i]]
        base = len(pieces) + _CHARACTERS

        def symbol(s: str) -> int | None:
            return ids.get(s, len(pieces) + ord(s) if len(s) == 1 else None)

        first_only = np.zeros(len(pieces), bool)
        spanned: dict[int, int] = {}
        for piece, i in ids.items():
            n = len(piece)
            for a in range(n):
                for b in range(a + 1, n + 1):
                    inner = ids.get(piece[a:b])
                    if inner is not None and b - a < n and ranks[inner] >= ranks[i]:
                        first_only[inner] = True
            parts = {(a, b): symbol(piece[a:b]) for a in range(n) for b in range(a + 1, n + 1)}
            for (a, b), left in parts.items():
                if left is None:
                    continue
                for c in range(b + 1, n + 1):
                    right = parts[b, c]
                    if right is not None:
                        spanned[left * base + right] = ids.get(piece[a:c], -1)
        keys = np.array(sorted(spanned), np.int64)
        characters = np.full(_CHARACTERS, -1, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                characters[ord(piece)] = i
        bytes_ = np.array([i for i, k in enumerate(kinds) if k == BYTE], np.int32)
        known = cls(tuple(pieces), np.array(kinds, np.int8), ranks, first_only, bytes_, keys,
                    np.array([spanned[k] for k in keys.tolist()], np.int32), characters,
                    dummy_prefix, unknown_surface, 0)
        return replace(known, space_run=known._space_run(ids))

    def _space_run(self, ids: dict[str, int]) -> int:
        """Length of the longest piece of spaces, if long runs of spaces begin with it.

        That is so where pieces of spaces are merged after all others and share a
        rank: the leftmost grows first, and is complete before what follows it.
        """
        runs = {p: i for p, i in ids.items() if set(p) == {SPACE} and len(p) > 1}
        if not runs or {i for i in ids.values() if self.ranks[i] >= min(self.ranks[list(runs.values())])
                        } - {ids.get(SPACE)} != set(runs.values()):
            return 0
        if len({int(self.ranks[i]) for i in runs.values()}) != 1:
            return 0
        n = max(map(len, runs))
        symbols = np.full(4 * n, self.characters[ord(SPACE)], np.int32)
        left, _ = self.merge(symbols, np.arange(4 * n) == 4 * n - 1)
        return n if left.tolist() == [runs[SPACE * n]] * 4 else 0

    # -- encoding ------------------------------------------------------------

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of symbols become (-1: no piece), and whether any piece spans them."""
        keys = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        spanned = self.pairs[at] == keys
        return np.where(spanned, self.merged[at], -1), spanned

    def _rank(self, pieces: np.ndarray) -> np.ndarray:
        return np.where(pieces >= 0, self.ranks[pieces], _NONE)

    def merge(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words laid end to end; ``ends`` marks each word's last symbol.

        Gives the symbols that remain and, for each, the place of its first symbol.
        """
        place = np.arange(len(symbols))
        done_at, done = [], []

        def pair_up(last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            becomes = np.full(len(symbols), -1, np.int32)
            inside = np.flatnonzero(~last)
            becomes[inside], spanned = self._look_up(symbols[inside], symbols[inside + 1])
            last = last.copy()
            last[inside[~spanned]] = True
            return becomes, self._rank(becomes), last

        becomes, rank, ends = pair_up(ends)
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], ends[:-1]]))
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.minimum.reduceat(rank, starts)
            open_ = np.repeat(best != _NONE, sizes)
            if not open_.all():
                done_at.append(place[~open_])
                done.append(symbols[~open_])
                symbols, place, ends = symbols[open_], place[open_], ends[open_]
                becomes, rank = becomes[open_], rank[open_]
                sizes, best = sizes[best != _NONE], best[best != _NONE]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            # a run of hits overlaps by one symbol: take every second, from the left
            fresh = np.concatenate([[True], np.diff(hits) != 1])
            run = np.flatnonzero(fresh)
            nth = np.arange(len(hits)) - np.repeat(run, np.diff(np.append(run, len(hits))))
            take = nth % 2 == 0
            alone = self.first_only[becomes[hits]]
            if alone.any():
                word = np.repeat(np.arange(len(sizes)), sizes)[hits]
                lead = np.concatenate([[True], word[1:] != word[:-1]])
                # ranks may be shared: one careful piece makes its word careful
                careful = np.zeros(len(sizes), bool)
                careful[word[alone]] = True
                take &= lead | ~careful[word]
            hits = hits[take]
            symbols[hits] = becomes[hits]
            ends[hits] = ends[hits + 1]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            moved = np.cumsum(keep) - 1
            symbols, place, ends, becomes, rank = (
                symbols[keep], place[keep], ends[keep], becomes[keep], rank[keep])
            hits = moved[hits]
            near = np.zeros(len(symbols), bool)
            near[hits] = True
            near[hits[hits > 0] - 1] = True
            touched = np.flatnonzero(near)
            becomes[touched], rank[touched] = -1, _NONE
            touched = touched[~ends[touched]]
            becomes[touched], spanned = self._look_up(symbols[touched], symbols[touched + 1])
            rank[touched] = self._rank(becomes[touched])
            ends[touched[~spanned]] = True
        if not done:
            return symbols, place
        at = np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        return np.concatenate(done)[order], at[order]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a large binary array of words, and their number for each word; none is empty."""
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        text = str(memoryview(words.buffers()[2])[int(bounds[0]):int(bounds[-1])], "utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int32)
        sizes = pc.utf8_length(words.cast(pa.large_string())).to_numpy(zero_copy_only=False)
        last = np.cumsum(sizes) - 1
        ends = np.zeros(len(points), bool)
        ends[last] = True
        points[points == 32] = ord(SPACE)
        symbols = self.characters[points]
        symbols = np.where(symbols < 0, len(self.pieces) + points, symbols).astype(np.int32)
        symbols, place = self.merge(symbols, ends)
        word = np.searchsorted(last, place)
        strange = np.flatnonzero(symbols >= len(self.pieces))
        if len(strange):
            spelled = [self.byte_ids[list(chr(c).encode())] for c in (symbols[strange] - len(self.pieces)).tolist()]
            n = np.ones(len(symbols), np.int64)
            n[strange] = [len(s) for s in spelled]
            at = np.cumsum(n) - n
            out = np.repeat(symbols, n)
            for start, ids in zip(at[strange].tolist(), spelled):
                out[start:start + len(ids)] = ids
            symbols, word = out, np.repeat(word, n)
        return symbols, np.bincount(word, minlength=len(words))

    def _word_starts(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Places of the bytes that begin a word: a row's first, the first space of a run."""
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[rows] = True
        if self.space_run:
            first = np.flatnonzero(space & start)
            ends = np.flatnonzero(np.concatenate([~space[1:] | start[1:], [True]]) & space) + 1
            long = np.flatnonzero(ends - first >= 2 * self.space_run)
            for a, b in zip(first[long].tolist(), ends[long].tolist()):
                # what is left, of one to two blocks, goes with the word that follows
                start[a + self.space_run:b - self.space_run + 1:self.space_run] = True
        return np.flatnonzero(start)

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list of ids for each text."""
        null = pc.is_null(texts)
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
        if self.dummy_prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(
                pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] \
            if len(texts) else np.zeros(1, np.int64)
        n = int(bounds[-1] - bounds[0])
        if not n:
            ids, per_row = np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        else:
            raw = texts.buffers()[2].slice(int(bounds[0]), n)
            rows = bounds - bounds[0]
            starts = np.append(self._word_starts(np.frombuffer(raw, np.uint8), rows[:-1][np.diff(rows) > 0]), n)
            counts = np.zeros(len(starts), np.int64)     # ids before each word
            out = []
            a = 0
            while a < len(starts) - 1:
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + SLICE_BYTES, "right")) - 1)
                words = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), b - a, [None, pa.py_buffer(starts[a:b + 1].astype(np.int64)), raw])
                coded = words.dictionary_encode()
                flat, sizes = self.encode_words(coded.dictionary)
                lists = pa.LargeListArray.from_arrays(
                    np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pa.array(flat, pa.int32()))
                out.append(lists.take(coded.indices).flatten().to_numpy())
                counts[a + 1:b + 1] = sizes[coded.indices.to_numpy()]
                a = b
            ids = np.concatenate(out)
            per_row = np.cumsum(counts)[np.searchsorted(starts, rows)]
            per_row = np.diff(per_row)
        offsets = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()),
                                        mask=null if null.true_count else None)

    # -- decoding ------------------------------------------------------------

    def surfaces(self) -> pa.Array:
        """The bytes that each id stands for."""
        out = []
        byte = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids)}
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds.tolist())):
            out.append({CONTROL: b"", UNKNOWN: self.unknown_surface.encode()}.get(kind)
                       if kind in (CONTROL, UNKNOWN) else byte.get(i, piece.replace(SPACE, " ").encode()))
        return pa.array(out, pa.large_binary())

    def decode(self, lists: pa.Array, surfaces: pa.Array) -> pa.Array:
        """The text of each list of ids."""
        codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))
        spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, k in zip(self.pieces, self.kinds)])
        silent = self.kinds == CONTROL
        out = []
        bounds = lists.offsets.to_numpy()
        known = lists.is_valid().to_numpy(zero_copy_only=False)
        values = lists.values
        a = 0
        while a < len(lists):       # rows of about SLICE_BYTES / 4 ids at a time
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE_BYTES // 4, "right")) - 1)
            ids = values.slice(int(bounds[a]), int(bounds[b] - bounds[a]))
            at = bounds[a:b + 1] - bounds[a]
            if ids.null_count:
                valid = ids.is_valid().to_numpy(zero_copy_only=False)
                at = np.concatenate([[0], np.cumsum(valid)])[at]
                ids = ids.drop_null()
            numbers = ids.to_numpy()
            spelled = surfaces.take(ids)
            ends = np.frombuffer(spelled.buffers()[1], np.int64)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
            data = memoryview(spelled.buffers()[2]) if len(ids) and ends[-1] else memoryview(b"")
            for row in range(b - a):
                if not known[a + row]:
                    out.append(None)
                    continue
                first, end = int(at[row]), int(at[row + 1])
                while first < end and silent[numbers[first]]:
                    first += 1
                skip = int(self.dummy_prefix and first < end and spaced[numbers[first]])
                # a control symbol parts the bytes of a character
                cuts = [first, *(first + np.flatnonzero(silent[numbers[first:end]])).tolist(), end]
                parts = [str(data[int(ends[i]) + (skip if i == first else 0):int(ends[j])], "utf-8", "each-byte")
                         for i, j in zip(cuts, cuts[1:])]
                out.append("".join(parts))
            a = b
        return pa.array(out, pa.string())


def encode(df: DataFrame, model: PieceModel, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with ``out``, the ids of the column ``text``."""
    shared = df.sparkSession.sparkContext.broadcast(model)   # as large as the vocabulary

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return shared.value.encode(texts)

    return df.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, model: PieceModel, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text of the list of ids in the column ``ids``."""
    shared = df.sparkSession.sparkContext.broadcast((model, model.surfaces()))

    @arrow_udf("string")
    def texts(lists: pa.Array) -> pa.Array:
        known, surfaces = shared.value
        return known.decode(lists, surfaces)

    return df.withColumn(out, texts(F.col(ids)))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every document's text encoded and decoded; ``model`` is the path of a model file."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    loaded = PieceModel.load(model)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = decode(encode(docs, loaded).drop("text"), loaded)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
