"""SentencePiece encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda by score.  Each candidate that comes up is skipped by a draw of its own: a hash
of the seed, the document, the copy and the word's place gives the gaps between skipped candidates, as many
candidates long as independent draws would make them.  So each occurrence of a word is drawn anew, a seed gives
the same segmentations again, and every segmentation is made of the model's own merges.

The words of a batch of texts that have a skip go through their agendas together, a turn of all words at a time,
as rows of arrays of piece ids.  Only what doesn't depend on a draw is kept between batches: the ids of a word of
which nothing is skipped.

Defined cases: a null or empty text has no pieces; U+2581 in a text comes back as a space, as in the model's
own decoder (``lossless`` is false there); all other texts come back whole; a row without id is named by its
text; repeated rows give equal rows, unless ``copies`` numbers them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlens.llm.common import documents, map_rows, row_key, text_or_empty
from kvlens.llm.tokens import vocabulary

SPACE = "▁"
#: Words whose ids without skips a worker remembers; longer words than LONG go through their agenda alone.
CACHE, LONG = 400_000, 48
MASK = (1 << 64) - 1
#: A gap that no word reaches.
NEVER = 1 << 62


def mixed(x: int) -> int:
    x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & MASK
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & MASK
    return x ^ (x >> 32)


def mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def place_hashes(key: int, n: int) -> np.ndarray:
    """Hashes of the places 0 to n - 1 under one key."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def first_gaps(hashes: np.ndarray, dropout: float) -> np.ndarray:
    """Candidates taken before the first that is skipped."""
    if dropout <= 0:
        return np.full(len(hashes), NEVER)
    if dropout >= 1:
        return np.zeros(len(hashes), np.int64)
    unit = ((hashes >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
    return np.minimum(np.log(unit) / log1p(-dropout), 1e18).astype(np.int64)


def skipped_turns(first: int, h: int, dropout: float) -> Iterator[int]:
    """The turns that are skipped, ascending, without end."""
    turn = first
    while True:
        yield turn
        h = mixed(h + 0x9E3779B97F4A7C15 & MASK)
        turn += 1 if dropout >= 1 else 1 + int(log(((h >> 11) + 1) * 2.0**-53) / log1p(-dropout))


class Numbers(dict):
    """A number for each word, in the order of their first use; ``new`` has those not yet encoded."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at ``starts``, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class DropoutEncoder:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        kinds = [(i, self.model.id_to_piece(i)) for i in range(n)]
        self.score = {p: self.model.get_score(i) for i, p in kinds if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))}
        self.ids = {p: i for i, p in kinds}
        self.own = {p: self.ids[p] for p in self.score}
        self.pieces = [p for _, p in kinds]
        self.byte_id = [self.ids[f"<0x{b:02X}>"] for b in range(256)]
        of_byte = {i: bytes((b,)) for b, i in enumerate(self.byte_id)}
        self.raw = [of_byte.get(i, p.encode()) for i, p in kinds]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.score):
            raise ValueError("a piece crosses a word's start; words can't be encoded apart")
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        # Merges as sorted keys of two ids, with the score and the id that they make.
        joined = [(self.own[p[:i]] << 20 | self.own[p[i:]], self.score[p], n) for p, n in self.own.items() for i in range(1, len(p)) if p[:i] in self.own and p[i:] in self.own]
        keys, scores, made = (np.array(x) for x in zip(*joined, strict=True))
        order = np.argsort(keys)
        self.keys, self.key_scores, self.made = keys[order], scores[order].astype(np.float32), made[order].astype(np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for p, n in self.own.items():
            if len(p) == 1:
                self.of_char[ord(p)] = n
        inside = set("".join(self.own))
        for b in range(128):  # characters of no piece are their byte, which nothing merges with
            if chr(b) not in inside:
                self.of_char[b] = self.byte_id[b]
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.flat, self.starts, self.turns, self.lengths = (np.empty(0, t) for t in (np.int32, np.int64, np.int64, np.int64))

    def segment(self, word: str, skips: Iterator[int]) -> tuple[list[str], int, tuple[int, ...]]:
        """Pieces, the number of turns and those skipped.

        Agenda: best score first, then leftmost; a turn is a candidate whose pieces both still stand, and one
        that is skipped is never merged.
        """
        n = len(word)
        score = self.score
        turn, skip, skipped = 0, next(skips), []
        end = list(range(1, n + 1))  # of the piece that begins here; 0 when none does
        before = list(range(-1, n - 1))
        agenda = [(-s, i, i + 1, i + 2) for i in range(n - 1) if (s := score.get(word[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, a, b, e = heappop(agenda)
            if end[a] != b or end[b] != e:
                continue
            turn += 1
            if turn > skip:
                skipped.append(skip)
                skip = next(skips)
                continue
            end[a], end[b] = e, 0
            if e < n:
                before[e] = a
                s = score.get(word[a : end[e]])
                if s is not None:
                    heappush(agenda, (-s, a, e, end[e]))
            if a:
                c = before[a]
                s = score.get(word[c:e])
                if s is not None:
                    heappush(agenda, (-s, c, a, e))
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out, turn, tuple(skipped)

    def piece_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            i = self.own.get(piece)
            if i is None:
                out.extend([self.byte_id[b] for b in piece.encode("utf-8")])
            else:
                out.append(i)
        return out

    def merge_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score (-inf if none) and id of what two pieces make."""
        wanted = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.key_scores[at], np.float32(-np.inf)), self.made[at]

    def rows(self, ids: np.ndarray, skip: np.ndarray, h: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """segment() of words of one length, as rows of the ids of their characters: ids in order, their number a row."""
        n, size = ids.shape
        stands = np.ones((n, size), bool)
        after = np.tile(np.arange(1, size + 1), (n, 1))
        before = after - 2
        score, made = np.full((n, size), -np.inf, np.float32), np.zeros((n, size), np.int32)
        if size > 1:
            score[:, :-1], made[:, :-1] = self.merge_of(ids[:, :-1], ids[:, 1:])
        skip, h, turn, row = skip.copy(), h.copy(), 0, np.arange(n)
        while len(row):
            a = score[row].argmax(1)
            left = score[row, a] > -np.inf
            row, a = row[left], a[left]
            skips = skip[row] == turn
            turn += 1
            r, c = row[skips], a[skips]
            if len(r):
                score[r, c] = -np.inf
                h[r] = mixed_all(h[r] + np.uint64(0x9E3779B97F4A7C15))
                skip[r] += 1 + first_gaps(h[r], dropout)
            r, c = row[~skips], a[~skips]
            b = after[r, c]
            e = after[r, b]
            ids[r, c], after[r, c], stands[r, b], score[r, b], score[r, c] = made[r, c], e, False, -np.inf, -np.inf
            x = np.flatnonzero(e < size)
            rx, cx, ex = r[x], c[x], e[x]
            before[rx, ex] = cx
            score[rx, cx], made[rx, cx] = self.merge_of(ids[rx, cx], ids[rx, ex])
            x = np.flatnonzero(c > 0)
            rx, cx = r[x], c[x]
            bx = before[rx, cx]
            score[rx, bx], made[rx, bx] = self.merge_of(ids[rx, bx], ids[rx, cx])
        return ids[stands], stands.sum(1)

    def segment_all(self, words: list[str], first: np.ndarray, h: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, the number of each word's ids, and its turns where nothing is skipped."""
        if not words:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = self.of_char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(size) - size
        alone = (np.minimum.reduceat(chars, starts) < 0) | (size > LONG)
        lengths, turns, parts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), []
        for n in np.unique(size[~alone]).tolist():
            at = np.flatnonzero(~alone & (size == n))
            ids, found = self.rows(chars[starts[at][:, None] + np.arange(n)], first[at], h[at], dropout)
            lengths[at], turns[at] = found, n - found
            parts.append((at, ids))
        for i in np.flatnonzero(alone).tolist():  # bytes, rare characters and very long words
            pieces, turns[i], _ = self.segment(words[i], skipped_turns(int(first[i]), int(h[i]), dropout))
            ids = self.piece_ids(pieces)
            lengths[i] = len(ids)
            parts.append((np.array([i]), np.array(ids, np.int32)))
        flat, places = np.empty(int(lengths.sum()), np.int32), np.cumsum(lengths) - lengths
        for at, ids in parts:
            flat[spread(places[at], lengths[at])] = ids
        return flat, lengths, turns

    def encode_all(self, texts: list[str], seed: int, docs: list[int], copies: list[int], dropout: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin and end."""
        found = [self.words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = list(chain.from_iterable(found))
        keys = (mixed(mixed(mixed(seed & MASK) ^ doc & MASK) + copy & MASK) for doc, copy in zip(docs, copies, strict=True))
        hashes = np.concatenate([np.empty(0, np.uint64), *(place_hashes(k, len(w)) for k, w in zip(keys, found, strict=True))])
        first = first_gaps(hashes, dropout)
        if len(self.numbers) > CACHE:
            self.forget()
        number = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if new := self.numbers.new:
            never = np.full(len(new), NEVER)
            flat, lengths, turns = self.segment_all(new, never, never.astype(np.uint64), dropout)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.flat, self.lengths, self.turns = (np.concatenate(x) for x in ((self.flat, flat), (self.lengths, lengths), (self.turns, turns)))
            new.clear()
        starts, lengths = self.starts[number], self.lengths[number]
        varied = np.flatnonzero(first < self.turns[number])
        flat, own, _ = self.segment_all([words[i] for i in varied.tolist()], first[varied], hashes[varied], dropout)
        starts[varied], lengths[varied] = len(self.flat) + np.cumsum(own) - own, own
        ends = np.r_[0, np.cumsum(lengths)]
        return np.concatenate([self.flat, flat])[spread(starts, lengths)], ends[np.cumsum([0, *map(len, found)])]

    def encode(self, text: str, seed: int, doc: int, copy: int, dropout: float) -> list[int]:
        return self.encode_all([text], seed, [doc], [copy], dropout)[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")[1:]


_encoders: dict[str, DropoutEncoder] = {}


def encoder(path: str) -> DropoutEncoder:
    if path not in _encoders:
        _encoders[path] = DropoutEncoder(path)
    return _encoders[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", seed: int = 1, dropout: float = 0.1, copies: bool = False) -> DataFrame:
    """id, piece_ids, n_pieces, lossless (whether decoding the ids gives the text again).

    With ``copies`` the rows of one id and text are numbered (they are shuffled for this) and drawn apart.
    """

    def run(ids: list, keys: list, numbers: list, texts: list) -> dict:
        own = encoder(vocabulary(model))
        flat, offsets = own.encode_all(texts, seed, keys, numbers, dropout)
        all_ids, at = flat.tolist(), offsets.tolist()
        same = [own.decode(all_ids[a:b]) == text for a, b, text in zip(at, at[1:], texts, strict=False)]
        arrays = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
        return {id_col: ids, "piece_ids": arrays, "n_pieces": np.diff(offsets), "lossless": same}

    alike = Window.partitionBy("key", F.xxhash64("text")).orderBy(F.lit(0))
    keyed = df.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), text_or_empty(text_col).alias("text"))
    numbered = keyed.withColumn("number", (F.row_number().over(alike) - 1) if copies else F.lit(0))
    return map_rows(numbered.select("id", "key", "number", "text"), run, f"{id_col} long, piece_ids array<int>, n_pieces long, lossless boolean", rows=1024)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "piece_ids", model: str = "piece_bpe_32k.model") -> DataFrame:
    """id, text: null ids give an empty text."""

    def run(ids: list, pieces: list) -> dict:
        own = encoder(vocabulary(model))
        return {id_col: ids, "text": [own.decode(p or []) for p in pieces]}

    return map_rows(df.select(F.col(id_col).cast("long").alias(id_col), ids_col), run, f"{id_col} long, text string", rows=256)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
