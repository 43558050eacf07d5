"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

For every prefix of a pre-token the last token of its encoding is found from the shorter prefixes: it is
the one vocabulary entry that ends there and can follow the last token of what precedes it.  So the count
of every prefix follows from one shorter prefix, and truncation and budget questions are lookups.

Defined cases: a null text is empty and has no tokens; the special token's string inside a text is that
one token; equal texts give equal counts; rows are kept as they come, repeated ones too.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlens.llm.common import documents, map_rows, text_or_empty

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose count a worker remembers.
CACHE = 500_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


CONTRACTIONS = ("'re", "'ve", "'ll")
#: The run of white space from a place on.
WHITE = regex.compile(r"\s+").match
#: A space after white space or at the text's start.
WIDE_SPACE = regex.compile(r"(?:\s|^) ").search


class AfterSpace(dict):
    """Tokens of a space and the word after it."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self.counter.split_total(" " + word)
        if len(word) < 64:
            self[word] = n
        return n


class PrefixCounter:
    """Exact token counts of all prefixes of a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        added = set(self.special)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        #: Every beginning of a token: its id, or -1 where it only begins longer ones.
        self.begins = {t[:i]: -1 for t in self.ids for i in range(1, len(t))} | self.ids
        self.token = {i: t for t, i in self.ids.items()}
        self.split, self.lazy = regex.compile(PATTERN).findall, regex.compile(PATTERN).finditer
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.follows: dict[int, bool] = {}
        self.totals: dict[str, int] = {}
        self.after_space = AfterSpace(self)

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE of a short string: used for one token or a pair of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def can_follow(self, pair: int) -> bool:
        """Whether BPE leaves two neighbouring tokens (or, with -1 first, one token) as they are."""
        a, b = (pair >> 20) - 1, pair & 0xFFFFF
        parts = [self.token[b]] if a < 0 else [self.token[a], self.token[b]]
        if len(self.follows) > 4 * CACHE:
            self.follows.clear()
        known = self.follows[pair] = self.merge(b"".join(parts)) == parts
        return known

    def prefixes(self, data: bytes) -> list[int]:
        """counts[i]: tokens of data[:i], for one pre-token.  last[i] is one more than the last token's id."""
        n = len(data)
        counts, last = [0] * (n + 1), [0] * (n + 1)
        begins, follows, can_follow = self.begins.get, self.follows.get, self.can_follow
        for start in range(n):
            before, count = last[start] << 20, counts[start] + 1
            for end in range(start + 1, n + 1):
                token = begins(data[start:end])
                if token is None:
                    break
                if token >= 0 and not last[end]:
                    known = follows(before | token)
                    if known or known is None and can_follow(before | token):
                        last[end], counts[end] = token + 1, count
        return counts

    def pieces(self, text: str):
        """(piece, is special) in order."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from ((p, False) for p in self.split(text[at : m.start()]))
            yield m.group(), True
            at = m.end()
        yield from ((p.group(), False) for p in self.lazy(text[at:] if at else text))

    def total(self, text: str) -> int:
        """Tokens of a whole text.

        No piece crosses a space that follows a non-space, so the words between single spaces are counted
        apart, each with the space before it; a text with other white space before a space is split whole.
        """
        if not any(s in text for s in self.special) and not WIDE_SPACE(text):
            first, *rest = text.split(" ")
            return self.split_total(first) + sum(map(self.after_space.__getitem__, rest))
        return self.split_total(text)

    def split_total(self, text: str) -> int:
        totals, n = self.totals, 0
        plain = not any(s in text for s in self.special)
        for piece in self.split(text) if plain else (p if not s else None for p, s in self.pieces(text)):
            if piece is None:
                n += 1
                continue
            count = totals.get(piece)
            n += self.count(piece) if count is None else count
        return n

    def count(self, piece: str) -> int:
        """Tokens of one pre-token; those of short ones are remembered."""
        totals = self.totals
        count = totals.get(piece)
        if count is None:
            if len(totals) > CACHE:
                totals.clear()
            count = self.prefixes(piece.encode("utf-8", "surrogatepass"))[-1]
            if len(piece) < 64:
                totals[piece] = count
        return count

    def by_character(self, piece: str) -> list[int]:
        """Tokens of piece[:1], piece[:2], ... as pre-tokens: one table for all of them."""
        counts = self.prefixes(piece.encode("utf-8", "surrogatepass"))
        if piece.isascii():
            return counts[1:]
        ends, out = 0, []
        for c in piece:
            ends += len(c.encode("utf-8", "surrogatepass"))
            out.append(counts[ends])
        return out

    def walk(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """For each piece in order: a bound that no later count is under, and the counts of text[:i] for each end i in it.

        A cut inside a piece leaves a shorter piece of its kind, whose count is in the piece's table.  But a cut
        behind white space joins the whole run of it to one piece, which has a table of its own; a contraction
        or a special token that is cut is split anew, and these are short.
        """
        done, start, run, run_done = 0, 0, 0, 0  # run: where the white space before begins, and the tokens up to there
        spaces: list[int] = []
        for piece, special in self.pieces(text):
            if not special and piece[0].isspace() and run == start:
                end = WHITE(text, start).end()
                spaces = self.by_character(text[start:end])
            if special:
                inner = [run_done + sum(self.prefixes(p.encode("utf-8", "surrogatepass"))[-1] for p in self.split(text[run : start + i])) for i in range(1, len(piece))]
                counts, whole = [*inner, done + 1], 1
            elif piece.isspace():
                own = self.by_character(piece)
                counts, whole = [run_done + spaces[start + i - run] for i in range(len(piece))], own[-1]
            else:
                counts = [done + n for n in self.by_character(piece)]
                whole = counts[-1] - done
                if piece[0].isspace():
                    counts[0] = run_done + spaces[start - run]
                if piece in CONTRACTIONS:
                    counts[:-1] = [done + sum(self.prefixes(p.encode())[-1] for p in self.split(piece[:i])) for i in range(1, len(piece))]
            yield run_done, counts
            done += whole
            start += len(piece)
            if special or not piece.isspace():
                run, run_done = start, done

    def all_prefixes(self, text: str) -> list[int]:
        """counts[i]: tokens of text[:i] as if it were encoded alone, for every code point i."""
        counts = [0]
        for _, part in self.walk(text):
            counts += part
        return counts

    def longest(self, text: str, budget: int) -> int:
        """The most code points whose encoding has at most ``budget`` tokens.

        Counts at the ends of words that single spaces part never fall, so the answer lies behind the last such
        end within the budget; from there on counts are made by character until they can't come back to it.
        """
        start = done = 0
        if not any(s in text for s in self.special) and not WIDE_SPACE(text):
            first, *rest = text.split(" ", budget + 1)  # each word has a token at least
            ends = list(accumulate(map(self.after_space.__getitem__, rest[:budget]), initial=self.split_total(first)))
            if within := bisect_right(ends, budget):
                start, done = len(first) + sum(map(len, rest[: within - 1])) + within - 1, ends[within - 1]
        best = at = start
        for least, part in self.walk(text[start:] if start else text):
            if done + least > budget:
                break
            for i, count in enumerate(part, at + 1):
                if done + count <= budget:
                    best = i
            at += len(part)
        return best


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per worker and vocabulary, with its caches."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(df: DataFrame, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", vocabulary_name: str = "byte_bpe_50k.json") -> DataFrame:
    """id, n_bytes, n_tokens of each whole text, over_limit, kept_chars (the most code points within the limit)."""

    def count(ids: list, texts: list) -> dict:
        own = counter(vocabulary(vocabulary_name))
        totals = [own.total(t) for t in texts]
        kept = [len(t) if n <= limit else own.longest(t, limit) for t, n in zip(texts, totals, strict=True)]
        return {id_col: ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": totals, "over_limit": [n > limit for n in totals], "kept_chars": kept}

    return map_rows(df.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text")), count, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_name: str = "byte_bpe_50k.json") -> DataFrame:
    """id and the counts of all prefixes; entry i (from 0) belongs to the first i code points."""

    def count(ids: list, texts: list) -> dict:
        own = counter(vocabulary(vocabulary_name))
        return {id_col: ids, "prefix_tokens": [own.all_prefixes(t) for t in texts]}

    return map_rows(df.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("text")), count, f"{id_col} long, prefix_tokens array<int>", rows=64)


def tokens_at(n_chars) -> F.Column:
    """Tokens of the first n_chars code points, from a stored table of prefixes."""
    return F.element_at("prefix_tokens", F.least(F.lit(n_chars) + 1, F.size("prefix_tokens")).cast("int"))


def longest_within(budget: int) -> F.Column:
    """The most code points whose encoding has at most ``budget`` tokens."""
    fits = F.transform("prefix_tokens", lambda n, i: F.when(n <= F.lit(budget), i).otherwise(F.lit(-1)))
    return F.array_max(fits)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), limit=1024)
