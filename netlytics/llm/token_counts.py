"""Token counts by prefix dynamic programming.

For byte-pair encoding the last token of the encoding of every prefix of a word is unique: among the
vocabulary entries that end there, exactly one forms, with the last token of the prefix before it, a
pair that the merges leave alone.  One pass over a word therefore yields the exact token count of
*every* prefix.  A text is cut into words by the tokenizer's own pattern; the counts at the word ends
are summed.  ``PrefixIndex`` stores the exact count of every prefix of a text, so that truncation and budget
questions are look-ups, without encoding anything again.

Nulls count as the empty text (0 tokens), repeated rows are counted like any others, an empty table
gives an empty result, texts of any length are counted whole, ids may be of any type, and columns other than the two named are not looked at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bounded

#: The byte-level tokenizers' word pattern (a fixed public value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = 1 << 60
_SPACES = regex.compile(r"\s+")
_CACHED_WORD, _CACHED_WORDS, _CACHED_GRIDS = 48, 500_000, 100_000


def _byte_chars() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixTokenizer:
    """Exact prefix token counts for a byte-level BPE ``.json`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE files are supported")
        of = _byte_chars()
        to_bytes = lambda s: bytes(of[c] for c in s)
        self.vocab = {to_bytes(k): v for k, v in spec["model"]["vocab"].items() if all(c in of for c in k)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        self.ends = ahocorasick.Automaton()
        for piece in self.vocab:
            self.ends.add_word(piece.decode("latin-1"), piece)
        self.ends.make_automaton()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pattern = regex.compile(WORDS)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.grown: dict[bytes, tuple[list, list] | None] = {}
        self.words: dict[str, int] = {}
        self.grids: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[tuple]:
        """Plain BPE of a short string: the trees (bytes, left, right, highest rank inside) that no merge joins any more."""
        parts = [(word[i : i + 1], None, None, -1) for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a[0], b[0]), _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == _NEVER:
                break
            a, b = parts[at : at + 2]
            parts[at : at + 2] = [(a[0] + b[0], a, b, max(rank, a[3], b[3]))]
        return parts

    def edges(self, token: bytes) -> tuple[list, list] | None:
        """How the first and the last part of a token grow under the merges: (part, when it is joined into the next); None for a token that the merges never make."""
        known = self.grown.get(token, 0)
        if known == 0:
            parts, known = self.merge(token), None
            if len(parts) == 1:
                known = ([], [])
                for side, out in zip((1, 2), known, strict=True):
                    node, until = parts[0], _NEVER
                    while node:
                        out.append((node[0], until))
                        node, until = node[side], node[3]
                    out.reverse()
            self.grown[token] = known
        return known

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave the two tokens apart (an empty left: whether they make the right one at all).

        The parts that touch are followed through the merges.  They are joined if their own merge comes
        before the next one on either side (of equal merges the leftmost comes first).
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            ends, starts = self.edges(left) if left else True, self.edges(right)
            known = bool(ends and starts)
            if known and left:
                ends, i, j = ends[1], 0, 0
                while True:
                    (a, a_until), (b, b_until) = ends[i], starts[0][j]
                    rank = self.ranks.get((a, b), _NEVER)
                    if rank < a_until and rank <= b_until and rank < _NEVER:
                        known = False
                        break
                    if a_until == b_until == _NEVER:
                        break
                    if a_until <= b_until:
                        i += 1
                    else:
                        j += 1
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def prefixes(self, word: bytes) -> list[int]:
        """Token counts of word[:0], word[:1], ... word."""
        counts, last, done = [0], [b""], 0
        pairs, stable = self.pairs.get, self.stable
        for end, piece in self.ends.iter(word.decode("latin-1")):  # all vocabulary entries, by where they end
            if end >= done:
                start = end + 1 - len(piece)
                fits = pairs((last[start], piece))
                if stable(last[start], piece) if fits is None else fits:
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    done = end + 1
        if done < len(word):
            raise ValueError("a byte is missing from the vocabulary")
        return counts

    def count_word(self, word: str) -> int:
        known = self.words.get(word)
        if known is None:
            known = self.prefixes(word.encode())[-1]
            if len(word) <= _CACHED_WORD:
                if len(self.words) >= _CACHED_WORDS:
                    self.words.clear()
                self.words[word] = known
        return known

    def segments(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(start, end, special) parts of a text: strings of added tokens are tokens of their own."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        if at < len(text):
            yield at, len(text), False

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        total, known, count_word = 0, self.words.get, self.count_word
        for start, end, special in self.segments(text):
            if special:
                total += 1
            else:
                part = text if end - start == len(text) else text[start:end]
                for word in self.pattern.findall(part):
                    n = known(word)
                    total += count_word(word) if n is None else n
        return total

    def fit(self, text: str, limit: int) -> int:
        """The most characters that a prefix of at most ``limit`` tokens can have.

        The counts at word ends lead to the words around the limit; only there every prefix's count is needed.  A word that
        follows no white space begins anew whatever comes after it.
        """
        words, done = [(0, 0)], 0  # where words begin, with the tokens before them
        for start, end, special in self.segments(text):
            if special:
                done += 1
                words.append((end, done))
            else:
                for m in self.pattern.finditer(text[start:end]):
                    done += self.count_word(m.group())
                    words.append((start + m.end(), done))
                    if done > limit:
                        break
            if done > limit:
                break
        k = max(0, len(words) - 6)
        while k and _SPACES.match(text[words[k][0] - 1]):
            k -= 1
        at, before = words[k]
        return at + self.index(text[at:], limit - before).fit(limit - before)

    def char_counts(self, word: str) -> list[int]:
        """Token counts of the prefixes of a word by characters."""
        known = self.grids.get(word)
        if known is None:
            raw = word.encode()
            known = self.prefixes(raw)
            if len(raw) > len(word):
                known = [0, *(known[i] for i in accumulate(len(c.encode()) for c in word))]
            if len(word) <= _CACHED_WORD:
                if len(self.grids) >= _CACHED_GRIDS:
                    self.grids.clear()
                self.grids[word] = known
        return known

    def index(self, text: str, upto: int | None = None) -> PrefixIndex:
        return PrefixIndex(self, text, upto)


class PrefixIndex:
    """The exact token count of every prefix of a text: ``counts[c]`` is that of ``text[:c]``.

    A word's prefixes have the counts of its dynamic program, added to those of the words before it.  In three places a cut
    changes the words themselves, and they get programs of their own: a run of white space (it is one word at the end of a
    text, but gives its last character to what follows), a contraction, and the string of an added token.

    With ``upto`` the counts end where no longer prefix can have so few tokens.
    """

    def __init__(self, tokenizer: PrefixTokenizer, text: str, upto: int | None = None):
        self.text, self.whole = text, True
        counts, done = [0], 0
        for start, end, special in tokenizer.segments(text):
            if special:
                at, before = last[0] if start else (0, 0)
                counts += [before + tokenizer.count(text[at:c]) for c in range(start + 1, end)]
                done += 1
                counts.append(done)
                last = [(end, done)] * 2
                continue
            last, gap_end = [(start, done)] * 2, start  # where the last two words begin, with the tokens before them
            for m in tokenizer.pattern.finditer(text[start:end]):
                a, word = m.start() + start, m.group()
                if _SPACES.match(word[-1]):
                    if a >= gap_end:
                        gap = _SPACES.match(text, a, end).group()
                        gap_end = a + len(gap)
                        counts += [done + n for n in tokenizer.char_counts(gap)[1:]]
                    done_now = tokenizer.count_word(word)
                else:
                    grid = tokenizer.char_counts(word)
                    if len(word) == 3 and word[0] == "'" and word[2].isalpha():
                        grid = [0, grid[1], grid[1] + tokenizer.count_word(word[1]), grid[3]]
                    counts += [done + n for n in grid[len(counts) - a :]]
                    done_now = grid[-1]
                last = [last[1], (a, done)]
                done += done_now
                if upto is not None and last[0][1] > upto:
                    self.whole = False
                    break
            if not self.whole:
                break
        self.counts = np.array(counts, np.int32)

    def total(self) -> int:
        """Tokens of the whole text (of an index without ``upto``)."""
        return int(self.counts[-1])

    def count(self, chars: int) -> int:
        """Token count of text[:chars]."""
        return int(self.counts[min(max(chars, 0), len(self.text))])

    def fit(self, budget: int) -> int:
        """The most characters that a prefix of at most ``budget`` tokens can have."""
        return int(np.flatnonzero(self.counts <= budget)[-1])


_loaded: dict[str, PrefixTokenizer] = {}


def load(path: str) -> PrefixTokenizer:
    """One tokenizer for each Python worker; its word cache (bounded) serves all tasks of the worker."""
    if path not in _loaded:
        _loaded[path] = PrefixTokenizer(path)
    return _loaded[path]


def token_counts(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars) of every whole text, one narrow pass without a shuffle.

    ``fit_chars``: the characters of the longest prefix of at most ``limit`` tokens, from the stored prefix counts.
    """
    bounded(df)

    def run(batches):
        tokenizer = load(path)
        for batch in batches:
            texts = batch.column(1)
            n_bytes, n_tokens, fits = [], [], []
            for value in texts:
                text = value.as_py() or ""
                n = tokenizer.count(text)
                n_bytes.append(len(text.encode()))
                n_tokens.append(n)
                fits.append(len(text) if n <= limit else tokenizer.fit(text, limit))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    added = StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, StructType([df.schema[id_col], *added]))


def truncate_to_budget(df: DataFrame, path: str, budget: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_tokens): each text cut to the most characters that ``budget`` tokens hold."""
    bounded(df)

    def run(batches):
        tokenizer = load(path)
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(1):
                index = tokenizer.index(value.as_py() or "", budget)
                cut = index.fit(budget)
                texts.append(index.text[:cut])
                counts.append(index.count(cut))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=[id_col, text_col, "n_tokens"])

    added = StructType([StructField(text_col, StringType()), StructField("n_tokens", LongType())])
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, StructType([df.schema[id_col], *added]))
