"""Token counts at every prefix of a text, by dynamic programming, and the tokens themselves.

White space divides a text into chunks that a word-level BPE never joins, so everything about a chunk is remembered
(in two bounded generations) and a text is the sum of its chunks. Within a word, count[i], the tokens of its first i
symbols, is count[i - len(t)] + 1 for the one token t that ends there and fits the last token before it: two tokens fit
if BPE makes the same two of their joined symbols. The count of a prefix that ends the word is found alike, its last
symbol being the one with the word end. So one pass gives the exact count at every prefix, and questions about budgets
and truncation are answered from the table. The total of a word needs that table too, but an end at its last symbol only.

Prefixes are those of the normalised text (composed, lower case), which has the code points of the text itself except
where normalisation changes their number.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words and chunks that a generation of a memory holds, and the longest ones that it keeps.
WORDS, CHUNKS, LONGEST = 60_000, 40_000, 64

#: Symbols of a head that words share, and heads that a generation holds.
HEAD, HEADS = 6, 30_000

#: Pairs of tokens of which it is known whether they fit.
FITS = 200_000

LIMIT = 2048

#: Texts whose chunks are numbered at once.
ROWS = 400

#: str.split() also divides at these four, which are not white space to the tokenizer.
_CONTROL = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")

#: Latin text, for which Python's lower case and letters are the tokenizer's; the rest goes through the library.
_PLAIN = re.compile(r"[!-~\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-ıĴ-ňŊ-ž]*")
#: The same for whole texts, as Arrow's regular expressions have it: texts with other characters, and all parts but letters.
_NOT_PLAIN = r"[^\t-\r -~\x{a1}-\x{a9}\x{ab}\x{ac}\x{ae}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}-\x{ff}]|<\|"
_BETWEEN = r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^a-z\x{b5}\x{df}-\x{f6}\x{f8}-\x{ff}0-9\t-\r ]+)"

#: What marks a special token among words, which have no blanks.
_SPECIAL = " "

_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")

def _byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte: itself where printable, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


SYMBOLS = _byte_symbols()


def _symbols(word: str) -> str:
    """The symbols of a word's bytes; letters of ASCII are their own."""
    return word if word.isascii() and word.isalpha() else "".join(map(SYMBOLS.__getitem__, word.encode()))


def _suffixes(tokens: Iterable[str]) -> dict[str, bool]:
    """All strings that end a token, and whether they are one: a string that is missing has no longer ones before it either."""
    own = set(tokens)
    return {t[i:]: t[i:] in own for t in own for i in range(len(t))}


#: In place of the merge that makes a token, for single symbols.
_SYMBOL = (-1, "", "")

_tokenizers: dict[str, object] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The tokenizer of a file, one for each process, as the file describes it."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class Memory(dict):
    """What has been worked out for a chunk, with at most two generations of chunks kept."""

    def __init__(self, work, size: int = WORDS):
        super().__init__()
        self.work, self.size, self.old = work, size, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.work(key)
        if len(key) <= LONGEST:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def split(texts: pa.Array) -> pa.Array:
    """Lists of what is between white space. Arrow looks past the end of a last text that ends in white space, so that
    goes first."""
    return pc.utf8_split_whitespace(pc.utf8_rtrim_whitespace(texts))


class Chunks:
    """The parts of many texts: the distinct ones, and for each text which it has, in order.

    Arrow divides and numbers them, so that Python sees each distinct part once.
    """

    def __init__(self, lists: pa.Array, own: bool = False):
        """own: the parts are all that is between white space in the texts, code point by code point, but for its case."""
        self.own = own
        coded = lists.values.dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_pylist()
        self.which = coded.indices
        self.bounds = lists.offsets.to_numpy()

    @classmethod
    def of(cls, texts: pa.Array) -> Chunks:
        """What is between white space: Arrow takes the tokenizer's characters for it, but for those of _CONTROL."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if pc.any(pc.match_substring_regex(texts, _CONTROL.pattern)).as_py():
            return cls(pa.array([chunks(t) for t in texts.to_pylist()], pa.large_list(pa.large_string())))
        return cls(split(texts))

    def sums(self, each: list[int]) -> np.ndarray:
        """Sums over each text of what its chunks have."""
        run = self.running(each)
        return run[self.bounds[1:]] - run[self.bounds[:-1]]

    def running(self, each: list[int]) -> np.ndarray:
        """Sums of what comes before each chunk, over all texts."""
        return np.concatenate([[0], np.cumsum(np.array(each, np.int64)[self.which.to_numpy()])]) if each else np.zeros(1, np.int64)

    def joined(self, each: list[bytes]) -> list[memoryview]:
        """What the chunks of each text have, one after another."""
        flat = pa.array(each, pa.large_binary()).take(self.which)
        if not len(flat):
            return [memoryview(b"")] * (len(self.bounds) - 1)
        data, at = memoryview(flat.buffers()[2]), np.frombuffer(flat.buffers()[1], np.int64)[flat.offset :][self.bounds].tolist()
        return [data[a:b] for a, b in zip(at, at[1:])]


def chunks(text: str | None, most: int | None = None) -> list[str]:
    """What is between white space; with most, the first ones of it."""
    if not text:
        return []
    if _CONTROL.search(text):
        return [c for c in _SPACE.split(text) if c][:most]
    return text.split() if most is None else text.split(None, most)[:most]


class Words:
    """How a word-level BPE divides a chunk into special tokens and words."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        with open(path) as f:
            self.description = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.description["added_tokens"]}
        self._split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _simple(self, chunk: str) -> list[str] | None:
        """The words of a chunk of plain characters without special tokens, else None."""
        return _PIECES.findall(chunk.lower()) if _PLAIN.fullmatch(chunk) and not ("<" in chunk and self._split_special and self._split_special.search(chunk)) else None

    def _pieces(self, text: str) -> tuple[str, list[str]]:
        """The normalised text of a chunk and the words that are encoded on their own."""
        if _PLAIN.fullmatch(text):
            text = text.lower()
            return text, _PIECES.findall(text)
        text = self.tokenizer.normalizer.normalize_str(text)
        # offsets are code points of the normalised text, but for characters of several bytes in several pieces
        return text, [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def divided(self, texts: pa.Array) -> list[tuple[np.ndarray, Chunks]]:
        """The words of texts, in two groups with the places of their texts: plain ones by Arrow, others one by one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _NOT_PLAIN)
        out = []
        if len(plain := texts.filter(pc.invert(odd))):
            spaced = pc.replace_substring_regex(pc.utf8_lower(plain), _BETWEEN, r" \1 ")
            out.append((np.flatnonzero(~odd.to_numpy(zero_copy_only=False)), Chunks(split(spaced), own=True)))
        if len(rest := texts.filter(odd)):
            words = [[w for c in chunks(t) for text, ws in self._parts(c) for w in ([_SPECIAL + text] if ws is None else ws)] for t in rest.to_pylist()]
            out.append((np.flatnonzero(odd.to_numpy(zero_copy_only=False)), Chunks(pa.array(words, pa.large_list(pa.large_string())))))
        return out

    def _parts(self, chunk: str):
        """The special tokens of a chunk, as (text, None), and what is between them, as (normalised text, its words)."""
        if self._split_special and self._split_special.search(chunk):
            for part in self._split_special.split(chunk):
                if part:
                    yield (part, None) if part in self.special else self._pieces(part)
        else:
            yield self._pieces(chunk)


class PrefixCounts(Words):
    """Exact token counts at every prefix of words, chunks and texts for a BPE with word ends."""

    def __init__(self, path: str):
        super().__init__(path)
        model = self.description
        self.end = model["model"]["end_of_word_suffix"]
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self.rank = {m: i for i, m in enumerate(merges)}
        self.made = {a + b: (i, a, b) for i, (a, b) in enumerate(merges)}
        vocab = model["model"]["vocab"]
        # BPE must make a token of its own symbols, or it never appears
        self.inner = _suffixes(t for t in vocab if not t.endswith(self.end))
        self.final = _suffixes(t[: -len(self.end)] for t in vocab if t.endswith(self.end))
        del self.description
        self.fits: tuple[dict, dict] = ({}, {})
        self.words = Memory(self._word)
        self.wholes = Memory(self._whole)
        self.heads = Memory(self._head, HEADS)
        self.totals = Memory(self._total, CHUNKS)

    def bpe(self, symbols: list[str]) -> list[str]:
        """Merge by rank until nothing merges."""
        while len(symbols) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            at = ranks.index(best)
            pair = (symbols[at], symbols[at + 1])
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _fit(self, a: str, b: str, final: int) -> bool:
        """Whether BPE makes a and b of their joined symbols (only b, where a is empty)."""
        fits = self.fits[final]
        if len(fits) > FITS:
            fits.clear()
        right = b + self.end * final
        if a:
            known = (fits["", b] if ("", b) in fits else self._fit("", b, final)) and self._apart(a, right)
        else:
            known = self.bpe([*b[:-1], b[-1] + self.end * final]) == [right]
        fits[a, b] = known
        return known

    def _apart(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two tokens while they come about.

        Their merges are undone from the last one on. A merge across what is then at the border would have come first if
        its rank is below that of the merge undone; of equal ranks the one further left comes first.
        """
        limit = len(self.rank)
        while True:
            if self.rank.get((left, right), limit) < limit:
                return False
            of_left, of_right = self.made.get(left, _SYMBOL), self.made.get(right, _SYMBOL)
            if of_left[0] > of_right[0]:
                limit, left = of_left[0], of_left[2]
            elif of_right is _SYMBOL:
                return True
            else:
                limit, right = of_right[0] + 1, of_right[1]

    def _word(self, word: str) -> bytes | array:
        """Tokens of each prefix of a word, as a word of its own, by code points; entry 0 is the empty prefix."""
        s = _symbols(word)
        bounds = range(len(s) + 1) if len(s) == len(word) else list(accumulate((len(c.encode()) for c in word), initial=0))
        n = len(s)
        count, last = self._steps(s, n, *self.heads[s[:HEAD]])
        ends = [0, *(self._end(s, i, count, last) for i in range(1, n + 1))]
        return bytes(ends) if n == len(word) and ends[n] < 256 else array("I", (ends[b] for b in bounds))

    def _whole(self, word: str) -> int:
        """Tokens of a word: of all ends only its own."""
        s = _symbols(word)
        n = len(s)
        return self._end(s, n, *self._steps(s, n - 1, *self.heads[s[: min(HEAD, n - 1)]]))

    def _head(self, s: str) -> tuple[list, list]:
        """What many words share: the table of their first symbols."""
        return self._steps(s, len(s), [0], [""])

    def _steps(self, s: str, n: int, count: list[int], last: list[str]) -> tuple[list, list]:
        """Go on from the table of a shorter prefix up to n symbols: tokens that don't end the word, and the last of them."""
        k, inner, fits = len(count), self.inner, self.fits[0]
        if k > n:
            return count, last
        count, last = count + [0] * (n + 1 - k), last + [""] * (n + 1 - k)
        for i in range(k, n + 1):
            for j in range(i - 1, -1, -1):
                t = s[j:i]
                token = inner.get(t)
                if token:
                    before = last[j]
                    if (before or not j) and (fits[before, t] if (before, t) in fits else self._fit(before, t, 0)):
                        count[i], last[i] = count[j] + 1, t
                        break
                elif token is None:
                    break
        return count, last

    def _end(self, s: str, i: int, count: list[int], last: list[str]) -> int:
        """Tokens of the first i symbols as a word, from the table of those before the last one."""
        final, fits = self.final, self.fits[1]
        for j in range(i - 1, -1, -1):
            t = s[j:i]
            token = final.get(t)
            if token:
                before = last[j]
                if (before or not j) and (fits[before, t] if (before, t) in fits else self._fit(before, t, 1)):
                    return count[j] + 1
            elif token is None:
                break
        return 0

    def _total(self, chunk: str) -> int:
        if (words := self._simple(chunk)) is not None:
            return sum([self.wholes[w] for w in words])
        return sum(1 if words is None else sum(self.wholes[w] for w in words) for _, words in self._parts(chunk))

    def inside(self, chunk: str) -> array:
        """Tokens of each prefix of a chunk; entry 0 is the empty prefix."""
        out = array("I", [0])
        for text, words in self._parts(chunk):
            base, run = out[-1], 0
            for w in self._pieces(text)[1] if words is None else words:  # before its end a special token is ordinary text
                if w[0] == "'" and 1 < len(w) and w[1].isalpha():  # and the parts of a contraction are words
                    mark = self.words["'"][-1]
                    counts = [mark, *(mark + c for c in self.words[w[1:]][1:-1]), self.words[w][-1]]
                else:
                    counts = self.words[w][1:]
                out.extend(base + run + c for c in counts)
                run += counts[-1]
            if words is None:
                out[-1] = base + 1
        return out

    def total(self, text: str | None) -> int:
        return sum(map(self.totals.__getitem__, chunks(text)))

    def all_longest(self, texts: list[str | None], budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of each text, and what longest_prefix() gives for it; the words of both are counted once."""
        total, chars, fit = (np.zeros(len(texts), np.int64) for _ in range(3))
        for at, parts in self.divided(pa.array(texts, pa.large_string())):
            each = [1 if w[:1] == _SPECIAL else self.wholes[w] if w else 0 for w in parts.distinct]
            total[at] = fit[at] = parts.sums(each)
            sizes = list(map(len, parts.distinct)) if parts.own else None
            chars[at] = parts.sums(sizes) if parts.own else [sum(map(len, chunks(texts[i]))) for i in at]
            over = np.flatnonzero(total[at] > budget).tolist()
            tokens, symbols = (parts.running(each), parts.running(sizes)) if over and parts.own else (None, None)
            for k in over:
                text, table = texts[at[k]], None
                if parts.own:  # a chunk begins where one of its words does
                    a, b = parts.bounds[k], parts.bounds[k + 1] + 1
                    first = chunks(text, budget + 1)
                    where = np.searchsorted(symbols[a:b], symbols[a] + np.cumsum([0, *map(len, first)]))
                    table = first, (tokens[a:b][where] - tokens[a]).tolist()
                chars[at[k]], fit[at[k]] = self.longest_prefix(text, budget, table)
        return total, chars, fit

    def table(self, text: str | None, most: int | None = None) -> tuple[list[str], list[int]]:
        """The chunks of a text and the tokens before each, then those of all; inside(c) has what is inside.

        With most, only so many chunks: each has a token, so that a budget needs no more.
        """
        parts = chunks(text) if most is None else chunks(text, most)
        return parts, list(accumulate(map(self.totals.__getitem__, parts), initial=0))

    def longest_prefix(self, text: str | None, budget: int, table: tuple[list[str], list[int]] | None = None) -> tuple[int, int]:
        """The most code points at the start of a text, counted without white space, that make at most `budget` tokens, and those tokens.

        table: that of the text, if it is known, with budget + 1 chunks at least.
        """
        parts, before = table or self.table(text, budget + 1)
        k = bisect_right(before, budget) - 1
        whole = sum(map(len, parts[:k]))
        if k == len(parts):
            return whole, before[k]
        inside = self.inside(parts[k])
        best = max((i for i, c in enumerate(inside) if before[k] + c <= budget), default=0)
        return whole + best, before[k] + inside[best]

    def every_prefix(self, text: str | None) -> list[int]:
        """Tokens of every prefix of a text, by code points of its chunks as they are normalised."""
        parts, before = self.table(text)
        return [0, *(b + c for p, b in zip(parts, before) for c in self.inside(p)[1:])]


class Ids(Words):
    """The token ids of texts, as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        super().__init__(path)
        del self.description
        self.words = Memory(self._word)

    def _word(self, word: str) -> bytes:
        if word[:1] == _SPECIAL:
            return array("I", [self.special[word[1:]]]).tobytes()
        s = "".join(map(SYMBOLS.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(s)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        return bytes(self.encode_all(pa.array([text], pa.large_string()))[0])

    def encode_all(self, texts: pa.Array) -> list[memoryview]:
        out: list = [b""] * len(texts)
        for at, parts in self.divided(texts):
            for i, ids in zip(at.tolist(), parts.joined([self.words[w] for w in parts.distinct])):
                out[i] = ids
        return out


_made: dict[tuple, object] = {}


def one(kind: type, path: str):
    """The one object of a kind for a vocabulary in this process."""
    key = (kind.__name__, path)
    if key not in _made:
        _made[key] = kind(path)
    return _made[key]


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """One row per row of df: doc_id, n_bytes (UTF-8), n_tokens, over_limit, and the longest prefix within the budget:
    fit_chars (its code points but white space) and fit_tokens. With prefixes, also the counts of every prefix.

    path: a .json file with a word-end BPE, on every machine. Null and empty texts have 0 bytes and tokens. Texts of any
    length are taken whole. Repeated rows give repeated rows, an empty table none; other columns are not read.
    """

    def work(cols: list[list]) -> list[list]:
        t = one(PrefixCounts, path)
        ids, texts = cols
        n, chars, fit = t.all_longest(texts, budget)
        out = [ids, [len((x or "").encode()) for x in texts], n, n > budget, chars, fit]
        return [*out, [t.every_prefix(x) for x in texts]] if prefixes else out

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return map_batches(rows, work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, fit_tokens long" + ", prefix_tokens array<int>" * prefixes, ROWS)
