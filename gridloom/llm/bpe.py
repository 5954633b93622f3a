"""BPE encoding by speculation and verification, and decoding.

For every word a greedy longest match, run over all words of a batch at once, proposes tokens. The proposal is right exactly when each
of its adjacent pairs is: when the merges, run on the two tokens' characters alone, give the two
tokens back. Pairs are checked for all words of a batch at once against a sorted table of pairs
already judged; only pairs never seen before are judged by merging, and only words with a failing
pair are merged exactly, by a heap of their pairs, in a time that grows with n log n of their
characters. Words are cached up to bounds on their number and characters, after which the cache
starts anew.

The vocabulary file is named by path; it is read by each Python worker once and never copied.

Cases: a null or empty text has no tokens; the strings of special tokens in a text are their
tokens; a byte outside the vocabulary cannot occur, since all 256 are in it; repeated rows and
extra columns are kept; clashing input columns are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import struct
import unicodedata

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

#: Words and pairs that a worker remembers, and characters for each of these words on average.
CACHE_WORDS, CACHE_PAIRS, CACHE_CHARS = 300_000, 400_000, 32
#: Symbols from which a word is merged by a heap; shorter ones are searched, with the same result.
LONG_WORD = 64
SUFFIX = "</w>"
#: Added to the code point of a word's last character in texts of many words; beyond all bytes' stand-ins.
LAST = 0x200
#: Bits of an id in a pair of ids, and in a merge, which is its rank and the id that it makes.
BITS, MASK, NONE = 20, (1 << 20) - 1, 1 << 62

# The printable stand-ins of bytes in byte-level vocabularies are the bytes that
# print in Latin-1 themselves; the others take code points from 256 on, in order.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_names() -> list[str]:
    """The character that stands for each byte."""
    out, spare = [], 256
    for b in range(256):
        if b in _PRINTS:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


# Code points (hexadecimal, ranges inclusive) that are letters or numbers in the regular
# expressions' newest tables, but were assigned after Unicode 16, whose tables the vocabulary's tokenizer
# has: to it they are symbols.
_NEWER = """
    558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
    10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3
    16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6
    1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4
    1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


@functools.cache
def _newer() -> frozenset[str]:
    ends = [[int(x, 16) for x in part.split("-")] for part in _NEWER.split()]
    return frozenset(chr(c) for e in ends for c in range(e[0], e[-1] + 1))


def mark_end(word: str) -> str:
    return word[:-1] + chr(ord(word[-1]) + LAST)


class WordBpe:
    """Encoder and decoder of one word-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.joins = {self.ids[a] << BITS | self.ids[b]: k << BITS | self.ids[a + b] for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {v: k for k, v in self.ids.items()} | {v: k for k, v in self.special.items()}
        words = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(words)
        new = f"[{''.join(sorted(_newer()))}]"
        careful = words.replace(r"[\p{L}]", rf"(?:(?!{new})\p{{L}})").replace(r"[\p{N}]", rf"(?!{new})\p{{N}}").replace(r"[^\s\p{L}\p{N}]", rf"(?:{new}|[^\s\p{{L}}\p{{N}}])")
        self.new, self.careful = _newer(), regex.compile(careful)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes = dict(enumerate(byte_names()))
        own = {k: v for k, v in self.ids.items() if k not in self.special}
        self.inner = {k: v for k, v in own.items() if not k.endswith(SUFFIX)}
        self.final = {k[: -len(SUFFIX)]: v for k, v in own.items() if k.endswith(SUFFIX)}
        self.last = np.zeros(1 + max(self.names), bool)
        self.last[list(self.final.values())] = True
        self.match = ahocorasick.Automaton()
        for k, v in self.inner.items():
            self.match.add_word(k, v)
        for k, v in self.final.items():
            self.match.add_word(mark_end(k), v)
        self.match.make_automaton()
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.held, self.held_words, self.most = 0, 0, CACHE_WORDS
        self.sound = np.full(len(self.last), -1, np.int8)
        self.pairs = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)

    # --- exact merging ---

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to symbols, which are ids, in rank order, leftmost first."""
        if len(symbols) >= LONG_WORD:
            return self.merge_long(symbols)
        get, symbols = self.joins.get, list(symbols)
        found = [get(a << BITS | b, NONE) for a, b in itertools.pairwise(symbols)]
        while found and (best := min(found)) < NONE:
            i = found.index(best)
            symbols[i] = new = best & MASK
            del symbols[i + 1], found[i]
            if i < len(found):
                found[i] = get(new << BITS | symbols[i + 1], NONE)
            if i:
                found[i - 1] = get(symbols[i - 1] << BITS | new, NONE)
        return symbols

    def merge_long(self, symbols: list[int]) -> list[int]:
        """The same for long words: a heap of (merge, place of the left symbol), over a linked list of symbols."""
        joins, own = self.joins, [*symbols, MASK]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(joins[a << BITS | b], k) for k, (a, b) in enumerate(itertools.pairwise(symbols)) if a << BITS | b in joins]
        heapq.heapify(heap)
        while heap:
            join, k = heapq.heappop(heap)
            nxt = after[k]
            # A symbol that has been merged away is MASK, which is no id and so in no pair.
            if nxt == n or joins.get(own[k] << BITS | own[nxt]) != join:
                continue
            own[k], own[nxt] = join & MASK, MASK
            after[k] = after[nxt]
            if after[k] < n:
                before[after[k]] = k
                if (found := joins.get(own[k] << BITS | own[after[k]])) is not None:
                    heapq.heappush(heap, (found, k))
            if before[k] >= 0 and (found := joins.get(own[before[k]] << BITS | own[k])) is not None:
                heapq.heappush(heap, (found, before[k]))
        return [x for x in own if x != MASK]

    def symbols(self, token: str) -> list[int]:
        """The ids of a token's single characters, the last one with the word's end if it has it."""
        if token.endswith(SUFFIX):
            own = token[: -len(SUFFIX)]
            return [*map(self.inner.__getitem__, own[:-1]), self.final[own[-1]]]
        return list(map(self.inner.__getitem__, token))

    def exact(self, word: str) -> bytes:
        ids = self.merge(self.symbols(word + SUFFIX))
        return struct.pack(f"<{len(ids)}I", *ids)

    # --- speculation and verification ---

    def propose(self, words: list[str]) -> np.ndarray:
        """Greedy longest matches over all words one after the other; none goes beyond a word's marked last character."""
        return np.fromiter((v for _, v in self.match.iter_long("".join(map(mark_end, words)))), np.int64)

    def sound_tokens(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token's own characters merge to it."""
        for t in np.unique(tokens[self.sound[tokens] < 0]).tolist():
            self.sound[t] = self.merge(self.symbols(self.names[t])) == [t]
        return self.sound[tokens] == 1

    def judge_pairs(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left << BITS | right) is compatible; new ones are learned."""
        at = np.searchsorted(self.pairs, keys)
        known = (at < len(self.pairs)) & (self.pairs[np.minimum(at, max(0, len(self.pairs) - 1))] == keys) if len(self.pairs) else np.zeros(len(keys), bool)
        fresh = np.unique(keys[~known])
        if len(fresh):
            verdict = []
            for k in fresh.tolist():
                a, b = k >> BITS, k & MASK
                verdict.append(self.merge(self.symbols(self.names[a]) + self.symbols(self.names[b])) == [a, b])
            if len(self.pairs) + len(fresh) > CACHE_PAIRS:
                now = np.unique(keys)
                old = np.isin(self.pairs, now)
                self.pairs, self.fits = self.pairs[old], self.fits[old]
            both = np.concatenate([self.pairs, fresh])
            order = np.argsort(both, kind="stable")
            self.pairs, self.fits = both[order], np.concatenate([self.fits, np.array(verdict, bool)])[order]
        return self.fits[np.searchsorted(self.pairs, keys)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Token ids of words, spelled in the vocabulary's characters, all at once."""
        flat = self.propose(words)
        ends = np.flatnonzero(self.last[flat]) + 1
        starts = np.concatenate([[0], ends[:-1]])
        good = self.sound_tokens(flat)
        left = np.flatnonzero(~self.last[flat])
        if len(left):
            good[left] &= self.judge_pairs((flat[left] << BITS) | flat[left + 1])
        fits = np.logical_and.reduceat(good, starts)
        whole, size = flat.astype("<u4").tobytes(), 4
        return [
            whole[a * size : b * size] if fit else self.exact(w)
            for w, a, b, fit in zip(words, starts.tolist(), ends.tolist(), fits.tolist(), strict=True)
        ]

    # --- texts ---

    def learn_chunks(self, chunks: list[str]) -> None:
        """Encode chunks, which are texts without a space or line end, that are not cached yet."""
        new = self.new.intersection("".join(chunks))
        split = [[c] if c.isascii() and c.isalpha() else (self.split if new.isdisjoint(c) else self.careful).findall(c) for c in chunks]
        fresh = list(dict.fromkeys(w for ws in split for w in ws if w not in self.words))
        if fresh:
            spelled = [w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes) for w in fresh]
            for word, ids in zip(fresh, self.encode_words(spelled)):
                self.words[word] = ids
                self.held_words += len(word)
        for chunk, ws in zip(chunks, split):
            self.chunks[chunk] = self.words[ws[0]] if len(ws) == 1 else b"".join(map(self.words.__getitem__, ws))
            self.held += len(chunk)

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids of every text.

        No word crosses a space or a line end, so a text is looked up chunk by chunk between them.
        """
        if len(self.chunks) > self.most or self.held > CACHE_CHARS * self.most:
            self.chunks.clear()
            self.held = 0
        if len(self.words) > self.most or self.held_words > CACHE_CHARS * self.most:
            self.words.clear()
            self.held_words = 0
        parts: list[list[str | list[str]]] = []
        for text in texts:
            own: list[str | list[str]] = []
            for part in self.cut.split(text or "") if self.cut is not None else [text or ""]:
                if part in self.special:
                    own.append(part)
                elif part:
                    own.append(lower(part if part.isascii() else unicodedata.normalize("NFC", part)).replace("\n", " ").split(" "))
            parts.append(own)
        known = self.chunks
        fresh = [c for c in set().union(*(p for own in parts for p in own if p.__class__ is list)) if c not in known]
        if fresh:
            self.learn_chunks(sorted(fresh))
        out = []
        for own in parts:
            ids = [b"".join(map(known.__getitem__, p)) if p.__class__ is list else struct.pack("<I", self.special[p]) for p in own]
            out.append(np.frombuffer(b"".join(ids), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' own strings, joined by a space: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


# Capitals assigned in Unicode 16 and 17, which Python's tables lack (hexadecimal: first-last, then the first small letter).
_CAPITALS = "1c89 1c8a; a7cb 264; a7cc a7cd; a7ce a7cf; a7d2 a7d3; a7d4 a7d5; a7da a7db; a7dc 19b; 10d50-10d65 10d70; 16ea0-16eb8 16ebb"


@functools.cache
def _capitals() -> dict[int, int]:
    out = {}
    for pair in _CAPITALS.split(";"):
        span, to = pair.split()
        ends = [int(x, 16) for x in span.split("-")]
        out |= {c: int(to, 16) + c - ends[0] for c in range(ends[0], ends[-1] + 1)}
    return out


def lower(text: str) -> str:
    """Lower-case code point by code point, without the context rule for a final sigma."""
    out = text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))
    return out if text.isascii() or max(text) < "\u1c89" else out.translate(_capitals())


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The vocabulary of a path, once in each worker."""
    return WordBpe(path)


def encode_decode(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = True, with_decoded: bool = True, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``ids`` and ``decoded``.

    Digests are those of the ids as little-endian 32-bit integers and of the decoded UTF-8 text.
    ``cache_words`` bounds what a worker remembers: fewer take less memory and more time, with the same result.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    if with_decoded:
        fields.append(T.StructField("decoded", T.StringType()))

    def compute(texts: list[str | None]) -> dict[str, list]:
        model = load(path)
        model.most = cache_words
        ids = model.encode_batch(texts)
        decoded = [model.decode(x) for x in ids]
        made = {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
        }
        return made | ({"ids": [x.tolist() for x in ids]} if with_ids else {}) | ({"decoded": decoded} if with_decoded else {})

    return map_texts(df, text_col, compute, fields, keep)
