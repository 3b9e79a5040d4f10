"""Words of a byte-pair tokenizer with word ends, and their merges.

Covers tokenizer files whose normaliser composes characters, lowers them and treats all
white space alike, whose words are runs of letters, single numerals, runs of other characters
and English contractions, and whose model is a byte-level BPE with a suffix at word ends.
Any other file is refused.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from lodestone.llm.wordhash import mix

# fixed values of the format
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Characters that no valid text has: they part texts, and stand for special tokens.
_PART = "\udfff"
_SPECIAL = 0xD800

SLICE_CHARS = 1 << 20
# Longer words are merged one by one, with a heap.
LONG_WORD = 64


@lru_cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each character, and which ones are left to the tokenizer library.

    Those are the ones that Python's Unicode table lacks, and those whose order among marks or composition is
    younger than Unicode 3.2: other libraries' tables may be older or younger there.
    """
    old = unicodedata.ucd_3_2_0
    kinds = np.full(0x110000, OTHER, dtype=np.uint8)
    foreign = np.zeros(0x110000, dtype=bool)
    for code in range(0x110000):
        char = chr(code)
        c = unicodedata.category(char)
        if c == "Cn":
            foreign[code] = True
        elif c[0] == "L":
            kinds[code] = LETTER
        elif c[0] == "N":
            kinds[code] = NUMBER
        if c[0] == "M":
            foreign[code] |= unicodedata.combining(char) != old.combining(char)
        parts = unicodedata.decomposition(char)
        if parts and parts[0] != "<" and parts != old.decomposition(char):
            foreign[[code, *[p for p in (int(x, 16) for x in parts.split()) if old.category(chr(p)) == "Cn"]]] = True
    kinds[_SPACES] = SPACE
    kinds[ord(_PART)] = SPACE
    return kinds, foreign


@lru_cache
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache
def _library_words() -> Split:
    return Split(Regex(_WORDS), "removed", invert=True)


@lru_cache(maxsize=65536)
def _library_class(char: str) -> int:
    """Class of a character that is no white space, as the library's words show it."""
    words = _library_words()
    if len(words.pre_tokenize_str("a" + char)) == 1:
        return LETTER
    return OTHER if len(words.pre_tokenize_str("!" + char)) == 1 else NUMBER


def _normal(text: str) -> str:
    # a sigma is lowered without regard to its place
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _normal_and_classes(joined: str, path: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The normalised text, its code points and their classes.

    Only stretches with foreign characters are normalised by the library, and only characters
    without a class in Python get the library's.
    """
    kinds, foreign = _classes()
    if not foreign[_codes(joined)].any():
        joined = _normal(joined)
        codes = _codes(joined)
        return joined, codes, kinds[codes]
    stretches = re.split(f"([{chr(_SPECIAL)}-{_PART}])", joined)
    joined = "".join(_library(path).normalizer.normalize_str(s) if foreign[_codes(s)].any() else _normal(s) for s in stretches)
    codes = _codes(joined)
    kind = kinds[codes]
    at = np.flatnonzero(foreign[codes])
    own, place = np.unique(codes[at], return_inverse=True)
    kind[at] = np.array([_library_class(chr(c)) for c in own], dtype=np.uint8)[place]
    return joined, codes, kind


def _byte_chars() -> list[str]:
    """The characters that byte-level vocabularies write for bytes: themselves if printable, else from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


@dataclass
class Vocabulary:
    """Numbers of the symbols, and merges as rank and result of a pair of numbers."""

    path: str
    first: np.ndarray  # of a byte inside a word
    last: np.ndarray  # of the byte that ends a word
    pairs: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int]
    keys: list[np.ndarray]  # two hash tables of pairs, the second for what meets in the first
    ranks: list[np.ndarray]
    results: list[np.ndarray]
    factors: list[int]


_BITS = 20
_NEVER = np.int32(2**31 - 1)


def _slot(keys: np.ndarray, factor: int) -> np.ndarray:
    return ((keys * np.uint64(factor)) >> np.uint64(64 - _BITS)).astype(np.int64)


@lru_cache
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, normal = spec["model"], spec["normalizer"] or {}
    splits = [p.get("pattern", {}).get("Regex") for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    known = (
        [n["type"] for n in normal.get("normalizers", [])] == _NORMALIZERS
        and splits == [_WORDS, None]
        and model["type"] == "BPE"
        and model["end_of_word_suffix"]
        and not (model["dropout"] or model["byte_fallback"] or model["ignore_merges"] or model["continuing_subword_prefix"])
        and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
    )
    if not known:
        raise ValueError(f"{path} holds another kind of tokenizer")
    numbers, end = model["vocab"], model["end_of_word_suffix"]
    chars = _byte_chars()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pairs: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, (a, b) in enumerate(merges):
        pairs[numbers[a], numbers[b]] = (rank, numbers[a + b])
    key = np.array([a << 32 | b for a, b in pairs], dtype=np.uint64)
    rank = np.array([r for r, _ in pairs.values()], dtype=np.int32)
    result = np.array([r for _, r in pairs.values()], dtype=np.int32)
    tables: tuple[list, list, list, list] = ([], [], [], [])
    left, factor = np.arange(len(key)), 0x9E3779B97F4A7C15
    while len(left):
        keys = np.full(1 << _BITS, 2**64 - 1, dtype=np.uint64)
        ranks, results = np.full(1 << _BITS, _NEVER), np.zeros(1 << _BITS, dtype=np.int32)
        slot = _slot(key[left], factor)
        _, at = np.unique(slot, return_index=True)
        keys[slot[at]], ranks[slot[at]], results[slot[at]] = key[left[at]], rank[left[at]], result[left[at]]
        for table, new in zip(tables, (keys, ranks, results, factor)):
            table.append(new)
        left = np.delete(left, at)
        factor = (factor * 0xD1342543DE82EF95 | 1) & (2**64 - 1)
    return Vocabulary(
        path,
        np.array([numbers[c] for c in chars], dtype=np.int64),
        np.array([numbers[c + end] for c in chars], dtype=np.int64),
        pairs,
        {t["content"]: t["id"] for t in spec["added_tokens"]},
        *tables,
    )


def _lookup(vocab: Vocabulary, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and result of each pair; the rank of a pair that never merges is larger than any."""
    key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    slot = _slot(key, vocab.factors[0])
    miss = vocab.keys[0][slot] != key
    rank, result = vocab.ranks[0][slot], vocab.results[0][slot]
    rank[miss] = _NEVER
    for keys, ranks, results, factor in list(zip(vocab.keys, vocab.ranks, vocab.results, vocab.factors))[1:]:
        at = np.flatnonzero(miss)
        slot = _slot(key[at], factor)
        good = keys[slot] == key[at]
        rank[at[good]], result[at[good]] = ranks[slot[good]], results[slot[good]]
        miss[at[good]] = False
    return rank, result


def merged(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """What is left of a word's symbols: the lowest-rank adjacent pair, leftmost first, is merged until none is left.

    The pairs wait in a heap, the symbols are a linked list; an entry whose symbols have
    changed meanwhile is passed over.
    """
    n = len(symbols)
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = pairs.get((symbols[i], symbols[i + 1]))
        if pair is not None:
            heap.append((pair[0], i, symbols[i], symbols[i + 1], pair[1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if symbols[i] == a else n
        if j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = pairs.get((new, symbols[k]))
            if pair is not None:
                heapq.heappush(heap, (pair[0], i, new, symbols[k], pair[1]))
        h = before[i]
        if h >= 0:
            pair = pairs.get((symbols[h], new))
            if pair is not None:
                heapq.heappush(heap, (pair[0], h, symbols[h], new, pair[1]))
    return [s for s in symbols if s >= 0]


def merged_count(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many symbols :func:`merged` leaves: those at the start less one for each merge."""
    n = left = len(symbols)
    if n < 2:
        return n
    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    get, pop, push = pairs.get, heapq.heappop, heapq.heappush
    heap = []
    for i in range(n - 1):
        pair = get((symbols[i], symbols[i + 1]))
        if pair is not None:
            heap.append((pair[0], i, symbols[i], symbols[i + 1], pair[1]))
    heapq.heapify(heap)
    while heap:
        _, i, a, b, new = pop(heap)
        j = after[i] if symbols[i] == a else n
        if j >= n or symbols[j] != b:
            continue
        left -= 1
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = get((new, symbols[k]))
            if pair is not None:
                push(heap, (pair[0], i, new, symbols[k], pair[1]))
        h = before[i]
        if h >= 0:
            pair = get((symbols[h], new))
            if pair is not None:
                push(heap, (pair[0], h, symbols[h], new, pair[1]))
    return left


@dataclass
class Pieces:
    """The words of some texts: text and distinct word of each, in order; and the distinct words.

    A special token has its place among the specials in ``special`` and is empty as a word;
    others have -1.
    """

    n_texts: int
    text: np.ndarray
    word: np.ndarray
    words: list[str]
    special: np.ndarray


def _words_in(texts: list[str], vocab: Vocabulary) -> Pieces:
    joined, specials = _PART.join(texts), vocab.specials
    for i, name in enumerate(specials):
        if name in joined:
            joined = joined.replace(name, chr(_SPECIAL + i))
    joined, codes, kind = _normal_and_classes(joined, vocab.path)
    special = (codes >= _SPECIAL) & (codes < _SPECIAL + len(specials))
    begin = kind != SPACE
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | special[1:] | special[:-1]
    # an apostrophe alone before letters takes those of a contraction with it
    at = np.flatnonzero((codes[:-1] == ord("'")) & begin[:-1] & (kind[1:] == LETTER))
    for i in at:
        found = next((c for c in _CONTRACTIONS if joined.startswith(c, i + 1)), None)
        if found:
            begin[i + 1] = False
            after = i + 1 + len(found)
            if after < len(kind) and kind[after] == LETTER:
                begin[after] = True
    starts = np.flatnonzero(begin)
    stop = np.flatnonzero(begin | (kind == SPACE))
    ends = np.append(stop, len(codes))[np.searchsorted(stop, starts, "right")]
    parts = np.flatnonzero(codes == ord(_PART))
    text = np.searchsorted(parts, starts)
    # distinct words by a hash of their characters
    base, inverse = np.uint64(0x5851F42D4C957F2D), pow(0x5851F42D4C957F2D, -1, 1 << 64)
    power = np.full(len(codes) + 1, base, dtype=np.uint64)
    back = np.full(len(codes) + 1, inverse, dtype=np.uint64)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * power[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    of = np.where(special[starts[first]], codes[starts[first]].astype(np.int64) - _SPECIAL, -1)
    own = [joined[s:e] if i < 0 else "" for s, e, i in zip(starts[first].tolist(), ends[first].tolist(), of)]
    return Pieces(len(texts), text, word, own, of)


def pieces(texts: list[str], vocab: Vocabulary) -> Iterator[tuple[int, Pieces]]:
    """Words of runs of texts of bounded length (one long text alone may be longer), with the first text of each."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > SLICE_CHARS:
            yield first, _words_in(texts[first:i], vocab)
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, _words_in(texts[first:], vocab)


def symbols(vocab: Vocabulary, word: str) -> list[int]:
    data = word.encode("utf-8")
    return [*vocab.first[list(data[:-1])].tolist(), int(vocab.last[data[-1]])]


def word_ids(vocab: Vocabulary, some: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all distinct words, end to end, and how many each has.

    All words take a merge at a time together; long ones are merged by themselves.
    """
    words = some.words
    data = [w.encode("utf-8") for w in words]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    long = sizes > LONG_WORD
    short = np.flatnonzero(~long & (sizes > 0))
    raw = np.frombuffer(b"".join(data[i] for i in short), dtype=np.uint8)
    owner = np.repeat(short, sizes[short])
    sym = vocab.first[raw]
    ends = np.cumsum(sizes[short]) - 1
    sym[ends] = vocab.last[raw[ends]]
    marked = np.flatnonzero(some.special >= 0)
    done_sym, done_owner = [np.array(list(vocab.specials.values()), dtype=np.int64)[some.special[marked]]], [marked]
    while len(sym):
        # pairs inside a word; the last symbol of each word has none
        rank = np.full(len(sym), _NEVER)
        result = np.zeros(len(sym), dtype=np.int32)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner], result[inner] = _lookup(vocab, sym[inner], sym[inner + 1])
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.minimum.reduceat(rank, first)
        length = np.diff(np.append(first, len(sym)))
        active = np.repeat(best != _NEVER, length)
        hit = np.flatnonzero((rank == np.repeat(best, length)) & active)
        # leftmost of each word
        hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])] if len(hit) else hit
        done_sym.append(sym[~active])
        done_owner.append(owner[~active])
        sym[hit] = result[hit]
        keep = active.copy()
        keep[hit + 1] = False
        sym, owner = sym[keep], owner[keep]
    for i in np.flatnonzero(long):
        left = merged(symbols(vocab, words[i]), vocab.pairs)
        done_sym.append(np.array(left, dtype=np.int64))
        done_owner.append(np.full(len(left), i))
    owner = np.concatenate(done_owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(done_sym)[order], np.bincount(owner, minlength=len(words))
