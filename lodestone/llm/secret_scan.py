"""Secrets in texts: known forms, and strings that look drawn at random.

A string of one encoding's symbols is tested three ways: chi-squared against equal use of
the alphabet, the number of runs above and below its middle, and the correlation of
neighbours. The runs and the correlation must not contradict randomness. The chi-squared
statistic gives a p-value for the string being ordinary text: for text of that length,
whose letters coincide as often as in language, how likely is a use of the alphabet as even as
this. Strings of one case have too few symbols for that statistic to tell, so it has a second one
there: how much better equal use explains the string than ordinary text does, in which letters
have the shares of language and letters and digits come in groups. These p-values are held against a false-discovery bound (Benjamini-Hochberg)
within each band of lengths, over all strings of all documents.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import stored, with_text_columns, without

KINDS = ("assign", "access", "hex", "random")
# fixed values: the known forms
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer is no match, and no part of one
_STRING = re.compile(r"[A-Za-z0-9+/_-]{20,}")

# Encodings by their alphabets, in order; a string is of the first that has all its symbols.
_ALPHABETS = (
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
_SYMBOLS = [{c: i for i, c in enumerate(a)} for a in _ALPHABETS]
# Chance that two letters of ordinary text agree.
COINCIDENCE = 0.065
# Shares of the letters a to z in ordinary text, as percent: rounded means of English, French, German, Spanish
# and Italian, 0.3 at least.
_LETTER_SHARES = (9.3, 1.3, 3.7, 4.5, 14.1, 1.3, 1.7, 2.6, 7.9, 0.3, 0.5, 4.9, 2.7, 7.4, 6.8, 2.2, 0.6, 6.6, 6.9, 6.5, 4.0, 1.3, 0.9, 0.3, 0.6, 0.5)
# Chance that a letter follows a digit, or a digit a letter, in ordinary text that holds both.
SWITCH = 0.15
# Ways to part a string that no alphabet has all symbols of.
_PARTS = tuple(re.compile(rf"[^{separators}]{{20,}}") for separators in ("+/", "_-", "+/_-"))
# Share of false ones among the strings reported, in each band of lengths.
FALSE_SHARE = 0.01
# Runs and correlation contradict randomness below this p-value.
DOUBT = 0.001
# Bands double in length from the shortest string; p-values are counted in steps of this many per decade.
_STEPS, _LEAST = 20, 300

_SPAN = pa.struct([pa.field(n, pa.int32()) for n in ("kind", "start", "end", "band", "step")])
FIELDS = [pa.field("found", pa.list_(_SPAN))]


def _upper(z: float) -> float:
    """P(normal > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _ratios(alphabet: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Logarithms of how much likelier than in ordinary text each symbol is under equal use, and each change
    between digits (0) and letters (1); and which symbols are letters. None for an alphabet of both cases."""
    letters = [c for c in alphabet if c.isalpha()]
    if len({c.lower() for c in letters}) < len(letters):
        return None
    shares = {c: _LETTER_SHARES[ord(c.lower()) - ord("a")] for c in letters}
    total = sum(shares.values())
    symbols = np.array([math.log(total / len(letters) / shares[c]) if c in shares else 0.0 for c in alphabet])
    p = len(letters) / len(alphabet)
    changes = np.log([[(1 - p) / (1 - SWITCH), p / SWITCH], [(1 - p) / SWITCH, p / (1 - SWITCH)]]) if p < 1 else np.zeros((2, 2))
    return symbols, changes, np.array([int(c in shares) for c in alphabet])


_RATIOS = [_ratios(a) for a in _ALPHABETS]


def battery(string: str) -> tuple[float, float, float] | None:
    """p-values: of being ordinary text, and of the runs and the correlation if drawn at random.

    None for a string of digits alone, of one symbol alone, of letters in one case with separators, or of no
    known alphabet.
    """
    used = set(string)
    digits, cases = any(c.isdigit() for c in used), any(c.islower() for c in used) + any(c.isupper() for c in used)
    if len(used) == 1 or all(c.isdigit() for c in used) or not (digits or cases == 2 or string.isalpha()):
        return None
    which = next((i for i, s in enumerate(_SYMBOLS) if used <= s.keys()), None)
    if which is None:
        return None
    table, ratios = _SYMBOLS[which], _RATIOS[which]
    size, n = len(table), len(string)
    x = np.array([table[c] for c in string])
    counts = np.bincount(x, minlength=size)
    chi = float((counts.astype(float) ** 2).sum() * size / n - n)
    # ordinary text: a non-central chi-squared, by the cube-root normal approximation of Sankaran
    k, shift = size - 1, max(n * (size * COINCIDENCE - 1), 0.05 * n)
    h = 1 - 2 * (k + shift) * (k + 3 * shift) / (3 * (k + 2 * shift) ** 2)
    p = (k + 2 * shift) / (k + shift) ** 2
    m = (h - 1) * (1 - 3 * h)
    z = ((max(chi, 0) / (k + shift)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p))
    ordinary = _upper(-z)
    # one case: a likelihood ratio of r has a chance of 1 / r at most (Markov); it does not count where equal use
    # is out of the question (chi-squared by the cube-root approximation). The better of two p-values counts double
    if ratios is not None:
        symbols, changes, letter = ratios
        even = _upper(((chi / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k)))
        ratio = float(symbols[x].sum() + changes[letter[x[:-1]], letter[x[1:]]].sum()) if even >= DOUBT else 0.0
        ordinary = min(1.0, 2 * min(ordinary, math.exp(-max(ratio, 0.0))))
    high = x >= size / 2
    n1 = int(high.sum())
    n0 = n - n1
    if not n0 or not n1:
        return ordinary, 0.0, 0.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 1 + 2 * n0 * n1 / n
    spread = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    by_runs = 2 * _upper(abs(runs - mean) / math.sqrt(spread))
    y = x - x.mean()
    serial = float((y[1:] * y[:-1]).sum() / max((y * y).sum(), 1e-9))
    by_serial = 2 * _upper(abs(serial + 1 / n) * math.sqrt(n))
    return ordinary, by_runs, by_serial


def _step(p: float) -> int:
    """p as a number of steps below 1, rounded towards 1."""
    return int(min(-math.log10(max(p, 10.0**-_LEAST)), _LEAST) * _STEPS)


def _tested(string: str, doubt: float) -> list[tuple[int, int, float]]:
    """Start, end and p-value of what is tested in a string: all of it, or else its parts between separators.

    It is parted in each way; of parts that overlap, the one of the least p-value counts, times the number of ways.
    """

    def value(found: tuple[float, float, float]) -> float:
        return found[0] if min(found[1:]) >= doubt else 1.0

    whole = battery(string)
    if whole is not None:
        return [(0, len(string), value(whole))]
    parts = {m.span() for p in _PARTS for m in p.finditer(string)}
    tried = sorted((min(1.0, len(_PARTS) * value(b)), s, e) for s, e in parts if (b := battery(string[s:e])) is not None)
    out: list[tuple[int, int, float]] = []
    ends: list[tuple[int, int]] = []  # taken, in order
    for p, s, e in tried:
        at = bisect.bisect(ends, (s, e))
        if (at == 0 or ends[at - 1][1] <= s) and (at == len(ends) or e <= ends[at][0]):
            ends.insert(at, (s, e))
            out.append((s, e, p))
    return out


def spans_of(text: str, doubt: float = DOUBT) -> list[tuple[int, int, int, int, int]]:
    """Kind, start, end, band and step of the known forms, and of strings the battery passes or fails.

    Strings that a known form covers are left to it. One that fails the runs or the correlation counts as
    tested, with the p-value 1.
    """
    out = []
    for m in _ASSIGN.finditer(text):
        if len(m[1]) >= 6:
            out.append((0, m.start(), m.end(), 0, 0))
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), 0, 0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(2, m.start(), m.end(), 0, 0) for m in _HEX.finditer(text)]
    known = sorted((s, e) for _, s, e, _, _ in out)
    starts = [s for s, _ in known]
    furthest = list(itertools.accumulate((e for _, e in known), max))  # end of what begins there or before

    def covered(start: int, end: int) -> bool:
        at = bisect.bisect(starts, start)
        return at > 0 and furthest[at - 1] >= end

    for m in _STRING.finditer(text):
        if covered(m.start(), m.end()):
            continue
        for start, end, p in _tested(m[0], doubt):
            start, end = m.start() + start, m.start() + end
            if not covered(start, end):
                out.append((3, start, end, int(math.log2((end - start) / 20)), _step(p)))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def _columns(texts: pa.Array, doubt: float) -> dict[str, pa.Array]:
    found = [spans_of(t, doubt) for t in texts.fill_null("").to_pylist()]
    offsets = np.cumsum([0, *map(len, found)])
    flat = np.array([s for spans in found for s in spans], dtype=np.int32).reshape(-1, 5)
    spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(5)], fields=list(_SPAN))
    return {"found": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)}


def _bounds(tests: DataFrame, share: float) -> dict[int, int]:
    """For each band the least step that is reported: Benjamini-Hochberg over the counts of steps.

    There are at most 6,000 steps in a band and a band for each doubling of the length.
    """
    counts: dict[int, dict[int, int]] = {}
    for r in tests.groupBy("band", "step").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["band"], {})[r["step"]] = r["n"]
    out = {}
    for band, steps in counts.items():
        total, so_far = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            so_far += steps[step]
            if 10 ** (-step / _STEPS) <= share * so_far / total:
                out[band] = step  # the largest p-value that its rank allows
    return out


def find_secrets(docs: DataFrame, text: str = "text", share: float = FALSE_SHARE, doubt: float = DOUBT) -> DataFrame:
    """Every row, without its text, with ``found``: spans (kind, start, end), by start and then kind.

    Positions are code points, ends exclusive. Null and empty texts have no spans. A very
    long text is searched whole. Repeated rows count once each among the strings tested. An empty
    table gives no rows. A column ``found`` is replaced, others are kept. The texts are read
    once; the bounds come from counts over all documents.
    """
    scanned = stored(with_text_columns(without(docs, ["found"]), partial(_columns, doubt=doubt), FIELDS, text))
    tests = scanned.select(F.inline(F.filter("found", lambda s: s.kind == 3))).select("band", "step")
    bounds = _bounds(tests, share)
    keep = " OR ".join(["s.kind < 3", *[f"(s.band = {band} AND s.step >= {step})" for band, step in bounds.items()]])
    names = ", ".join(f"'{k}'" for k in KINDS)
    spans = f"transform(filter(found, s -> {keep}), s -> struct(array({names})[s.kind] AS kind, s.start, s.end))"
    return scanned.withColumn("found", F.expr(spans))
