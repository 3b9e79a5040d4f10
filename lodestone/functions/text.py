"""Text columns: folding, normalising, tokens and n-grams (all JVM-side)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Blocks whose accented letters are folded by table; marks elsewhere go by \p{Mn}.
_FOLDED_BLOCKS = ((0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000))
# Java's (?U)\s plus the four separators that Python also counts as white space.
SPACE = r"(?U)[\s\x1c-\x1f]"


def _fold_table() -> tuple[str, str]:
    """Letters that decompose into one letter plus marks, and that letter."""
    accented, plain = [], []
    for first, last in _FOLDED_BLOCKS:
        for letter in map(chr, range(first, last)):
            parts = unicodedata.normalize("NFD", letter)
            base = [p for p in parts if unicodedata.category(p) != "Mn"]
            if len(parts) > 1 and len(base) == 1:
                accented.append(letter)
                plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _fold_table()


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fold(c: Column) -> Column:
    """Strip accents. ASCII text, found by comparing byte and character counts, passes through."""
    stripped = F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}+", "")
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(stripped)


def search_form(c: Column) -> Column:
    """Lower case, no accents, every other run of characters one space; null gives ''."""
    return F.trim(F.regexp_replace(fold(F.lower(text_or_empty(c))), "[^a-z0-9]+", " "))


def social_form(c: Column) -> Column:
    """Lower case, no accents, the marks ! ? , . as spaces, white space collapsed."""
    plain = F.translate(fold(F.lower(text_or_empty(c))), "!?,.", "    ")
    return F.trim(F.regexp_replace(plain, f"{SPACE}+", " "))


def category_key(c: Column) -> Column:
    """Accent- and case-insensitive key of a category name."""
    edges = f"^{SPACE}+|{SPACE}+$"
    return F.lower(F.regexp_replace(fold(c), edges, ""))


def compose(*parts: Column) -> Column:
    """One document text from several columns, in order, null as ''."""
    return F.concat_ws(" ", *[text_or_empty(p) for p in parts])


def has_text(c: Column) -> Column:
    return text_or_empty(c).rlike(r"(?U)[^\s\x1c-\x1f]")


def words(form: Column) -> Column:
    """Words of a text that already has single spaces; '' gives no words."""
    return F.filter(F.split(form, " "), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Index tokens: runs of two or more of [a-z0-9] in the folded lower-case text.

    The same as splitting :func:`search_form` and dropping one-character words, in one regex.
    """
    plain = fold(F.lower(text_or_empty(c)))
    return F.regexp_extract_all(plain, F.lit("([a-z0-9]{2,})"), F.lit(1))


def adjacent(toks: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens as structs ``w0 .. w(n-1)``."""
    size = F.greatest(F.size(toks) - F.lit(n - 1), F.lit(0))
    fields = ", ".join(f"w{i}: string" for i in range(n))
    parts = [F.slice(toks, i + 1, size) for i in range(n)]
    return F.arrays_zip(*parts).cast(f"array<struct<{fields}>>")


def ngrams(toks: Column, span: Sequence[int] = (1, 2)) -> Column:
    """All n-grams for ``span[0] <= n <= span[1]``; neighbours are joined by one space.

    ``toks`` is read several times, so pass a column of an earlier ``select``.
    """

    def of(n: int) -> Column:
        if n == 1:
            return toks
        size = F.greatest(F.size(toks) - F.lit(n - 1), F.lit(0))
        joined = F.slice(toks, 1, size)
        for i in range(1, n):
            joined = F.zip_with(joined, F.slice(toks, i + 1, size), lambda a, b: F.concat(a, F.lit(" "), b))
        return joined

    low, high = span
    return F.concat(*[of(n) for n in range(low, high + 1)])


def long_words(form: Column, longer_than: int = 3) -> Column:
    return F.array_distinct(F.filter(words(form), lambda w: F.length(w) > longer_than))


def pieces(word: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters (none for shorter words)."""
    last = F.length(word) - F.lit(size - 1)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(word, i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(cut))


def phrase_words(phrases: Column) -> Column:
    """The set of single words used by an array of phrases."""
    return F.array_distinct(F.flatten(F.transform(phrases, words)))


def code_lines(c: Column, comment: str = "#") -> Column:
    """Number of lines that are neither blank nor a comment."""
    lines = F.split(text_or_empty(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    bare = F.transform(lines, lambda s: F.regexp_replace(s, f"^{SPACE}+", ""))
    return F.size(F.filter(bare, lambda s: (s != "") & ~s.startswith(comment)))


def short_label(c: Column, length: int, prefix: str = "") -> Column:
    """A label on one line: known prefix removed, line breaks as spaces, cut to ``length``."""
    bare = F.replace(c, F.lit(prefix), F.lit("")) if prefix else c
    return F.substring(F.translate(bare, "\n", " "), 1, length)


def score_label(similarity: Column, digits: int = 3, missing: str = "fallback") -> Column:
    return F.when(similarity.isNull(), F.lit(missing)).otherwise(F.format_string(f"%.{digits}f", similarity))
