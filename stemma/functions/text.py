"""Text functions as Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GAP, GREEK, LETTER_BINS, SHINGLE, Alphabet

#: White space as Python's ``str.isspace`` has it (fixed values).
_BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{_BLANKS}]"


def _col(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


@cache
def _folding(letters: str, folds: tuple[tuple[str, str], ...]) -> tuple[str, str]:
    """All characters that become a letter of the alphabet or a blank, and which.

    Made by rule: decomposed, without combining marks, in lower case, variants read as one.
    Decomposition is context-free but for the order of marks, which are dropped; hence one
    ``translate`` does the work of a normalisation that Spark lacks.
    """
    fold, source, target = dict(folds), [], []
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        base = [x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x)]
        out = [" " if x.isspace() else y for x in base if (y := fold.get(x.lower(), x.lower())) and (x.isspace() or y in letters)]
        if len(out) == 1 and out[0] != chr(c):
            source.append(chr(c))
            target.append(out[0])
    return "".join(source), "".join(target)


def ranges(letters: str) -> str:
    """The letters as ranges of a character class, which are tested faster than single characters."""
    runs: list[list[int]] = []
    for c in sorted(set(map(ord, letters))):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)


def normalize(text: Column | str, alphabet: Alphabet = GREEK) -> Column:
    """Letters of the alphabet with single blanks; runs of losses parted only by blanks are one loss.

    Null stays null. Signs outside the alphabet vanish before losses are merged, so ``▯[3]▯`` is one.
    """
    source, target = _folding(alphabet.letters, tuple(alphabet.folds.items()))
    t = F.translate(_col(text), source, target)
    t = F.regexp_replace(t, f"[^{ranges(alphabet.letters + alphabet.gap + ' ')}]+", "")
    t = F.trim(F.regexp_replace(t, " {2,}", " "))
    return F.regexp_replace(t, f"{alphabet.gap}(?: *{alphabet.gap})+", alphabet.gap)


def without_blanks(line: Column | str) -> Column:
    return F.replace(_col(line), F.lit(" "), F.lit(""))


def count_letters(text: Column | str, gap: str = GAP) -> Column:
    """Characters that are no loss, blank or line break."""
    return F.length(F.translate(_col(text), f"{gap} \n", ""))


def letters_in(lines: Column | str) -> Column:
    return F.coalesce(count_letters(F.array_join(_col(lines), "")), F.lit(0))


def text_lines(lines: Column | str) -> Column:
    """Lines with at least one letter."""
    return F.size(F.filter(_col(lines), lambda x: count_letters(x) > 0))


def joined(lines: Column | str) -> Column:
    """The searchable text of a document: its lines, a line break between two."""
    return F.array_join(_col(lines), "\n")


def letters_only(token: Column | str, alphabet: Alphabet = GREEK) -> Column:
    return F.regexp_replace(normalize(token, alphabet), f"[^{ranges(alphabet.letters)}]+", "")


def ngrams(text: Column | str, n: int, barriers: str = f"{GAP}\n") -> Column:
    """All overlapping n-grams in order, none across a loss or line break; a linear pass, [] for short texts."""
    return F.regexp_extract_all(_col(text), F.lit(f"(?=([^{barriers}]{{{n}}}))"), F.lit(1))


def shingles(text: Column | str, k: int = SHINGLE) -> Column:
    """The distinct k-grams of a text, whatever its characters."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1)))


def query_terms(query: Column | str, n: int) -> Column:
    """The n-grams of a query, or the query itself where it is shorter."""
    q = _col(query)
    return F.when(F.length(q) >= n, ngrams(q, n)).otherwise(F.array(q))


def letter_positions(text: Column | str, alphabet: Alphabet = GREEK) -> Column:
    """Offsets (from 0) of the letters of the alphabet."""
    t = _col(text)
    return F.when(F.length(t) > 0, F.filter(F.transform(F.split(t, ""), lambda c, i: F.when(F.lit(alphabet.letters).contains(c) & (c != ""), i)), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))


def year(value: Column | str) -> Column:
    """The signed four-digit year at the start of a date; null if there is none, or for a year 0."""
    y = F.nullif(F.regexp_extract(F.trim(_col(value)), r"^-?\d{4}", 0), F.lit("")).cast("int")
    return F.nullif(y, F.lit(0))


def middle(lo: Column | str, hi: Column | str) -> Column:
    return (_col(lo).cast("double") + _col(hi)) / 2


def url_key(url: Column | str) -> Column:
    """The last part of a URL, percent-decoded; outer blanks and final slashes don't count, ``+`` stays, and so does what can't be decoded."""
    last = F.regexp_extract(F.regexp_replace(F.trim(_col(url)), "/+$", ""), "[^/]*$", 0)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def size_bin(letters: Column | str, edges: tuple[int, ...] = LETTER_BINS) -> Column:
    """The name of the bin of a size: '0', '1–19', …, '≥2000' for the default edges."""
    n = _col(letters)
    out = F.when(n < edges[0], "0")
    for a, b in zip(edges, edges[1:]):
        out = out.when(n < b, f"{a}–{b - 1}")
    return out.when(n >= edges[-1], f"≥{edges[-1]}")


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1): the first 8 bytes of the SHA-256 of the parts joined with ``|``."""
    return _fraction(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))


def _fraction(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hash_split(key: Column | str, shares: dict[str, float], seed: int) -> Column:
    """The split of a key: where its hash falls among the cumulative shares; the last name takes what rounding leaves."""
    h = _fraction(F.concat(F.lit(f"{seed}:"), _col(key)))
    edge, out = 0.0, None
    for name, share in shares.items():
        edge += share
        out = F.when(h < edge, name) if out is None else out.when(h < edge, name)
    return F.when(_col(key).isNotNull(), out.otherwise(list(shares)[-1]))


#: Inflectional endings, tried in this order (fixed values).
ENDINGS = ("ομαι", "ευσ", "εω", "αω", "οω", "μι", "οσ", "ον", "ησ", "ασ", "ισ", "υσ", "ωσ", "ων", "αι", "οι", "ω", "η", "α")


def headword_stem(line: Column | str, alphabet: Alphabet = GREEK) -> Column:
    """The stem of a dictionary line's headword: its first word before a stop or comma, as letters, without the first listed ending that leaves four; null if there is none of four letters."""
    word = letters_only(F.regexp_extract(_col(line), rf"^{SPACE}*([^{_BLANKS}]+){SPACE}*[.,]", 1), alphabet)

    def stem(w: Column) -> Column:
        out = F.when(F.length(w) < 4, F.lit(None).cast("string"))
        for end in ENDINGS:
            out = out.when(w.endswith(end) & (F.length(w) >= len(end) + 4), F.substring(w, F.lit(1), F.length(w) - len(end)))
        return out.otherwise(w)

    return bind(word, stem)
