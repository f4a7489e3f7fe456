import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemma.config import GREEK, LATIN
from stemma.functions import text as T
from stemma.functions.distance import best_match, edit_distance

from .conftest import rows


def plain(text):
    """Character by character, as the rule is stated."""
    out = ""
    for c in unicodedata.normalize("NFD", text):
        if unicodedata.combining(c):
            continue
        if c == "▯":
            out += c
        elif c.isspace():
            out += " "
        else:
            c = GREEK.folds.get(c.lower(), c.lower())
            out += c if c in GREEK.letters else ""
    words = out.split()
    out = []
    for w in words:
        out.append(w)
    s = " ".join(out)
    while "▯ ▯" in s or "▯▯" in s:
        s = s.replace("▯ ▯", "▯").replace("▯▯", "▯")
    return s


CASES = ["ἘΡΡῶσθαι", "ΣΟΣ", "α [3] ▯ ▯ β", "▯[3]▯", "", "ϲϐ Ϝ ϟ", "a α β\x1cγ", "ᾈδης ᾳ", "α\nβ\tγ", "Ω Ω ϑ", "▯ ▯ ▯α▯", "🜁α𐅷β", "ᾴ", "Ὅμηρος. ἄειδε", "  ", "​α"]


def test_normalize(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(CASES + [None])], "i int, t string")
    got = dict(rows(d.select("i", T.normalize("t"))))
    assert got[0] == "ερρωσθαι" and got[1] == "σοσ" and got[2] == "α ▯ β" and got[3] == "▯" and got[len(CASES)] is None
    assert [got[i] for i in range(len(CASES))] == [plain(t) for t in CASES]
    again = dict(rows(d.select("i", T.normalize(T.normalize("t")))))
    assert again == got


def test_every_character(spark):
    chars = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    d = spark.createDataFrame([(i, c) for i, c in enumerate(chars)], "i int, t string")
    got = dict(rows(d.select("i", T.normalize("t"))))
    assert [c for i, c in enumerate(chars) if got[i] != plain(c)] == []


def test_another_alphabet(spark):
    d = spark.createDataFrame([("Élan vítal 42",)], "t string")
    assert rows(d.select(T.normalize("t", LATIN))) == [("elan vital",)]


def test_grams_and_counts(spark):
    d = spark.createDataFrame([(1, "αβγδ▯εζη\nθ"), (2, "αβ"), (3, ""), (4, None)], "i int, t string")
    got = {r[0]: r[1:] for r in rows(d.select("i", T.ngrams("t", 3), T.count_letters("t"), T.shingles("t", 5), T.query_terms("t", 3)))}
    assert got[1][0] == ["αβγ", "βγδ", "εζη"] and got[1][1] == 8
    assert len(got[1][2]) == 6 and got[2][2] == [] and got[3][0] == []
    assert got[2][3] == ["αβ"] and got[4][0] is None


def test_small_parsers(spark):
    d = spark.createDataFrame([("-0099-01", " https://x/y/ddb%3Ba+b%20c/ ", 0), ("0117", "p;1", 19), ("12", None, 20), ("0000", "a/b%zz+", 1999), (None, "/", 2000)], "y string, u string, n int")
    got = d.select(T.year("y"), T.url_key("u"), T.size_bin("n")).collect()
    assert [r[0] for r in got] == [-99, 117, None, None, None]
    assert [r[1] for r in got] == ["ddb;a+b c", "p;1", None, "b%zz+", ""]
    assert [r[2] for r in got] == ["0", "1–19", "20–49", "1000–1999", "≥2000"]


def test_hash_split(spark):
    import hashlib

    from stemma.config import SEED, SHARES

    keys = [f"ddbdp/{i}" for i in range(300)]

    def of(k):
        h, edge = int.from_bytes(hashlib.sha256(f"{SEED}:{k}".encode()).digest()[:8], "big") / 2**64, 0.0
        for name, share in SHARES.items():
            edge += share
            if h < edge:
                return name
        return "test"

    got = dict(rows(spark.createDataFrame([(k,) for k in keys], "k string").select("k", T.hash_split("k", SHARES, SEED))))
    assert got == {k: of(k) for k in keys}


def test_stems(spark):
    lines = ["ἄνθρωπος, ὁ", "  λόγος. x", "βασιλεύς, έως", "ὁ, the", "no stop", "ποταμός", "ἀγορὰ.β, γ"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, t string")
    got = dict(rows(d.select("i", T.headword_stem("t"))))
    assert got[0] == "ανθρωπ" and got[1] == "λογοσ" and got[2] == "βασιλ" and got[3] is None and got[4] is None and got[5] is None


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_edit_distance(a, b):
    assert edit_distance(a, b) == levenshtein(a, b)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=6), st.text("abc▯\n", max_size=12))
def test_best_match(q, t):
    segments = t.replace("\n", "▯").split("▯")
    want = min([len(q)] + [levenshtein(q, s[i:j]) for s in segments for i in range(len(s)) for j in range(i, len(s) + 1)])
    assert best_match(q, t) == want


def test_long_query():
    q = "αβγδε" * 20
    assert best_match(q, "ζ" + q[:50] + "η" + q[51:] + "ζ") == 1


@pytest.mark.parametrize("letters", ["αβ"])
def test_letter_positions(spark, letters):
    d = spark.createDataFrame([(1, "α▯ β\nx"), (2, ""), (3, None)], "i int, t string")
    assert dict(rows(d.select("i", F.coalesce(T.letter_positions("t"), F.array().cast("array<int>"))))) == {1: [0, 3], 2: [], 3: []}
