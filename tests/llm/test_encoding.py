import os
import random

import pytest
from pyspark.sql import functions as F

from stemma.llm import encoding

from ..conftest import rows

PATH = os.environ.get("STEMMA_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")

TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\r\nb", "it's we'll I'd 'sx ' s", "<|endoftext|> <s>", "ἐρρῶσθαί σε εὔχομαι", "aaaa aaaaaaaaaaaaaaaa" * 3, "x" * 3000, "\x00\x1c\x85\xa0 　a​ b",
    "𐅷🜁 12 345a6", "   a b c", "a\t b \tc", "tab\x1cb \x1cc", "ζ" * 500 + " " * 40 + "η", "é ́e",
]


@pytest.fixture(scope="module")
def exact():
    import tiktoken

    ranks = encoding.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids(spark, exact):
    r = random.Random(1)
    alphabet = "aábe'stς ἀω\n\r\t   ,.-1²³x𐅷́​\x1c\x85"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = dict(rows(encoding.encode_corpus(d.repartition(5), PATH)))
    assert [i for i, t in enumerate(texts) if got[i] != exact(t or "")] == []
    assert rows(encoding.encode_corpus(d.limit(0), PATH)) == []
    assert encoding.encode_corpus(d, PATH).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]


def test_late_merges_and_small_memory(exact, monkeypatch):
    ranks = encoding.read_ranks(PATH)
    merges = encoding.merges_of(ranks)
    assert len(merges) == len(ranks) - 256
    r = random.Random(2)
    words = ["".join(r.choice("thersonaige") for _ in range(r.randrange(1, 40))) for _ in range(300)]
    for dense in (0, 50, 60_000):
        monkeypatch.setattr(encoding, "DENSE", dense)
        monkeypatch.setattr(encoding, "KEPT", 10)
        e = encoding.Encoder(ranks, merges)
        assert [x.tolist() for x in e(words)] == [exact(w) for w in words]
        assert [x.tolist() for x in e(words[::-1])] == [exact(w) for w in words[::-1]]


def test_round_trip(spark):
    tokens = {r: t for t, r in encoding.read_ranks(PATH).items()}
    d = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for i, ids in rows(encoding.encode_corpus(d, PATH)):
        assert b"".join(tokens[x] for x in ids).decode() == (TEXTS[i] or "")


def test_blanks_are_known():
    import regex

    assert [c for c in map(chr, range(0x110000)) if regex.match(r"\s", c) and not c.isspace()] == []
