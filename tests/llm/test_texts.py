import math
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from stemma.llm import arrays, distinctive, leakage, near, overlap, shingles, spans, suffixes

from ..conftest import rows
from ..test_relations import union_find

GREEK = "αβγδεζηθικλμνξοπρστυφχψω"


def word(r, n, letters=GREEK):
    return "".join(r.choice(letters) for _ in range(n))


def edited(r, t, n):
    t = list(t)
    for _ in range(n):
        i = r.randrange(len(t))
        t[i : i + r.randrange(2)] = word(r, r.randrange(2))
    return "".join(t)


def editions(spark, seed=1, n=60):
    """Texts, near copies, copies with other line breaks and gaps, periodic and short texts, nulls."""
    r = random.Random(seed)
    docs = []
    for i in range(n):
        t = word(r, r.randrange(20, 160))
        docs.append((f"a{i:03}", t))
        if i % 3 == 0:
            docs.append((f"b{i:03}", edited(r, t, r.randrange(0, 4))))
        if i % 5 == 0:
            docs.append((f"c{i:03}", t))
        if i % 6 == 0:
            docs.append((f"e{i:03}", t[len(t) // 2 :] + t[: len(t) // 2]))
    docs += [("p1", "αι" * 12), ("p2", "αι" * 30), ("p3", "ια" * 12), ("s1", "α" * 20), ("s2", "α" * 19), ("s3", "α" * 500), ("w1", word(r, 9000)), ("m1", "x" * 25 + "y"), ("m2", "x" * 25 + "z")]
    docs.append(("w2", edited(r, docs[-3][1], 150)))
    splits = ["train", " Train\t", "VAL", "test", None, "other", "train"]
    out = []
    for i, (d, t) in enumerate(docs):
        cut = sorted(r.randrange(len(t) + 1) for _ in range(3))
        lines = [t[a:b] + r.choice(["", "▯"]) for a, b in zip([0, *cut], [*cut, len(t)])]
        out.append((d, [*lines, None] if i % 4 == 0 else lines, splits[r.randrange(7)], "s" + str(i % 2), "2020-01-01"))
    out += [("null", None, "train", "s0", None), ("empty", [], "val", "s0", None), (None, ["α" * 30], "test", "s0", None), ("blank", [""], "test", "s0", None)]
    out += out[:7]
    out += [("a001", ["superseded" * 5], "val", "s0", "2019-01-01"), ("a002", out[0][1], "train", "s0", "2019-01-01")]
    return spark.createDataFrame(out, "doc_id string, lines array<string>, split string, source string, loaded_at string").withColumns({"id": F.lit(1), "text": F.lit("clash"), "k": F.lit(2), "side": F.lit(9), "size": F.lit(0), "at": F.lit(0)})


def truth(docs):
    last = {}
    for r in docs.collect():
        if r["doc_id"] is not None:
            last[r["doc_id"]] = max(last.get(r["doc_id"], ("",)), (r["loaded_at"] or "", "".join(x or "" for x in r["lines"] or []).replace("▯", ""), (r["split"] or "").strip(" \t").lower()))
    sets = {d: {t[i : i + 5] for i in range(len(t) - 4)} for d, (_, t, _) in last.items() if len(t) >= 20}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return pairs, {d: s for d, (_, _, s) in last.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_and_overlap(spark, seed):
    docs = editions(spark, seed)
    pairs, split = truth(docs)
    want = union_find(pairs)
    got = near.near_duplicate_groups(docs)
    assert rows(got, "doc_id", "group_id") == sorted(want.items(), key=repr)
    cross = {(a, b) if split[a] == "train" else (b, a) for a, b in pairs if {split[a], split[b]} in ({"train", "val"}, {"train", "test"})}
    o = overlap.cross_split_overlaps(docs.repartition(3))
    assert set(rows(o, "train_id", "held_id")) == cross and o.count() == len(cross)
    assert o.where("similarity < 0.8 or similarity > 1 or train_cover > 1 or held_cover <= 0").count() == 0
    report = overlap.overlap_report(docs, o)
    assert report.agg(F.sum("pairs")).first()[0] == len(cross)


def test_hot_shingles_go_in_chunks(spark, monkeypatch):
    docs = editions(spark, 3, 30)
    pairs, split = truth(docs)
    monkeypatch.setattr(near, "CHUNK", 2)
    monkeypatch.setattr(overlap, "CHUNK", 2)
    assert rows(near.near_duplicate_groups(docs), "doc_id", "group_id") == sorted(union_find(pairs).items(), key=repr)
    cross = {tuple(sorted(p)) for p in pairs if {split[p[0]], split[p[1]]} in ({"train", "val"}, {"train", "test"})}
    assert {tuple(sorted(p)) for p in rows(overlap.cross_split_overlaps(docs), "train_id", "held_id")} == cross


def test_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near, "GROUP", 3)
    r = random.Random(9)
    base = [word(r, 150) for _ in range(3)]
    texts = {f"g{i:03}": edited(r, base[i % 3], r.randrange(0, 5)) for i in range(150)}
    texts |= {f"x{i:03}": edited(r, base[i % 3], 4 + i % 9) for i in range(30)}
    texts |= {f"y{i:03}": word(r, 60) + base[i % 3][:90] for i in range(9)} | {"z": base[0] + base[1]}
    docs = spark.createDataFrame([(d, [t], "train", "s", None) for d, t in texts.items()], "doc_id string, lines array<string>, split string, source string, loaded_at string")
    pairs, _ = truth(docs)
    want = sorted(union_find(pairs).items(), key=repr)
    for chunk in (4096, 16, 2):
        monkeypatch.setattr(near, "CHUNK", chunk)
        assert rows(near.near_duplicate_groups(docs)) == want
    n = len(texts)
    key, ids, f = np.full(n, 5, np.uint64), np.arange(n), np.full(n, n)
    heavy = np.arange(n) % 3 == 0
    i, k = near.block_keys(key, ids, f, np.full(n, heavy.sum()), heavy)
    met = {}
    for a, b in zip(i.tolist(), k.tolist()):
        met.setdefault(b, []).append(a)
    pairs = {(a, b) for m in met.values() for a in m for b in m if a < b}
    assert all((a, b) in pairs for a in range(n) for b in range(a + 1, n) if not (heavy[a] and heavy[b])) and max(map(len, met.values())) < 25


def test_no_editions(spark):
    docs = editions(spark).limit(0)
    assert rows(near.near_duplicate_groups(docs)) == [] and rows(overlap.cross_split_overlaps(docs)) == []


def test_trie_is_complete():
    rng = np.random.default_rng(7)
    n = rng.integers(20, 200, 300)
    base = rng.integers(0, 2**63, (20, 4), dtype=np.uint64)
    bits = base[rng.integers(0, 20, 300)] ^ (rng.integers(0, 2**63, (300, 4), dtype=np.uint64) & rng.integers(0, 2**63, (300, 4), dtype=np.uint64) & rng.integers(0, 2**63, (300, 4), dtype=np.uint64) & rng.integers(0, 2**63, (300, 4), dtype=np.uint64))
    block, rank = rng.integers(0, 4, 300), np.zeros(300, np.int64)
    group = np.where(rng.integers(0, 3, 300) == 0, 7, np.arange(1000, 1300))
    i, j = near.trie_pairs(block, [b.astype(">u8").tobytes() for b in bits], n, rank, group)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    want = set()
    for a in range(300):
        for b in range(a):
            far = int(sum(np.bitwise_count(bits[a] ^ bits[b])))
            if block[a] == block[b] and group[a] != group[b] and shingles.alike_sizes(n[a], n[b]) and far <= shingles.budget(n[a], n[b]):
                want.add((b, a))
    assert got == want and len(want) > 20


def test_trie_of_several_widths():
    """Sets of 100 to 5,000 shingles with near copies: all alike pairs and no others come out, whatever the widths of their sketches."""
    rng = np.random.default_rng(11)
    sets = []
    for n in rng.integers(100, 5000, 90).tolist():
        base = rng.choice(1 << 40, n, replace=False)
        sets.append(base)
        for drop in (0.02, 0.08, 0.1, 0.3):
            sets.append(np.r_[base[int(drop * n) :], rng.choice(1 << 40, int(drop * n * rng.random()), replace=False)])
    h = np.concatenate(sets).astype(np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    n = np.bincount(row)
    sketches = shingles.wide_parity(row, h, n)
    i, j = near.trie_pairs(np.zeros(len(n), np.int64), sketches, n, np.zeros(len(n), np.int64), np.arange(len(n)))
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    assert len(got) == len(i)
    as_set = [set(x.tolist()) for x in sets]
    alike = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 5 * len(as_set[a] & as_set[b]) >= 4 * len(as_set[a] | as_set[b])}
    assert alike <= got and len(got - alike) < 0.5 * len(alike) and len(set(map(len, sketches))) == 5


@pytest.mark.parametrize("letters", [150, 600, 3000])
def test_trie_prunes(letters):
    """Of unrelated texts of one length no pair is within the budget."""
    r = random.Random(letters)
    texts = [word(r, letters) for _ in range(200)]
    row, h = shingles.distinct_shingles(texts)
    n = np.bincount(row)
    i, _ = near.trie_pairs(np.zeros(200, np.int64), shingles.wide_parity(row, h, n), n, np.zeros(200, np.int64), np.arange(200))
    assert len(i) == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=60), st.sets(st.integers(0, 400), max_size=60))
def test_parity_never_overestimates(a, b):
    h = lambda s: arrays.mix(np.array(sorted(s), np.uint64)) & np.uint64((1 << 48) - 1)
    row = np.r_[np.zeros(len(a), np.int64), np.ones(len(b), np.int64)]
    p = shingles.parity(row, np.r_[h(a), h(b)].astype(np.uint64), 2)
    assert int(np.bitwise_count(p[0] ^ p[1]).sum()) <= len(a ^ b)


@pytest.mark.parametrize("letters", ["αβγ", GREEK, "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))])
def test_suffix_array(letters):
    """Both sides sorted together: the nearest of the other side gives the longest prefix. Sorted side by side, few would be neighbours."""
    r = random.Random(4)
    texts = [word(r, r.randrange(0, 60), letters) for _ in range(12)]
    texts += [edited(r, t, 2) for t in texts if t] + ["αβγ" * 9, "αβγ" * 5, texts[0]]
    sides = np.array([r.randrange(1, 4) if i > 3 else 1 + i % 2 for i in range(len(texts))])
    alphabet = suffixes.Alphabet(np.array([ord(c) for t in [*texts, letters] for c in t], np.uint32))
    b = suffixes.Block(texts, alphabet)
    mask = overlap._of_entries(b, sides)
    spans = suffixes.cross_neighbours(b.keys, mask, alphabet)[b.entry].astype(int)
    base = np.cumsum(b.size) - b.size
    seen, got = set(), suffixes.covered(b, len(texts), spans[:, 0])
    for p, row, span in zip(b.pos, b.row[b.pos], spans):
        at = p - base[row]
        seen.add((row, at))
        for s in (0, 1):
            if sides[row] >> s & 1:
                own = texts[row][at : at + suffixes.DEPTH]
                of = [t for t, x in zip(texts, sides) if x >> (1 - s) & 1]
                assert span[s] == max((n for n in range(5, len(own) + 1) if any(own[:n] in t for t in of)), default=0)
    assert seen == {(i, j) for i, t in enumerate(texts) for j in range(len(t) - 4)}
    for i, t in enumerate(texts):
        others = "\n".join(x for x, s in zip(texts, sides) if s & 2)
        assert not sides[i] & 1 or got[i] == len({j + k for j in range(len(t) - 4) if t[j : j + 5] in others for k in range(5)})
    text, shingle = b.pairs()
    assert len(text) == sum(len({t[j : j + 5] for j in range(len(t) - 4)}) for t in texts)
    assert len(np.unique(b.codes(alphabet))) == len(b.shingle_start)
    keys, more = suffixes.unpack_keys(suffixes.pack_keys(b.keys, mask), alphabet.words, np.uint8)
    assert (keys == b.keys).all() and (more[0] == mask).all()


@pytest.mark.parametrize("block", [1_000_000, 500])
def test_coverage(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "LETTERS", block)
    docs = editions(spark, 6)
    last = {}
    for r in docs.where("doc_id is not null").collect():
        last[r["doc_id"]] = max(last.get(r["doc_id"], ("",)), (r["loaded_at"] or "", "".join(x or "" for x in r["lines"] or []).replace("▯", ""), (r["split"] or "").strip(" \t").lower()))
    side = {d: {"train": 0, "val": 1, "test": 1}[s] for d, (_, t, s) in last.items() if s in ("train", "val", "test") and len(t) >= 20}
    grams = [{last[d][1][i : i + 5] for d, x in side.items() if x == s for i in range(len(last[d][1]) - 4)} for s in (0, 1)]
    want = []
    for d, s in side.items():
        t = last[d][1]
        want.append((d, s, len(t), len({i + k for i in range(len(t) - 4) if t[i : i + 5] in grams[1 - s] for k in range(5)})))
    assert rows(overlap.split_coverage(docs), "doc_id", "split_side", "letters", "covered") == sorted(want, key=repr)
    assert rows(overlap.split_coverage(docs.limit(0))) == []


def test_merged():
    assert overlap.merged([(0, 5), (3, 8), (10, 12)]) == 10 and overlap.coverage("αβγδεζ", "xαβγδεx") == 5


def test_distinctive(spark):
    r = random.Random(5)
    lines = [[word(r, 40, "αβγ") if i % 2 else word(r, 30) + "ζηθζηθζηθζηθζηθ", "▯".join(word(r, 9, "αβ") for _ in range(3)), None] for i in range(30)]
    lines += [None, [], ["αβγ"], ["x" * 20], ["x" * 5000 + "▯"], [chr(0x4E00 + i) for i in range(300)] + ["".join(chr(0x4E00 + i) for i in range(300)) * 3]]
    data = [(f"d{i:02}", x) for i, x in enumerate(lines)]
    docs = spark.createDataFrame([*data, *data[:5], (None, ["x" * 30])], "doc_id string, lines array<string>").withColumns({"term": F.lit(1), "tf": F.lit(1), "text": F.lit("clash")})
    tf = {}
    for d, ls in data:
        for x in ls or []:
            for i in range(len(x or "") - 5):
                if "▯" not in x[i : i + 6]:
                    tf[d, x[i : i + 6]] = tf.get((d, x[i : i + 6]), 0) + 1
    df, cf = {}, {}
    for (d, t), n in tf.items():
        df[t], cf[t] = df.get(t, 0) + 1, cf.get(t, 0) + n
    for least in (1, 3):
        got = {(x["doc_id"], x["term"]): x for x in distinctive.distinctive_terms(docs, min_count=least).collect()}
        assert {k: (x["tf"], x["df"], x["cf"]) for k, x in got.items()} == {(d, t): (n, df[t], cf[t]) for (d, t), n in tf.items() if n >= least}
        for (d, t), x in got.items():
            ridf = -math.log2(df[t] / len(data)) + math.log2(1 - math.exp(-cf[t] / len(data)))
            assert abs(x["ridf"] - ridf) < 1e-9 and abs(x["score"] - ridf * x["tf"]) < 1e-9
    assert rows(distinctive.distinctive_terms(docs.limit(0), min_count=3)) == []


def brute_spans(docs, span):
    by = {}
    for d, t in docs:
        if t and d is not None:
            for i in range(len(t) - span + 1):
                by.setdefault(t[i : i + span], set()).add(d)
    out = set()
    for d, t in docs:
        if t and d is not None:
            on = [False] * len(t)
            for i in range(len(t) - span + 1):
                if len(by[t[i : i + span]]) > 1:
                    on[i : i + span] = [True] * span
            i = 0
            while i < len(t):
                if on[i]:
                    j = i
                    while j < len(t) and on[j]:
                        j += 1
                    out.add((d, i, j))
                    i = j
                i += 1
    return sorted(out, key=repr)


def running_texts(seed):
    r = random.Random(seed)
    pool = [word(r, r.randrange(30, 120), "abcd 𐅷\n") for _ in range(12)]
    docs = [(i, "".join(r.choice([*pool, word(r, 40)]) for _ in range(r.randrange(0, 12)))) for i in range(50)]
    docs += [(100, None), (101, ""), (102, "a" * 300), (103, "a" * 90), (104, "ab" * 100), (105, docs[3][1]), (106, docs[3][1]), (None, docs[3][1]), (107, "a" * 60), (108, "x" * 30 + "a" * 60 + "y")]
    return docs


@pytest.mark.parametrize("seed,hot", [(1, 5000), (2, 1), (3, 5000)])
def test_spans(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    docs = running_texts(seed)
    df = spark.createDataFrame([*docs, docs[0], docs[7]], "doc_id long, text string").withColumns({"id": F.lit(1), "key": F.lit(1), "n": F.lit("x")})
    got = spans.shared_spans(df, 60, anchor=20)
    assert rows(got) == brute_spans(docs, 60)
    assert rows(spans.shared_spans(df.repartition(7), 60, anchor=20)) == brute_spans(docs, 60)
    share = {r["doc_id"]: r for r in spans.shared_share(df, got).collect()}
    assert share[105]["share"] == 1.0 and 103 in share


def test_spans_empty_and_full_sketch(spark, monkeypatch):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert rows(spans.shared_spans(df)) == []
    full = np.full((1 << 16) * spans.DEPTH, 255, np.uint8)
    monkeypatch.setattr(spans, "count_min", lambda *a: full)
    assert spans.fill_ratio(full) == 1.0
    docs = running_texts(4)
    assert rows(spans.shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), 60, anchor=20)) == brute_spans(docs, 60)


def test_anchors_hang_on_the_stretch_alone():
    r = random.Random(8)
    stretch = "".join(r.choice("ab") * r.randrange(1, 9) for _ in range(60))[:200]
    for k, span in ((4, 12), (8, 40), (64, 200)):
        for before, others in ((0, 0), (7, 2), (150, 900), (33, 9000)):
            texts = [word(r, others), word(r, before) + stretch + word(r, 50), word(r, others)]
            row, pos, h = spans.anchors(texts, span, k)
            inside = (row == 1) & (pos >= before) & (pos + k <= before + len(stretch))
            got = {(p - before, x) for p, x in zip(pos[inside].tolist(), h[inside].tolist())}
            hashes = arrays.rolling(np.frombuffer(stretch.encode("utf-32-le"), np.uint32), k)
            brute = {o + int(np.argmin(hashes[o : o + span - k + 1])) for o in range(len(stretch) - span + 1)}
            assert brute <= {p for p, _ in got}


def plain(t):
    t = unicodedata.normalize("NFD", t).lower().replace("ς", "σ").replace("ϲ", "σ")
    return "".join(c for c in t if unicodedata.category(c)[0] == "L")


@pytest.mark.parametrize("small,bits", [(2_000_000, 1 << 31), (0, 1 << 20)])
def test_leaks(spark, monkeypatch, small, bits):
    monkeypatch.setattr(leakage, "SMALL", small)
    monkeypatch.setattr(leakage, "MOST_BITS", bits)
    r = random.Random(6)
    items = [(i, word(r, 100, "ἀβΓδές  .σϲ")) for i in range(12)] + [(50, None), (51, ""), (52, "short"), (None, "x" * 99), (60, "ab" * 40)]
    docs = []
    for i in range(60):
        t = word(r, r.randrange(0, 200), "αβγδες ,")
        if i % 2:
            x = items[r.randrange(12)][1]
            a = r.randrange(0, 60)
            x = x[a : a + r.randrange(30, 100)]
            t = t[:50] + r.choice([x, unicodedata.normalize("NFD", x).upper(), " - ".join(x), edited(r, x, 2)]) + t[50:]
        docs.append((i, t))
    docs += [(70, None), (71, ""), (72, "AB" * 300), (None, items[0][1]), (73, "\x00​" + items[1][1] + "<|endoftext|>")]
    want = set()
    for d, t in docs:
        for i, x in items:
            if t and x and d is not None and i is not None:
                a, b = plain(t), plain(x)
                if any(b[p : p + 48] in a for p in range(len(b) - 47)):
                    want.add((d, i))
    dd = spark.createDataFrame([*docs, docs[1], docs[5]], "doc_id long, text string").withColumns({"id": F.lit(1), "item_id": F.lit(2), "item": F.lit(2)})
    ii = spark.createDataFrame([*items, items[3]], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = leakage.leaked_items(dd, ii)
    assert rows(got.where("run >= 48"), "doc_id", "item_id") == sorted(want, key=repr) and len(want) > 5
    assert got.where("score < 2 * run or share > 1").count() == 0
    assert rows(leakage.leaked_items(dd.limit(0), ii)) == [] and rows(leakage.leaked_items(dd, ii.limit(0))) == []


def test_leaks_of_short_runs(spark):
    r = random.Random(9)
    items = [(i, word(r, 300, "abcdefghijklmnopqrstuvwxyz")) for i in range(3)]
    steps = (15, 30, 40)
    docs = [(i, "".join("#" if n % steps[i] == steps[i] - 1 else c for n, c in enumerate(x)).replace("#", "ß")) for i, x in items]
    got = rows(leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id", "run", "score")
    changed = [300 // s for s in steps]
    assert got == [(i, i, steps[i] - 1, 2 * 300 - 3 * changed[i] + (300 % steps[i] == 0)) for i in range(3)]


def full_score(item, text):
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (item, text))
    return int(leakage.align(a, b, np.array([0]), np.array([len(b)]), np.array([-len(a)]), len(a) + len(b))[0][0])


def test_recall_of_edited_copies(spark):
    """Of planted copies with 2 to 20 % of their letters edited that score as 48 equal letters or more, nine tenths or more are found at each rate."""
    r = random.Random(12)
    items = [(i, word(r, r.randrange(80, 150))) for i in range(60)]
    docs, planted = [], {}
    for rate in (2, 5, 10, 15, 20):
        for i, x in items:
            out = "".join(c if r.random() >= rate / 100 else r.choice([word(r, 1)] * 3 + [c + word(r, 1), ""]) for c in x)
            d = len(docs)
            docs.append((d, word(r, r.randrange(0, 400)) + out + word(r, r.randrange(0, 200))))
            if full_score(x, docs[-1][1]) >= 96:
                planted.setdefault(rate, set()).add((d, i))
    got = set(rows(leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id"))
    recall = {rate: len(got & of) / len(of) for rate, of in planted.items()}
    print(recall, {rate: len(of) for rate, of in planted.items()})
    assert got <= set().union(*planted.values()) and min(recall.values()) >= 0.9 and len(recall) == 5


def test_settle_document_zero():
    window = "abcd"
    for other in (0, 3):
        contexts = [("x" + window, other, [10], False), (window + "y", 1, [20], False), (window + "y", 2, [30], False)]
        for order in (contexts, contexts[::-1]):
            assert sorted(set(spans.settle(order, 4))) == sorted([(other, 11, 15), (1, 20, 25), (2, 30, 35)]), (other, order)


def test_alignment():
    def slow(x, y):
        h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                h[i + 1][j + 1] = max(0, h[i][j] + (2 if x[i] == y[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        return max(map(max, h))

    r = random.Random(8)
    for _ in range(60):
        x, y = word(r, r.randrange(1, 15), "abc"), word(r, r.randrange(1, 15), "abc")
        assert full_score(x, y) == slow(x, y)
