"""Same or near-same records across splits: a suffix array over the texts of both sides, read for neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stage
from .arrays import mix, product
from .shingles import K, alike_sizes, parts, latest, parity, positions_allow, distinct_shingles, similarity, sizes_of, text_rows
from .splits import read_split
from .suffixes import Alphabet, Block, covered, cross_neighbours, pack, pack_keys, shared_letters, unpack, unpack_keys

#: Texts of one side with one shingle that meet those of the other in one task; more are cut, and each piece meets each piece.
CHUNK = 2048
#: Letters of a block of texts.
LETTERS = 1_000_000


def merged(spans: list[tuple[int, int]]) -> int:
    """Positions covered by the union of half-open spans."""
    total, at = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, at))
        at = max(at, b)
    return total


def coverage(text: str, other: str) -> int:
    """Letters of ``text`` in a span of at least five letters that ``other`` holds too."""
    known = {other[i : i + K] for i in range(len(other) - K + 1)}
    return merged([(i, i + K) for i in range(len(text) - K + 1) if text[i : i + K] in known])


class Sides:
    """The distinct texts of two sides, and the parts of their joint suffix array.

    ``texts`` has ``num``, ``text`` and ``sides`` (bit 0 and bit 1; a text may stand on both).
    """

    def __init__(self, texts: DataFrame):
        letters = pa.schema([("c", pa.int64()), ("n", pa.int64())])

        def seen(batches):
            all_, n = np.zeros(0, np.uint32), 0
            for batch in batches:
                points = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
                all_, n = np.union1d(all_, points), n + len(points)
            yield pa.record_batch([pa.array(all_.astype(np.int64)), pa.array([n if not i else 0 for i in range(len(all_))], pa.int64())], schema=letters)

        # the driver gets one row a letter of the alphabet
        found = texts.select("text").mapInArrow(seen, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
        self.alphabet = Alphabet(np.array([r["c"] for r in found], np.uint32))
        total = sum(r["n"] for r in found)
        self.cell = self.alphabet.cell_letters(total)
        n_blocks = total // LETTERS + 1
        self.texts = texts.withColumn("block", F.pmod(F.xxhash64("num"), F.lit(n_blocks)))

    def suffixes(self) -> DataFrame:
        """The sorted suffixes of each block, cut into cells: ``cell``, ``block``, ``data``."""
        alphabet, letters = self.alphabet, self.cell

        def emit(table: pa.Table) -> pa.Table:
            b, sides, _ = _block(table, alphabet)
            mask = _of_entries(b, sides)
            row, shingle = b.pairs()
            held = [np.bincount(shingle[sides[row] >> s & 1 == 1], minlength=len(b.shingle_start)).astype(np.uint32) for s in (0, 1)]
            cell = (b.keys[:, 0] >> np.uint64(alphabet.bits * (alphabet.per_word - letters))).astype(np.int64)
            edge = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
            out = []
            for lo, hi in zip(edge, np.r_[edge[1:], len(cell)]):
                own = slice(b.shingle[lo], b.shingle[hi - 1] + 1)
                out.append(pack_keys(b.keys[lo:hi], mask[lo:hi], *(h[own] for h in held)))
            return pa.table({"cell": pa.array(cell[edge]), "block": pa.array(np.full(len(edge), table.column("block")[0].as_py())), "data": pa.array(out, pa.binary())})

        return self.texts.groupBy("block").applyInArrow(emit, "cell long, block long, data binary")

    def neighbours(self) -> DataFrame:
        """For each block and cell the longest prefix of each suffix on the other side, and how many texts of both sides hold each shingle."""
        alphabet = self.alphabet

        def meet(table: pa.Table) -> pa.Table:
            got = [unpack_keys(x, alphabet.words, np.uint8, np.uint32, np.uint32) for x in table.column("data").to_pylist()]
            keys = np.concatenate([k for k, _ in got])
            mask = np.concatenate([m[0] for _, m in got])
            order = np.lexsort(keys.T[::-1]) if alphabet.words > 1 else np.argsort(keys[:, 0], kind="stable")
            keys = keys[order]
            spans = np.empty((len(keys), 2), np.uint8)
            spans[order] = cross_neighbours(keys, mask[order], alphabet)
            span = np.empty(len(keys), np.int64)  # which span of K letters: the runs of neighbours with as many in common
            span[order] = np.cumsum(np.r_[False, shared_letters(keys[1:], keys[:-1], alphabet) < K])
            total = np.zeros((int(span.max(initial=0)) + 1, 2), np.int64)
            ends, out, which = np.cumsum([len(k) for k, _ in got]), [], []
            for (k, (_, *held)), end in zip(got, ends):
                own = span[end - len(k) : end]
                which.append(own[np.r_[True, own[1:] != own[:-1]]])
                for s in (0, 1):
                    total[which[-1], s] += held[s]  # a block has each span once
            total = np.minimum(total, 2**32 - 1).astype(np.uint32)
            for (k, _), end, w in zip(got, ends, which):
                a = spans[end - len(k) : end]
                out.append(pack(a[:, 0] | a[:, 1] << np.uint8(4), total[w, 0], total[w, 1]))
            return pa.table({"block": table.column("block"), "cell": table.column("cell"), "reply": pa.array(out, pa.binary())})

        return self.suffixes().groupBy("cell").applyInArrow(meet, "block long, cell long, reply binary")

    def coverage(self) -> DataFrame:
        """``num``, ``side``, ``letters``, ``covered``: letters of each text in spans of five or more that the other side holds."""
        alphabet = self.alphabet

        def cover(table: pa.Table, replies: pa.Table) -> pa.Table:
            b, sides, nums = _block(table, alphabet)
            spans, _ = _replies(replies)
            out = {"num": [], "side": [], "letters": [], "covered": []}
            for s in (0, 1):
                got = covered(b, len(nums), spans[:, s][b.entry].astype(np.int64))
                of = np.flatnonzero(sides >> s & 1)
                for c, x in zip(out, (nums[of], np.full(len(of), s), b.size[of], got[of])):
                    out[c].append(x)
            return pa.table({c: np.concatenate(x) for c, x in out.items()})

        return self.texts.groupBy("block").cogroup(self.neighbours().groupBy("block")).applyInArrow(cover, "num long, side long, letters long, covered long")

    def candidates(self) -> DataFrame:
        """Pairs (``a`` of side 0, ``b`` of side 1) of texts that may be alike.

        A text of n shingles that is alike with one of the other side has four fifths of them there: others go at once. An alike pair
        shares one of the ``n - ceil(4n/5) + 1`` rarest shingles of both, by the exact numbers of texts that the suffix array gives.
        The suffixes that begin with these make a smaller array; texts of both sides in one run of neighbours with five letters in
        common are candidates, if sizes and ranks leave room for the overlap needed.
        """
        alphabet, cell = self.alphabet, self.cell

        def emit(table: pa.Table, replies: pa.Table) -> pa.Table:
            b, sides, nums = _block(table, alphabet)
            _, held = _replies(replies)
            code = b.codes(alphabet)
            row, shingle = b.pairs()
            n, start = sizes_of(row, len(nums))
            f = held[shingle].astype(np.int64)
            enough = np.zeros(len(nums), bool)
            for s in (0, 1):
                there = np.bincount(row[f[:, 1 - s] > 0], minlength=len(nums))
                enough |= (sides >> s & 1 == 1) & (5 * there >= 4 * n)
            order = np.lexsort((code[shingle], f.sum(1), row))
            row, shingle, f = row[order], shingle[order], f[order]
            rank = np.arange(len(row)) - start[row]
            keep = enough[row] & (rank < (n - (4 * n + 4) // 5 + 1)[row])
            own = sides[row]
            keep &= ((own & 1 == 1) & (f[:, 1] > 0)) | ((own & 2 == 2) & (f[:, 0] > 0))
            row, shingle, f, rank = row[keep], shingle[keep], f[keep], rank[keep]
            pieces = f // CHUNK + 1
            code, num, size = code[shingle], nums[row], n[row]
            place = code >> np.uint64(alphabet.bits * (K - cell)) if alphabet.per_word >= K else code >> np.uint64(50)
            out = []  # (cell, index, side)
            for s in (0, 1):
                i = np.flatnonzero((sides[row] >> s & 1 == 1) & (f[:, 1 - s] > 0))
                again = np.repeat(i, pieces[i, 1 - s])
                other = np.arange(len(again)) - np.repeat(np.cumsum(pieces[i, 1 - s]) - pieces[i, 1 - s], pieces[i, 1 - s])
                mine = (mix(num[again].view(np.uint64)) % pieces[again, s].astype(np.uint64)).astype(np.int64)
                pair = (np.where(s == 0, mine, other) << 20 | np.where(s == 0, other, mine)).astype(np.uint64)
                hot = pieces[again].max(1, initial=1) > 1
                to = np.where(hot, (mix(code[again] ^ mix(pair)) | np.uint64(1 << 63)).view(np.int64), place[again].astype(np.int64))
                out.append(np.c_[to, again, np.full(len(again), s)])
            to, i, s = np.concatenate(out).T
            order = np.lexsort((code[i], to))
            to, i, s = to[order], i[order], s[order]
            edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
            rows = []
            for lo, hi in zip(edge, np.r_[edge[1:], len(to)]):
                at = i[lo:hi]
                rows.append(pack_keys(code[at][:, None], num[at], size[at].astype(np.uint32), (rank[at] << 1 | s[lo:hi]).astype(np.uint32)))
            return pa.table({"cell": pa.array(to[edge]), "data": pa.array(rows, pa.binary())})

        def meet(table: pa.Table) -> pa.Table:
            got = [unpack_keys(x, 1, np.int64, np.uint32, np.uint32) for x in table.column("data").to_pylist()]
            k = np.concatenate([k[:, 0] for k, _ in got])
            num, n, place = (np.concatenate([m[j] for _, m in got]) for j in range(3))
            side = place & np.uint32(1)
            order = np.lexsort((side, k))
            k, num, n, rank, side = k[order], num[order], n[order].astype(np.int64), (place[order] >> np.uint32(1)).astype(np.int64), side[order].astype(np.int64)
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            end = np.r_[edge[1:], len(k)]
            ones = np.r_[0, np.cumsum(side)]
            mid = end - (ones[end] - ones[edge])
            some = (mid > edge) & (end > mid)
            a0, a1, b0, b1 = edge[some], mid[some], mid[some], end[some]
            work, out = np.cumsum((a1 - a0) * (b1 - b0)) // 2_000_000, [np.zeros((0, 2), np.int64)]
            for w in np.unique(work):
                m = work == w
                i, j = product(a0[m], a1[m], b0[m], b1[m])
                ok = alike_sizes(n[i], n[j]) & positions_allow(n[i], rank[i], n[j], rank[j]) & (num[i] != num[j])
                out.append(np.unique(np.c_[num[i[ok]], num[j[ok]]], axis=0))
            pairs = np.unique(np.concatenate(out), axis=0)
            return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

        keyed = self.texts.groupBy("block").cogroup(self.neighbours().groupBy("block")).applyInArrow(emit, "cell long, data binary")
        return keyed.groupBy("cell").applyInArrow(meet, "a long, b long").distinct()


def _block(table: pa.Table, alphabet: Alphabet) -> tuple[Block, np.ndarray, np.ndarray]:
    """The suffixes of a block in one order, whatever the order of its rows; its texts' sides and numbers."""
    table = table.sort_by("num")
    return Block(table.column("text").to_pylist(), alphabet), table.column("sides").to_numpy(), table.column("num").to_numpy()


def _of_entries(b: Block, sides: np.ndarray) -> np.ndarray:
    out = np.zeros(len(b.keys), np.uint8)
    for s in (0, 1):
        out[b.entry[sides[b.row[b.pos]] >> s & 1 == 1]] |= np.uint8(1 << s)
    return out


def _replies(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """What the cells answered, in the order of the block's entries and shingles."""
    got = [unpack(x, np.uint8, np.uint32, np.uint32) for x in replies.sort_by("cell").column("reply").to_pylist()]
    if not got:
        return np.zeros((0, 2), np.uint8), np.zeros((0, 2), np.uint32)
    spans, first, second = (np.concatenate([g[j] for g in got]) for j in range(3))
    return np.stack([spans & np.uint8(15), spans >> np.uint8(4)], 1), np.stack([first, second], 1)


def close_pairs(pairs: DataFrame, texts: DataFrame, stage: Stage) -> DataFrame:
    """Of the candidates those alike exactly: ``a``, ``b``, ``common``, ``total``, ``cover_a``, ``cover_b``.

    Parity bits (32 bytes a text) are joined first, and texts only for pairs within the
    Hamming budget of their sizes.
    """

    def bits(batches):
        for texts, ids, _ in parts(batches):
            row, h = distinct_shingles(texts)
            n, _ = sizes_of(row, len(texts))
            p = parity(row, h, len(texts))
            yield pa.record_batch([ids, n, *(p[:, j].copy().view(np.int64) for j in range(4))], ["id", "n", "s0", "s1", "s2", "s3"])

    fields = ["n", "s0", "s1", "s2", "s3"]
    need = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = stage.save(texts.select(F.col("num").alias("id"), "text").join(need, "id", "left_semi"))
    sketch = stage.save(rows.mapInArrow(bits, "id long, n long, s0 long, s1 long, s2 long, s3 long"))
    left, right = (sketch.select(F.col("id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in fields]) for x in "ab")
    far = sum((F.bit_count(F.col(f"a_s{j}").bitwiseXOR(F.col(f"b_s{j}"))) for j in range(4)), F.lit(0))
    near = stage.save(pairs.join(left, "a").join(right, "b").where(far * 9 <= F.col("a_n") + F.col("b_n")).select("a", "b"))
    need = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = rows.join(need, "id", "left_semi")

    def test(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
                common, total = similarity(x, y)
                if total and 5 * common >= 4 * total:
                    out.append((a, b, common, total, coverage(x, y), coverage(y, x)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, o)) for o in out], schema=schema)

    names = ["a", "b", "common", "total", "cover_a", "cover_b"]
    schema = pa.schema([(c, pa.int64()) for c in names])
    both = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(test, ", ".join(f"{c} long" for c in names))


def two_sides(docs: DataFrame, stage: Stage, lines: str, split: str, train: str, held: tuple[str, ...], least: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``num``, ``side``, ``size`` of the documents that count, and ``num``, ``text``, ``sides`` of their distinct texts, both written.

    The last delivery of a document counts (ties: greatest text hash, then split).
    """
    cols = [F.col("doc_id"), F.col(lines).alias("lines"), read_split(split).alias("split"), *(["loaded_at"] if "loaded_at" in docs.columns else [])]
    side = F.when(F.col("split") == train, 0).when(F.col("split").isin(*held), 1)
    rows = text_rows(docs.select(*cols), 0).withColumn("side", side)
    last = stage.save(latest(rows.withColumn("size", F.length("text")), "id", "side", "size").where((F.col("size") >= least) & F.col("side").isNotNull()).select("doc_id", "id", "side", "size"))
    stands = last.groupBy("id").agg(F.bit_or(F.col("side") + 1).cast("long").alias("sides"))
    texts = stage.save(rows.where(F.length("text") >= least).select("id", "text").join(stands, "id").dropDuplicates(["id"]).withColumn("num", F.monotonically_increasing_id()))
    return stage.save(last.join(texts.select("id", "num"), "id").select("doc_id", "num", "side", "size")), texts.select("num", "text", "sides")


def cross_split_overlaps(docs: DataFrame, lines: str = "lines", split: str = "split", train: str = "train", held: tuple[str, ...] = ("val", "test"), least: int = 20) -> DataFrame:
    """Alike documents in the training and a held-out split.

    ``train_id``, ``held_id``, ``similarity`` (Jaccard of 5-letter shingles, 0.8 or more),
    ``train_cover`` and ``held_cover`` (share of the letters in spans that the other text holds).
    Split names are read without outer blanks and tabs and letter case; documents of no or
    another split don't count. Equal texts are one text in the suffix array; their documents are paired in the
    result. The last delivery of a document counts (ties: greatest text hash, then split).
    Null or empty lines, short texts and null ids give no rows; so does an empty table.
    """
    stage = Stage(docs.sparkSession, "overlap")
    member, texts = two_sides(docs, stage, lines, split, train, held, least)
    links = close_pairs(stage.save(Sides(texts).candidates()), texts, stage)
    own = member.where("side = 0").select(F.col("doc_id").alias("train_id"), F.col("num").alias("a"), F.col("size").alias("na"))
    other = member.where("side = 1").select(F.col("doc_id").alias("held_id"), F.col("num").alias("b"), F.col("size").alias("nb"))
    same = own.join(other, F.col("a") == F.col("b")).select("train_id", "held_id", F.lit(1.0).alias("similarity"), F.lit(1.0).alias("train_cover"), F.lit(1.0).alias("held_cover"))
    close = links.join(own, "a").join(other, "b").select("train_id", "held_id", (F.col("common") / F.col("total")).alias("similarity"), (F.col("cover_a") / F.col("na")).alias("train_cover"), (F.col("cover_b") / F.col("nb")).alias("held_cover"))
    return same.union(close)


def split_coverage(docs: DataFrame, lines: str = "lines", split: str = "split", train: str = "train", held: tuple[str, ...] = ("val", "test"), least: int = 20) -> DataFrame:
    """How much of each record stands on the other side: ``doc_id``, ``split_side`` (0 train, 1 held out), ``letters``, ``covered``.

    ``covered`` letters lie in spans of five or more letters that some text of the other side holds: the spans of
    neighbours in the joint suffix array, merged. Records and texts are read as in :func:`cross_split_overlaps`.
    """
    stage = Stage(docs.sparkSession, "cover")
    member, texts = two_sides(docs, stage, lines, split, train, held, least)
    return member.select("doc_id", "num", F.col("side").cast("long").alias("side")).join(Sides(texts).coverage(), ["num", "side"]).select("doc_id", F.col("side").cast("int").alias("split_side"), "letters", "covered")


def overlap_report(docs: DataFrame, overlaps: DataFrame, split: str = "split", source: str = "source") -> DataFrame:
    """Per held-out split and source: overlapping ``pairs``, held-out ``documents`` in them, their mean ``cover``."""
    about = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("held_id")).agg(F.max(read_split(split)).alias("split"), F.max(source).alias("source"))
    per = overlaps.groupBy("held_id").agg(F.count("*").alias("pairs"), F.max("held_cover").alias("cover"))
    return per.join(about, "held_id").groupBy("split", "source").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("documents"), F.round(F.avg("cover"), 6).alias("cover"))
