"""Long exact spans shared between records: count-min prefilter, exact grouping, extension."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import Stage
from .arrays import blocks, flat, mix, rolling
from .sketch import merged, saturating, sized

#: Characters of an anchor; most counters of a row of the sketch, and rows.
ANCHOR = 64
WIDEST, DEPTH = 1 << 25, 2
#: Contexts of one anchor above which it is resolved window by window.
HOT = 5_000


def anchors(texts: list[str], span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in the text and hash of the anchors.

    Of the ``span - k + 1`` windows of ``k`` characters inside each stretch of ``span`` characters the one
    with the smallest hash (all 64 bits; the leftmost of equals) is an anchor. Equal stretches hold equal
    anchors, in whatever text and block of texts they stand, and every stretch holds at least one.
    """
    points, row, ends = flat(texts)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(points) < span:
        return none
    h = rolling(points, k)
    w = span - k + 1
    at = np.arange(-(-len(h) // w) * w + w)
    pad = np.full(len(at), np.uint64(0xFFFFFFFFFFFFFFFF))
    pad[: len(h)] = h
    grid, place = pad.reshape(-1, w), at.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    falls = np.c_[np.ones(len(grid), bool), ahead[:, 1:] < ahead[:, :-1]]
    first = np.maximum.accumulate(np.where(falls, place, 0), axis=1).ravel()  # where the least so far stands, and where the least to come, leftmost
    next_ = np.minimum.accumulate(np.where(grid == behind, place, len(at))[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead, behind = ahead.ravel(), behind.ravel()
    m = len(points) - span + 1
    best = np.where(behind[:m] <= ahead[w - 1 : w - 1 + m], next_[:m], first[w - 1 : w - 1 + m])
    best = best[np.arange(m) + span <= ends[row[:m]]]
    if not len(best):
        return none
    at = np.unique(best)
    begins = ends - np.bincount(row, minlength=len(texts))
    return row[at], at - begins[row[at]], h[at]


def cells(h: np.ndarray, width: int) -> list[np.ndarray]:
    return [(mix(h ^ np.uint64(0x5BD1E995 * (d + 1))) % np.uint64(width)).astype(np.int64) + d * width for d in range(DEPTH)]


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
        for a, b in blocks(np.fromiter(map(len, texts), np.int64, len(texts))):
            yield ids[a:b], texts[a:b]


def count_min(rows: DataFrame, span: int, k: int) -> np.ndarray:
    """For each cell the number of documents with an anchor there, up to 255.

    A row has at least two cells for each anchor to be expected, up to ``WIDEST``: 64 MB at most that go to all tasks.
    It may overestimate; where it is full, all anchors go on to the exact grouping.
    """
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    width = sized(4 * chars // (span - k + 2), 1 << 16, WIDEST)

    def fill(batches):
        s = np.zeros(width * DEPTH, np.uint8)
        for _, texts in _parts(batches):
            row, _, h = anchors(texts, span, k)
            pairs = np.unique(np.stack([row.astype(np.uint64), h], 1), axis=0)[:, 1] if len(h) else h
            for c in cells(pairs, width):
                at, n = np.unique(c, return_counts=True)
                s[at] = np.minimum(s[at].astype(np.int64) + n, 255)
        return s

    return merged(rows, fill, width * DEPTH, np.uint8, saturating)


def fill_ratio(sketch: np.ndarray) -> float:
    """Share of the cells that are in use; near 1 the sketch rules nothing out."""
    return float(np.count_nonzero(sketch)) / len(sketch)


_CONTEXT = "key long, context string, id long, starts array<int>, met boolean"
_FOUND = "id long, span_start int, span_end int"


class _Collapse:
    """Contexts of one task, each kept once.

    Documents of the task with an equal context have it wholly shared, which is settled here;
    one of them goes on, so that other tasks learn of it. A context that a third of all rows
    have makes one row a task. Emptied when it holds ``most`` contexts.
    """

    def __init__(self, most: int = 50_000):
        self.at: dict[tuple[int, str], list] = {}
        self.done: list[tuple[int, int, int]] = []
        self.most = most

    def add(self, key: int, context: str, doc: int, starts: list[int]) -> None:
        x = self.at.get((key, context))
        if x is None:
            self.at[key, context] = [doc, list(starts), False]
        elif x[0] == doc and not x[2]:
            x[1].extend(starts)
        else:
            n = len(context)
            if not x[2] and x[0] != doc:
                self.done.extend((x[0], s, s + n) for s in x[1])
                x[1], x[2] = [], True
            self.done.extend((doc, s, s + n) for s in starts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = [(k, c, d, s, m) for (k, c), (d, s, m) in self.at.items()]
        none = len(self.done)
        yield pa.record_batch(
            [
                pa.array([r[0] for r in rows] + [None] * none, pa.int64()), pa.array([r[1] for r in rows] + [None] * none, pa.string()),
                pa.array([r[2] for r in rows] + [d[0] for d in self.done], pa.int64()),
                pa.array([r[3] for r in rows] + [[d[1], d[2]] for d in self.done], pa.list_(pa.int32())),
                pa.array([r[4] for r in rows] + [None] * none, pa.bool_()),
            ],
            ["key", "context", "id", "starts", "met"],
        )
        self.at.clear()
        self.done.clear()


#: Marks a window that two documents have; equal to no key.
SEVERAL = object()


def settle(rows: list[tuple[str, int, list[int], bool]], span: int) -> Iterator[tuple[int, int, int]]:
    """Shared stretches of the contexts of one anchor, each row a context, its document, its places and whether it is settled."""
    docs: dict[str, set] = {}
    for context, doc, _, met in rows:
        docs.setdefault(context, set()).add(doc)
        if met:
            docs[context].add(None)
    if len(docs) == 1:
        (context, who), = docs.items()
        if len(who) > 1:
            for _, doc, starts, _ in rows:
                for s in starts:
                    yield doc, s, s + len(context)
        return
    holder: dict[str, object] = {}  # of each window its document, or SEVERAL once there are two
    for context, who in docs.items():
        one = next(iter(who)) if len(who) == 1 else SEVERAL
        for o in range(len(context) - span + 1):
            w = context[o : o + span]
            if holder.setdefault(w, one) != one:
                holder[w] = SEVERAL
    for context, doc, starts, _ in rows:
        if not starts:
            continue
        first = None
        for o in range(len(context) - span + 2):
            shared = o <= len(context) - span and holder[context[o : o + span]] is SEVERAL
            if shared and first is None:
                first = o
            elif not shared and first is not None:
                for s in starts:
                    yield doc, s + first, s + o - 1 + span
                first = None


def _settled(contexts: DataFrame, span: int) -> DataFrame:
    def run(batches):
        key, group = None, []

        def out(found):
            return pa.record_batch([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["id", "span_start", "span_end"])

        for batch in batches:
            found: list = []
            for k, *r in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "id", "starts", "met"))):
                if k != key and group:
                    found.extend(settle(group, span))
                    group = []
                key = k
                group.append(tuple(r))
            yield out(found)
        if group:
            yield out(list(settle(group, span)))

    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(run, _FOUND)


def shared_spans(docs: DataFrame, span: int = 200, text: str = "text", key: str = "doc_id", anchor: int = ANCHOR) -> DataFrame:
    """Maximal runs of characters that lie in a stretch of ``span`` or more standing in another document.

    ``key``, ``span_start``, ``span_end`` (from 0, end exclusive, in code points).

    1. Every stretch of ``span`` characters holds an anchor that only its content decides. A count-min
       sketch, sized by the characters of all texts, takes the anchors of all documents.
    2. Anchors that the sketch estimates at two documents or more are grouped exactly, by hash
       alone (24 bytes each); those in two documents remain. However full the sketch is, this loses none.
    3. Of the remaining anchors the surrounding ``2 span - anchor`` characters are compared as text;
       every stretch of ``span`` around an anchor that two documents hold is shared. Equal surroundings are settled
       within a task, and an anchor with more than ``HOT`` different ones is resolved stretch by
       stretch under keys of their own, so that no group grows with the number of copies.

    Texts of the same key never count for each other (repeated rows change nothing). Null, empty and
    short texts and null keys give no row, an empty table none; further columns are ignored.
    """
    stage = Stage(docs.sparkSession, "spans")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where((F.length("text") >= span) & F.col("id").isNotNull())
    sketch = docs.sparkSession.sparkContext.broadcast(count_min(rows, span, anchor))

    def repeated(batches):
        s = sketch.value
        for ids, texts in _parts(batches):
            row, pos, h = anchors(texts, span, anchor)
            often = np.ones(len(h), bool)
            for c in cells(h, len(s) // DEPTH):
                often &= s[c] > 1
            yield pa.record_batch([h[often].view(np.int64), np.array(ids, np.int64)[row[often]], pos[often].astype(np.int32)], ["key", "id", "pos"])

    seen = stage.save(rows.mapInArrow(repeated, "key long, id long, pos int"))
    several = seen.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key")
    places = stage.save(seen.join(several, "key", "left_semi").groupBy("id").agg(F.collect_set(F.struct("key", "pos")).alias("places")))

    def surroundings(batches):
        kept = _Collapse()
        for batch in batches:
            for doc, t, places in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "places"))):
                for p in places:
                    a = max(0, p["pos"] - span + anchor)
                    context = t[a : p["pos"] + span]
                    if len(context) >= span:
                        kept.add(p["key"], context, doc, [a])
            if len(kept.at) > kept.most:
                yield from kept.flush()
        yield from kept.flush()

    def windows(batches):
        kept = _Collapse()
        for batch in batches:
            for h, context, doc, starts, met in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "id", "starts", "met"))):
                points = np.frombuffer(context.encode("utf-32-le", "surrogatepass"), np.uint32)
                for o, k in enumerate(rolling(points, span).view(np.int64).tolist()):
                    w = context[o : o + span]
                    kept.add(k, w, doc, [s + o for s in starts])
                    if met:
                        kept.add(k, w, -1 - doc, [])
            if len(kept.at) > kept.most:
                yield from kept.flush()
        yield from kept.flush()

    contexts = stage.save(rows.join(places, "id").select("id", "text", "places").mapInArrow(surroundings, _CONTEXT))
    hot = stage.save(contexts.where("key is not null").groupBy("key").count().where(F.col("count") > HOT).select("key"))
    open_ = contexts.where("key is not null")
    found = [contexts, _settled(open_.join(hot, "key", "left_anti"), span)]
    if hot.limit(1).count():
        singly = stage.save(open_.join(hot, "key", "left_semi").select("key", "context", "id", "starts", "met").mapInArrow(windows, _CONTEXT))
        found += [singly, _settled(singly.where("key is not null"), span)]
    at_once = [c.where("key is null").select("id", F.col("starts")[0].alias("span_start"), F.col("starts")[1].alias("span_end")) for c in found[::2]]
    runs = at_once[0]
    for more in [*at_once[1:], *found[1::2]]:
        runs = runs.union(more)
    order = W.partitionBy("id").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    part = runs.distinct().withColumn("new", F.coalesce(F.col("span_start") > reach, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    out = part.groupBy("id", "run").agg(F.min("span_start").cast("long").alias("span_start"), F.max("span_end").cast("long").alias("span_end"))
    return out.select(F.col("id").cast(docs.schema[key].dataType).alias(key), "span_start", "span_end")


def shared_share(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of each document with shared spans their number, total length, and share of the text."""
    per = spans.groupBy(key).agg(F.count("*").alias("spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared"))
    return per.join(docs.where(F.col(text).isNotNull()).groupBy(key).agg(F.max(F.length(text)).alias("length")), key).select(key, "spans", "shared", (F.col("shared") / F.col("length")).alias("share"))
