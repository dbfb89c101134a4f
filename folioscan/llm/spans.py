"""Long exact spans shared between records (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..lineage import cut

#: Code points that are worked on at once; bounds a worker's memory, not a text's length.
BATCH_POINTS = 1_000_000
_POSITION_BITS = 24
#: Different contexts of a leader that are judged within one task; leaders with more are spread over all.
GROUP_CONTEXTS = 5_000
#: Base of the rolling hash: odd, and 3 modulo 8, so that differences of its powers keep most bits.
_BASE = np.uint64(0x9E3779B97F4A7C13)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < n."""

    def powers(base: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done, step = 1, base
        while done < n:
            k = min(done, n - done)
            out[done : done + k] = out[:k] * np.uint64(step)
            done, step = done + k, step * step % 2**64
        return out

    base = int(_BASE)
    return powers(base), powers(pow(base, -1, 2**64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Points:
    """Code points of several (parts of) texts on end, with hashes of any stretch."""

    def __init__(self, pieces: list[tuple[int, int, str]]):
        self.row = np.array([r for r, _, _ in pieces], np.int64)
        self.offset = np.array([o for _, o, _ in pieces], np.int64)
        size = np.array([len(t) for _, _, t in pieces], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        points = np.frombuffer("".join(t for _, _, t in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(points)
        self.up, self.down = (p[: self.n + 1] for p in _powers(1 << (max(self.n, BATCH_POINTS) + 1).bit_length()))
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_mix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * self.up[: self.n], out=self.sums[1:])
        self.piece = np.repeat(np.arange(len(pieces)), size)

    def grams(self, length: int) -> np.ndarray:
        """Hash of the ``length`` code points from each place on."""
        if self.n < length:
            return np.empty(0, np.uint64)
        return _mix((self.sums[length:] - self.sums[:-length]) * self.down[: self.n - length + 1])

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64))

    def whole(self, length: int) -> np.ndarray:
        """Whether the ``length`` code points from a place on lie within one piece."""
        return np.arange(self.n) + length <= self.end[self.piece]

    def leaders(self, grams: np.ndarray, count: int) -> np.ndarray:
        """For each place the place of the least of the ``count`` grams from it on (leftmost of equals).

        What leads a window depends on the window's own characters only, so equal
        windows of different texts have equal leaders.
        """
        mask = np.uint64((1 << _POSITION_BITS) - 1)
        low = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= count:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < count:
            low = np.minimum(low[: len(low) - (count - width)], low[count - width :])
        return (low & mask).astype(np.int64)


def _pieces(texts: list[str | None], least: int) -> Iterator[Points]:
    """Texts in batches; a text beyond a batch in parts that overlap by all but one place of a window."""
    held, total = [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < least:
            continue
        for at in range(0, len(text) - least + 1, BATCH_POINTS):
            part = text[at : at + BATCH_POINTS + least - 1] if len(text) > BATCH_POINTS else text
            held.append((row, at, part))
            total += len(part)
            if total >= BATCH_POINTS:
                yield Points(held)
                held, total = [], 0
            if part is text:
                break
    if held:
        yield Points(held)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _leaders(p: Points, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places where windows begin, the hashes of stretches of half the length, each window's leader."""
    grams = p.grams(least // 2)
    leader = p.leaders(grams, least - least // 2 + 1)
    begins = np.flatnonzero(p.whole(least)[: len(leader)])
    return begins, grams, leader[begins]


def _first_level(least: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column(0)
            for p in _pieces(part.column(1).to_pylist(), least):
                _, grams, leader = _leaders(p, least)
                leader = leader[np.flatnonzero(np.diff(leader, prepend=-1))]
                row, gram = p.row[p.piece[leader]], grams[leader]
                by = np.lexsort((gram, row))
                row, gram = row[by], gram[by]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                yield pa.RecordBatch.from_arrays([_signed(gram[new]), ids.take(pa.array(row[new]))], names=["gram", "doc"])

    return run


def _second_level(least: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, known, texts = part.column(0), part.column(2), part.column(1).to_pylist()
            sets = [np.asarray(known[i].values.to_numpy(zero_copy_only=False), np.int64) for i in range(len(known))]
            for p in _pieces(texts, least):
                begins, grams, leader = _leaders(p, least)
                runs = np.flatnonzero(np.diff(leader, prepend=-1))
                heads = leader[runs]
                row, gram = p.row[p.piece[heads]], grams[heads].view(np.int64)
                good = np.zeros(len(heads), bool)
                edges = np.flatnonzero(np.diff(row, prepend=-1, append=-1)) if len(row) else row
                for a, b in zip(edges[:-1], edges[1:]):
                    good[a:b] = np.isin(gram[a:b], sets[row[a]])
                if not good.any():
                    continue
                first, last = begins[runs], begins[np.append(runs[1:], len(begins)) - 1]
                first, last, head = first[good], last[good], heads[good]
                context = p.stretch(first, last + least)
                context = _mix(context + (head - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                piece = p.piece[first]
                at = first - p.start[piece] + p.offset[piece]
                n = (last - first + 1).astype(np.int32)
                text = [texts[r][i : i + m + least - 1] for r, i, m in zip(p.row[piece].tolist(), at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(p.row[piece])), _signed(grams[head]), _signed(context), pa.array(at), pa.array(n), pa.array(text, pa.string())],
                    names=["doc", "gram", "context", "start", "n", "words"],
                )

    return run


def _unfold(words: list[str], n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset, hash) of every window of the contexts, context after context."""
    p = Points([(i, 0, t) for i, t in enumerate(words)])
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(p.start, n) + off
    return off, p.stretch(begin, begin + least)


def _in_groups(least: int):
    """Contexts in the order of their leaders: which of their windows occur under another id."""

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(np.int64)
        _, codes = np.unique(pd.concat([pdf["a"], pdf["b"]]).to_numpy(), return_inverse=True)
        a, b = codes[: len(pdf)], codes[len(pdf) :]
        off, h = _unfold(pdf["words"].tolist(), n, least)
        row = np.repeat(np.arange(len(pdf)), n)
        h = h + np.repeat(_mix(pdf["gram"].to_numpy(np.int64).view(np.uint64)), n)
        by = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.diff(h[by], prepend=h[by][:1] + np.uint64(1)))
        shared = np.minimum.reduceat(a[row[by]], begin) < np.maximum.reduceat(b[row[by]], begin)
        hit = np.zeros(len(h), bool)
        hit[by] = np.repeat(shared, np.diff(np.append(begin, len(h))))
        hit &= (a == b)[row]
        edge = np.diff(np.where(hit, row, -1), prepend=-1, append=-1)
        starts = np.flatnonzero(hit & (edge[:-1] != 0))
        ends = np.flatnonzero(hit & (edge[1:] != 0)) + 1
        return pd.DataFrame({"gram": pdf["gram"].to_numpy()[row[starts]], "context": pdf["context"].to_numpy()[row[starts]], "from": off[starts].astype(np.int32), "to": (off[ends - 1] + 1).astype(np.int32)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            last = part["gram"].iloc[-1]
            if part["gram"].iloc[0] == last and held:
                held.append(part)
                continue
            done = part[part["gram"] != last]
            if held or len(done):
                whole = pd.concat([*held, done], ignore_index=True)
                rest = whole[whole["gram"] == last]
                whole = whole[whole["gram"] != last]
                held = [rest] if len(rest) else []
                if len(whole):
                    yield judge(whole)
            held.append(part[part["gram"] == last])
        if held:
            yield judge(pd.concat(held, ignore_index=True))

    return run


def _apart(least: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4000):
                some = part.slice(at, 4000)
                n = some.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                off, h = _unfold(some.column(3).to_pylist(), n, least)
                take = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(take), some.column(1).take(take), pa.array(off.astype(np.int32)), _signed(h), some.column(4).take(take), some.column(5).take(take)],
                    names=["gram", "context", "off", "window", "a", "b"],
                )

    return run


def _islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Merge overlapping or touching [start, end) of the same keys."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before >= F.col(start), 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200) -> DataFrame:
    """(``id_col``, ``span_start``, ``span_chars``): each maximal run of characters that lie in a
    stretch of ``least`` or more characters which appears verbatim under another id.

    Method: level-wise doubling.  Every window of ``least`` characters is led by one of
    its stretches of half that length (the one with the least hash).  Leaders that
    occur under one id alone are out, and their windows with them; only windows with a
    repeated leader are extended to the full length.  There they are compared by whole
    contexts (all neighbouring windows under one leader) first, and window by window
    where one leader has several contexts.

    Groups are reduced to their least and greatest id before the shuffle and after, so
    text held by a third of all rows costs no more than other text, and no pairs are
    formed.  Leaders with more than GROUP_CONTEXTS different contexts are judged window by
    window across all tasks, the others within a task; both ways are exact.

    Stretches are compared by 64-bit hashes.

    Defined results: null, empty and short texts share nothing; rows with null id are
    left out; rows of the same id are one document and don't share with each other;
    a document without shared characters has no row.  Texts are taken whole.
    """
    if least % 2 or least < 4:
        raise ValueError("least must be even, at least 4")
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).filter(F.col("doc").isNotNull() & (F.length("text") >= least))

    def schema(**fields: T.DataType) -> T.StructType:
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])

    long, integer = T.LongType(), T.IntegerType()
    # half the length
    grams = texts.mapInArrow(_first_level(least), schema(gram=long, doc=kind))
    repeated = cut(grams.groupBy("gram").agg(F.min("doc").alias("_a"), F.max("doc").alias("_b")).filter("_a < _b").select("gram"), "leaders")
    known = grams.join(repeated, "gram").groupBy("doc").agg(F.collect_list("gram").alias("grams"))
    led = texts.join(known, "doc").mapInArrow(_second_level(least), schema(doc=kind, gram=long, context=long, start=long, n=integer, words=T.StringType()))
    led = cut(led, "led")
    # the whole length: contexts as such
    contexts = led.groupBy("gram", "context").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.any_value("n").alias("n"))
    leaders = contexts.groupBy("gram").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    whole = contexts.filter("a < b").select("gram", "context")
    # and window by window, where a leader has several
    open_ = cut(
        led.groupBy("gram", "context").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.any_value("n").alias("n"), F.any_value("words").alias("words")).join(leaders, "gram")
        .select("gram", "context", "n", "words", "a", "b", "contexts"), "contexts")
    parts = (
        open_.filter(F.col("contexts") <= GROUP_CONTEXTS).drop("contexts").repartition("gram").sortWithinPartitions("gram")
        .mapInPandas(_in_groups(least), T.StructType([T.StructField("gram", long), T.StructField("context", long), T.StructField("from", integer), T.StructField("to", integer)]))
    )
    windows = open_.filter(F.col("contexts") > GROUP_CONTEXTS).drop("contexts").mapInArrow(_apart(least), schema(gram=long, context=long, off=integer, window=long, a=kind, b=kind))
    again = windows.groupBy("gram", "window").agg(F.min("a").alias("_a"), F.max("b").alias("_b")).filter("_a < _b").select("gram", "window")
    hits = windows.filter("a = b").join(again, ["gram", "window"]).select("gram", "context", F.col("off").alias("from"), (F.col("off") + 1).alias("to"))
    parts = parts.unionByName(_islands(hits, ["gram", "context"], "from", "to"))
    spans = (
        led.join(whole, ["gram", "context"], "left_semi").select("doc", F.col("start"), (F.col("start") + F.col("n") - 1 + least).alias("end"))
        .unionByName(led.join(parts, ["gram", "context"]).select("doc", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to") - 1 + least).alias("end")))
    )
    return _islands(spans, ["doc"], "start", "end").select(F.col("doc").alias(id_col), F.col("start").alias("span_start"), (F.col("end") - F.col("start")).alias("span_chars"))


def shared_shares(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``shared_chars``, ``share``) of every document; 0 where nothing is shared or the text is null or empty."""
    shared = spans.groupBy(id_col).agg(F.sum("span_chars").alias("shared_chars"))
    size = F.length(text_col)
    return docs.select(id_col, size.alias("_n")).join(shared, id_col, "left").select(
        id_col, F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
        F.when(F.col("_n") > 0, F.coalesce("shared_chars", F.lit(0)) / F.col("_n")).otherwise(0.0).alias("share"))
