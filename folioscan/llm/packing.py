"""Filling containers of fixed capacity with items of varying size (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut

#: Windows that are open at once while a bucket is packed.
OPEN_WINDOWS = 256
#: Size that a bucket of the first round is to hold, in units of capacity.
BUCKET_CONTAINERS = 4_000
#: Rows of a bucket, at most on average.
BUCKET_ROWS = 2_000_000
#: Buckets whose leftovers are merged into one bucket of the next round.
FAN_IN = 16


class Windows:
    """A bounded number of open windows; best fit; the fullest is emitted when none fits."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r is set if a window with room r is open
        self.members: dict[int, list[tuple]] = {}
        self.next = 0

    def _open(self, window: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(window)
        self.rooms |= 1 << room

    def _take(self, room: int) -> int:
        held = self.by_room[room]
        window = held.pop()
        if not held:
            del self.by_room[room]
            self.rooms &= ~(1 << room)
        return window

    def put(self, item: tuple, size: int) -> list[tuple[int, list[tuple]]]:
        """Place an item; the windows that were closed by this."""
        closed = []
        fitting = self.rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            window = self._take(room)
            self.members[window].append(item)
        else:
            if len(self.members) >= self.most:
                least = (self.rooms & -self.rooms).bit_length() - 1
                full = self._take(least)
                closed.append((full, self.members.pop(full)))
            window, room = self.next, self.capacity
            self.next += 1
            self.members[window] = [item]
        if room == size and size:
            closed.append((window, self.members.pop(window)))
        else:
            self._open(window, room - size)
        return closed


def _round(items: DataFrame, key: str, capacity: int, number: int, most: int) -> DataFrame:
    """Pack every bucket of ``items``; rows with ``open`` are of windows that were left over."""
    names = [f.name for f in items.schema if f.name not in ("bucket", "rank")]
    schema = T.StructType([*[items.schema[n] for n in names], T.StructField("container_id", T.LongType()), T.StructField("open", T.BooleanType())])
    size_at = names.index("n_tokens")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, windows, out = None, None, []

        def emit(closed, is_open):
            for w, members in closed:
                cid = (number << 56) | (now << 24) | w
                out.extend((*m, cid, is_open) for m in members)

        def frame():
            df = pd.DataFrame(out, columns=schema.names)
            out.clear()
            return df

        for pdf in parts:
            for bucket, *item in zip(pdf["bucket"], *(pdf[n] for n in names)):
                if bucket != now:
                    if windows:
                        emit(sorted(windows.members.items()), True)
                    now, windows = bucket, Windows(capacity, most)
                emit(windows.put(tuple(item), item[size_at]), False)
                if len(out) > 50_000:
                    yield frame()
        if windows:
            emit(sorted(windows.members.items()), True)
        yield frame()

    return items.sortWithinPartitions("bucket", "rank", key, "piece").drop("rank").mapInPandas(run, schema)


def pack(sizes: DataFrame, capacity: int = 2048, id_col: str = "doc_id", size_col: str = "n_tokens", open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: (``id_col``, ``piece``, ``token_start``, ``n_tokens``, ``container_id``, ``container_tokens``).

    Method: bounded-space online packing.  Items come in hashed order to buckets that
    are packed on their own with a fixed number of open windows: an item goes where it
    leaves the least room, the fullest window is emitted when it fits nowhere.  The
    windows left open at the end of the buckets are taken apart, and their items
    merged in rounds of FAN_IN buckets each, largest first, until one bucket is left.

    An item is split only if it alone exceeds the capacity: into full pieces and a rest.

    Defined results: size null, 0 or below counts as 0 and takes no room, but the row
    has a container; repeated rows are items of their own; a null id is an item like
    another.  An empty table gives an empty table.  The result doesn't depend on
    how Spark splits its input.
    """
    items = sizes.select(F.col(id_col), F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    pieces = items.select(id_col, "size", F.posexplode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)))).alias("piece", "_at"))
    pieces = cut(
        pieces.select(
            id_col, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).cast("long").alias("token_start"),
            F.least(F.col("size") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n_tokens"),
        ), "pieces")
    total, rows = pieces.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    # rows without tokens take no room, but a task
    buckets = max(1, round(total / capacity / BUCKET_CONTAINERS), -(-rows // BUCKET_ROWS))
    spread = F.when(F.col(id_col).isNull(), F.xxhash64("n_tokens", "piece")).otherwise(F.xxhash64(F.col(id_col), F.col("piece")))
    now = pieces.withColumns({"bucket": F.pmod(spread, F.lit(buckets)), "rank": spread})
    done: list[DataFrame] = []
    number = 0
    while True:
        packed = cut(_round(now.repartition(buckets, "bucket"), id_col, capacity, number, open_windows), "packed")
        if number and buckets == 1:
            done.append(packed.drop("open"))
            break
        done.append(packed.filter(~F.col("open")).drop("open"))
        source = F.shiftright("container_id", 24).bitwiseAND(F.lit((1 << 32) - 1))
        buckets = -(-buckets // FAN_IN)
        number += 1
        now = packed.filter("open").select(*pieces.columns, F.pmod(source, F.lit(buckets)).alias("bucket"), (-F.col("n_tokens")).alias("rank"))
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    fill = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("container_tokens"))
    return placed.join(fill, "container_id").select(id_col, "piece", "token_start", "n_tokens", "container_id", "container_tokens")
