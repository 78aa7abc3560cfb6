"""Filling containers of fixed capacity with items, by hierarchical multi-length packing.

The plan is made on the histogram of lengths, which has at most as many rows as the capacity however many items there
are. Every tier has a context size; lengths are routed to the smallest context that holds them. From the longest tier down, the windows of the longer
contexts are first filled up from the tier (best fit, longest items first); what is left of the tier is packed into windows of its own context. So every window
belongs to one context, and long windows have their gaps filled from shorter tiers. At the end the windows of all contexts are put together to containers of
the one capacity, again by best fit; as each context divides the next, full windows do so without loss. Windows filled alike form one group of the
plan. An item finds its container from its length and its rank among the items of that length, which is
counted in two steps so that no length is gathered in one task. Containers are dealt to step groups so that these hold equally many tokens.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from strandline.session import materialize

CAPACITY = 2048
TIERS = (256, 512, 1024, 2048)
#: Containers per step, and buckets that the items of one length are ranked in.
STEP, BUCKETS = 8, 256


@dataclass
class Group:
    """``count`` containers (or windows) with the same content: (context of its window, length, how many) in order."""

    count: int
    free: int
    content: list[tuple[int, int, int]] = field(default_factory=list)


class _Open:
    """Groups by the space that is free in them."""

    def __init__(self):
        self.by_free: dict[int, list[Group]] = {}
        self.frees: list[int] = []
        self.full: list[Group] = []

    def put(self, g: Group) -> None:
        if not g.count:
            return
        if not g.free:
            self.full.append(g)
            return
        if g.free not in self.by_free:
            self.by_free[g.free] = []
            insort(self.frees, g.free)
        self.by_free[g.free].append(g)

    def fill(self, size: int, count: int, content: list[tuple[int, int, int]] | None, length: int = 0) -> int:
        """Put up to ``count`` pieces of ``size`` where they fit best; gives how many found no space.

        A piece is an item of ``length`` (it takes the context of the window it comes into) or a window with its ``content``."""
        while count:
            at = bisect_left(self.frees, size)
            if at == len(self.frees):
                break
            space = self.frees[at]
            groups = self.by_free[space]
            g = groups.pop()
            if not groups:
                del self.by_free[space]
                self.frees.pop(at)
            fit = min(space // size, max(1, count // g.count))  # as many as each of them can take
            take = min(g.count, count // fit)
            more = content * fit if content is not None else [(g.content[-1][0], length, fit)]
            self.put(Group(g.count - take, g.free, g.content))
            self.put(Group(take, g.free - fit * size, [*g.content, *more]))
            count -= take * fit
        return count

    def all(self) -> list[Group]:
        return self.full + [g for f in self.frees for g in self.by_free[f]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, tiers: Sequence[int] = TIERS) -> list[Group]:
    """Groups of containers that hold every item of the histogram (length -> number, lengths 1..capacity)."""
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError("lengths must be within 1..capacity")
    contexts = sorted({*(t for t in tiers if 0 < t < capacity), capacity})
    windows = _Open()
    lower = dict(zip(contexts, [0, *contexts]))
    for context in reversed(contexts):
        left = {n: windows.fill(n, histogram[n], None, n) for n in sorted(histogram, reverse=True) if lower[context] < n <= context}
        own = _Open()
        for n, count in left.items():
            rest = own.fill(n, count, None, n)
            each = context // n
            own.put(Group(rest // each, context - each * n, [(context, n, each)]))
            if rest % each:
                own.put(Group(1, context - rest % each * n, [(context, n, rest % each)]))
        for g in own.all():
            windows.put(g)
    # windows of all contexts together to containers: the best filled first
    whole = _Open()
    for g in sorted(windows.all(), key=lambda g: (-_used(g), g.content)):
        used = _used(g)
        rest = whole.fill(used, g.count, g.content)
        each = capacity // used
        whole.put(Group(rest // each, capacity - each * used, g.content * each))
        if rest % each:
            whole.put(Group(1, capacity - rest % each * used, g.content * (rest % each)))
    return sorted(whole.all(), key=lambda g: (g.free, g.content))


def _used(g: Group) -> int:
    return sum(length * k for _, length, k in g.content)


def lookup(groups: Sequence[Group]) -> dict[str, np.ndarray]:
    """Per (length, first rank): the first container, items per container, the offset of the first item there, and the context of its window."""
    rows, used, base = [], {}, 0
    for g in groups:
        offset = 0
        for context, length, k in g.content:
            start = used.get(length, 0)
            rows.append((length, start, base, k, offset, context))
            used[length] = start + g.count * k
            offset += length * k
        base += g.count
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 6).T
    return {"length": cols[0], "start": cols[1], "base": cols[2], "each": cols[3], "offset": cols[4], "context": cols[5], "containers": np.array([base])}


_RANK_BITS = 46


def _place(table: dict[str, np.ndarray], steps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table["length"] << _RANK_BITS) + table["start"]
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            i = np.searchsorted(keys, (size << _RANK_BITS) + rank, side="right") - 1
            nth = rank - table["start"][i]
            box = table["base"][i] + nth // table["each"][i]
            offset = table["offset"][i] + nth % table["each"][i] * size
            # round and back, since containers are numbered by their fill: each turn gives all groups about as much
            turn, place = box // steps, box % steps
            step = np.where(turn % 2 == 0, place, steps - 1 - place)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(4)), *map(pa.array, (box, offset, step, table["context"][i]))],
                names=["id", "piece_no", "start_token", "n_tokens", "container_id", "container_offset", "step_group", "context"],
            )

    return run


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, tiers: Sequence[int] = TIERS, step: int = STEP) -> DataFrame:
    """(``key``, ``piece_no``, ``start_token``, ``n_tokens``, ``container_id``, ``container_offset``, ``step_group``, ``context``).

    An item above the capacity is split into full pieces and a rest, no other is. Items of size 0 or null take no
    container: one row with ``n_tokens`` 0 and null container. Keys must be unique; null keys are left out. ``context`` is
    the context size of the window that the piece is in. Containers are dealt to step groups of about ``step`` containers in order of their
    fill, round and back, so that groups hold equally many tokens. Empty input gives no rows.
    """
    items = sizes.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    cap = F.lit(capacity)
    pieces = items.where("n > 0").select(
        "id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / cap))).alias("piece_no")
    ).select(
        "id", "piece_no", (F.col("piece_no") * capacity).alias("start_token"), F.least(cap, F.col("n") - F.col("piece_no") * capacity).cast("long").alias("n_tokens")
    )
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(BUCKETS)))
    counts = materialize(pieces.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("c")), "lengths")
    histogram = {r["n_tokens"]: r["c"] for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}  # at most ``capacity`` rows
    table = lookup(plan(histogram, capacity, tiers))
    steps = max(1, -(-int(table["containers"][0]) // step))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("c")).drop("c")
    own = Window.partitionBy("n_tokens", "bucket").orderBy("id", "piece_no")
    ranked = (
        pieces.withColumn("own", F.row_number().over(own) - 1)
        .join(before.hint("merge"), ["n_tokens", "bucket"])  # both sides are partitioned so already
        .select("id", "piece_no", "start_token", "n_tokens", (F.col("before") + F.col("own")).alias("rank"))
    )
    schema = "id long, piece_no long, start_token long, n_tokens long, container_id long, container_offset long, step_group long, context long"
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    empty = items.where("n = 0").select("id", zero.alias("piece_no"), zero.alias("start_token"), zero.alias("n_tokens"), none.alias("container_id"), none.alias("container_offset"), none.alias("step_group"), none.alias("context"))
    return ranked.mapInArrow(_place(table, steps), schema).unionByName(empty).withColumnRenamed("id", key)
