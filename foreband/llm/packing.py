"""Best-fit packing of token sequences by hierarchical residual packing (operator 5).

Documents are encoded and only those longer than a sequence are cut, so that every piece but the first is a whole sequence. Pieces shorter
than that are dealt into small groups; each group packs best-fit, longest first, and gives out its nearly full bins. The underfull
bins of several groups meet as items in the next round, and so on up the tree, with less and less room tolerated. A round that no longer lowers
the number of bins is the last. Groups are sized from counts and dealt by a row number, so none grows with the data or with equal rows.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.llm.common import cut, prepare
from foreband.llm.tokens import default_path, encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
GROUP, TOP_GROUP = 2_000, 20_000
# Free places a bin may have when it is given out, by round; later rounds keep the last.
ROOM = (0, 2, 8, 16)


def _pieces(path: str, end_id: int, room: int, keep_ids: bool):
    def run(batches):
        encode = encoder(path).encode
        for b in batches:
            out = []
            for doc, ids in zip(b.column("id").to_pylist(), encode([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]), strict=True):
                raw = np.append(ids, end_id).astype("<u4")
                cuts = [0, *range((len(raw) - 1) % room + 1, len(raw) + 1, room)]
                for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    part = raw[x:y]
                    out.append((doc, i, x, y - x, zlib.crc32(part.tobytes()), part.tolist() if keep_ids else None))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            n = 5 + keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:n], types, strict=False)], names[:n])

    return run


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Items of each bin; every item, longest first, goes where the least room is left that still holds it."""
    bins, free, by_room = [], [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(free, sizes[i])
        if at == len(free):
            where, left = len(bins), room
            bins.append([])
        else:
            left = free[at]
            where = by_room[left].pop()
            if not by_room[left]:
                free.pop(at)
                del by_room[left]
        bins[where].append(i)
        left -= sizes[i]
        if left:
            if left not in by_room:
                insort(free, left)
                by_room[left] = []
            by_room[left].append(where)
    return bins


def _merged(members: pa.ListArray, bins: list[list[int]]) -> pa.ListArray:
    """The members of each bin's items, one item after the other, with their offsets in the bin."""
    taken = members.take(pa.array(chain.from_iterable(bins), pa.int64()))
    item_ends = np.cumsum(pc.list_value_length(taken).to_numpy())
    cuts = np.append(0, item_ends[np.cumsum([len(b) for b in bins]) - 1])
    flat = taken.flatten()
    fields, columns = list(flat.type), flat.flatten()
    length = columns[flat.type.get_field_index("length")].to_numpy()
    before = np.cumsum(length) - length
    columns[flat.type.get_field_index("offset")] = pa.array(before - np.repeat(before[cuts[:-1]], np.diff(cuts)))
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(columns, fields=fields), type=members.type)


def _packed(room: int, tolerated: int):
    """Bins of one group, numbered in it: done or to be packed on; members in place order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("tie", "ascending")]).combine_chunks()
        sizes, group = table.column("size").to_pylist(), table.column("g")[0].as_py()
        bins = best_fit(sizes, room)
        total = [sum(sizes[i] for i in b) for b in bins]
        return pa.table(
            {
                "g": pa.array([group] * len(bins), pa.int64()),
                "number": pa.array(range(len(bins)), pa.int64()),
                "size": pa.array(total, pa.int64()),
                "members": _merged(table.column("members").chunk(0), bins),
                "done": pa.array([room - t <= tolerated for t in total], pa.bool_()),
            }
        )

    return run


def pack(docs: DataFrame, path: str | None = None, room: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with end_id. A null or empty text is that one id. Pieces of documents with more than `room` ids fill
    sequences of their own, but for the first. Repeated rows are packed each; null ids stay.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(rows.mapInArrow(_pieces(path or default_path(), end_id, room, False), PIECE))
    full = pieces.where(F.col("length") == room).select(
        "*", (F.monotonically_increasing_id() + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    open_ = pieces.where(F.col("length") < room)
    count = open_.count()
    if not count:
        return full
    groups = math.ceil(count / GROUP)
    # The checkpointed row's number is hashed too: equal rows would else fall into one group, however many they are.
    open_ = open_.withColumn("row", F.monotonically_increasing_id())
    tie = F.xxhash64("doc_id", "piece", "ids_crc32", "row")
    items = open_.select(F.pmod(tie, F.lit(groups)).alias("g"), F.col("length").alias("size"), tie.alias("tie"), F.array(F.struct(*cols, F.lit(0).cast("long").alias("offset"))).cast(f"array<{MEMBER}>").alias("members"))
    bins, level = None, 0
    out = f"g long, number long, size long, members array<{MEMBER}>, done boolean"
    while True:
        last_room = ROOM[min(level, len(ROOM) - 1)]
        packed = cut(items.groupBy("g").applyInArrow(_packed(room, last_room), out))
        left = packed.where(~F.col("done")).count()
        # One group has met everything that is left; and bins that no longer merge won't merge higher up.
        final = groups == 1 or left > 0.98 * count and level > 0
        new = packed if final else packed.where("done")
        bins = new if bins is None else bins.union(new)
        if final or not left:
            break
        before, count, level = groups, left, level + 1
        groups = 1 if left <= TOP_GROUP else min(before, math.ceil(left / GROUP))
        # Neighbouring groups meet; with as many groups as before they are dealt anew.
        meet = F.floor(F.col("g") * groups / before).cast("long") if groups < before else F.pmod(F.xxhash64("g", "number"), F.lit(groups))
        items = packed.where(~F.col("done")).select(meet.alias("g"), "size", F.xxhash64("g", "number").alias("tie"), "members")
    # Bins of all rounds are checkpointed, so their row numbers are sequence ids that no two share.
    numbered = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    placed = numbered.select("sequence_id", F.explode("members").alias("m"))
    return placed.select(*[F.col(f"m.{c}").alias(c) for c in cols], "sequence_id", "m.offset").union(full)
