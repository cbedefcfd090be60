"""Cross-tokenizer alignment by pointer jumping (operator 12).

Texts are encoded by two tokenizers, and the tokens of a batch of texts laid end to end by their bytes. Every token points to the
token overlapping it that reaches farthest right; successors double until nothing moves, which leaves each token at the last token of
its group. Tokens of a group are linked, all of one side with all of the other. A first pass encodes and keeps each
document's distinct linked id pairs with their multiplicities, packed; a second sums the pairs' document counts, combined within tasks; a third
looks the counts up. The most frequent pairs, in a number with a bound, are broadcast; rarer ones, of which none is in many
documents, meet the documents' pairs in a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.llm.common import cut, prepare
from foreband.llm.tokens import default_path, encoder

# Links that are expanded at a time, and distinct pairs that a task sums before it gives them out.
LINKS, SUMMED = 2_000_000, 2_000_000
# Pairs that are broadcast at most, 13 bytes each.
BROADCAST_PAIRS = 1_000_000
BATCH = 200

OUT = "row long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, more boolean, pairs binary"


def second_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Tokens:
    """Token ids of texts with a blank put first, as bytes and as decimal cells."""

    def __init__(self, path: str, lead: bytes):
        self.encoder, self.lead = encoder(path, True), lead
        parts = self.encoder.token_bytes()
        self.count = len(parts)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        digits = [str(i).encode() for i in range(self.count)]
        self.width = max(map(len, digits))
        self.digits = np.frombuffer(b"".join(d.ljust(self.width, b"\0") for d in digits), np.uint8).reshape(self.count, self.width)
        self.digit_sizes = np.array([len(d) for d in digits])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return list(self.encoder.encode([self.lead + t for t in texts]))

    def spelled(self, ids: np.ndarray) -> bytes:
        """The joined bytes of tokens."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - (ends - sizes), sizes)].tobytes()


@lru_cache(maxsize=2)
def sides(first: str, second: str) -> tuple[Tokens, Tokens]:
    # A model file of sentencepiece adds the blank itself.
    return tuple(Tokens(p, b"" if p.endswith(".model") else b" ") for p in (first, second))


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For all tokens of both sides (first the a), given by rising end offsets over one stretch of bytes: the number of the b token that ends its group."""
    na, nb = len(a_end), len(b_end)
    a_start, b_start = np.append(0, a_end[:-1]), np.append(0, b_end[:-1])
    to = np.arange(na + nb)
    to[:na] = na + np.searchsorted(b_start, a_end) - 1
    far = np.searchsorted(a_start, b_end) - 1
    to[na:] = np.where(a_end[far] > b_end, far, to[na:])
    while True:
        jumped = to[to]
        if (jumped == to).all():
            return to - na
        to = jumped


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of counts[i] places: i, and its place from 0."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _expand(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, wide: int) -> np.ndarray:
    """Pair keys of all links of groups of p a tokens and q b tokens, laid end to end."""
    group, place = _spread(p * q)
    a_at, b_at = np.cumsum(p) - p, np.cumsum(q) - q
    return a[a_at[group] + place // q[group]].astype(np.int64) * wide + b[b_at[group] + place % q[group]]


def _pack(keys: np.ndarray, times: np.ndarray) -> bytes:
    import zstandard

    steps = np.diff(keys, prepend=0).astype(np.uint64)
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes() + times.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    n = len(planes) // 12
    steps = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(steps).astype(np.int64), np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view(np.uint32).ravel().astype(np.int64)


def _distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in rising order, and how often each comes."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    starts = np.flatnonzero(new)
    return x[starts], y[starts], np.diff(starts, append=len(x))


def _heavy(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of one document with very many links, in pieces by ranges of a ids: repeated ids of a group are met once."""
    groups = np.arange(len(p))
    a_id, a_group, a_times = _distinct(a, np.repeat(groups, p))
    b_group, b_id, b_times = _distinct(np.repeat(groups, q), b)
    b_at = np.searchsorted(b_group, np.arange(len(p) + 1))
    partners = np.diff(b_at)[a_group]
    reach = np.append(0, np.cumsum(partners))
    bounds = np.append(np.flatnonzero(np.diff(a_id, prepend=-1)), len(a_id))
    at = 0
    while at < len(a_id):
        # As many whole ids as stay within the bound, one at least.
        later = bounds[bounds > at]
        fits = later[reach[later] - reach[at] <= LINKS]
        to = int(fits[-1] if len(fits) else later[0])
        which, place = _spread(partners[at:to])
        other = b_at[a_group[at:to][which]] + place
        keys = a_id[at:to][which].astype(np.int64) * wide + b_id[other]
        found, back = np.unique(keys, return_inverse=True)
        times = np.zeros(len(found), np.int64)
        np.add.at(times, back, a_times[at:to][which] * b_times[other])
        yield found, times
        at = to


def _blobs(doc: np.ndarray, a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, n: int, wide: int, space: int) -> list[list[bytes]]:
    """Packed pairs of each of n documents; doc: the document of each group."""
    out: list[list[bytes]] = [[] for _ in range(n)]
    links = np.bincount(doc, p * q, n).astype(np.int64)
    group_at = np.searchsorted(doc, np.arange(n + 1))
    a_at, b_at = np.append(0, np.cumsum(p))[group_at], np.append(0, np.cumsum(q))[group_at]
    at = 0
    while at < n:
        if links[at] > LINKS:
            own = slice(group_at[at], group_at[at + 1])
            args = a[a_at[at] : a_at[at + 1]], p[own], b[b_at[at] : b_at[at + 1]], q[own], wide
            out[at] = [_pack(*piece) for piece in _heavy(*args)]
            at += 1
            continue
        to, size = at, 0
        while to < n and size + links[to] <= LINKS:
            size += links[to]
            to += 1
        own = slice(group_at[at], group_at[to])
        keys = _expand(a[a_at[at] : a_at[to]], p[own], b[b_at[at] : b_at[to]], q[own], wide)
        keys += np.repeat(doc[own] - at, p[own] * q[own]) * space
        keys.sort()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        times, keys = np.diff(starts, append=len(keys)), keys[starts]
        ends = np.searchsorted(keys, np.arange(to - at + 1) * space)
        for i in range(to - at):
            mine = slice(ends[i], ends[i + 1])
            if ends[i] < ends[i + 1]:
                out[at + i] = [_pack(keys[mine] - i * space, times[mine])]
        at = to
    return out


def _strings(side_a: Tokens, side_b: Tokens, a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All groups as text (`a1,a2|b1;...`), and where each document's part ends; last: the last group of each document."""
    na, width = len(a), max(side_a.width, side_b.width)
    cells = np.zeros((na + len(b), width + 1), np.uint8)
    sizes = np.zeros(len(cells), np.int64)
    p_end, q_end = np.cumsum(p), np.cumsum(q)
    at_a = np.arange(na) + np.repeat(q_end - q, p)
    at_b = np.arange(len(b)) + np.repeat(p_end, q)
    for side, ids, at in ((side_a, a, at_a), (side_b, b, at_b)):
        cells[at, : side.width] = side.digits[ids]
        sizes[at] = side.digit_sizes[ids]
    mark = np.full(len(cells), ord(","), np.uint8)
    mark[at_a[p_end - 1]] = ord("|")
    mark[at_b[q_end - 1]] = ord(";")
    cells[np.arange(len(cells)), sizes] = mark
    flat = cells[np.arange(width + 1)[None, :] <= sizes[:, None]]
    return flat, np.cumsum(sizes + 1)[at_b[q_end[last] - 1]] - 1


def aligned(texts: list[bytes], side_a: Tokens, side_b: Tokens) -> list[tuple[int, int, int, int, str, list[bytes]]]:
    """For each text: tokens of both sides, groups, links, the groups' digest, packed pairs."""
    out: list = [(0, 0, 0, 0, "", [])] * len(texts)
    ids = [side.encode(texts) for side in (side_a, side_b)]
    use = [i for i, t in enumerate(texts) if t and side_a.spelled(ids[0][i]) == b" " + t == side_b.spelled(ids[1][i])]
    if not use:
        return out
    a, b = (np.concatenate([x[i] for i in use]).astype(np.int64) for x in ids)
    n_a, n_b = (np.array([len(x[i]) for i in use]) for x in ids)
    a_end, b_end = np.cumsum(side_a.sizes[a]), np.cumsum(side_b.sizes[b])
    stop = terminals(a_end, b_end)
    final = np.unique(stop)  # the last b token of each group
    group = np.searchsorted(final, stop)
    p, q = np.bincount(group[: len(a)], minlength=len(final)), np.bincount(group[len(a) :], minlength=len(final))
    doc = np.searchsorted(np.cumsum(n_b), final, "right")
    n_groups = np.bincount(doc, minlength=len(use))
    n_links = np.bincount(doc, p * q, len(use)).astype(np.int64)
    flat, ends = _strings(side_a, side_b, a, p, b, q, np.cumsum(n_groups) - 1)
    wide = side_b.count
    blobs = _blobs(doc, a, p, b, q, len(use), wide, side_a.count * wide)
    at = 0
    for k, i in enumerate(use):
        text = flat[at : ends[k]].tobytes()
        at = ends[k] + 1
        out[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), hashlib.sha256(text).hexdigest(), blobs[k])
    return out


def _align(first: str, second: str):
    def run(batches):
        side_a, side_b = sides(first, second)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
                rows = []
                for row, i, found in zip(b.column("row").to_pylist(), b.column("id").to_pylist(), aligned(texts, side_a, side_b), strict=True):
                    *facts, blobs = found
                    rows.append((row, i, *facts, False, blobs[0] if blobs else None))
                    rows += [(row, None, None, None, None, None, None, True, blob) for blob in blobs[1:]]
                kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
                fields = [f.split() for f in OUT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    return run


def _counted(batches):
    """How many of the task's documents hold each pair, in parts of a bounded number of distinct pairs."""
    keys, n, fresh, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def summed():
        every = np.concatenate([keys, *fresh])
        found, back = np.unique(every, return_inverse=True)
        return found, np.bincount(back, np.concatenate([n, np.ones(len(every) - len(n), np.int64)]), len(found)).astype(np.int64)

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    for b in batches:
        for raw in b.column("pairs").to_pylist():
            fresh.append(_unpack(raw)[0])
            size += len(fresh[-1])
            if size > SUMMED:
                (keys, n), fresh, size = summed(), [], 0
                if len(keys) > SUMMED:
                    yield batch()
                    keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, n = summed()
    if len(keys):
        yield batch()


def _looked_up(table, found: bool):
    """Sums over a document's pairs that the broadcast table has, or with found=False the pairs that it lacks, one row each."""

    def run(batches):
        keys, counts, best = table.value
        for b in batches:
            rows, n_best, sums, lacking = b.column("row").to_pylist(), [], [], []
            for row, raw in zip(rows, b.column("pairs").to_pylist(), strict=True):
                mine, times = _unpack(raw) if raw else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                at = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
                known = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
                if found:
                    n_best.append(int(times[known][best[at[known]]].sum()))
                    sums.append(int((times[known] * counts[at[known]]).sum()))
                elif not known.all():
                    lacking.append((np.full((~known).sum(), row), mine[~known], times[~known]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in b.schema.names if c != "pairs"), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64())],
                    [*(c for c in b.schema.names if c != "pairs"), "n_best", "count_sum"],
                )
            elif lacking:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*lacking, strict=True)], ["row", "pair", "times"])

    return run


def align(
    docs: DataFrame, first: str | None = None, second: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_PAIRS
) -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    first, second: files of two tokenizers that spell out every byte (byte-level .json, or .model). Each text is encoded with a blank
    before it, special strings as plain text. Byte offsets where tokens of both sides end cut the tokens into groups; every pair of
    token occurrences of one group is a link. A pair's count is the number of rows that hold it linked, repeated rows each.
    n_best: links whose count is the highest of their first id, ties included; count_sum: sum of counts over links. groups_sha256:
    digest of the groups as `a1,a2|b1;a3|b2,b3`. A text that is null, empty or not spelled out by either side has zeros and an empty digest.
    Texts of any length are read whole; one with very many links passes in several rows. Null ids come back; other columns are not read.
    most: pairs that are broadcast, the most frequent ones.
    """
    spark = docs.sparkSession
    prepare(spark)
    first, second = first or default_path(), second or second_path()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = cut(rows.mapInArrow(_align(first, second), OUT))
    counts = found.where("pairs is not null").select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    side = F.floor(F.col("pair") / sides(first, second)[1].count).alias("side")
    # One row per id of the first tokenizer at most, whose vocabulary bounds it.
    top = F.broadcast(counts.groupBy(side).agg(F.max("n").alias("top")))
    pairs = counts.withColumn("side", side).join(top, "side").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))

    # The least power of two so that no more than `most` pairs have that count.
    sizes = {r.level: r.size for r in counts.groupBy((F.length(F.bin("n")) - 1).alias("level")).agg(F.count("*").alias("size")).collect()}
    least = next(k for k in range(64) if sum(s for level, s in sizes.items() if level >= k) <= most)
    frequent = pairs.where(F.col("n") >= 1 << least).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast((frequent.column("pair").to_numpy(), frequent.column("n").to_numpy(), frequent.column("best").to_numpy().astype(bool)))

    facts = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "more"]
    kept = ", ".join(f for f in OUT.split(", ") if f != "pairs binary")
    scored = found.select(*facts, "pairs").mapInArrow(_looked_up(table, True), f"{kept}, n_best long, count_sum long")
    extra = []
    if found.where("more").limit(1).count():
        extra.append(scored.where("more").select("row", "n_best", "count_sum"))
    if least:
        rare = found.select("row", "pairs").mapInArrow(_looked_up(table, False), "row long, pair long, times long").join(pairs.where(F.col("n") < 1 << least), "pair")
        extra.append(rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")))
    out = scored.where("not more")
    if extra:
        added = extra[0] if len(extra) == 1 else extra[0].unionByName(extra[1])
        added = added.groupBy("row").agg(F.sum("n_best").alias("b_"), F.sum("count_sum").alias("c_"))
        out = out.join(added, "row", "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("b_", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("c_", F.lit(0))}
        )
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
