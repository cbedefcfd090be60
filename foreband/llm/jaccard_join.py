"""N-gram Jaccard join by universe partition and pigeonhole (operator 8).

A document's set holds its distinct word shingles as 64-bit hashes; shingle hashes are the universe, cut into m ranges
("segments"). Sizes fall into bands so narrow that linked sets lie in the same or in adjacent bands. Two sets that link
differ in at most H shingles, H following from the band. An exact segment spends one unit, a segment with its one-deletion
neighbourhood two: with more units than H, any linked pair agrees on some segment, exactly or up to one deletion. A document
may leave out its smallest segments, which say least: every pair has units to spare for what both sides leave out. How many
segments, how many of them with deletions, and how many to leave out is chosen per band by cost (`allocation`).

Index rows, nearly all of which share their key with no other, travel packed: a task sorts its keys, cuts them to as many bits as their number
needs and writes differences, with places in a list of its classes. Cut keys that meet by chance only add pairs to compare.

Equal sets are one class throughout. Members of an index bucket are compared with the bucket's first member, exactly. Only buckets
that still hold different groups go on: a task streams a bucket past a bounded number of its members and gives out the pairs between groups
that the sets' parities leave possible, which are compared exactly, until nothing new links. Rows without a possible pair drop out. No
bucket is held in memory or expanded into pairs.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreband.llm.common import ID_LIMIT, cut, gathered, grouped, joined_hot, prepare, release, unsized
from foreband.llm.words import distinct, mix, shingles, word_hashes

# Costs in index rows: a key that holds no shingle meets all sets of its band, one with a single shingle those that hold a common one.
EMPTY_COST, TINY_COST = 5_000.0, 100.0
# Members of a bucket that the others are held against at a time.
PIVOTS = 512
# Pairs whose parities are held against each other at a time, and rows of a bucket whose pairs are held at a time.
NEAR_CELLS, STRETCH = 1 << 17, 500
# Pairs a task remembers, so that it does not give them out for each bucket they share; a full memory starts anew.
REMEMBERED = 200_000
# Index rows that a task holds to find the buckets among them; a bucket with a large share of them is then given out in parts.
HELD = 2_000_000
# Index rows that a task packs at a time, by which it has under 2 ** PLACE classes.
PACKED, PLACE = 900_000, 20
# Index rows in a slot, a range of keys that is looked through at once.
SLOT = 500_000
# Bits of a key beyond those that tell as many keys apart as there are: one in 2 ** SPARE meets another by chance. Bits at most.
SPARE, KEY_BITS = 14, 44
# Sets of this many bytes are broadcast at most.
BROADCAST_BYTES = 2 << 20
# Ids from which on it is worth finding out whether the others are fewer.
MANY = 20_000
# Bucket rows to each new pair from which on all possible pairs are given out.
FEW_LEFT = 16


@lru_cache
def band_starts(num: int, den: int, top: int) -> tuple[int, ...]:
    """Smallest size of each band; a set links at most into the next band."""
    starts = [1, 2]
    while starts[-1] <= top:
        starts.append(max(starts[-1] + 1, den * (starts[-1] - 1) // num + 1))
    return tuple(starts)


def _beyond(mean: float, limit: int) -> float:
    """How far a Poisson variable lies above a limit on average."""
    chance, left = math.exp(-mean), mean - limit
    for k in range(limit):
        left += (limit - k) * chance
        chance *= mean / (k + 1)
    return max(0.0, left)


@lru_cache(maxsize=4096)
def allocation(largest: int, num: int, den: int) -> tuple[int, int, int]:
    """(segments, of them with deletions, units left out by each side) of the band whose largest set is given, at the least cost."""
    need = (den - num) * 2 * largest // (den + num) + 1
    best = (math.inf, 1, 0, 0)
    for skip in range(33):
        units = need + 2 * skip
        for quarter in range(5):
            double = units // 2 * quarter // 4
            m = units - double
            mean = largest / m
            # Units that stand for a key without shingles, and for one with a single shingle.
            none = (m + double + double * mean) * math.exp(-mean)
            one = (m + double * mean / 2) * mean * math.exp(-mean)
            rows = m + double * mean
            best = min(best, (rows + EMPTY_COST * _beyond(none, skip) + TINY_COST * _beyond(none + one, skip), m, double, skip))
    return best[1:]


def _signatures(tokens: np.ndarray, band: int, largest: int, num: int, den: int) -> np.ndarray:
    """Index keys of one sorted set in one band's segmentation."""
    m, double, skip = allocation(largest, num, den)
    segment = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    ends = np.searchsorted(segment, np.arange(1, m + 1, dtype=np.uint64))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(tokens + np.uint64(band)))))
    starts = np.concatenate(([0], ends[:-1]))
    whole, counts = sums[ends] - sums[starts], ends - starts
    salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
    # A set below the band's largest differs less from what it links with, by so many units on its side. One unit is a segment's deletions,
    # another the segment itself. First those go whose keys hold no shingle or one, then the deletions of large segments, which are most rows.
    spare = skip + (den - num) * (largest - len(tokens)) // (den + num)
    few, most = counts[:double], len(tokens) + 1
    order = np.concatenate((np.where(few <= 2, few - 1, most - few + 1), np.where(counts <= 1, counts, most + counts)))
    keep = np.ones(m + double, bool)
    keep[np.argsort(order, kind="stable")[:spare]] = False
    keys = mix(whole + salt)[keep[double:]]
    if not double:
        return keys
    inner = np.flatnonzero(keep[segment[: ends[double - 1]].astype(np.int64)])
    at = segment[inner].astype(np.int64)
    fewer = mix(whole[at] - mix(tokens[inner] + np.uint64(band)) + salt[at])
    return distinct(np.concatenate((keys, fewer)))


def signatures(tokens: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index keys of one sorted set in its own band and in the one above."""
    if not len(tokens):
        return tokens
    starts = band_starts(num, den, 1 << max(4, (4 * len(tokens)).bit_length()))
    band = int(np.searchsorted(starts, len(tokens), "right")) - 1
    return np.concatenate([_signatures(tokens, b, starts[b + 1] - 1, num, den) for b in (band, band + 1)])


def sets_of(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    for hashes in word_hashes(texts):
        yield distinct(shingles(hashes, size))


def digest_of(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def class_of(digest: bytes | None) -> int | None:
    return None if digest is None else int.from_bytes(digest[:8], "little", signed=True)


def _digests(size: int):
    def run(batches):
        for b in batches:
            sets = list(sets_of(b.column("text"), size))
            digests = [digest_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(d) for d in digests], pa.int64()), pa.array(digests, pa.binary())],
                ["id", "n_shingles", "cls", "digest"],
            )

    return run


def _keys(size: int, num: int, den: int):
    """One index row for each key of each document's set."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                sets = [s for s in sets_of(b.column("text").slice(at, 200), size) if len(s)]
                keys = [signatures(s, num, den).view(np.int64) for s in sets]
                classes = np.array([class_of(digest_of(s)) for s in sets], np.int64)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(classes, [len(k) for k in keys]))], ["key", "cls"])

    return run


def _packed(make, slots: int, bits: int):
    """Index rows that `make` gives, packed: rows (slot, part, data), for each part also its classes, in a slot after the others.

    A class is named by its part and its place among the part's classes.
    """

    def blocks(part: int, held: list) -> pa.RecordBatch:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        classes, places = np.unique(np.concatenate([c for _, c in held]), return_inverse=True)
        keys = np.concatenate([k for k, _ in held]).view(np.uint64) >> np.uint64(64 - bits)
        both = distinct((keys << np.uint64(PLACE)) | places.astype(np.uint64))
        keys, places = both >> np.uint64(PLACE), both & np.uint64((1 << PLACE) - 1)
        slot = ((keys >> np.uint64(bits - 32)) * np.uint64(slots)) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        data = []
        for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            steps = np.diff(keys[x:y], prepend=keys[x])
            width = (int(steps.max()).bit_length() + 7) // 8
            planes = [v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for v, w in ((steps, width), (places[x:y], 3))]
            data.append(struct.pack("<IBQ", y - x, width, int(keys[x])) + pack(b"".join(planes)))
        columns = [[*slot[starts].tolist(), slots + (part + (part >> 20)) % slots], [part] * (len(data) + 1), [*data, classes.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["slot", "part", "data"])

    def run(batches):
        part, held, rows = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 20, [], 0
        for b in make(batches):
            held.append((b.column("key").to_numpy(), b.column("cls").to_numpy()))
            rows += b.num_rows
            if rows >= PACKED:
                yield blocks(part, held)
                part, held, rows = part + 1, [], 0
        if rows:
            yield blocks(part, held)

    return run


def _unpacked(part: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a block, ascending, and the names of their classes."""
    import zstandard

    n, width, first = struct.unpack_from("<IBQ", data)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[struct.calcsize("<IBQ") :]), np.uint8).reshape(-1, n)
    steps, places = np.zeros((2, n, 8), np.uint8)
    steps[:, :width], places[:, :3] = planes[:width].T, planes[width:].T
    return np.uint64(first) + np.cumsum(steps.view("<u8").ravel()), (places.view("<i8").ravel() | (part << PLACE))


def _runs(slots: int):
    """Of packed index rows sorted by slot and part: the members of buckets that hold several classes, as (bucket, class, first class of the
    bucket), and the classes by name, as (null, name, class).

    A bucket is named by its members, so that buckets with equal members are one: a task gives them out once, and rows that several tasks
    give out are equal. A bucket too long to be held is named by its key.
    """

    def rows(names, classes, pivots):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names, classes, pivots)], ["key", "ref", "pivot"])

    def merged(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, their classes, and where each bucket starts and how long it is; blocks come with ascending classes."""
        key, ref = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key, kind="stable")
        key, ref = key[order], ref[order]
        firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key, ref, firsts, np.diff(firsts, append=len(key))

    def spread(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.repeat(firsts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())

    def whole(held: list, given: set):
        """Rows of complete buckets."""
        key, ref, firsts, sizes = merged(held)
        firsts, sizes = firsts[sizes > 1], sizes[sizes > 1]
        if not len(firsts):
            return
        ref = ref[spread(firsts, sizes)]
        firsts = np.cumsum(sizes) - sizes
        names = mix(np.add.reduceat(mix(ref.view(np.uint64)), firsts) + sizes.astype(np.uint64)).view(np.int64)
        once = np.unique(names, return_index=True)[1]
        fresh = np.array([i for i, name in zip(once, names[once].tolist(), strict=True) if name not in given], np.int64)
        if len(given) > REMEMBERED:
            given.clear()
        given.update(names[fresh].tolist())
        if len(fresh):
            yield rows(np.repeat(names[fresh], sizes[fresh]), ref[spread(firsts[fresh], sizes[fresh])], np.repeat(ref[firsts[fresh]], sizes[fresh]))

    def run(batches):
        slot, held, count, most, long, given = None, [], 0, HELD, {}, set()
        for b in batches:
            for s, part, data in zip(*(b.column(c).to_pylist() for c in ("slot", "part", "data")), strict=True):
                if s >= slots:
                    classes = np.frombuffer(data, np.int64)
                    yield rows(pa.nulls(len(classes)), (part << PLACE) + np.arange(len(classes)), classes)
                    continue
                if s != slot:
                    if held:
                        yield from whole(held, given)
                    slot, held, count, most, long = s, [], 0, HELD, {}
                key, ref = _unpacked(part, data)
                if long:
                    # Go on with buckets that were too long to be held.
                    known = np.isin(key, np.array([*long], np.uint64))
                    if known.any():
                        own = key[known]
                        yield rows(mix(own).view(np.int64), ref[known], np.array([long[k] for k in own.tolist()], np.int64))
                        key, ref = key[~known], ref[~known]
                held.append((key, ref))
                count += len(key)
                if count > most:
                    key, ref, firsts, sizes = merged(held)
                    hot = sizes > HELD // 16
                    long |= dict(zip(key[firsts[hot]].tolist(), ref[firsts[hot]].tolist(), strict=True))
                    at = spread(firsts[hot], sizes[hot])
                    yield rows(mix(key[at]).view(np.int64), ref[at], np.repeat(ref[firsts[hot]], sizes[hot]))
                    rest = np.ones(len(key), bool)
                    rest[at] = False
                    held, count = [(key[rest], ref[rest])], int(rest.sum())
                    most = max(most, 2 * count)
        if held:
            yield from whole(held, given)

    return run


def parity(tokens: np.ndarray, finer: int = 2) -> bytes:
    """A bit for each bucket: whether it holds an odd number of tokens.

    finer=2: four to eight buckets a token, so that two tokens seldom meet in one and cancel out: pairs a little below the threshold are ruled
    out as well. finer=-1: half to one bucket a token, which takes an eighth of the space and still rules out sets that have little in common.
    finer=0: one to two, which rules out most sets that share a half.
    """
    width = 1 << max(6, len(tokens).bit_length() + finer)
    counts = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """At most the number of tokens that only one of two sets has, from their parities; the finer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _sketches(size: int):
    """Parities of each document's set."""

    def run(batches):
        for b in batches:
            sets = [s for s in sets_of(b.column("text"), size) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([class_of(digest_of(s)) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array([parity(s, finer) for s in sets], pa.binary()) for finer in (-1, 0, 2)),
                ],
                ["cls", "n", "coarse", "middle", "fine"],
            )

    return run


def _texts(size: int):
    """Whole texts, packed: they take less space than the hashes of their shingles."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            made = [(class_of(digest_of(s)), len(s), pack(t)) for s, t in zip(sets_of(b.column("text"), size), texts, strict=True) if len(s)]
            columns = zip(*made, strict=True) if made else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["cls", "n", "packed"])

    return run


def _possible(num: int, den: int):
    """Pairs that their parities don't rule out."""

    def run(batches):
        for b in batches:
            x, y, sizes = b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("sizes").to_pylist()
            keep = [(den + num) * least_difference(p, q) <= (den - num) * n for p, q, n in zip(x, y, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep, pa.bool_())), b.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def _folded(table: np.ndarray, words: int) -> np.ndarray:
    """Rows of parities, coarser."""
    while table.shape[1] > words:
        half = table.shape[1] // 2
        table = table[:, :half] ^ table[:, half:]
    return table


def _near(rows: list, pivots: list, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a row and a pivot that stands before it, of different groups, that their parities let link: places of both and the least
    difference as a share. rows, pivots: (places in the bucket, groups, sizes, table of parities)."""
    words = min(rows[3].shape[1], pivots[3].shape[1])
    many, step = _folded(pivots[3], words), max(1, NEAR_CELLS // len(pivots[0]))
    for at in range(0, len(rows[0]), step):
        place, group, size, table = (x[at : at + step] for x in rows)
        table = _folded(table, words)
        apart = np.zeros((len(place), len(many)), np.int32)
        for k in range(words):
            apart += np.bitwise_count(table[:, k, None] ^ many[None, :, k])
        both = size[:, None] + pivots[2][None, :]
        found = ((den + num) * apart <= (den - num) * both) & (group[:, None] != pivots[1][None, :]) & (pivots[0][None, :] < place[:, None])
        i, j = np.nonzero(found)
        if len(i):
            yield place[i], pivots[0][j], apart[i, j] / both[i, j]


def _streamed(batches, column: str, skip: int, num: int, den: int):
    """Of rows (key, cls, n, parity, g) sorted by key and class: pairs of a bucket's pivots, its members after the first `skip`, PIVOTS at
    most, with members that follow them, if they may link, as (key, pivots' classes, members' classes, shares) of a stretch of members, each in one stretch."""
    last, seen, held, pivots = None, 0, np.zeros(0, np.int64), {}
    for b in batches:
        if not b.num_rows:
            continue
        key, cls, n, g = (b.column(c).to_numpy() for c in ("key", "cls", "n", "g"))
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]) | (np.arange(len(key)) % STRETCH == 0)).tolist()
        for start, end in zip(starts, [*starts[1:], len(key)], strict=True):
            if key[start] != last:
                last, seen, held, pivots = key[start], 0, np.zeros(0, np.int64), {}
            first, before = start + max(0, skip - seen), seen
            seen += end - start
            if first >= end:
                continue
            bits = b.column(column).slice(first, end - first).to_pylist()
            widths = np.array([len(x) for x in bits])
            rows = {}
            for width in np.unique(widths).tolist():
                own = np.flatnonzero(widths == width)
                table = np.frombuffer(b"".join([bits[i] for i in own.tolist()]), np.uint64).reshape(len(own), -1)
                at = first + own
                # Places count from the first pivot on.
                rows[width] = [at - start + before - skip, g[at], n[at], table]
            held = np.concatenate((held, cls[first : max(first, start + skip + PIVOTS - before)][: end - first]))
            for width, own in rows.items():
                new = [x[own[0] < PIVOTS] for x in own]
                if len(new[0]):
                    pivots[width] = [np.concatenate(x) for x in zip(pivots[width], new, strict=True)] if width in pivots else new
            found = [x for own in rows.values() for some in pivots.values() for x in _near(own, some, num, den)]
            if found:
                i, j, share = (np.concatenate(x) for x in zip(*found, strict=True))
                yield last, held[j], cls[i + skip - before + start], share


def _batches_of(rows: Iterator[tuple[int, int]], names: list[str], size: int = 10_000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)


def _promising(num: int, den: int, skip: int):
    """Of the rows of a bucket those that their middle parities let link with another group in it, each once: (key, cls)."""

    def rows(batches):
        given: set[int] = set()
        last = None
        for key, a, b, _ in _streamed(batches, "middle", skip, num, den):
            if key != last:
                given, last = set(), key
            fresh = set(np.unique(np.concatenate((a, b))).tolist()) - given
            given |= fresh
            for c in fresh:
                yield int(key), c

    return lambda batches: _batches_of(rows(batches), ["key", "cls"])


def _meet(num: int, den: int, skip: int, every: bool):
    """Of rows sorted by key and class: pairs of different groups in one bucket that their fine parities let link, as (null, class, class).

    The members of a bucket after the first `skip`, PIVOTS of them at most, meet all that follow them. Of a member's possible pairs
    only the likeliest is given out, or with `every` each of them. Members of any possible pair come as
    (key, class, null), each once; later rounds need no others.
    """

    def rows(batches):
        given: set[tuple[int, int]] = set()
        members: set[int] = set()
        last = None
        for key, a, b, share in _streamed(batches, "fine", skip, num, den):
            if key != last:
                members, last = set(), key
            fresh = set(np.unique(np.concatenate((a, b))).tolist()) - members
            members |= fresh
            for c in fresh:
                yield int(key), c, None
            if not every:
                order = np.lexsort((a, share, b))
                order = order[np.append(True, b[order[1:]] != b[order[:-1]])]
                a, b = a[order], b[order]
            if len(given) > REMEMBERED:
                given.clear()
            for pair in zip(a.tolist(), b.tolist(), strict=True):
                if pair not in given:
                    given.add(pair)
                    yield None, *pair

    return lambda batches: _batches_of(rows(batches), ["key", "a", "b"])


def _linked(size: int, num: int, den: int):
    """Pairs whose sets link, from their packed texts."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            keep = []
            for at in range(0, b.num_rows, 200):
                pairs = [*zip(*(b.column(c).slice(at, 200).to_pylist() for c in ("x", "y")), strict=True)]
                packed = [*dict.fromkeys(p for pair in pairs for p in pair)]
                sets = dict(zip(packed, sets_of(pa.array([unpack(p) for p in packed], pa.binary()), size), strict=True))
                for x, y in ((sets[p], sets[q]) for p, q in pairs):
                    if len(x) > len(y):
                        x, y = y, x
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return run


def _few(ids: DataFrame) -> DataFrame:
    """Broadcast only if a count has shown the ids to be few; else they are joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= ID_LIMIT else ids


def _with_ids(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id is one of those wanted (column first, distinct). Of many wanted ids and all others the fewer are broadcast."""
    same, n = F.col("id").eqNullSafe(F.col("first")), wanted.count()
    if n > MANY:
        others = cut(rows.select("id").distinct().join(wanted, same, "left_anti").select(F.col("id").alias("first")))
        if others.count() < min(n, ID_LIMIT):
            return rows.join(F.broadcast(others), same, "left_anti")
    return rows.join(F.broadcast(wanted) if n <= ID_LIMIT else wanted, same, "left_semi")


def _classes_of(pairs: DataFrame, rows: int) -> DataFrame:
    return cut(gathered(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct(), 2 * rows))


def _met(pairs: DataFrame, held: DataFrame, column: str) -> DataFrame:
    """Pairs with a column of both of their sets. Sets of known few bytes are broadcast, others joined by shuffle."""
    size = held.agg(F.sum(F.octet_length(column) + 16)).first()[0] or 0
    hint = F.broadcast if size <= BROADCAST_BYTES else (lambda df: df)
    one = pairs.join(hint(held.select(F.col("cls").alias("b"), F.col(column).alias("y"), F.col("n").alias("m"))), "b")
    return one.join(hint(held.select(F.col("cls").alias("a"), F.col(column).alias("x"), "n")), "a").select("a", "b", "x", "y", (F.col("n") + F.col("m")).alias("sizes"))


class _Sets:
    """The sets of classes of equal documents: sketches of those that share a key, and texts, packed when they are asked for."""

    def __init__(self, rows: DataFrame, classes: DataFrame, alike: DataFrame, size: int, num: int, den: int):
        self.rows, self.classes, self.size, self.num, self.den = rows, classes.select("cls", "first"), size, num, den
        self.sketches = self._made(alike, _sketches, "cls long, n long, coarse binary, middle binary, fine binary")
        self.count = self.sketches.count()

    def _made(self, ids: DataFrame, make, schema: str) -> DataFrame:
        wanted = cut(self.classes.join(ids, "cls", "left_semi").select("first").distinct())
        made = cut(_with_ids(self.rows, wanted).select("text").mapInArrow(make(self.size), schema))
        if made.groupBy("cls").count().where("count > 1").limit(1).count():
            made = cut(made.dropDuplicates(["cls"]))  # rows that share an id
        return made

    def of(self, ids: DataFrame, column: str) -> DataFrame:
        """A sketch of each class, or of those in `ids` if they are less than half of all."""
        held = self.sketches.select("cls", "n", column)
        return held.join(_few(ids), "cls", "left_semi") if 2 * ids.count() < self.count else held

    def links(self, pairs: DataFrame, columns=("coarse", "fine")) -> DataFrame:
        """Pairs that link. Sketches, a small part of the sets' size, leave few pairs for which texts are moved."""
        for column in columns:
            rows = pairs.count()
            pairs = cut(gathered(_met(pairs, self.of(_classes_of(pairs, rows), column), column).mapInArrow(_possible(self.num, self.den), "a long, b long"), rows))
        texts = self._made(_classes_of(pairs, pairs.count()), _texts, "cls long, n long, packed binary")
        return cut(_met(pairs, texts, "packed").mapInArrow(_linked(self.size, self.num, self.den), "a long, b long"))


def shared_buckets(source: DataFrame, make, keys: int) -> DataFrame:
    """Buckets of index rows that hold several classes, each set of members once: rows (key, cls, pivot).

    make: gives index rows (key, cls) of batches of `source`, each class's from one row; keys: about how many, for the choice of slots and bits.
    """
    slots = max(4 * int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(keys / SLOT))
    bits = min(KEY_BITS, max(32, keys.bit_length() + SPARE))
    packed = source.mapInArrow(_packed(make, slots, bits), "slot long, part long, data binary")
    found = cut(packed.repartition("slot").sortWithinPartitions("slot", "part").mapInArrow(_runs(slots), "key long, ref long, pivot long"))
    rows = found.where("key is not null")
    refs = cut(rows.select("ref").distinct())
    names = _few(cut(found.where("key is null").select("ref", F.col("pivot").alias("cls")).join(refs, "ref", "left_semi")))
    named = rows.join(names, "ref").select("key", "cls", "pivot").dropDuplicates(["key", "cls"])
    pivots = names.select(F.col("ref").alias("pivot"), F.col("cls").alias("p_"))
    return cut(named.join(pivots, "pivot").select("key", "cls", F.col("p_").alias("pivot")))


def resolve(rows: DataFrame, classes: DataFrame, shared: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Groups of classes of equal sets, given index rows (key, cls, pivot): rows (digest, lowest, n_class).

    rows: (id, text) of all documents; classes: (digest, cls, first, n_class); lowest: smallest id of a class's group.
    """
    release(rows.sparkSession)
    ends = [F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")]
    done = cut(shared.where("cls != pivot").select(*ends).distinct())

    alike = _classes_of(done, done.count())
    sets = _Sets(rows, classes, alike, size, num, den)
    links = sets.links(done)
    groups = grouped(links)
    release(rows.sparkSession)

    def named(df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the group of a class; a class without links is a group of its own."""
        found = df.join(_few(groups.select(F.col("id").alias(column), F.col("component").alias("c_"))), column, "left")
        return found.withColumn(name, F.coalesce("c_", column)).drop("c_")

    def mixed(live: DataFrame, least: int = 2) -> DataFrame:
        """Rows of the buckets of `least` members or more that hold several groups, with the group and the number of members."""
        with_groups = named(live.select("key", "cls"), "cls", "g")
        several = with_groups.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("members"))
        several = several.where(F.col("low") != F.col("high")).where(F.col("members") >= least)
        return unsized(cut(with_groups.join(several.select("key", "members"), "key").select("key", "cls", "g", "members")))

    def streamed(live: DataFrame, column: str, make, schema: str) -> DataFrame:
        """Every slice of pivots over all buckets that are longer than its start."""
        largest, found = live.agg(F.max("members")).first()[0] or 0, []
        ids = cut(live.select("cls").distinct())
        held = sets.of(ids, column)
        for at in range(0, max(1, largest - 1), PIVOTS):
            rest = live.where(F.col("members") > at + 1).join(held, "cls").select("key", "cls", "n", column, "g")
            found.append(rest.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(make(at), schema))
        return reduce(DataFrame.union, found).distinct()

    # Pairs of buckets of two are all compared. Most members of longer ones share a passage and little else: one pass over middle parities
    # leaves those that may link at all.
    live = mixed(shared, 3)
    live = cut(streamed(live, "middle", lambda at: _promising(num, den, at), "key long, cls long"))
    every, most = False, 0
    while True:
        release(rows.sparkSession)
        live = mixed(live)
        rows_left = live.count()
        if not rows_left:
            break
        most = max(most, rows_left)
        met = cut(gathered(streamed(live, "fine", lambda at: _meet(num, den, at, every), "key long, a long, b long"), rows_left))
        live = met.where("key is not null").select("key", F.col("a").alias("cls"))
        fresh = cut(gathered(met.where("key is null").select("a", "b").join(done, ["a", "b"], "left_anti"), rows_left))
        pairs, linked = fresh.count(), 0
        if pairs:
            more = sets.links(fresh, ())
            done = done.union(fresh)
            linked = more.limit(1).count()
        if linked:
            links = cut(links.union(more))
            groups = grouped(links)
        elif every:
            break
        # The likeliest pair of each row comes first; all pairs, which must link nothing new in the end, when those have become few.
        every = not linked or FEW_LEFT * pairs <= most

    member = classes.select("cls", "digest", "first", "n_class").join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn("g", F.coalesce("component", "cls"))
    lowest = member.groupBy("g").agg(F.min("first").alias("lowest"))
    return member.join(lowest, "g").select("digest", "lowest", "n_class")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (smallest id reachable by links, itself included), n_class.

    Documents link when den * |A & B| >= num * |A | B| over their sets of `size`-word shingles. A text of fewer words is one
    shingle as a whole; null, empty and blank texts have no shingle and link with nothing (n_class null). Rows with equal sets
    are linked, repeated rows too; n_class counts them. Null ids come back as rows; a component of null ids only has a null id.
    Other columns of `docs` are not read. Shingles are told apart by 64-bit hashes, sets by 128-bit ones.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    narrow = cut(rows.mapInArrow(_digests(size), "id long, n_shingles long, cls long, digest binary"))
    classes = cut(narrow.where("digest is not null").groupBy("digest", "cls").agg(F.min("id").alias("first"), F.count("*").alias("n_class"), F.min("n_shingles").alias("n")))

    # Only the first document of each class is indexed.
    first = _with_ids(rows, classes.select("first").distinct()).select("text")
    shared = shared_buckets(first, _keys(size, num, den), classes.agg(F.sum("n")).first()[0] or 0)
    named = resolve(rows, classes, shared, size, num, den)
    none = narrow.where("digest is null").withColumns({"lowest": F.lit(None).cast("long"), "n_class": F.lit(None).cast("long")})
    joined = joined_hot(narrow.where("digest is not null"), named, "digest", "n_class", narrow.count()).unionByName(none)
    return joined.select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("component_id"), "n_class"
    )
