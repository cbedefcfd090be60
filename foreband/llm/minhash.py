"""Document fingerprints by MinHash (operator 3).

A fingerprint holds, for each of 126 multiply-add permutations of the word shingles' hashes, 16 bits of the smallest value. Texts are dealt
by ranges of descending ids, so that the next document is the next row; only a range's last row takes its next one from the
head of the range after it. Near duplicates come from 21 signature bands of 6 values, joined by key, with every Jaccard verified.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreband.llm.common import cut, joined_hot, prepare
from foreband.llm.jaccard_join import class_of, digest_of, resolve, shared_buckets
from foreband.llm.words import mix, shingles, word_hashes

BANDS, ROWS = 21, 6
PERMUTATIONS = BANDS * ROWS
_DRAW = np.random.default_rng(20260103)
_FACTOR = (_DRAW.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))[:, None]
_SHIFT = _DRAW.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]
_STEP = 1024
# Of texts without words.
EMPTY = np.full(PERMUTATIONS, 0xFFFF, np.uint16)

OUT = "part int, kind int, id long, n_chars long, edited_sha256 string, sig binary, edited binary, near_edited double, near_next double, digest binary, cls long, packed binary"


def signature(tokens: np.ndarray) -> np.ndarray:
    """The fingerprint of a text's shingle hashes."""
    if not len(tokens):
        return EMPTY
    x = tokens.astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _STEP):
        np.minimum(least, (x[at : at + _STEP] * _FACTOR + _SHIFT).min(axis=1), out=least)
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity: the share of equal values."""
    return float((a == b).mean())


def tokens_of(texts: list[str], size: int):
    return [shingles(h, size) for h in word_hashes([t.encode() for t in texts])]


def edit(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _zip(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        packed = [pack(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"), pa.array(packed, pa.binary())], ["id", "tie", "packed"])


def _unzip(column) -> list[str]:
    import zstandard

    out = zstandard.ZstdDecompressor().decompress
    return [out(z).decode() for z in column.to_pylist()]


def _compared(docs: list[tuple], following: list[tuple], size: int) -> list[dict]:
    """docs and their next ones as (id, text, fingerprint, digest)."""
    edited = [edit(d[1], f[1]) for d, f in zip(docs, following, strict=True)]
    out = []
    for d, f, e, t in zip(docs, following, edited, tokens_of(edited, size), strict=True):
        sig = signature(t)
        out.append(
            {"kind": 0, "id": d[0], "n_chars": len(d[1]), "edited_sha256": hashlib.sha256(e.encode()).hexdigest(), "sig": d[2].tobytes(), "edited": sig.tobytes()}
            | {"near_edited": likeness(d[2], sig), "near_next": likeness(d[2], f[2]), "digest": d[3], "cls": class_of(d[3])}
        )
    return out


def _batch(rows: list[dict], part: int) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([part if n == "part" else r.get(n) for r in rows], types[t]) for n, t in fields], [n for n, _ in fields])


def _described(texts: list[str], size: int) -> list[tuple]:
    out = []
    for t in tokens_of(texts, size):
        out.append((signature(t), digest_of(np.unique(t))))
    return out


def _ranged(size: int):
    """Rows of one range of ids; its first and its last document also as rows of kinds 1 and 2."""

    def run(batches):
        part, held, last = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            texts = _unzip(b.column("packed"))
            rows = [(i, t, *d) for i, t, d in zip(b.column("id").to_pylist(), texts, _described(texts, size), strict=True)]
            packed = b.column("packed")
            if held is None:
                yield _batch([{"kind": 1, "id": rows[0][0], "packed": packed[0].as_py()}], part)
            chain = rows if held is None else [held, *rows]
            if len(chain) > 1:
                yield _batch(_compared(chain[:-1], chain[1:], size), part)
            held, last = rows[-1], packed[-1].as_py()
        if held is not None:
            yield _batch([{"kind": 2, "id": held[0], "packed": last}], part)

    return run


def _joined(size: int):
    """The last documents of ranges with the first of the next ones."""

    def run(batches):
        for b in batches:
            one, two = _unzip(b.column("packed")), _unzip(b.column("following"))
            docs = [(i, t, *d) for i, t, d in zip(b.column("id").to_pylist(), one, _described(one, size), strict=True)]
            following = [(None, t, *d) for t, d in zip(two, _described(two, size), strict=True)]
            if docs:
                yield _batch(_compared(docs, following, size), -1)

    return run


def _bands(batches):
    for b in batches:
        if not b.num_rows:
            continue
        classes = np.array([class_of(d) for d in b.column("digest").to_pylist()], np.int64)
        values = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(len(classes), BANDS, ROWS).astype(np.uint64)
        keys = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(classes), 1), np.uint64)
        for r in range(ROWS):
            keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + values[:, :, r])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(classes, BANDS))], ["key", "cls"])


def fingerprints(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next, class_id, n_class.

    The edited text is the document with its last third replaced from the next document in descending id (ids alike: by a hash of
    the text; null ids last; after the last the first). A null text is empty; texts without words have one fingerprint of their
    own. Texts under `size` words are one shingle. class_id: smallest id among the document's near duplicates (word
    shingles of Jaccard similarity num/den or more, found by bands and verified, and their near duplicates), itself included;
    n_class: documents with just its shingles.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    packed = rows.withColumn("tie", F.xxhash64("text")).mapInArrow(_zip, "id long, tie long, packed binary")
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    ranged = cut(packed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "packed").mapInArrow(_ranged(size), OUT))

    # Two rows per range: its first document and its last.
    heads, tails = ranged.where("kind = 1").select("part", "packed"), ranged.where("kind = 2").select("part", "id", "packed")
    by_part = Window.orderBy("part")
    after = heads.select("part").withColumn("next", F.lead("part").over(by_part))
    after = after.join(after.agg(F.min("part").alias("first"))).select("part", F.coalesce("next", "first").alias("next"))
    met = tails.join(after, "part").join(heads.select(F.col("part").alias("next"), F.col("packed").alias("following")), "next")
    whole = ranged.where("kind = 0").union(cut(met.select("id", "packed", "following").mapInArrow(_joined(size), OUT)))

    described = whole.where("digest is not null")
    classes = cut(described.groupBy("digest", "cls").agg(F.min("id").alias("first"), F.count("*").alias("n_class"), F.min("sig").alias("sig")))
    shared = shared_buckets(classes.select("digest", "sig"), _bands, BANDS * classes.count())
    groups = resolve(rows, classes.select("digest", "cls", "first", "n_class"), shared, size, num, den)
    none = whole.where("digest is null").withColumns({"lowest": F.lit(None).cast("long"), "n_class": F.lit(None).cast("long")})
    joined = joined_hot(described, groups, "digest", "n_class", described.count()).unionByName(none)
    return joined.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.lower(F.hex("sig")).alias("fingerprint"), F.lower(F.hex("edited")).alias("edited_fingerprint"),
        "near_edited", "near_next", F.coalesce("lowest", "id").alias("class_id"), F.coalesce("n_class", F.lit(1).cast("long")).alias("n_class"),
    )
