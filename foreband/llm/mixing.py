"""Mixing sources to target weights by pivotal dependent rounding (operator 1), with DataFrame functions only.

A source's target divided by its size is the number of copies each of its documents should have; the whole part is certain,
the fraction is a probability. Within a block two documents with open probabilities meet and words, not just probability, move
from one to the other until one of them is settled at 0 or 1; the direction is drawn so that each keeps its expected copies. The
words expected from a source thus never change. The open document left in a block goes on to the next level, where blocks hold
the residuals of many blocks, until one document per source is left, which is drawn. A source's taken words miss its target by
less than that one document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foreband.llm.common import cut, free, prepare

WORD = r"[^\x20\x09-\x0D]+"
# Documents that meet in one fold; blocks are sized from counts, so no source or key makes one larger.
BLOCK = 64


def _ranked(sources: DataFrame) -> DataFrame:
    """Numbers the sources by code point, null last: ranges of sources are numbered apart and shifted by the counts before them."""
    spread = cut(
        sources.withColumn("no", F.col("source").isNull()).repartitionByRange("no", "source").sortWithinPartitions("no", "source").withColumn(
            "at", F.monotonically_increasing_id()
        )
    )
    part = F.shiftright("at", 33).cast("int")
    counts = spread.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One entry per partition, however many sources there are.
    before = counts.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("counts"))
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    shift = F.aggregate(F.filter("counts", lambda c: c["part"] < part), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    return spread.join(F.broadcast(before)).select("source", "source_size", (inside + shift).alias("place"))


def targets(items: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """One row (source, source_size, target) per source. The sum of all sizes is shared by weight, at most `most` sizes each;
    what a full source can't take is shared anew by weight among the others."""
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    state = cut(_ranked(sizes).withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))))
    limit = F.col("source_size") * F.lit(most)
    share = None
    while True:
        full = F.lit(False) if share is None else F.col("weight") * F.lit(share) > limit
        total, held, open_weight = state.agg(
            F.sum("source_size"), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        # Sources without words are full at once; with nothing left open the shares stand.
        again = ((total or 0) - (held or 0.0)) / open_weight if open_weight else share or 0.0
        if share is not None and again <= share * (1 + 1e-12):
            break
        share = again
    return state.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(share)).cast("double").alias("target"))


def _draw(seed: int, *cols):
    """A number in [0, 1) that depends on the given columns and the seed only."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)


ROW = "struct<key:string,doc_id:bigint,size:bigint,n:bigint>"
STATE = f"struct<settled:array<struct<row:{ROW},more:int>>,open:struct<row:{ROW},p:double>>"


def _meet(state, two, seed: int):
    """One step of a fold: words move between the open document and the next one until one of the two is settled."""
    one = state["open"]
    w1, w2 = one["row"]["size"].cast("double"), two["row"]["size"].cast("double")
    up1, up2, down1, down2 = (1 - one["p"]) * w1, two["p"] * w2, one["p"] * w1, (1 - two["p"]) * w2
    up, down = F.least(up1, up2), F.least(down1, down2)
    rising = _draw(seed, one["row"]["key"], one["row"]["n"], two["row"]["key"], two["row"]["n"]) * (up + down) < down
    p1 = one["p"] + F.when(rising, up).otherwise(-down) / w1
    p2 = two["p"] - F.when(rising, up).otherwise(-down) / w2
    # Which one is settled follows from what bounded the move, not from rounded sums.
    first = F.when(rising, up1 <= up2).otherwise(down1 <= down2)
    row, more = F.when(first, one["row"]).otherwise(two["row"]), (rising == first).cast("int")
    left, p = F.when(first, two["row"]).otherwise(one["row"]), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(first, p2).otherwise(p1)))
    settled = F.concat(state["settled"], F.array(F.struct(row.alias("row"), more.alias("more"))))
    return F.struct(settled.alias("settled"), F.struct(left.alias("row"), p.alias("p")).alias("open")).cast(STATE)


def _folded(block, seed: int):
    start = F.struct(F.array().cast(f"array<struct<row:{ROW},more:int>>").alias("settled"), F.element_at(block, 1).alias("open")).cast(STATE)
    return F.aggregate(F.slice(block, F.lit(2), F.size(block)), start, lambda state, two: _meet(state, two, seed))


def key_of(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """Identity of a row's document; nulls differ from empty values."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string"), F.lit("\u0000")), F.lit("\u0000")) for c in (id_col, source_col, text_col)]
    return F.md5(F.concat(*parts))


def items_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows (key, n, doc_id, source, size): the words of each document; equal rows share a key and differ in n."""
    rows = docs.select(
        key_of(id_col, text_col, source_col).alias("key"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    counted = cut(rows.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("m")))
    return counted.select("key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("n"), "doc_id", "source", "size")


def copies(items: DataFrame, shares: DataFrame, seed: int = 17) -> DataFrame:
    """Copies of each row of items (key, n, doc_id, source, size): adds source_size, target and copies."""
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    counts = shares.join(items.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("rows")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    counts = cut(counts.withColumn("per", per))
    # Spark broadcasts the sources if they are small and else splits the part of a hot source.
    joined = items.withColumnRenamed("source", "s").join(counts, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    # A rounding error away from a whole number is a whole number.
    whole = F.floor(F.col("per") + 1e-9)
    rest = F.when(F.col("per") - whole < 1e-9, F.lit(0.0)).otherwise(F.col("per") - whole)
    joined = cut(joined.withColumn("base", whole.cast("int")).withColumn("p", rest))
    open_rows = joined.where("p > 0 and size > 0").select(
        "source", "rows", F.struct("key", "doc_id", "size", "n").alias("row"), "p", F.xxhash64("key", "n", F.lit(seed)).alias("h")
    )
    most = counts.agg(F.max("rows")).first()[0] or 0
    settled, level, blocks = None, 0, most
    while True:
        blocks = math.ceil(blocks / BLOCK)
        number = F.ceil(F.col("rows") / float(BLOCK ** (level + 1)))
        sorted_block = F.transform(F.sort_array(F.collect_list(F.struct("h", "row", "p"))), lambda x: F.struct(x["row"].alias("row"), x["p"].alias("p")))
        blocked = open_rows.groupBy("source", "rows", F.pmod(F.xxhash64("h", F.lit(level)), number).alias("b")).agg(sorted_block.alias("block"))
        folded = cut(blocked.select("source", "rows", _folded(F.col("block"), seed + level).alias("f")))
        new = folded.select(F.inline("f.settled")).select("row.key", "row.n", "more")
        settled = new if settled is None else settled.union(new)
        open_rows = folded.select("source", "rows", "f.open.row", "f.open.p").withColumn("h", F.xxhash64("row.key", "row.n", F.lit(seed)))
        if blocks <= 1:
            break
        level += 1
    last = open_rows.select("row.key", "row.n", (_draw(seed, F.col("row.key"), F.col("row.n")) < F.col("p")).cast("int").alias("more"))
    extra = settled.union(last).where("more > 0")
    return joined.join(extra, ["key", "n"], "left").select(
        "key", "n", "doc_id", "size", "source", "source_size", "target", (F.col("base") + F.coalesce("more", F.lit(0))).alias("copies")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 17, **columns: str) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken (copies times size).

    Sources by code point, null last, take the weights in turn. A null text counts no words; documents without words are only
    taken the whole part of their copies. Repeated rows are documents of their own. Reruns give the same copies.
    """
    prepare(docs.sparkSession)
    items = items_of(docs, **columns)
    out = copies(items, targets(items, weights, most), seed)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with the columns of `docs`, whatever their names."""
    key, copied, rows, nth, times, copy = (free(n, docs.columns) for n in ("key_", "copies_", "rows_", "nth_", "times_", "copy_"))
    names = ("id_col", "text_col", "source_col")
    columns = {k: options[k] for k in names if k in options}
    taken = mix(docs, **options).groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copied), F.count("*").alias(rows))
    keyed = docs.withColumn(key, key_of(**columns))
    keyed = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    often = F.floor(F.col(copied) / F.col(rows)) + (F.col(nth) <= F.col(copied) % F.col(rows)).cast("int")
    joined = keyed.join(taken, key).withColumn(times, often.cast("int")).where(F.col(times) > 0)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)
