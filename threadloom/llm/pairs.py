"""Items that appear together (problem 7): stripes, merged by key, with log-likelihood.

A record is a checkpoint, an item a file path. Each task gathers for every item an
associative array (a stripe) of the items beside it; stripes are shuffled by item and
their arrays merged by key, an item after the other. Items in very many records have
their stripes split by neighbour, so none of them is one task's work. A record longer
than BLOCK items is cut into blocks, and each pair of its blocks is dealt on its own.
Significance is the log-likelihood ratio of a pair against chance.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.durable import materialise
from threadloom.tables import with_row

BLOCK = 512
MIN_TOGETHER, MIN_LIFT = 5, 3.0
#: Chance of a table as uneven as this is one in a thousand (one degree of freedom).
SIGNIFICANT = 10.83
#: Entries a task gathers before it hands its stripes on, and entries of a row of them at most.
FLUSH, STRIPE = 200_000, 256
#: Items in more records than this, and than this share of all memberships (so they are at
#: most 10,000), have stripes split by neighbour into PARTS.
HOT_RECORDS, HOT_SHARE, PARTS = 10_000, 1e-4, 32


def clean_path(path: Column) -> Column:
    """A path without its leading './'; a rename 'old<TAB>new' counts as new; blank is null."""
    p = F.regexp_replace(F.element_at(F.split(path, "\t"), -1), r"^\./", "")
    return F.when(F.trim(p) != "", p)


def memberships(files_index: DataFrame) -> DataFrame:
    """Distinct (record, item); rows with a null record or a blank path are none."""
    return files_index.select(F.col("checkpoint_id").alias("record"), clean_path(F.col("file_path")).alias("item")).where("record is not null and item is not null").distinct()


_STRIPE = pa.schema([("item", pa.string()), ("part", pa.int32()), ("beside", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_PAIR = pa.schema([("file_a", pa.string()), ("file_b", pa.string()), ("c", pa.int64())])


def _gather(hot: frozenset[str]):
    """Blocks of records, as (left, right or null), to stripes of what their items stand beside."""

    def flush(stripes: dict[str, Counter]) -> pa.RecordBatch:
        rows: tuple[list, list, list, list] = ([], [], [], [])
        for item, found in stripes.items():
            parts: dict[int, list] = {0: list(found.items())}
            if item in hot:
                parts = defaultdict(list)
                for x, c in found.items():
                    parts[crc32(x.encode()) % PARTS].append((x, c))
            for part, entries in parts.items():
                for i in range(0, len(entries), STRIPE):
                    piece = entries[i : i + STRIPE]
                    for col, v in zip(rows, (item, part, [x for x, _ in piece], [c for _, c in piece])):
                        col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _STRIPE)], schema=_STRIPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[str, Counter] = defaultdict(Counter)
        n = 0
        for b in batches:
            for left, right in zip(b.column("left").to_pylist(), b.column("right").to_pylist()):
                if right is None:
                    items = sorted(left)
                    for i, a in enumerate(items[:-1]):
                        stripes[a].update(items[i + 1 :])
                    n += len(items) * (len(items) - 1) // 2
                else:
                    for a in left:
                        for x in right:
                            stripes[min(a, x)][max(a, x)] += 1
                    n += len(left) * len(right)
                if n > FLUSH:
                    yield flush(stripes)
                    stripes, n = defaultdict(Counter), 0
        if stripes:
            yield flush(stripes)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes sorted by (item, part): their arrays are merged by key; only the last item's is carried on."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        at = pc.list_parent_indices(b.column("beside"))
        flat = pa.table({"item": b.column("item").take(at), "part": b.column("part").take(at), "beside": pc.list_flatten(b.column("beside")), "c": pc.list_flatten(b.column("counts"))})
        flat = flat if held is None else pa.concat_tables([held, flat])
        merged = flat.group_by(["item", "part", "beside"]).aggregate([("c", "sum")]).rename_columns(["item", "part", "beside", "c"])
        last = pc.and_(pc.equal(merged["item"], b.column("item")[-1]), pc.equal(merged["part"], b.column("part")[-1]))
        held = merged.filter(last)
        yield from _pairs(merged.filter(pc.invert(last)))
    if held is not None:
        yield from _pairs(held)


def _pairs(merged: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from pa.table([merged["item"], merged["beside"], merged["c"]], schema=_PAIR).to_batches(max_chunksize=50_000)


def together(members: DataFrame) -> DataFrame:
    """(file_a, file_b, c): in how many records each pair occurs, file_a < file_b by code point."""
    hot_at = max(HOT_RECORDS, int(members.count() * HOT_SHARE))
    hot = frozenset(r["item"] for r in members.groupBy("item").count().where(F.col("count") > hot_at).select("item").collect())
    sizes = members.groupBy("record").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("record", F.ceil(F.col("size") / BLOCK).alias("n"))
    cut = members.join(sizes, "record", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    blocks = cut.groupBy("record", "n", F.pmod(F.xxhash64("item"), F.col("n")).alias("block")).agg(F.collect_list("item").alias("items"))
    within = blocks.where(F.size("items") > 1).select(F.col("items").alias("left"), F.lit(None).cast("array<string>").alias("right"))
    # The pairs of a record's blocks are named first, then each side joins its own block.
    firsts = sizes.select("record", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("i")).repartition("record", "i")
    named = firsts.select("record", "i", F.explode(F.sequence(F.col("i") + 1, F.col("n") - 1)).alias("j"))
    long = blocks.where("n > 1")
    side = lambda at, out: long.select("record", F.col("block").alias(at), F.col("items").alias(out))
    across = named.join(side("i", "left"), ["record", "i"]).join(side("j", "right"), ["record", "j"]).select("left", "right")
    stripes = within.unionByName(across).mapInArrow(_gather(hot), "item string, part int, beside array<string>, counts array<bigint>")
    return stripes.repartition("item", "part").sortWithinPartitions("item", "part").mapInArrow(_merge, "file_a string, file_b string, c bigint")


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))


def log_likelihood(c: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's ratio of the 2x2 table of a pair: twice the information its two items share."""
    cells = [c, a - c, b - c, n - a - b + c]
    rows, cols = [a, n - a], [b, n - b]
    total = _xlogx(n)
    for x in cells:
        total = total + _xlogx(x)
    for x in rows + cols:
        total = total - _xlogx(x)
    return F.greatest(F.lit(0.0), 2.0 * total)


def _scored(pairs: DataFrame, support: DataFrame, n_records: DataFrame) -> DataFrame:
    a = support.select(F.col("item").alias("file_a"), F.col("n").alias("a"))
    b = support.select(F.col("item").alias("file_b"), F.col("n").alias("b"))
    return with_row(pairs.join(a, "file_a").join(b, "file_b"), n_records)


def count_records(checkpoints: DataFrame) -> DataFrame:
    """One row: the number of distinct records there are, with or without items."""
    return checkpoints.select("id").where("id is not null").agg(F.count_distinct("id").alias("n"))


def pairs(files_index: DataFrame, checkpoints: DataFrame, min_together: int = 1, min_lift: float = 0.0) -> DataFrame:
    """(file_a, file_b, c, a, b, n, lift, llr) of each pair that reaches both thresholds.

    Items that cannot reach them are left out first, which loses nothing: c is at most
    min(a, b), so an item in fewer than *min_together* records has no such pair, nor has
    one in more than n / *min_lift* records, as c * n >= min_lift * a * b needs
    max(a, b) <= n / min_lift.
    """
    members = materialise(memberships(files_index), "members")
    support = members.groupBy("item").agg(F.count("*").alias("n"))
    n_records = count_records(checkpoints)
    if min_together > 1 or min_lift > 0:
        ok = with_row(support, n_records.withColumnRenamed("n", "total")).where((F.col("n") >= min_together) & (F.col("n") * min_lift <= F.col("total")))
        support = materialise(ok.select("item", "n"), "support")
        members = members.join(support.select("item"), "item", "left_semi")
    c, a, b, n = (F.col(x).cast("double") for x in ("c", "a", "b", "n"))
    got = _scored(together(members).where(F.col("c") >= min_together), support, n_records).where(c * n >= min_lift * a * b)
    return got.select("file_a", "file_b", "c", "a", "b", "n", (c * n / (a * b)).alias("lift"), log_likelihood(c, a, b, n).alias("llr"))


def significant(files_index: DataFrame, checkpoints: DataFrame, least: float = SIGNIFICANT) -> DataFrame:
    """The pairs that occur together more often than chance with a log-likelihood ratio of at least *least*."""
    return pairs(files_index, checkpoints).where((F.col("llr") >= least) & (F.col("lift") > 1))


def cache_differences(files_index: DataFrame, checkpoints: DataFrame, cached: DataFrame) -> DataFrame:
    """(file_a, file_b, cached, counted, problem) where the cached counts are wrong.

    The cache leaves out pairs seen once, so a pair counted once and not cached is in
    order. 'missing': not cached; 'extra': cached but never together; 'turned': cached
    with file_a > file_b; 'stale': too low; 'too high'. Repeated cache rows fold into
    one by their largest count.
    """
    lo, hi = F.least("file_a", "file_b"), F.greatest("file_a", "file_b")
    kept = (
        cached.where("file_a is not null and file_b is not null")
        .select(lo.alias("file_a"), hi.alias("file_b"), F.col("count").cast("long").alias("cached"), (F.col("file_a") > F.col("file_b")).alias("turned"))
        .groupBy("file_a", "file_b")
        .agg(F.max("cached").alias("cached"), F.max("turned").alias("turned"))
    )
    counted = together(materialise(memberships(files_index), "members")).withColumnRenamed("c", "counted")
    both = counted.join(kept, ["file_a", "file_b"], "full").where("cached is not null or counted > 1")
    problem = (
        F.when(F.col("cached").isNull(), "missing")
        .when(F.col("counted").isNull(), "extra")
        .when(F.col("turned"), "turned")
        .when(F.col("cached") < F.col("counted"), "stale")
        .when(F.col("cached") > F.col("counted"), "too high")
    )
    return both.withColumn("problem", problem).where("problem is not null").select("file_a", "file_b", "cached", "counted", "problem")


def found(files_index: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Pairs together in at least 5 records and at least 3 times as often as chance."""
    return pairs(files_index, checkpoints, MIN_TOGETHER, MIN_LIFT).select("file_a", "file_b")
