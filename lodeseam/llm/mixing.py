"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of words.  The blocks of a source are put in a random order by hash; a source's target is
met by whole passes over its blocks and one partial pass over the head of that order, the last block cut to the word.
How many draws of each source an output shard gets is decided before any block moves: a binary tree splits the exact
draw counts among shards, each split a multivariate hypergeometric sample (one hypergeometric after another, by inverse
transform from the mode).  A shard then owns a run of each source's permuted draws, so shards are disjoint, and orders
its draws by hash.  Everything is hash-seeded: reruns agree.

Order within a source is found by bucketing hashes: bucket totals, a window over the buckets, and a window inside each
bucket, so no task ever holds a source.  Tables with a row per source are broadcast only after their size is checked.

The tree has one row per node with a count per source, and the targets are found over one row per source: both fit a task
for as long as sources do (eight bytes each), however many documents they have.

Defined cases: a null text has size 0 and is never drawn, though reported; a null source is a source of its own, last;
null and repeated ids and repeated rows are rows of their own; a very long text is many blocks; ties in hash are broken by
id, block and row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

BLOCK_WORDS = 256
WHOLE = 1 << 40
#: Hash buckets of a source: a power of two that keeps about BUCKET_BLOCKS blocks in a bucket, and this many bits at least.
BUCKET_BITS = 10
BUCKET_BLOCKS = 50_000
SHARDS = 16
WEIGHTS = (3, 1, 2)
SEED = 20260
#: Tables with a row per source are broadcast up to this many rows; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Keeps code point order, with null after every string."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def _by_source(rows: DataFrame, small: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_SOURCES else small, "source_key")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150) -> DataFrame:
    """``totals``: source_key, source_size.  Adds weight and target.

    Targets share ``percent`` of all sizes by weight; none exceeds twice its source's size, and what is cut off is shared
    again.  Sources in order of size by weight reach that limit one after another, so running sums find who does.  The
    windows run over one row per source.
    """
    share = percent * 2  # in hundredths of half a word
    everything, by_name = Window.partitionBy(), Window.orderBy("source_key")
    ranked = totals.select(
        "source_key",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long").alias("weight"),
        F.sum("source_size").over(everything).alias("all"),
    )
    cap, before = 2 * F.col("source_size"), Window.orderBy(F.col("source_size") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        cap.alias("cap"),
        (share * F.col("all") - 200 * F.coalesce(F.sum(cap).over(before), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights_left"),
    )
    full = F.col("cap") * 200 * F.col("weights_left") <= F.col("weight") * F.col("left")
    marked = filled.withColumn("full", full)
    first_open = F.min(F.when(~F.col("full"), F.struct(F.col("left") * -1, "left", "weights_left"))).over(everything)
    # the first source below its limit has the least capped before it, hence the largest remainder
    return marked.withColumn("open", first_open).select(
        "source_key",
        "source_size",
        "weight",
        F.when(F.col("full"), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * F.col("open.left")).cast("double") / (200 * F.col("open.weights_left")).cast("double"))
        .alias("target"),
    )


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric_sql(good: str, total: str, drawn: str, u: str) -> str:
    """How many of ``drawn`` items are good when ``good`` of ``total`` are, at the uniform number ``u``, as a SQL expression.

    The inverse transform walks up from the mode and then down from it; weights relative to the mode cannot underflow.
    Beyond twelve standard deviations from the mode nothing is ever drawn.
    """
    up_ratio = "(q.c - x) * (q.m - x) / ((x + 1D) * (q.n - q.c - q.m + x + 1D))"
    down_ratio = "x * (q.n - q.c - q.m + x) / ((q.c - x + 1D) * (q.m - x + 1D))"
    up, down = "sequence(s.mode, s.top)", "if(s.mode > s.bottom, sequence(s.mode, s.bottom + 1, -1L), cast(array() as array<bigint>))"
    weight_up = f"aggregate({up}, named_struct('r', 1D, 't', 0D), (a, x) -> named_struct('r', a.r * {up_ratio}, 't', a.t + a.r), a -> a.t)"
    weight_down = f"aggregate({down}, named_struct('r', 1D, 't', 0D), (a, x) -> named_struct('r', a.r * {down_ratio}, 't', a.t + a.r * {down_ratio}), a -> a.t)"
    pick_up = (
        f"aggregate({up}, named_struct('r', 1D, 't', 0D, 'x', -1L), (a, x) -> named_struct('r', a.r * {up_ratio}, 't', a.t + a.r,"
        " 'x', if(a.x < 0 and z.at < a.t + a.r, x, a.x)), a -> if(a.x < 0, s.top, a.x))"
    )
    pick_down = (
        f"aggregate({down}, named_struct('r', 1D, 't', 0D, 'x', -1L), (a, x) -> named_struct('r', a.r * {down_ratio}, 't', a.t + a.r * {down_ratio},"
        f" 'x', if(a.x < 0 and z.at - z.up < a.t + a.r * {down_ratio}, x - 1, a.x)), a -> if(a.x < 0, s.bottom, a.x))"
    )
    spread = "sqrt(q.m * (q.c / greatest(q.n, 1D)) * (1 - q.c / greatest(q.n, 1D)) * (q.n - q.m) / greatest(q.n - 1, 1D))"
    args = f"named_struct('c', cast({good} as double), 'n', cast({total} as double), 'm', cast({drawn} as double), 'u', {u})"
    shape = "named_struct('mode', cast(floor((q.c + 1) * (q.m + 1) / (q.n + 2)) as bigint), 'lo', cast(greatest(0D, q.m - (q.n - q.c)) as bigint)," f" 'hi', cast(least(q.c, q.m) as bigint), 'w', cast(ceil(12 * {spread}) as bigint) + 30)"
    clip = "named_struct('mode', least(greatest(b.mode, b.lo), b.hi), 'top', least(b.hi, b.mode + b.w), 'bottom', greatest(b.lo, b.mode - b.w))"
    sums = _let(f"named_struct('up', {weight_up}, 'down', {weight_down})", "y", "named_struct('up', y.up, 'at', q.u * (y.up + y.down))")
    pick = f"if(z.at < z.up, {pick_up}, {pick_down})"
    return _let(args, "q", _let(shape, "b", _let(clip, "s", _let(sums, "z", pick))))


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``quotas``: source_key, draws.  Returns source_key, cuts: the running totals of its draws over the shards.

    One row per tree node, holding an array with a count per source; ``shards`` is a power of two.
    """
    levels = shards.bit_length() - 1
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("source_key", "draws"))).alias("s")).select(
        F.lit(0).alias("node"), F.col("s.source_key").alias("keys"), F.col("s.draws").alias("counts")
    )
    for level in range(levels):
        uniform = f"(pmod(xxhash64({seed}, {level}, node, a.i), 9007199254740992) + 0.5D) / 9007199254740992D"
        take = hypergeometric_sql("c", "a.n", "a.m", uniform)
        total = "aggregate(counts, 0L, (t, c) -> t + c)"
        left = (
            f"aggregate(counts, named_struct('i', 0, 'n', {total}, 'm', {total} div 2, 'out', cast(array() as array<bigint>)), "
            f"(a, c) -> {_let(take, 'k', 'named_struct(' + repr('i') + ', a.i + 1, ' + repr('n') + ', a.n - c, ' + repr('m') + ', a.m - k, ' + repr('out') + ', concat(a.out, array(k)))')}, a -> a.out)"
        )
        halves = nodes.select("node", "keys", "counts", F.expr(left).alias("half"))
        nodes = halves.select(
            "keys",
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("half").alias("counts")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("counts", "half", lambda a, b: a - b).alias("counts")),
                )
            ).alias("x"),
        ).select("x.node", "keys", "x.counts")
    cells = nodes.select("node", F.explode(F.arrays_zip("keys", "counts")).alias("c")).select("node", F.col("c.keys").alias("source_key"), F.col("c.counts").alias("draws"))
    upto = Window.partitionBy("source_key").orderBy("node")
    cells = cells.withColumn("upto", F.sum("draws").over(upto))
    return cells.groupBy("source_key").agg(F.sort_array(F.collect_list(F.struct("node", "upto"))).alias("c")).select("source_key", F.col("c.upto").alias("cuts"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = 150,
    shards: int = SHARDS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
    whole_blocks: bool = False,
    key: str | None = None,
) -> DataFrame:
    """One row for each draw, and one with a null shard for each block that is never drawn.

    Columns: row_key, doc_id, source, source_size, target, block, words (of the block), repeat (0 first), taken (words of
    this draw), shard, place (order within the shard).  ``whole_blocks`` takes the last block wholly or not at all,
    whichever is nearer to the target; with ``block_words=WHOLE`` blocks are documents.  ``key`` names a column that tells
    the rows of ``docs`` apart; without one rows are numbered as they are read.  Texts enter the hash, so that rows that
    share an id, or have none, get orders of their own.
    """
    row_key = F.col(key) if key else F.monotonically_increasing_id()
    sizes = docs.select(row_key.alias("row_key"), "doc_id", "source", _source_key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("salt"))
    sizes = materialize(sizes, "mix-sizes")
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(totals, weights, percent), "mix-targets")
    in_blocks = F.greatest(F.ceil(F.col("size") / block_words), F.lit(1)).cast("int")
    count = sizes.agg(F.sum(in_blocks)).first()[0] or 0
    bits = max(BUCKET_BITS, (count // BUCKET_BLOCKS).bit_length())
    blocks = (
        sizes.select(*sizes.columns, F.explode(F.sequence(F.lit(0), in_blocks - 1)).alias("block"))
        .withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block").cast("long") * block_words))
        .withColumn("h", F.xxhash64("doc_id", "block", F.lit(seed), "salt"))
        .withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    )
    per_bucket = blocks.groupBy("source_key", "bucket").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "source_key", "bucket", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("words_ahead"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("blocks_ahead")
    )
    inside = Window.partitionBy("source_key", "bucket").orderBy("h", "doc_id", "block", "words", "row_key")
    ranked = (
        blocks.withColumn("rank", F.row_number().over(inside) - 1)
        .withColumn("sum", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(materialize(offsets, "mix-offsets"), ["source_key", "bucket"])
        .select("row_key", "doc_id", "source", "source_key", "block", "words", "salt", (F.col("rank") + F.col("blocks_ahead")).alias("rank"), (F.col("sum") - F.col("words") + F.col("words_ahead")).alias("before"))
    )
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("int")
    placed = _by_source(ranked, targets).withColumn("passes", passes).withColumn("rest", goal - F.col("passes") * F.col("source_size"))
    drawn = (2 * F.col("before") + F.col("words") <= 2 * F.col("rest")) if whole_blocks else (F.col("before") < F.col("rest"))
    placed = materialize(placed.withColumn("partial", drawn & (F.col("words") > 0)), "mix-blocks")
    # blocks without words sort anywhere in the order, so they count as drawn in whole passes only
    quotas = placed.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("partial"), F.col("rank") + 1)).alias("head"), F.first("passes").alias("passes"))
    quotas = materialize(quotas.select("source_key", "n", (F.col("passes") * F.col("n") + F.coalesce("head", F.lit(0))).alias("draws")), "mix-quotas")
    cuts = materialize(quotas.join(split_quotas(quotas.select("source_key", "draws"), shards, seed), "source_key").select("source_key", "n", "cuts"), "mix-cuts")
    times = F.col("passes") + F.col("partial").cast("int")
    repeats = F.when(times > 0, F.sequence(F.lit(0), times - 1))
    taken = F.col("words") if whole_blocks else F.when(F.col("repeat") < F.col("passes"), F.col("words")).otherwise(F.least("words", F.col("rest") - F.col("before")))
    position = F.col("repeat") * F.col("n") + F.col("rank")
    return (
        _by_source(placed, cuts)
        .withColumn("repeat", F.explode_outer(repeats))
        .select(
            "row_key",
            "doc_id",
            "source",
            "source_size",
            "target",
            "block",
            "words",
            "repeat",
            F.when(F.col("repeat").isNotNull(), taken).otherwise(0).cast("long").alias("taken"),
            F.when(F.col("repeat").isNotNull(), F.size(F.filter("cuts", lambda c: c <= position))).alias("shard"),
            F.xxhash64("doc_id", "block", "repeat", F.lit(seed + 1), "salt").alias("place"),
        )
    )


def write_shards(draws: DataFrame, path: str, files: int = 1) -> None:
    """The mix as files: a folder per shard, its draws shuffled and dealt over ``files`` files, so that a shard can be as many tasks."""
    drawn = draws.where("shard is not null")
    drawn.repartition(SHARDS * files, "shard", F.pmod(F.col("place"), F.lit(files))).sortWithinPartitions("shard", "place").write.partitionBy("shard").parquet(path)


def per_document(draws: DataFrame) -> DataFrame:
    """One row per row of the documents: size, source_size, target, taken (words over all shards), draws, shards, first_shard, first_place.

    Draws are summed by shard first, so ``taken`` is what the shards hold.
    """
    once = F.coalesce(F.col("repeat"), F.lit(0)) == 0
    by_shard = draws.groupBy("row_key", "doc_id", "shard").agg(
        F.sum(F.when(once, F.col("words")).otherwise(0)).alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum("taken").alias("taken"),
        F.count("repeat").alias("draws"),
        F.min("place").alias("place"),
    )
    first = F.min(F.when(F.col("shard").isNotNull(), F.struct("shard", "place")))
    return by_shard.groupBy("row_key", "doc_id").agg(
        F.sum("size").alias("size"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum(F.when(F.col("shard").isNotNull(), F.col("taken")).otherwise(0)).alias("taken"),
        F.sum("draws").alias("draws"),
        F.array_join(F.sort_array(F.collect_set("shard")), ",").alias("shards"),
        first["shard"].alias("first_shard"),
        first["place"].alias("first_place"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_document(mix(table(spark, sf_dir, "documents"))).drop("row_key")
