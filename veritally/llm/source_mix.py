"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

1. `targets`: sources in code point order (NULL last) weigh 5, 2, 1, repeating, and share 150 % of
   all words. A source stops at twice its size and its excess goes to the others by weight. That
   has a closed form: with the sources sorted by cap per weight, those before the first one that
   its share does not fill are full, and the rest share what is left.
2. `quotas`: the mix is a row of blocks of `BLOCK` words, cut into shards of equal size (`SHARD_BLOCKS`
   blocks, or more where that would be over `SHARDS` shards). Seat by seat, the highest quotient
   target / (2 seats + 1) gets the next block, so the seats at the end of each shard give an integer
   quota per shard and source. Only the few seats that a divisor leaves open are ranked: of n
   sources, at most 3 n quotients per shard, however many blocks.
3. `selection`: the documents of a source stand in the order of a seeded digest of their id, and
   their words are cut into blocks in that order. Every shard draws on its own equal stretch of
   these blocks: the blocks of its quota run around the stretch from a place given by the seed,
   the source and the shard. A quota above twice its stretch leaves the excess to the next shard.
4. `mix`: a document's words lie between two places of its source; what the shards take before each
   of the two is looked up by shard, and the difference is taken from the document. Words are
   counted through in two levels (digest prefix, then within it), so no task holds a source.

Defined results: a NULL or empty text has size 0 and is taken 0 times its words; a NULL source is
a source of its own; NULL ids share a digest and are ordered by size; repeated rows are separate
rows; columns other than doc_id, text and source are ignored; an empty table gives an empty mix.
Whole words are counted over whole texts. The same table and seed give the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritally.session import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix per word of input
CAP = 2  # times that a document may be taken
BLOCK = 16  # words in a block
SHARD_BLOCKS = 1 << 12  # blocks in a shard of the mix, or more
SHARDS = 1 << 10  # shards of the mix at most
SEED = "mix-1"


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, and what the later steps group and order by."""
    return docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")).alias("skey"),  # "t": after all others
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("order_key"),
    ).withColumn("cell", F.substring("order_key", 1, 3))


def targets(cells: DataFrame) -> DataFrame:
    """skey, source_size, weight, place and target per source, from rows of skey and size."""
    by_source = cells.groupBy("skey").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))  # one row per source
    ranked = by_source.select(
        "skey", "source_size", (F.row_number().over(everything.orderBy("skey")) - 1).alias("place"),
        (F.lit(SHARE) * F.sum("source_size").over(everything)).alias("total"),
    ).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int")))
    by_need = everything.orderBy(F.col("cap") / F.col("weight"), "place")
    filled = (
        ranked.withColumn("cap", (CAP * F.col("source_size")).cast("double"))
        .withColumn("nth", F.row_number().over(by_need))
        .withColumn("used", F.sum("cap").over(by_need.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("open_weight", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("used")) / F.col("open_weight"))
        .withColumn("short", F.col("cap") > F.col("level") * F.col("weight"))
        .withColumn("stop", F.min(F.when(F.col("short"), F.struct("nth", "level"))).over(everything))
    )
    open_ = F.col("stop").isNotNull() & (F.col("nth") >= F.col("stop.nth"))
    return filled.select(
        "skey", "source_size", "weight", "place",
        F.when(open_, F.col("stop.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"),
    )


def quotas(by_source: DataFrame, shard_blocks: int = SHARD_BLOCKS, shards: int = SHARDS) -> DataFrame:
    """skey, shard, shards, quota and seats (of this and all earlier shards): blocks of each source in
    each shard of the mix."""
    # In a fixed order: a sum of doubles must not change between runs.
    everything = Window.partitionBy(F.lit(0)).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    votes = by_source.where(F.col("target") > 0).select(
        "skey", "place", "target", F.sum("target").over(everything).alias("votes"), F.count(F.lit(1)).over(everything).alias("n")
    ).withColumn("blocks", F.round(F.col("votes") / BLOCK).cast("long"))
    counted = votes.where(F.col("blocks") > 0).withColumn(
        "shards", F.least(F.ceil(F.col("blocks") / F.lit(shard_blocks)), F.lit(shards)).cast("long")
    )
    houses = counted.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
    ).withColumn("house", F.expr("(shard + 1) * blocks DIV shards"))
    seats = lambda divided: F.floor(F.col("target") * divided / F.col("votes") + F.lit(0.5)).cast("long")
    # At votes / (house - n) as divisor, at most `house` seats are given; at votes / (house + n), at least.
    bounds = houses.withColumn("low", F.when(F.col("house") > F.col("n"), seats(F.col("house") - F.col("n"))).otherwise(F.lit(0).cast("long")))
    bounds = bounds.withColumn("high", F.greatest(F.col("low"), seats(F.col("house") + F.col("n"))))
    shard = Window.partitionBy("shard")
    bounds = bounds.withColumn("open_seats", F.col("house") - F.sum("low").over(shard))
    ranked = bounds.where(F.col("high") > F.col("low")).select(
        "skey", "shard", "place", "open_seats", "target", F.explode(F.sequence("low", F.col("high") - 1)).alias("seat")
    ).withColumn("nth", F.row_number().over(shard.orderBy((F.col("target") / (2 * F.col("seat") + 1)).desc(), "place")))
    won = ranked.where(F.col("nth") <= F.col("open_seats")).groupBy("skey", "shard").agg(F.count(F.lit(1)).alias("won"))
    at = bounds.select("skey", "shard", "shards", "low").join(won, ["skey", "shard"], "left").select(
        "skey", "shard", "shards", (F.col("low") + F.coalesce("won", F.lit(0))).alias("seats")
    )
    before = F.lag("seats", 1, 0).over(Window.partitionBy("skey").orderBy("shard"))
    return at.select("skey", "shard", "shards", (F.col("seats") - before).alias("quota"), "seats")


def _around(size: Column) -> Column:
    """Blocks of a source."""
    return F.greatest(F.ceil(size / F.lit(BLOCK)).cast("long"), F.lit(1).cast("long"))


def selection(by_source: DataFrame, shares: DataFrame, seed: str = SEED) -> DataFrame:
    """What each shard takes of its stretch of a source, in words: skey, shard, `begin` of the stretch,
    `before` (taken by earlier shards), `rounds` of the whole stretch, and once more what lies in
    [low, high) and below `wrap`, counted from `begin`. A source has at most `SHARDS` rows."""
    in_order = Window.partitionBy("skey").orderBy("shard")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    stretch = shares.join(by_source.select("skey", _around(F.col("source_size")).alias("around")), "skey").select(
        "skey", "shard", "seats", F.expr("shard * around DIV shards").alias("first"), F.expr("(shard + 1) * around DIV shards").alias("end"),
    )
    # A queue: seats wait while they are more than the stretches so far can give.
    room = CAP * F.col("end")
    given = stretch.withColumn("given", room + F.least(F.lit(0), F.min(F.col("seats") - room).over(so_far)))
    given = given.withColumn("given_before", F.lag("given", 1, 0).over(in_order))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("skey"), F.lit(":"), F.col("shard").cast("string")))
    taken = given.select(
        "skey", "shard", "first", "given_before", (F.col("end") - F.col("first")).alias("length"), (F.col("given") - F.col("given_before")).alias("blocks"),
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("drawn"),
    ).where("length > 0")
    start, rest = F.col("drawn") % F.col("length"), F.col("blocks") % F.col("length")
    return taken.select(
        "skey", "shard", (BLOCK * F.col("first")).alias("begin"), (BLOCK * F.col("given_before")).alias("before"),
        F.expr("blocks DIV length").alias("rounds"), (BLOCK * start).alias("low"), (BLOCK * F.least(start + rest, F.col("length"))).alias("high"),
        (BLOCK * F.greatest(start + rest - F.col("length"), F.lit(0))).alias("wrap"),
    )


def _shard_of(place: Column) -> Column:
    """The shard on whose stretch a place of a source lies; the end of a source is on the last."""
    block = F.least(F.floor(place / F.lit(BLOCK)).cast("long"), F.col("around") - 1)
    return F.floor(((block + 1) * F.col("shards") - 1) / F.col("around")).cast("long")


def _taken_before(place: Column, name: str) -> Column:
    """Words that the mix takes before a place, given the row of its shard."""
    part = lambda c: F.col(f"{name}.{c}")
    x = place - part("begin")
    more = F.greatest(F.least(x, part("high")) - part("low"), F.lit(0)) + F.least(x, part("wrap"))
    return part("before") + part("rounds") * x + more


def mix(docs: DataFrame, seed: str = SEED, shard_blocks: int = SHARD_BLOCKS, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of `docs`."""
    rows = checkpointed(sized(docs, seed))  # the texts are read once
    cells = rows.groupBy("skey", "cell").agg(F.sum("size").alias("size"))
    by_source = checkpointed(targets(cells))
    shares = quotas(by_source, shard_blocks, shards)
    chosen = checkpointed(selection(by_source, shares, seed))
    n_shards = shares.groupBy("skey").agg(F.first("shards").alias("shards"))
    in_order = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    plan = (
        cells.select("skey", "cell", (F.sum("size").over(in_order) - F.col("size")).alias("cell_start"))
        .join(by_source.join(n_shards, "skey", "left"), "skey")
        .select("skey", "cell", "cell_start", "source_size", "target", "shards", _around(F.col("source_size")).alias("around"))
    )
    within = Window.partitionBy("skey", "cell").orderBy("order_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end_in_cell", F.sum("size").over(within)).join(plan, ["skey", "cell"])
    placed = placed.withColumn("end", F.col("cell_start") + F.col("end_in_cell")).withColumn("start", F.col("end") - F.col("size"))
    for name in ("start", "end"):
        found = chosen.select(F.col("skey").alias("_skey"), F.col("shard").alias("_shard"), F.struct(*[c for c in chosen.columns if c not in ("skey", "shard")]).alias(f"at_{name}"))
        placed = placed.join(found, (F.col("skey") == F.col("_skey")) & (_shard_of(F.col(name)) == F.col("_shard")), "left").drop("_skey", "_shard")
    taken = _taken_before(F.col("end"), "at_end") - _taken_before(F.col("start"), "at_start")
    return placed.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0).cast("long")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"))


def oracle(documents: str = "documents") -> str:
    """DuckDB text of `mix` over a documents relation."""
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key
  FROM {documents}),
s AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY skey) - 1 AS place,
         {SHARE} * CAST(sum(sum(size)) OVER () AS DOUBLE) AS total
  FROM d GROUP BY skey),
w AS (
  SELECT *, CAST(([5, 2, 1])[CAST(place % 3 AS INT) + 1] AS DOUBLE) AS weight, CAST({CAP} * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS nth,
         (total - (sum(cap) OVER (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING) - cap))
         / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
stop AS (SELECT min(nth) AS nth, arg_min(level, nth) AS level FROM l WHERE cap > level * weight),
t AS (
  SELECT l.skey, l.place, l.source_size,
         CASE WHEN l.nth >= stop.nth THEN stop.level * l.weight ELSE l.cap END AS target
  FROM l LEFT JOIN stop ON true),
v AS (
  SELECT *, sum(target) OVER () AS votes, count(*) OVER () AS n,
         CAST(round(sum(target) OVER () / {BLOCK}) AS BIGINT) AS blocks
  FROM t WHERE target > 0),
c AS (SELECT *, least((blocks + {SHARD_BLOCKS} - 1) // {SHARD_BLOCKS}, {SHARDS}) AS shards FROM v WHERE blocks > 0),
h AS (SELECT *, (shard + 1) * blocks // shards AS house FROM (SELECT *, unnest(range(shards)) AS shard FROM c)),
b AS (
  SELECT *, CASE WHEN house > n THEN CAST(floor(target * (house - n) / votes + 0.5) AS BIGINT) ELSE 0 END AS low,
         CAST(floor(target * (house + n) / votes + 0.5) AS BIGINT) AS high FROM h),
q AS (
  SELECT skey, shard, place, target, unnest(range(low, high)) AS seat FROM b),
o AS (SELECT shard, max(house) - sum(low) AS open_seats FROM b GROUP BY shard),
won AS (
  SELECT skey, shard, count(*) AS won FROM (
    SELECT skey, shard, row_number() OVER (PARTITION BY shard ORDER BY target / (2 * seat + 1) DESC, place) AS nth FROM q)
  JOIN o USING (shard) WHERE nth <= open_seats GROUP BY skey, shard),
e AS (
  SELECT b.skey, b.shard, b.shards, b.low + coalesce(won.won, 0) AS seats,
         greatest((b.source_size + {BLOCK} - 1) // {BLOCK}, 1) AS around,
         b.shard * around // b.shards AS first, (b.shard + 1) * around // b.shards AS stop
  FROM b LEFT JOIN won USING (skey, shard)),
g AS (
  SELECT *, {CAP} * stop + least(0, min(seats - {CAP} * stop) OVER (PARTITION BY skey ORDER BY shard)) AS given FROM e),
k AS (
  SELECT skey, shard, first, stop - first AS length, coalesce(lag(given) OVER (PARTITION BY skey ORDER BY shard), 0) AS given_before,
         given - given_before AS taken_blocks,
         CAST('0x' || substr(md5('{SEED}:' || skey || ':' || shard), 1, 8) AS BIGINT) AS drawn
  FROM g),
z AS (  -- the blocks that a shard takes once more than the others of its stretch
  SELECT skey, shard, first, length, taken_blocks // length AS rounds, drawn % length AS start, taken_blocks % length AS rest
  FROM k WHERE length > 0),
x AS (
  SELECT doc_id, skey, size, sum(size) OVER (PARTITION BY skey ORDER BY order_key, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d),
y AS (SELECT *, row_number() OVER () AS rid FROM x),
taken AS (
  SELECT rid, sum(rounds * greatest(0, least(y.start + size, {BLOCK} * (first + length)) - greatest(y.start, {BLOCK} * first))
           + greatest(0, least(y.start + size, {BLOCK} * (first + least(z.start + rest, length))) - greatest(y.start, {BLOCK} * (first + z.start)))
           + greatest(0, least(y.start + size, {BLOCK} * (first + greatest(z.start + rest - length, 0))) - greatest(y.start, {BLOCK} * first))) AS taken
  FROM y JOIN z ON y.skey = z.skey AND y.start < {BLOCK} * (first + length) AND y.start + size > {BLOCK} * first GROUP BY rid)
SELECT y.doc_id, y.size, t.source_size, t.target, CAST(coalesce(taken.taken, 0) AS BIGINT) AS taken
FROM y JOIN t USING (skey) LEFT JOIN taken USING (rid)"""


ORACLE_SQL = oracle()
