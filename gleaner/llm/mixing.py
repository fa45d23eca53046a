"""Mixing sources to target weights by a low-discrepancy schedule (operator 9).

Each source's documents are shuffled into one stream of words, cut into blocks of equal
length. The schedule has a slot for each block of the whole mix. Slot ``i`` takes the
golden-ratio point ``frac(i * phi)``, in whole numbers; the point falls on a source through
the cumulative targets, and the slot's rank among the source's slots names the block that
fills it. A source gives as many blocks as slots fall on it, which the sequence keeps within
a few blocks of its target; past its stream's end a second pass begins, and what would be
a third is not taken.

Streams are summed in hash buckets, so a hot source does not gather in one task; slots meet
blocks in a join on source and block, of which a hot source has many.

Defined results: a null text has no words; a null source is a source of its own, the last; a
source without words has target 0; repeated rows are rows of their own; an empty table
gives no rows; extra columns are ignored. Rows that are equal in id and text share a place
in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Cuts, told_apart, unused
from gleaner.llm.ranks import buckets_for, group_key, running, shuffle_key

SEED = 23
#: Weights of the sources in code point order, over and over.
WEIGHTS = (3, 1, 2)
#: All targets together, and the most of one target, as parts of the sizes.
BUDGET, MOST = 1.5, 2.0
#: The most words in a block, the least slots of a schedule that has enough words, and the most slots.
BLOCK, LEAST_SLOTS, MOST_SLOTS = 4096, 1 << 16, 1 << 31
#: The golden ratio's fraction and all points, in parts of 2 ** 32.
GOLDEN, ONE = 2654435769, 1 << 32
CHUNK = 4096


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, stratum, source_size) -> the same with ``place``, ``weight`` and ``target``.

    Shares the budget by weight; a target above its limit stops there and its excess is
    shared again. In order of limit / weight, the first source whose equal share fits gives
    the level for all later ones. One row per source goes through these windows.
    """
    given = F.array(*(F.lit(float(w)) for w in weights))
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    placed = placed.withColumn("weight", F.element_at(given, ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    every = Window.partitionBy(F.lit(0))
    placed = placed.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    spent = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    heavy = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    placed = placed.withColumn("level", (F.sum("source_size").over(every) * F.lit(budget) - spent) / heavy)
    fits = F.when(F.col("level") <= F.col("ratio"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return placed.withColumn("target", F.least(F.col("weight") * level, F.col("limit"))).select("source", "stratum", "source_size", "place", "weight", "target")


def sized(docs: DataFrame, cuts: Cuts, seed: int = SEED, key: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None) -> DataFrame:
    """One slim written row per document: row, id, source, stratum, size, h."""
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return cuts.write(docs.select((F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"), F.col(key).alias("id"), F.col(source).alias("source"), group_key(F.col(source)).alias("stratum"), words.alias("size"), shuffle_key(seed, F.col(key), F.col(text)).alias("h")))


def block_of(total: float) -> int:
    """Words in a block of a mix of so many words."""
    whole = int(total)
    return max(1, min(BLOCK, whole // LEAST_SLOTS), -(-whole // MOST_SLOTS))


def schedule(shares: DataFrame, length: int, sources: int, golden: int = GOLDEN) -> DataFrame:
    """(stratum, low, high) in parts of ``ONE`` -> (slot, stratum, rank) of ``length`` slots, ranks from 0."""
    width = max(0, 32 - max(10, (4 * sources).bit_length()))
    cell = lambda c: F.shiftright(c, width)
    points = shares.sparkSession.range(length).select(F.col("id").alias("slot")).withColumn("point", F.expr(f"(slot * {golden}L) & {ONE - 1}L")).withColumn("cell", cell(F.col("point")))
    parts = shares.where("high > low").select("stratum", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))).alias("cell"))
    hit = points.join(parts, "cell").where("point >= low and point < high").select("slot", F.expr(f"slot div {CHUNK}").alias("chunk"), "stratum")
    counts = hit.groupBy("stratum", "chunk").agg(F.count("*").alias("own"))
    earlier = Window.partitionBy("stratum").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("stratum", "chunk", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("stratum", "chunk").orderBy("slot")
    return hit.join(offsets, ["stratum", "chunk"]).select("slot", "stratum", (F.col("offset") + F.row_number().over(inside) - 1).alias("rank"))


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, key: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None, golden: int = GOLDEN) -> tuple[DataFrame, DataFrame]:
    """The mixed documents and the filled schedule.

    Rows are told apart by the column ``row`` if there is one. Documents: row, key, ``size``,
    ``source_size``, ``target``, ``taken`` and ``first_slot``, null where nothing is taken.
    Schedule: ``slot``, ``stratum``, ``rank`` (the block), and the piece of a document in it:
    ``row``, ``lap`` (the pass), ``words``.
    """
    cuts = Cuts(docs.sparkSession, "mixing")
    rows = sized(docs, cuts, seed, key, source, text, row)
    sizes = rows.groupBy("source", "stratum").agg(F.sum("size").alias("source_size"))
    n_rows, words, sources = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("stratum")).first()
    total = words * budget
    block = block_of(total)
    cumulative = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    cut = lambda c: F.floor(c / F.lit(max(total, 1.0)) * F.lit(float(ONE)) + 0.5)
    wanted = targets(sizes, weights, budget, most).withColumn("upto", F.sum("target").over(cumulative))
    before = F.lag("upto", 1, 0.0).over(Window.orderBy("place"))
    shares = cuts.write(wanted.select("stratum", "source_size", "target", cut(before).alias("low"), cut(F.col("upto")).alias("high")))
    slots = cuts.write(schedule(shares, -(-int(total + 0.5) // block), sources, golden))
    own = slots.groupBy("stratum").agg(F.count("*").alias("slots"))
    # the words that a source's slots hold, and no more than its passes have
    take = F.least(F.coalesce("slots", F.lit(0)) * F.lit(block), F.floor(F.col("source_size") * F.lit(most)))
    wanted = cuts.write(shares.join(own, "stratum", "left").select("stratum", "source_size", "target", take.alias("take")))
    placed = running(rows, "stratum", ["id", "size", "row"], buckets_for(n_rows), "size")
    per = placed.join(wanted.select("stratum", "source_size", "take"), "stratum")
    # a document's words in each pass over its source's stream, up to where the source stops
    passes = F.expr("case when size = 0 or take <= before then array() else sequence(0L, (take - before - 1) div source_size) end")
    lap = per.select("row", "stratum", "size", "before", "take", "source_size", F.explode(passes).alias("lap")).select(
        "row", "stratum", "lap", (F.col("lap") * F.col("source_size") + F.col("before")).alias("start"), F.least(F.col("lap") * F.col("source_size") + F.col("before") + F.col("size"), F.col("take")).alias("end")
    )
    pieces = lap.select("row", "stratum", "lap", "start", "end", F.explode(F.expr(f"sequence(start div {block}L, (end - 1) div {block}L)")).alias("rank")).select(
        "row", "stratum", "lap", "rank", (F.least("end", (F.col("rank") + 1) * F.lit(block)) - F.greatest("start", F.col("rank") * F.lit(block))).alias("words")
    )
    filled = pieces.join(slots, ["stratum", "rank"])
    taken = filled.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    mixed = (
        rows.join(wanted.select("stratum", "source_size", "target"), "stratum")
        .join(taken, "row", "left")
        .select("row", F.col("id").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    )
    return mixed, filled


def mixed_documents(docs: DataFrame, key: str = "doc_id", **more) -> DataFrame:
    """The documents that the mix takes, with ``docs``' columns: once for each pass that takes any of their words.

    They come in the order of the schedule: each where its first slot of that pass is.
    Documents without words are never taken. Each row has passes of its own, whatever its key.
    """
    spark = docs.sparkSession
    own, slot, part = unused(docs, "mixed_row", "slot", "part")
    told = told_apart(docs, own, Cuts(spark, "mixed"))
    _, filled = mix(told, key=key, row=own, **more)
    each = Cuts(spark, "laps").write(filled.groupBy("row", "lap").agg(F.min("slot").alias(slot)).select(F.col("row").alias(own), slot))
    last = each.agg(F.max(slot)).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = told.join(each, own).withColumn(part, F.expr(f"cast(`{slot}` * {n}L div {last + 1}L as int)"))
    return out.repartitionById(n, F.col(part)).sortWithinPartitions(slot).drop(own, slot, part)


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs)[0].select("doc_id", "size", "source_size", "target", "taken", "first_slot")


#: The same from the schedule's points and the streams themselves.
ORACLE_SQL = rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS stratum, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents
), sources AS (
  SELECT stratum, source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY stratum, source
), weighted AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((place - 1) % 3 + 1 AS BIGINT)] AS weight, CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS most
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sources)
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT *, least(weight * (SELECT arg_min(level, (most / weight, place)) FROM levels WHERE level <= most / weight), most) AS target FROM levels
), whole AS (
  SELECT *, CAST(floor(total + 0.5) AS BIGINT) AS mixed FROM (SELECT coalesce(sum(source_size), 0) * 1.5::DOUBLE AS total FROM sources)
), sized AS (
  SELECT *, greatest(1, least({BLOCK}, CAST(floor(total) AS BIGINT) // {LEAST_SLOTS}), (CAST(floor(total) AS BIGINT) + {MOST_SLOTS - 1}) // {MOST_SLOTS}) AS block FROM whole
), shares AS (
  SELECT t.*, CAST(floor(earlier / total * {float(ONE)}::DOUBLE + 0.5) AS BIGINT) AS low, CAST(floor(upto / total * {float(ONE)}::DOUBLE + 0.5) AS BIGINT) AS high
  FROM (SELECT *, coalesce(lag(upto) OVER (ORDER BY place), 0.0::DOUBLE) AS earlier FROM (SELECT *, sum(target) OVER (ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM targets)) t, whole
), slots AS (
  SELECT slot, stratum, row_number() OVER (PARTITION BY stratum ORDER BY slot) - 1 AS rank
  FROM (SELECT i AS slot, (i * {GOLDEN}) & {ONE - 1} AS point FROM (SELECT unnest(range((mixed + block - 1) // block)) AS i FROM sized)) JOIN shares ON point >= low AND point < high
), takes AS (
  SELECT shares.*, block, least(coalesce(n, 0) * block, 2 * source_size) AS take FROM shares LEFT JOIN (SELECT stratum, count(*) AS n FROM slots GROUP BY stratum) USING (stratum), sized
), streams AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY stratum ORDER BY h % b, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs, (SELECT greatest(64, (count(*) + 16383) // 16384) AS b FROM documents)
), taken AS (
  SELECT *, CAST(greatest(0, least(before + size, take) - before) + greatest(0, least(source_size + before + size, take) - source_size - before) AS BIGINT) AS taken FROM streams JOIN takes USING (stratum)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM taken LEFT JOIN slots ON slots.stratum = taken.stratum AND slots.rank = taken.before // taken.block
"""
