"""Mixing sources to target weights by a low-discrepancy schedule (operator 4).

Slot k of the schedule is the point frac(k * golden ratio) on the unit
interval; the source whose share of the cumulative targets holds the point fills
the slot. The r-th slot of a source takes the r-th block of ``block_words`` words
of that source's documents, shuffled by a hash and read at most twice. So any
stretch of the schedule holds the sources in their target shares. Each source's last
block ends at its target, rounded to whole words, and the few blocks that the schedule's points leave out stand
behind its end, so every source, however small, gives the words that its target asks for.

No step gathers a source: running totals go over (source, hash bucket) first and
over the bucket sums second, ranks over (source, stretch of slots) likewise, and
blocks meet slots on (source, block). Only the table with one row per source is
ordered as a whole.

Rows: null text has size 0, is never taken, and keeps its row; a null source is a
source of its own, last in the order; a null doc_id is a key like any other;
repeated rows are documents of their own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from decimal import Decimal, getcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import common

WEIGHTS = (5, 2, 1)
CELLS = 1024
STRETCH = 1 << 14
HIGH = 1 << 21

getcontext().prec = 50
_PHI = (Decimal(5).sqrt() - 1) / 2
#: frac(golden ratio) and frac(HIGH * golden ratio): two factors keep 31 bits of the point for slots up to 2**42
STEP_LOW, STEP_HIGH = float(_PHI), float(_PHI * HIGH % 1)


def sizes(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """_row (new numbers unless given), doc_id, source, size (words) and _key, the place in the shuffled order."""
    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(
        row.alias("_row"), "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(common.WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_key"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """One row per source: ord, source, source_size, target.

    A target is min(most * size, level * weight) with the one level at which the
    targets add up to ``share`` of all sizes. Sources in the order of
    most * size / weight stop at their cap as long as the level still exceeds it.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = per.withColumn("ord", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumns({"cap": F.col("source_size") * F.lit(most),
                                 "total": F.sum("source_size").over(every) * F.lit(share)})
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "ord")
    before, behind = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    full = (F.coalesce(F.sum("cap").over(before), F.lit(0.0))
            + F.col("cap") / F.col("w") * F.sum("w").over(behind)) <= F.col("total")
    marked = ranked.withColumn("full", full)
    level = ((F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0)))
             / F.sum(F.when(~F.col("full"), F.col("w"))).over(every))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(level * F.col("w"), F.col("cap")))
    return marked.select("ord", "source", "source_size", target.alias("target"))


def point(k: Column) -> Column:
    """frac(k * golden ratio)."""
    u = F.floor(k / F.lit(HIGH)) * F.lit(STEP_HIGH) + (k % F.lit(HIGH)) * F.lit(STEP_LOW)
    return u - F.floor(u)


def schedule(targets: DataFrame, n_slots: int) -> DataFrame:
    """slot, ord, rank: which source fills each slot, and its how-many-th slot it is."""
    upto = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy())
    part = targets.where("target > 0").select("ord", (F.sum("target").over(upto) / total).alias("hi"))
    part = part.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("ord")), F.lit(0.0)))
    part = part.withColumn("hi", F.when(F.col("ord") == F.max("ord").over(Window.partitionBy()), 1.0)
                           .otherwise(F.col("hi")))
    # a point is compared only with the sources that reach into its cell of the unit interval
    cells = part.select("ord", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    slots = targets.sparkSession.range(n_slots).select(
        F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = slots.join(cells, "cell").where("u >= lo and u < hi").select(
        "slot", "ord", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    held = drawn.groupBy("ord", "stretch").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("ord").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("ord", "stretch", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("ord", "stretch").orderBy("slot")) - 1
    return drawn.withColumn("inside", inside).join(held, ["ord", "stretch"]).select(
        "slot", "ord", (F.col("before") + F.col("inside")).alias("rank"))


def filled(slots: DataFrame, targets: DataFrame, n_slots: int, block_words: int) -> DataFrame:
    """The slots of blocks that targets ask for; blocks that no slot fills follow behind slot ``n_slots``."""
    needs = targets.select("ord", F.ceil(F.round("target") / block_words).alias("need"))
    used = slots.join(needs, "ord").where("rank < need").drop("need")
    held = used.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    short = needs.join(held, "ord", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n < need")
    late = short.select("ord", "n", F.explode(F.sequence("n", F.col("need") - 1)).alias("rank"))
    return used.select("slot", "ord", "rank").union(
        late.select((F.lit(n_slots) + F.col("rank") - F.col("n")).alias("slot"), "ord", "rank"))


def blocks(sized: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """ord, rank, _row, at, words: the parts of documents that make up each block of a source up to its target, in two rounds."""
    bucket = F.substring("_key", 1, 3)
    in_order = Window.partitionBy("source", "bucket").orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.where("size > 0").select("_row", "source", "size", "_key", bucket.alias("bucket"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"),
                       F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(in_order), F.lit(0)))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    known = targets.select("ord", F.col("source").alias("_t"), "source_size", F.round("target").cast("bigint").alias("upto"))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("_t"))).select(
        "ord", "_row", "size", "source_size", "upto", (F.col("before") + F.col("inside")).alias("from"))
    twice = placed.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "from", F.col("from") + F.col("round") * F.col("source_size")).where("from < upto").withColumn(
        "to", F.least(F.col("from") + F.col("size"), "upto"))
    b = F.lit(block_words)
    each = twice.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / b), F.floor((F.col("to") - 1) / b))))
    start = F.greatest("from", F.col("rank") * b)
    return each.select("ord", "rank", "_row", "round", (start - F.col("from")).alias("at"),
                       (F.least(F.col("to"), (F.col("rank") + 1) * b) - start).alias("words"))


def mix(docs: DataFrame, block_words: int = 64, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
        most: float = 2.0, row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized documents, one row per source, mix). The mix has, for each slot and each
    document part in its block: slot, ord, _row, round, at (first word), words."""
    sized = common.stored(sizes(docs, row), "mix-sizes")
    targets = common.stored(source_targets(sized, weights, share, most), "mix-sources")
    wanted = targets.agg(F.sum("target").alias("t")).first()["t"] or 0.0
    n_slots = math.ceil(wanted / block_words)
    slots = filled(schedule(targets, n_slots), targets, n_slots, block_words)
    drawn = slots.join(blocks(sized, targets, block_words), ["ord", "rank"])
    return sized, targets, drawn.select("slot", "ord", "_row", "round", "at", "words")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: _row, doc_id, source, size, source_size, target, taken."""
    sized, targets, drawn = mix(docs, **options)
    taken = drawn.groupBy("_row").agg(F.sum("words").alias("taken"))
    known = targets.select(F.col("source").alias("_t"), "source_size", "target")
    return sized.join(taken, "_row", "left").join(known, F.col("source").eqNullSafe(F.col("_t"))).select(
        "_row", "doc_id", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it stands."""
    parts = F.split(text, rf"(?<={common.SPACE[:-1]})(?={common.WORD[:-1]})")  # a word and the space behind it
    lead = text.rlike(f"^{common.SPACE}").cast("int")
    return F.regexp_replace(F.array_join(F.slice(parts, F.lit(1), n + lead), ""), rf"{common.SPACE}+\z", "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with their own columns: a document once per round that
    takes it; the one document of a source at which its last round ends keeps its
    first words only, as many as are taken. The rows of each partition, which are a random
    part of the mix, stand in the order of the schedule."""
    rows = common.nested(docs, "mix-rows")
    sized, _, drawn = mix(rows.select("key", "doc.doc_id", "doc.source", "doc.text"), row=F.col("key"), **options)
    rounds = drawn.groupBy("_row", "round").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    taken = rounds.join(sized.select("_row", "size"), "_row").select(
        F.col("_row").alias("key"), "words", "slot", (F.col("words") < F.col("size")).alias("cut"))
    whole = rows.join(common.stored(taken, "mix-taken"), "key").sortWithinPartitions("slot")
    text = F.when(F.col("cut"), first_words(F.col("doc.text"), F.col("words").cast("int"))).otherwise(F.col("doc.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed["n_chars"] = F.when(F.col("cut"), F.length(text).cast(kind)).otherwise(F.col("doc.n_chars"))
    return common.unnested(whole, docs, **changed)


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken_words(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (
  select row_number() over (order by doc_id) - 1 as r, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as k
  from documents),
s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as ord
  from d group by source),
s1 as (
  select *, [5.0::double, 2.0::double, 1.0::double][1 + ord % 3] as w, source_size * 2.0::double as cap,
         sum(source_size) over () * 1.5::double as total from s),
s2 as (
  select *, coalesce(sum(cap) over (order by cap / w, ord rows between unbounded preceding and 1 preceding), 0)
            + cap / w * sum(w) over (order by cap / w, ord rows between current row and unbounded following)
            <= total as is_full from s1),
t as (
  select ord, source, source_size,
         case when is_full then cap else least(cap, w * (total - coalesce(sum(cap) filter (is_full) over (), 0))
              / sum(w) filter (not is_full) over ()) end as target from s2),
f as (
  select d.*, t.source_size, t.target, round(t.target) as upto,
         sum(size) over (partition by t.ord order by k, r) - size as a
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (greatest(0, least(upto, a + size) - a)
        + greatest(0, least(upto, source_size + a + size) - source_size - a))::bigint as taken
from f"""
