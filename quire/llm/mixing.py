"""op3: mixing sources to target weights by pivotal dependent rounding, in SQL functions only.

A source's target over its size gives the copies each of its documents should have on average: a
whole part, and a fraction p that must become 0 or 1. Items of one source are put into bands of like size
(classes are powers of two; neighbouring ones are joined up to GROUP items), and each band is dealt
into groups of about GROUP by a hash. Within a group a fold, largest item first, keeps
one open item and meets it with the next: mass (p times the item's words) moves between the two, in either direction with the
probabilities that keep both expectations, until one of them is 0 or 1. So the group's expected
words stay exact but for the one item left open; open items go up a tree of such groups, one level
a round, until a source has at most GROUP, which one last fold brings down to one, as a rule a small
one since it comes last. It is rounded by its own probability.

Every random number is a hash of ids, sizes and the level, so reruns agree. Sources weigh by their
place in code point order, nulls last, from WEIGHTS; targets stop at MOST times the size of the
source, which is the water level at which sum(min(MOST * size, level * weight)) is the total.

Rows that agree in id, source and size are counted, not listed: of n such rows, floor(n * p) get the
further copy for certain, and only what is left over is an item that meets others. So however many rows are
equal, they take their share but for one row's words.

The only tables that lie in one task are per source or per source and size class; both are counts.

Defined cases: null and empty texts have size 0 and take 0 words. Null ids and null sources are
values like others. Of rows that agree in id, source and size but not in their texts, those that come first by a hash of all
columns get the further copies. An empty table gives no rows. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_stored, stored

WEIGHTS = (5, 2, 1)
MOST = 3
#: Items of a group on average; a fold copies its results as it goes, so a group stays small.
GROUP = 128
SEED = 20
#: Longest array of row numbers, and hash buckets among rows that agree in id, source and size.
RUN, BUCKETS = 4096, 64

#: One step of the fold. acc: the open item o (null if none) and the settled items; x: the next item.
_STEP = """
(acc, x) -> transform(
  array(named_struct(
    'up', least((1 - acc.o.p) * acc.o.w, x.p * x.w),
    'down', least(acc.o.p * acc.o.w, (1 - x.p) * x.w))),
  m -> transform(
    array(named_struct(
      'o', named_struct('key', acc.o.key, 'w', acc.o.w, 'h', acc.o.h, 'p', acc.o.p + if(x.u * (m.up + m.down) < m.down, m.up, -m.down) / acc.o.w),
      'x', named_struct('key', x.key, 'w', x.w, 'h', x.h, 'p', x.p - if(x.u * (m.up + m.down) < m.down, m.up, -m.down) / x.w))),
    n -> if(acc.o IS NULL, named_struct('o', named_struct('key', x.key, 'w', x.w, 'h', x.h, 'p', x.p), 'done', acc.done),
      named_struct(
        'o', CASE WHEN n.o.p > 1e-9 AND n.o.p < 1 - 1e-9 THEN n.o WHEN n.x.p > 1e-9 AND n.x.p < 1 - 1e-9 THEN n.x END,
        'done', concat(acc.done,
          if(n.o.p > 1e-9 AND n.o.p < 1 - 1e-9, array(), array(named_struct('key', n.o.key, 'one', n.o.p > 0.5))),
          if((n.o.p > 1e-9 AND n.o.p < 1 - 1e-9) OR n.x.p <= 1e-9 OR n.x.p >= 1 - 1e-9, array(named_struct('key', n.x.key, 'one', n.x.p > 0.5)), array())))
    ))[0])[0]
"""


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source and number of words of each row."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size, items, target; one row a source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("items"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int")))
    # sources in the order in which a rising water level reaches their caps
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    room = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = room / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("capped", most * F.col("source_size") <= F.col("level") * F.col("weight"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    target = F.when(F.col("capped") | free.isNull(), most * F.col("source_size").cast("double")).otherwise(free * F.col("weight"))
    return per.select("source", "source_size", "items", target.alias("target"))


def _level(items: DataFrame, by: list[str], level: int) -> DataFrame:
    """Fold each group of items (source, key, w, p, h), largest first: `done` results and the open item `o`."""
    at = F.xxhash64("h", F.lit(-SEED - level))
    listed = items.groupBy("source", *by).agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("big"), at.alias("at"), "key", "w", "p", "h"))).alias("xs"))
    listed = listed.withColumn("xs", F.expr("transform(xs, x -> named_struct('key', x.key, 'w', x.w, 'h', x.h, 'p', x.p, 'u', (x.at & 4503599627370495) / 4503599627370496D))"))
    key = "struct<doc_id:bigint,source:string,size:bigint>"
    done = f"array<struct<key:{key},one:boolean>>"
    zero = f"named_struct('o', cast(null AS struct<key:{key},w:double,h:bigint,p:double>), 'done', cast(array() AS {done}))"
    step = _STEP.replace("array()", f"cast(array() AS {done})")
    folded = listed.select("source", F.expr(f"aggregate(xs, {zero}, {step})").alias("r"))
    return stored(folded.select("source", "r.o", "r.done"), f"mix-level{level}")


def copies(sized: DataFrame, weights=WEIGHTS, most: float = MOST, group: int = GROUP) -> DataFrame:
    """doc_id, source, size, n (rows that agree in these), source_size, target, whole (copies of each of them), up (how many of them get one more)."""
    aims = stored(targets(sized, weights, most), "mix-targets")
    items = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(F.col("rate"))
    joined = items.join(aims.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("rate", rate)
    joined = joined.withColumn("rate", F.when(F.abs(F.col("rate") - near) < 1e-9, near).otherwise(F.col("rate")))
    joined = joined.withColumn("whole", F.floor("rate").cast("bigint")).withColumn("more", F.col("n") * (F.col("rate") - F.floor("rate")))
    near = F.round(F.col("more"))
    joined = joined.withColumn("more", F.when(F.abs(F.col("more") - near) < 1e-9, near).otherwise(F.col("more")))
    joined = stored(joined.withColumn("sure", F.floor("more").cast("bigint")).withColumn("p", F.col("more") - F.floor("more")), "mix-items")

    key = F.struct("doc_id", "source", "size")
    open_ = joined.filter("p > 0 AND size > 0").select("source", key.alias("key"), F.col("size").cast("double").alias("w"), "p", F.xxhash64(F.lit(SEED), "doc_id", "source", "size").alias("h"))
    size_class = F.floor(F.log2("w"))
    settled, levels, level, final = None, [], 0, False
    while True:
        if final:
            folded = _level(open_, [], level)
        else:
            left = open_.groupBy(F.col("source").alias("_s"), size_class.alias("_c")).agg(F.count("*").alias("_n"))
            larger = F.sum("_n").over(Window.partitionBy("_s").orderBy(F.desc("_c"))) - F.col("_n")
            left = left.withColumn("_b", F.floor(larger / group)).withColumn("_n", F.ceil(F.sum("_n").over(Window.partitionBy("_s", "_b")) / group))
            dealt = open_.join(left, F.col("source").eqNullSafe(F.col("_s")) & (size_class == F.col("_c")))
            dealt = dealt.withColumn("_g", F.pmod(F.xxhash64("h", F.lit(SEED + level)), F.col("_n")))
            folded = _level(dealt, ["_b", "_g"], level)
        levels.append(folded)
        done = folded.select(F.explode("done").alias("d")).select("d.key", "d.one")
        settled = done if settled is None else settled.union(done)
        open_ = folded.filter("o IS NOT NULL").select("source", F.col("o.key").alias("key"), F.col("o.w").alias("w"), F.col("o.p").alias("p"), F.col("o.h").alias("h"))
        level += 1
        if final:
            break
        final = open_.groupBy("source").count().filter(F.col("count") > group).isEmpty()
    last = open_.select("key", ((F.xxhash64("h", F.lit(SEED)).bitwiseAND(4503599627370495)) / 4503599627370496 < F.col("p")).alias("one"))
    settled = settled.union(last).select(F.col("key.doc_id").alias("_d"), F.col("key.source").alias("_s"), F.col("key.size").alias("_z"), "one")
    out = joined.join(settled, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    up = F.col("sure") + F.coalesce(F.col("one").cast("bigint"), F.lit(0))
    plan = stored(out.select("doc_id", "source", "size", "n", "source_size", "target", "whole", up.alias("up")), "mix-plan")
    drop_stored(aims, joined, *levels)
    return plan


def _numbered(df: DataFrame, n: str, name: str) -> DataFrame:
    """Each row n times, numbered from 0; long runs in two steps, so no array is longer than RUN or n / RUN."""
    runs = df.withColumn("_run", F.explode(F.expr(f"if({n} > 0, sequence(0L, ({n} - 1) div {RUN}), array())")))
    inside = F.expr(f"sequence(_run * {RUN}, least((_run + 1) * {RUN}, {n}) - 1)")
    return runs.withColumn(name, F.explode(inside)).drop("_run")


def mix_plan(docs: DataFrame, weights=WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, copies and the words taken."""
    sized = stored(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    plan = _numbered(copies(sized, weights, most), "n", "_i")
    plan = plan.withColumn("copies", F.col("whole") + (F.col("_i") < F.col("up")).cast("bigint"))
    drop_stored(sized)
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns as they are."""
    sized = stored(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    plan = copies(sized, weights, most).filter("whole > 0 OR up > 0")
    drop_stored(sized)
    # own names for the columns of docs, so that none can clash with the plan's
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    col = lambda c: F.col(names[docs.columns.index(c)])
    words = F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    on = col(id_col).cast("bigint").eqNullSafe(F.col("doc_id")) & col(source_col).cast("string").eqNullSafe(F.col("source")) & (words == F.col("size"))
    alone = own.join(plan.filter("n = 1").select("doc_id", "source", "size", (F.col("whole") + F.col("up")).alias("times")), on).select(*names, "times")
    several = plan.filter("n > 1")
    if not several.isEmpty():
        alone = alone.union(_shared(own.join(several, on), names))
    return _numbered(alone, "times", "_i").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def _shared(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows that agree in id, source and size, equal ones once: how often each is taken. `up` copies go to the first by hash."""
    key = ["doc_id", "source", "size"]
    equal = rows.groupBy(*names, *key, "whole", "up").agg(F.count("*").alias("m"))
    equal = equal.withColumn("h", F.xxhash64(*names, *[F.isnull(n) for n in names])).withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    # places in two steps: of hash buckets within a key, then of rows within a bucket
    per = equal.groupBy(*key, "b").agg(F.sum("m").alias("m"))
    first = per.select(*(F.col(k).alias(f"{k}_") for k in key), F.col("b").alias("b_"), (F.sum("m").over(Window.partitionBy(*key).orderBy("b")) - F.col("m")).alias("first"))
    same = (F.col("b") == F.col("b_")) & F.col("size").eqNullSafe(F.col("size_")) & F.col("doc_id").eqNullSafe(F.col("doc_id_")) & F.col("source").eqNullSafe(F.col("source_"))
    before = F.col("first") + F.sum("m").over(Window.partitionBy(*key, "b").orderBy("h", *names).rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    times = F.col("m") * F.col("whole") + F.greatest(F.lit(0), F.least("m", F.col("up") - F.col("before")))
    return equal.join(first, same).withColumn("before", before).select(*names, times.alias("times"))
