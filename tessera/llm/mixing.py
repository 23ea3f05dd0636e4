"""Mixing sources to target weights by Pareto order sampling.

A source's share of all words follows its weight, up to ``limit`` times its own
words; what is above goes to the others by weight. A target of r times the
source's words is met by floor(r) certain whole copies of each document, and the
rest, a fraction f, by order sampling: every document gets a fixed random number
U of (0, 1) from its id and the rank

    Q = U / (1 - U) * (1 - p) / p,    p its inclusion probability,

and the documents of least Q are taken until the rest of the target is reached.
p follows ``importance`` (a column; equal by default) with mean f in words.

The cut is found without sorting a source: words by fine bins of Q first, then
exact order in the one bin where the cut lies. Only counts by source and bin, and
the rows of the cut bins, are shuffled.

Cases: null and empty texts have size 0, and are taken 0 words; a null source
is a source of its own that comes last; a source without words has target 0;
equal ranks are ordered by id, rows with one id share U, and of rows alike in all
that is ranked it does not matter which is taken; an empty table gives an empty
result. ``mix`` repeats rows as often as they are taken and keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, fresh, n_words

WEIGHTS = (5.0, 2.0, 1.0)
LIMIT = 3.0
BINS = 4096
SALT = "mix"
LAST_ID = (1 << 63) - 1


def uniform(id_col: str = "doc_id", salt: str = SALT) -> Column:
    """In (0, 1), from the first 48 bits of an MD5 of the salt and the id."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, size); one row a source.

    With sources in order of 1 / w * size, those that reach their limit are the
    first k for some k, so one window over the sources replaces the rounds of
    sharing anew: source i is at its limit if, with all before it at theirs, its
    share of what is left is still above it.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % n + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("cap", F.lit(limit) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    by = by.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    by = by.withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    full = F.col("left") * F.col("w") >= F.col("cap") * F.col("w_left")
    rest = F.first(F.when(~full, F.col("left") / F.col("w_left")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.select("source", "source_size", F.when(full, F.col("cap")).otherwise(rest * F.col("w")).alias("target"))


def _ranked(rows: DataFrame, bins: int) -> DataFrame:
    """Documents with their source's goal: inclusion probability, rank and bin."""
    p = F.least(F.greatest(F.col("imp") * F.col("rest") / F.col("mass"), F.lit(1e-12)), F.lit(1 - 1e-12))
    rows = rows.withColumn("p", p).withColumn("q", F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p"))
    rows = rows.withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * bins).cast("int"))
    return rows.withColumn("place", F.struct("q", F.coalesce(F.col("id"), F.lit(LAST_ID)).alias("id"), "size"))


def _with_goal(rows: DataFrame, goal: DataFrame) -> DataFrame:
    return rows.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _columns(id_col: str, text: str, source: str, importance: str | None, salt: str) -> list[Column]:
    imp = F.col(f"`{importance}`").cast("double") if importance else F.lit(1.0)
    return [F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source}`").alias("source"), n_words(text).alias("size"), imp.alias("imp"), uniform(id_col, salt).alias("u")]


def goals(slim: DataFrame, weights: tuple[float, ...], limit: float, bins: int) -> DataFrame:
    """One row a source: its target, certain copies, and the last place that is picked."""
    goal = targets(slim, weights, limit)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("copies", F.floor(ratio + 1e-12).cast("long"))
    goal = goal.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("source_size")))
    mass = slim.groupBy("source").agg(F.sum(F.col("imp") * F.col("size")).alias("mass"))
    goal = cut(_with_goal(mass, goal))
    wanted = _ranked(_with_goal(slim.filter("size > 0"), goal.filter("rest > 0")), bins)
    per_bin = wanted.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
    edge = per_bin.withColumn("before", upto - F.col("words")).filter("before < rest and before + words >= rest").select("source", F.col("bin").alias("edge"), "before")
    near = _with_goal(wanted, edge).filter("bin = edge")
    order = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("upto", F.col("before") + F.sum("size").over(order))
    last = near.groupBy("source", "edge").agg(F.max(F.when(F.col("upto") - F.col("size") / 2 <= F.col("rest"), F.col("place"))).alias("last"))
    last = last.withColumnRenamed("source", "s")
    return cut(goal.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def _taken(rows: DataFrame, bins: int) -> DataFrame:
    """Adds ``times``, how often each document is taken."""
    rows = _ranked(rows, bins)
    inside = F.col("edge").isNull() | (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False)))
    pick = (F.col("size") > 0) & (F.col("rest") > 0) & inside
    return rows.withColumn("times", F.when(F.col("size") > 0, F.col("copies") + pick.cast("long")).otherwise(F.lit(0)).cast("long"))


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, importance: str | None = None, bins: int = BINS, salt: str = SALT) -> DataFrame:
    """id, size, source_size, target, taken."""
    slim = cut(docs.select(*_columns(id_col, text, source, importance, salt)))
    rows = _taken(_with_goal(slim, goals(slim, weights, limit, bins)), bins)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, limit: float = LIMIT, importance: str | None = None, bins: int = BINS, salt: str = SALT) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Ids and sizes go through the plan; the texts are read a second time and meet
    only the goals, one row a source.
    """
    columns = _columns(id_col, text, source, importance, salt)
    goal = goals(cut(docs.select(*columns)), weights, limit, bins)
    own = fresh(docs, "mix_row")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(own), *columns)
    rows = _taken(_with_goal(whole, goal), bins).filter("times > 0")
    rows = rows.select(own, F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*(F.col(f"{own}.`{c}`").alias(c) for c in docs.columns))


ORACLE = """
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
         (cast('0x' || substr(md5('mix:' || doc_id), 1, 12) as bigint) + 0.5::double) / 281474976710656::double as u
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as k from d group by source),
w as (select *, case k % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, 3.0::double * source_size as cap from s),
o as (select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as l,
             sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as wl from w),
f as (select *, l * w >= cap * wl as is_full from o),
t as (select source, source_size, case when is_full then cap else (select l / wl from f where not is_full order by cap / w, source nulls last limit 1) * w end as target from f),
g as (select *, floor(case when source_size > 0 then target / source_size else 0 end + 1e-12) as copies from t),
r as (select d.*, g.source_size, g.target, g.copies, greatest(0, g.target - g.copies * g.source_size) as rest from d join g on d.source is not distinct from g.source),
q as (select *, least(greatest(rest / source_size, 1e-12), 1 - 1e-12) as p from r),
c as (select *, sum(size) over (partition by source order by u / (1 - u) * (1 - p) / p, doc_id, size rows between unbounded preceding and current row) as upto from q where size > 0 and rest > 0),
e as (select *, max(case when upto - size / 2.0 <= rest then upto end) over (partition by source) as stop from c),
x as (select doc_id, size, source_size, target, cast(copies * size + case when upto <= stop then size else 0 end as bigint) as taken from e
      union all select doc_id, size, source_size, target, cast(copies * size as bigint) from q where not (size > 0 and rest > 0))
select doc_id, size, source_size, target, taken from x
"""
