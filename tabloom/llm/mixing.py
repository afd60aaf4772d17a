"""Mixing sources to target weights.

Sources in code-point order (null last) weigh ``weights``, repeating, and share ``total`` of all words; a target stops
at ``most`` times its source's size and the excess goes to the other sources by weight until none is above.

Within a source, rows are in Efraimidis-Spirakis order: by the exponential key -ln(u) / w, where u is a uniform number
made from the row's id (so that reruns agree) and w its quality weight. A target takes as many complete epochs of its
source as it holds, and then the rows with the smallest keys while their words, summed up, fit the rest; the row at the
edge gives just the words that are left. So every source meets its target to the word.

The prefix sums never sort a source in one task: keys fall into 256 bins whose sums locate the edge, its bin into 256
bins again, and only rows of the bin that holds the edge are sorted, however large the source.

A null text has no words. The sizes of rows without words are 0 and nothing of them is taken. Ties of the key are
ordered by id and then by text; rows that are repeated in full take one after the other. An empty table gives an empty table.
Other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import private, written

#: A word: a run of anything but the six ASCII white space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
BINS = 256


def words(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def letters_weight(text: Column) -> Column:
    """A quality weight from 1 to 3: prose, where ASCII letters are most of the characters, weighs most."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.lit(1.0) + F.when(n > 0, F.char_length(F.regexp_replace(text, "[^A-Za-z]", "")) / n).otherwise(0.0) * 2


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from a key's text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...], total: float, most: int) -> DataFrame:
    """``sizes`` (source, source_size) with each source's target.

    Sources enter in the order of most * size / weight: those that are filled up come first, and the level of the rest
    is what is left, by weight. It works on a row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("goal", F.sum("source_size").over(everything) * total)
    s = s.withColumn("left", F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left") / F.col("w_left"))
    s = s.withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    # From the first source that isn't filled up, the level stays: its own is that of all after it.
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("final", level)
    return s.select("source", "source_size", F.when(F.col("full") | F.col("final").isNull(), F.col("cap").cast("double")).otherwise(F.col("final") * F.col("w")).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), total: float = 1.0, most: int = 3, quality: Column | None = None) -> DataFrame:
    """id, dealt (a hash of the text), size, source_size, target, taken for each row.

    ``taken``: the words that the mix takes of the row, those of each epoch. ``quality``: an expression over ``docs``
    for the rows' weights, above 0.
    """
    text = F.col(f"`{text_col}`")
    w = letters_weight(text) if quality is None else quality
    key = -F.log(uniform(F.col(f"`{id_col}`"))) / w
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.xxhash64(text).alias("dealt"), words(text).alias("size"), key.alias("key"))
    # Where the key falls in its distribution at weight 2, as a number below 1 that grows with the key.
    slim = written(slim.withColumn("place", F.least(1 - F.exp(F.col("key") * -2), F.lit(1 - 1e-12))), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    # A row for each source; ``rest``: the words that the fractional part takes.
    goal = targets(sizes, weights, total, most)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.floor(F.col("target") + 0.5) / F.col("source_size"))).otherwise(0).cast("long"))
    goal = written(goal.withColumn("rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size")), "targets")

    bin1 = F.floor(F.col("place") * BINS).cast("int")
    bin2 = F.floor(F.col("place") * (BINS * BINS)).cast("int") - bin1 * BINS
    r = slim.withColumn("b1", bin1).withColumn("b2", bin2).withColumn("s", F.coalesce("source", F.lit(""))).withColumn("s_null", F.col("source").isNull())
    g = goal.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("s_null", F.col("source").isNull()).drop("source")
    own = ["s", "s_null"]
    # Words of the same source in earlier bins, of both levels; then only the edge's bin is looked into.
    sums = written(r.groupBy(*own, "b1", "b2").agg(F.sum("size").alias("n")), "bins")
    upto = Window.partitionBy(*own).orderBy("b1").rowsBetween(Window.unboundedPreceding, -1)
    first = sums.groupBy(*own, "b1").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    edge1 = first.join(g, own).where("before < rest and rest <= before + n").select(*own, F.col("b1").alias("e1"), "before")
    second = sums.join(edge1, own).where("b1 = e1")
    upto2 = Window.partitionBy(*own).orderBy("b2").rowsBetween(Window.unboundedPreceding, -1)
    second = second.withColumn("before2", F.col("before") + F.coalesce(F.sum("n").over(upto2), F.lit(0)))
    edge2 = second.join(g, own).where("before2 < rest and rest <= before2 + n").select(*own, "e1", F.col("b2").alias("e2"), "before2")
    goals = g.join(edge2, own, "left")
    # A row for each source: Spark broadcasts it if it is small, and splits hot sources otherwise.
    r = r.join(goals, own)
    ahead = (F.col("b1") < F.col("e1")) | ((F.col("b1") == F.col("e1")) & (F.col("b2") < F.col("e2")))
    at = (F.col("b1") == F.col("e1")) & (F.col("b2") == F.col("e2"))
    r = r.withColumn("where", F.when(F.col("e1").isNull(), "after").when(ahead, "before").when(at, "edge").otherwise("after"))
    edge = r.where("where = 'edge'")
    so_far = Window.partitionBy(*own).orderBy("key", F.col("id").asc_nulls_first(), "dealt").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before2") - F.coalesce(F.sum("size").over(so_far), F.lit(0)))))
    others = r.where("where != 'edge'").withColumn("extra", F.when(F.col("where") == "before", F.col("size")).otherwise(F.lit(0)))
    both = others.unionByName(edge)
    return both.select("id", "dealt", "source", "size", "source_size", "target", "epochs", F.col("extra").cast("long").alias("extra"), (F.col("epochs") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``: complete epochs as repeated rows, then the fractional part.

    Of the one row at each source's edge, its first words make up the target's rest; all other rows are whole. Rows
    without words are in no mix.
    """
    names = list(docs.columns)
    p_id, p_dealt, p_size, p_epochs, p_extra, p_no, no, dealt, copy = (private(names, f"_mix_{x}") for x in ("id", "hash", "size", "epochs", "extra", "place", "no", "dealt", "copy"))
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("taken > 0")
    p = written(plan.select(F.col("id").alias(p_id), F.col("dealt").alias(p_dealt), F.col("size").alias(p_size), F.col("epochs").alias(p_epochs), F.col("extra").alias(p_extra)), "taken")
    own = [F.col(f"`{c}`") for c in names]
    rows = docs.select(*own, F.xxhash64(F.col(f"`{text_col}`")).alias(dealt))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(p_id)) & (F.col(dealt) == F.col(p_dealt))
    if p.groupBy(p_id, p_dealt).count().where("count > 1").limit(1).count():
        # Rows with the same id and text are told apart by their number among their like, in an order of all their columns.
        p = p.withColumn(p_no, F.row_number().over(Window.partitionBy(p_id, p_dealt).orderBy(F.desc(p_extra))))
        rest = F.xxhash64(*[F.col(f"`{c}`") for c in names if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))])
        rows = rows.withColumn(no, F.row_number().over(Window.partitionBy(f"`{id_col}`", dealt).orderBy(rest)))
        same = same & (F.col(no) == F.col(p_no))
    hit = rows.join(p, same)
    none = F.array().cast("array<long>")
    copies = F.when(F.col(p_epochs) > 0, F.sequence(F.lit(1).cast("long"), F.col(p_epochs))).otherwise(none)
    copies = F.concat(copies, F.when(F.col(p_extra) > 0, F.array(F.lit(0).cast("long"))).otherwise(none))
    hit = hit.withColumn(copy, F.explode(copies))
    cut = (F.col(copy) == 0) & (F.col(p_extra) < F.col(p_size))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), 0), F.lit(1), F.least(F.col(p_extra), F.lit(2**31 - 1)).cast("int")), " ")
    text = F.when(cut, head).otherwise(F.col(f"`{text_col}`"))
    return hit.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names])
