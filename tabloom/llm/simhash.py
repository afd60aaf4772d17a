"""Document fingerprints by SimHash, with DataFrame operations only.

A text's terms are its words (runs without white space), hashed to 128 bits; of a run of more than 24 characters, as in scripts
without spaces, the overlapping runs of four characters. Each term votes on every bit, with a
weight that grows with its length (short words are mostly the common ones): a bit is set if the terms that have it set
outweigh those that don't. Likeness is the share of equal bits. Votes are summed two bits to a 64-bit number, 32 bits
each, so that one sum serves two bits; weights are at most 16, so up to 268 million words in a text can't overflow.

``within`` finds all fingerprints within a Hamming radius of some given ones by permuted block tables: the bits are cut
into radius + 2 blocks; of two fingerprints that differ in at most radius bits, two blocks are equal, so a table for each
two blocks, keyed by them, finds them all. Fingerprints are joined once each, however many texts have them.

A null text is empty and has the fingerprint of no votes (all zero). Equal texts have equal fingerprints. Repeated rows
stay as many rows; an empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import join_on, range_edges, range_of, width, written

BITS = 128
#: Longer runs without white space are cut into overlapping runs of so many characters.
LONGEST, GRAM = 24, 4
_LANES = (1 << 32) | 1
_MOST = 16


def _terms(word: Column) -> Column:
    """A word, or the parts of a long one, as rows."""
    parts = F.regexp_extract_all(word, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return F.explode(F.when(F.char_length(word) <= LONGEST, F.array(word)).otherwise(parts))


def _votes(words: DataFrame, keys: list[str], word: str) -> DataFrame:
    """Sums of the votes of a column of words by ``keys``: total and v0 ... v63, two bits each."""
    weight = F.least(F.char_length(word), F.lit(_MOST)).cast("long")
    hashed = words.select(*keys, weight.alias("_w"), F.xxhash64(word).alias("_h0"), F.xxhash64(word, F.lit(1)).alias("_h1"))
    sums = [F.sum(F.shiftrightunsigned(f"_h{half}", j).bitwiseAND(F.lit(_LANES)) * F.col("_w")).alias(f"v{32 * half + j}") for half in (0, 1) for j in range(32)]
    return hashed.groupBy(*keys).agg(F.sum("_w").alias("total"), *sums)


def _halves() -> list[Column]:
    """The two 64-bit halves of the fingerprint, from the sums."""
    out = []
    for half in (0, 1):
        bits = F.lit(0).cast("long")
        for j in range(32):
            v = F.col(f"v{32 * half + j}")
            for high, lane in ((0, v.bitwiseAND(F.lit((1 << 32) - 1))), (32, F.shiftrightunsigned(v, 32))):
                value = 1 << (j + high)
                bits = bits.bitwiseOR(F.when(lane * 2 > F.col("total"), F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")).otherwise(F.lit(0).cast("long")))
        out.append(bits)
    return out


def fingerprints(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys`` (which must tell the rows apart), f0 and f1 (the halves) of each row's text."""
    words = df.select(*keys, F.explode(F.split(F.coalesce(text, F.lit("")), "[\\s]+")).alias("_word"))
    words = words.select(*keys, _terms(F.col("_word")).alias("_term"))
    f0, f1 = _halves()
    return _votes(words, keys, "_term").select(*keys, f0.alias("f0"), f1.alias("f1"))


def text_of(f0: Column, f1: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f0), 16, "0")))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, rn (together: the row), id, dealt, text, next_id, next_dealt, next_text: the next row in descending
    order of the id (null last; equal ids by the text's hash), after the last the first.

    Rows are dealt into ranges of ids; each range also gets the first row of the following one, so that no task sorts
    more than a range.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("dealt"))
    n = rows.count()
    edges = range_edges(rows, "id", min(1000, max(width(docs.sparkSession), n // 2000)))
    rows = rows.withColumn("bucket", range_of("id", edges))
    # The first row of each range: at most 1000 of three numbers. null ids come last: they are in range 0, with the smallest.
    heads = rows.groupBy("bucket").agg(F.max(F.struct(F.col("id").isNotNull().alias("some"), F.col("id"), (-F.col("dealt")).alias("less"))).alias("h"))
    heads = [(r["bucket"], r["h"]["id"], -r["h"]["less"]) for r in heads.orderBy(F.desc("bucket")).collect()]
    spark = docs.sparkSession
    of_next = [(heads[i][0], *heads[(i + 1) % len(heads)][1:]) for i in range(len(heads))]
    following = F.broadcast(spark.createDataFrame(of_next, "to int, h_id long, h_dealt long"))
    first = rows.join(following, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("dealt") == F.col("h_dealt")))
    # Of rows that are repeated in full, one will do.
    first = first.dropDuplicates(["to"]).select("id", "text", "dealt", F.col("to").alias("bucket"), F.lit(1).alias("extra"))
    both = rows.select("id", "text", "dealt", "bucket", F.lit(0).alias("extra")).unionByName(first)
    order = Window.partitionBy("bucket").orderBy("extra", F.col("id").desc_nulls_last(), "dealt")
    both = both.select("*", F.row_number().over(order).alias("rn"), *[F.lead(c).over(order).alias(f"next_{c}") for c in ("id", "dealt", "text")])
    return both.where("extra = 0").drop("extra")


def edited(text: Column, following: Column) -> Column:
    """The text, its last third replaced by as much of the beginning of the following one (or all of it)."""
    n = F.char_length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def compare(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", asks: Column | None = None, radius: int = 3) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    With ``asks``, a condition on the id (as ``id``): also n_within, the number of other rows whose fingerprint is within ``radius`` of
    the row's, where the condition holds, else null.
    """
    rows = with_next(docs, id_col, text_col)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    keys = ["bucket", "rn", "id", "dealt", "next_id", "next_dealt", "n_chars", "edited_sha256", "kind"]
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("k")
    two = rows.select(*keys[:-1], kinds).select(*keys[:-1], "k.kind", "k.t")
    found = fingerprints(two, keys, F.col("t"))
    pick = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    both = found.groupBy(*keys[:-1]).agg(pick("f0", 0).alias("f0"), pick("f1", 0).alias("f1"), pick("f0", 1).alias("e0"), pick("f1", 1).alias("e1"))
    both = written(both.drop("bucket", "rn"), "fingerprints")
    other = both.select(F.col("id").alias("o_id"), F.col("dealt").alias("o_dealt"), F.col("f0").alias("o0"), F.col("f1").alias("o1")).dropDuplicates(["o_id", "o_dealt"])
    both = both.join(other, F.col("next_id").eqNullSafe(F.col("o_id")) & (F.col("next_dealt") == F.col("o_dealt")), "left")
    alike = lambda a, b: 1.0 - distance(F.col("f0"), F.col("f1"), F.col(a), F.col(b)) / float(BITS)
    both = both.withColumn("fingerprint", text_of(F.col("f0"), F.col("f1")))
    more = []
    if asks is not None:
        asked = F.coalesce(asks, F.lit(False))
        near = written(neighbours(both.select("f0", "f1"), both.where(asked).select("f0", "f1"), radius), "neighbours")
        both = join_on(both, near, "fingerprint", 96, "left")
        more = [F.when(asked, F.col("n") - 1).alias("n_within")]
    return both.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint",
        text_of(F.col("e0"), F.col("e1")).alias("edited_fingerprint"), alike("e0", "e1").alias("near_edited"), alike("o0", "o1").alias("near_next"), *more,
    )


def _keys(f0: Column, f1: Column, radius: int) -> Column:
    """A key for each two of the radius + 2 blocks of a fingerprint: a hash of their numbers and their bits."""
    text, edges = text_of(f0, f1), [round(i * 32 / (radius + 2)) for i in range(radius + 3)]
    block = [F.substring(text, edges[i] + 1, edges[i + 1] - edges[i]) for i in range(radius + 2)]
    return F.array(*[F.xxhash64(F.lit(i), F.lit(j), block[i], block[j]) for i, j in combinations(range(radius + 2), 2)])


def within(prints: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """(a0, a1, b0, b1, distance): every distinct fingerprint (f0, f1) of ``prints`` within ``radius`` (30 at most) of
    a distinct one of ``asked``, equal ones included. Members of a fingerprint are joined by its halves."""
    if not 0 <= radius <= 30:
        raise ValueError("the radius must be from 0 to 30")
    p = prints.select(F.col("f0").alias("b0"), F.col("f1").alias("b1")).distinct()
    q = asked.select(F.col("f0").alias("a0"), F.col("f1").alias("a1")).distinct()
    tables = p.withColumn("key", F.explode(_keys(F.col("b0"), F.col("b1"), radius)))
    near = distance(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
    # The distance is a condition of the join, so that fingerprints that only share blocks are never rows.
    hits = q.withColumn("asked", F.explode(_keys(F.col("a0"), F.col("a1"), radius))).join(tables, (F.col("asked") == F.col("key")) & (near <= radius))
    return hits.select("a0", "a1", "b0", "b1", near.alias("distance")).distinct()


def neighbours(prints: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """fingerprint, n: the number of rows of ``prints`` (f0, f1) within ``radius`` of each distinct fingerprint of ``asked``."""
    copies = prints.groupBy(F.col("f0").alias("b0"), F.col("f1").alias("b1")).agg(F.count(F.lit(1)).alias("c"))
    found = within(prints, asked, radius).join(copies, ["b0", "b1"])
    return found.groupBy("a0", "a1").agg(F.sum("c").alias("n")).select(text_of(F.col("a0"), F.col("a1")).alias("fingerprint"), "n")
