"""Near copies of texts by Order MinHash.

A text is its lower-case words. A k-mer is a run of five words with its occurrence number (the second occurrence of the
same run is another k-mer). For each of ``sketches`` hash functions a text's ``ell`` smallest k-mers are taken and, kept
in the order of the text, hashed to a bucket: texts meet where they share these k-mers *and* their order. Two k-mers of
112 functions are taken unless asked for otherwise; few texts that keep 0.8 of their words don't meet. Texts of
up to 80 words have sketches of shorter runs besides. Candidates are verified by a banded alignment of their
words; texts are near copies if it keeps a share of 0.8 or more of both texts' words (twice the longest common
subsequence over the sum of the lengths). Texts that share 0.8 of their five-word runs, in order, are well within that.

Texts of equal words are one node: copies are never paired. Nodes with fewer than five words have no k-mer and are
near copies of equal nodes only; texts without any word (null, empty, punctuation) are near copies of none, not even
each other. Repeated rows are copies of one another. The group's name is the smallest id in it; a null id counts as
smaller than others in no way: it is largest. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import BROADCAST_BYTES, clear_shuffles, discard, join_on, lean, private, written
from tabloom.llm.linking import alike_edits, link, parities, shingles

_WORD = re.compile(r"\w+")
SHINGLE, SIMILARITY = 5, 0.8
#: (words in a run, least and most words of the texts that have such runs too). Texts of nearly equal lengths share a kind of run.
SHORT_RUNS = ((2, 5, 16), (3, 7, 80))
#: Parities of a text's words, which rule pairs out; and so many k-mers are hashed at once, however long the text.
PARITIES, PIECE = 2048, 1 << 12


class WordIds(dict):
    """32-bit hashes of words, kept for a task and emptied when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        n = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return n


def normal_words(text: str | None, ids: WordIds) -> np.ndarray:
    w = _WORD.findall((text or "").lower())
    return np.fromiter(map(ids.__getitem__, w), np.uint32, len(w))


def named_words(text: str | None, ids: WordIds) -> tuple[np.ndarray, bytes | None]:
    """The words, and sixteen bytes that name them (made of the words themselves: their 32-bit hashes could collide); no name without any."""
    w = _WORD.findall((text or "").lower())
    name = hashlib.blake2b(" ".join(w).encode("utf-8", "surrogatepass"), digest_size=16).digest() if w else None
    return np.fromiter(map(ids.__getitem__, w), np.uint32, len(w)), name


_MULTIPLY = np.random.default_rng(20).integers(1, 2**63, 128, dtype=np.uint64) | np.uint64(1)


def order_minhash(words: np.ndarray, sketches: int, ell: int, k: int = SHINGLE) -> list[int]:
    """A bucket for each hash function; none for a text without k-mers."""
    s = shingles(words, k)
    n = len(s)
    if not n:
        return []
    # Occurrence numbers: equal runs side by side, numbered in the order of the text.
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    number = np.empty(n, np.uint64)
    number[order] = (np.arange(n) - begin).astype(np.uint64)
    with np.errstate(over="ignore"):
        label = s ^ (number * np.uint64(0xD6E8FEB86659FD93))
        label = (label ^ (label >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        label ^= label >> np.uint64(29)
        take = min(ell, n)
        least, rank = np.zeros((sketches, 0), np.int64), np.zeros((sketches, 0), np.uint64)
        for at in range(0, n, PIECE):
            h = label[None, at : at + PIECE] * _MULTIPLY[:sketches, None]
            h ^= h >> np.uint64(31)
            if take <= 2 and h.shape[1] >= take:
                # One or two passes for the minimum cost less than a partition.
                own = h.copy() if take == 2 else h
                first = own.argmin(axis=1)[:, None]
                i = first
                if take == 2:
                    np.put_along_axis(own, first, np.uint64(2**64 - 1), axis=1)
                    i = np.concatenate([first, own.argmin(axis=1)[:, None]], axis=1)
            else:
                i = np.argpartition(h, take - 1, axis=1)[:, :take] if h.shape[1] > take else np.tile(np.arange(h.shape[1]), (sketches, 1))
            least, rank = np.concatenate([least, i + at], axis=1), np.concatenate([rank, np.take_along_axis(h, i, axis=1)], axis=1)
        if least.shape[1] > take:
            least = np.take_along_axis(least, np.argpartition(rank, take - 1, axis=1)[:, :take], axis=1)
        least.sort(axis=1)
        out = np.arange(k * 64, k * 64 + sketches, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(take):
            out = (out ^ label[least[:, i]]) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(32)
        return out.astype(np.int64).tolist()


def buckets_of(words: np.ndarray, sketches: int, ell: int) -> list[int]:
    """The buckets of a text: of its five-word runs, and of shorter ones where few changes leave no run of five."""
    n = len(words)
    if n < SHINGLE:
        return []
    runs = [SHINGLE] + [k for k, low, high in SHORT_RUNS if low <= n <= high]
    # Texts with several kinds of runs need fewer sketches of each.
    each = sketches if len(runs) == 1 else -(-sketches // 2)
    return [b for k in runs for b in order_minhash(words, each, ell, k)]


def sketch(docs: DataFrame, id_col: str, text_col: str, sketches: int, ell: int) -> DataFrame:
    """id, dealt (a hash of the text), name (of its words, null without any), n (words), sig (parities), buckets of each row."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("dealt long, name binary, n long, sig array<long>, buckets array<long>")])
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("dealt"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            texts, name, n, sig, buckets = batch.column(2), [], [], [], []
            for i in range(batch.num_rows):
                words, node = named_words(texts[i].as_py(), ids)
                name.append(node)
                n.append(len(words))
                buckets.append(np.array(buckets_of(words, sketches, ell), np.int64))
                sig.append(parities(words, PARITIES) if len(buckets[-1]) else np.zeros(0, np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (sig, buckets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(name, pa.binary()), pa.array(n, pa.int64()), *lists], names=["id", "dealt", "name", "n", "sig", "buckets"])

    return slim.mapInArrow(lean(run), schema)


def words_again(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """node, seq (its words' hashes) of the ``wanted`` texts (node, id, dealt)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("dealt"), F.col(f"`{text_col}`").alias("t"))
    wanted = wanted.select(F.col("id").alias("w_id"), F.col("dealt").alias("w_dealt"), "node")
    if wanted.count() * 64 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            seq = [normal_words(x.as_py(), ids).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, pa.binary())], names=["node", "seq"])

    found = rows.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("dealt") == F.col("w_dealt"))).select("node", "t")
    # Rows that are equal in id and text have the same words.
    return found.mapInArrow(lean(run), "node long, seq binary").dropDuplicates(["node"])


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sketches: int = 112, ell: int = 2, least: float = SIMILARITY) -> DataFrame:
    """id, dealt, group (the smallest id of the near copies, its own if it has none), n_links (verified links of the
    row's words with other words), first (whether the row is the one of its group that stays)."""
    rows = written(sketch(docs, id_col, text_col, sketches, ell), "sketches")
    # Copies meet here: a row for each distinct text goes on. Equal names have equal words, so any row will do.
    order = F.struct(F.col("id").isNull().alias("none"), "id", "dealt")
    grouped = rows.where("name is not null").groupBy("name").agg(F.min(order).alias("h"), F.max(order).alias("t"), *[F.first(c).alias(c) for c in ("n", "sig", "buckets")])
    nodes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    clear_shuffles(docs.sparkSession)
    # A bucket's lowest bits say which sketch it is of.
    buckets = nodes.select(F.posexplode("buckets").alias("at", "b"), "node").select(F.col("b").bitwiseAND(F.lit(~15)).bitwiseOR(F.least("at", F.lit(15)).cast("long")).alias("bucket"), "node")
    early = F.col("bucket").bitwiseAND(F.lit(15)) < 4

    def seqs_of(wanted: DataFrame) -> DataFrame:
        places = join_on(nodes.select("node", "h"), wanted, "node", 32).select("node", "h.id", "h.dealt")
        return words_again(docs, id_col, text_col, written(places, "wanted"))

    labels, links = link(buckets, early, nodes.where(F.size("buckets") > 0).select("node", "n", "sig"), seqs_of, alike_edits, least, count=True)
    # What is known of the words that more than one row has, or that are linked with others.
    slim = nodes.select("node", "name", "h", (F.col("h") != F.col("t")).alias("repeated"))
    none = F.lit(0).cast("long")
    if labels is None:
        known = slim.where("repeated").select("name", "h", none.alias("n_links"))
    else:
        degree = links.select(F.col("a").alias("node"), "na").union(links.select("b", "nb")).groupBy("node").agg(F.sum("na").alias("n_links"))
        linked = written(slim.join(labels, "node").join(degree, "node", "left"), "linked")
        first = written(linked.groupBy("component").agg(F.min("h").alias("h")), "firsts")
        apart = slim.where("repeated").join(labels, "node", "left_anti").select("name", "h", none.alias("n_links"))
        known = apart.unionByName(join_on(linked.select("name", "component", F.coalesce("n_links", none).alias("n_links")), first, "component", 64).select("name", "h", "n_links"))
    known = written(known, "known")
    discard(nodes, labels)
    named = join_on(rows.select("id", "dealt", "name"), known, "name", 96, "left")
    alone = F.col("h").isNull()
    stays = alone | (F.col("id").eqNullSafe(F.col("h.id")) & (F.col("dealt") == F.col("h.dealt")))
    return named.select("id", "dealt", F.when(alone, F.col("id")).otherwise(F.col("h.id")).alias("group"), F.coalesce("n_links", none).alias("n_links"), stays.alias("first"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of which no near copy has a smaller id; rows that are equal in id and text stay once."""
    k_id, k_dealt, dealt = (private(docs.columns, f"_near_copies_{x}") for x in ("id", "hash", "dealt"))
    stay = groups(docs, id_col=id_col, text_col=text_col, **options).where("first").select(F.col("id").alias(k_id), F.col("dealt").alias(k_dealt))
    stay = written(stay.groupBy(k_id, k_dealt).agg(F.count(F.lit(1)).alias("c")), "stay")
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*own, F.xxhash64(F.col(f"`{text_col}`")).alias(dealt))
    hit = rows.join(stay.drop("c"), F.col(f"`{id_col}`").eqNullSafe(F.col(k_id)) & (F.col(dealt) == F.col(k_dealt)), "left_semi")
    hit = hit.dropDuplicates([id_col, dealt]) if stay.where("c > 1").limit(1).count() else hit
    return hit.select(*own)
