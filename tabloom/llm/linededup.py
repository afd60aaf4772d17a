"""Fuzzy line deduplication.

Lines (between line feeds) are normalised to their lower-case words and named by 128 bits. Equal lines are one node. Lines of fewer than
``min_words`` words are only compared for equality, and only with ``short_lines``, as in the query and the pipeline; else
they stay. Blank lines always stay. Each other node has buckets, of its words with all digits alike: the four 48-bit
blocks of its SimHash (a vote of its words' hashes on 192 signs, weighted by the words' lengths, for short ones are the
common ones), which find all pairs that differ in at most three signs (shorter blocks would meet by chance, as often as the square of the lines); and eight sketches, each of the word that
comes first by a hash function that favours long words, with the words before and after it, which find pairs by the share of words that they have in common.
Lines of five or six words also have the line without each of its words, which finds every pair of one changed word.
Lines that agree in a bucket are candidates. They are verified by a banded alignment of their words: the share that it
keeps must be 0.8 or more. Digits count by their characters: those that differ must leave 0.8 of the lines' characters.
Of each connected group one occurrence stays, the first by id, text and position in the text.

Buckets are kept once for each node, not for each occurrence, and the words of a line are read again from its text when
the line is a candidate, so that what is shuffled is in proportion to the lines rather than to their lengths.

Rows that are equal in id and text are one and lose the same lines. A null text stays null, an empty one empty; a text
may lose all its lines and is then empty (``drop_empty`` drops rows that lost lines and have only blank ones left). Null ids come last in the
order. An empty table gives an empty table. Extra columns pass through and may have any name. Lines may be of any length: their words are
taken up in pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm.common import BROADCAST_BYTES, clear_shuffles, discard, join_on, lean, private, written
from tabloom.llm.linking import alike_edits, lcs, link, meetings, parities_of_many

_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")
BLOCKS, BLOCK_BITS = 4, 48
SIGNS = BLOCKS * BLOCK_BITS
SKETCHES = 8
#: Lines of at most so many words also meet where all but one of their words are equal.
SHORT = 6
MIN_WORDS, SIMILARITY = 5, 0.8
#: Parities of a line's words, which rule pairs out.
PARITIES = 128
#: Words are taken up in pieces of so many: their votes (16 at most) add up in 16 bits.
PIECE = 4_000
_MULTIPLY = np.random.default_rng(30).integers(1, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)
_NEVER = np.uint64(2**64 - 1)
#: The eight signs of a byte as lanes of 16 bits, four to a number.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint16).view(np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word: of its bytes, each with its place, summed up."""
    if not words:
        return np.zeros(0, np.uint64)
    _, ends, data = pa.array(words, pa.large_string()).buffers()
    ends = np.frombuffer(ends, "<i8")[: len(words) + 1]
    size = np.diff(ends)
    raw = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    place = np.arange(len(raw), dtype=np.uint64) - np.repeat(ends[:-1], size).astype(np.uint64)
    with np.errstate(over="ignore"):
        each = _mix(_mix((place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + raw) + np.uint64(0x165667B19E3779F9))
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        return _mix(upto[ends[1:]] - upto[ends[:-1]] + size.astype(np.uint64))


class _Lexicon:
    """The distinct words of some lines: where each word of the lines is among them, and by it what the word adds to its
    line: hash, length, digits, votes, place in the sketches. ``plain``: digits are all alike."""

    def __init__(self, words: list[str], plain: bool) -> None:
        coded = pa.array(words, pa.string()).dictionary_encode()
        self.at, own = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        odd = [k for k, w in enumerate(own) if not w.isalpha()]
        self.length = np.fromiter(map(len, own), np.int64, len(own))
        self.digits = np.zeros(len(own), np.int64)
        self.digits[odd] = [len(_DIGIT.findall(own[k])) for k in odd]
        if plain:
            for k in odd:
                own[k] = _DIGIT.sub("0", own[k])
        self.hash = h = hashes(own)
        # Numbers whose digits are alike are common, however long they are.
        weight = np.where((self.digits > 0) & plain, 1, np.minimum(self.length, 16))
        self.weight = weight
        with np.errstate(over="ignore"):
            bits = np.stack([_mix(h * m) for m in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))], axis=1)
            u = _mix(_mix(h)[:, None] * _MULTIPLY)
        # The word's weight where its sign is set.
        self.votes = _LANES[bits.view(np.uint8)].reshape(len(own), SIGNS // 4) * weight[:, None].astype(np.uint64)
        rank = np.log((u >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) - np.float32(24 * np.log(2))
        rank = rank / -np.where((self.digits > 0) & plain, 0.1, weight)[:, None].astype(np.float32)
        # Positive numbers of single precision sort as their bits do; the lower half names the word.
        self.keys = rank.view(np.uint32).astype(np.uint64) << np.uint64(32) | (h & np.uint64(2**32 - 1))[:, None]


def _pieces(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, line) of the pieces of consecutive lines."""
    many = -(-sizes // PIECE)
    line = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many)
    return (np.cumsum(sizes) - sizes)[line] + number * PIECE, line


def contexts(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each word with the words before and after it in its line."""
    starts = np.cumsum(sizes) - sizes
    before, after = np.roll(hashes, 1), np.roll(hashes, -1)
    before[starts], after[starts + sizes - 1] = np.uint64(1), np.uint64(2)
    with np.errstate(over="ignore"):
        h = _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + before)
        return _mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + after)


def _first(keys: np.ndarray, around: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the smallest key, the smallest context among the words that have it) of each group of rows, by sketch."""
    least = np.minimum.reduceat(keys, starts, axis=0)
    return least, np.minimum.reduceat(np.where(keys == np.repeat(least, sizes, axis=0), around, _NEVER), starts, axis=0)


def line_blocks(above: np.ndarray) -> np.ndarray:
    """The blocks of SimHashes (a row of signs each), each with its number in the lowest four bits."""
    packed = np.packbits(above, axis=1).reshape(len(above), BLOCKS, BLOCK_BITS // 8).astype(np.int64)
    block = np.zeros((len(above), BLOCKS), np.int64)
    for i in range(BLOCK_BITS // 8):
        block = block << 8 | packed[:, :, i]
    return block << 4 | np.arange(BLOCKS)


def prints(known: _Lexicon, at: np.ndarray, sizes: np.ndarray, most: int = 4 * PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(signs, sketches) of consecutive lines of ``sizes`` words, given by their numbers."""
    starts, line = _pieces(sizes)
    ends, around = np.append(starts[1:], len(at)), contexts(known.hash[at], sizes)
    votes, firsts = [], []
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + most, side="right")))
        words = slice(starts[first], ends[last - 1])
        own, begin = at[words], starts[first:last] - starts[first]
        votes.append(np.add.reduceat(known.votes[own], begin, axis=0).view(np.uint16).astype(np.int64))
        firsts.append(_first(known.keys[own], around[words, None], begin, ends[first:last] - starts[first:last]))
        first = last
    vote, (key, sketch) = np.concatenate(votes), (np.concatenate(x) for x in zip(*firsts, strict=True))
    if len(line) > len(sizes):
        own = np.bincount(line, minlength=len(sizes))
        begin = np.cumsum(own) - own
        vote, (_, sketch) = np.add.reduceat(vote, begin, axis=0), _first(key, sketch, begin, own)
    total = np.add.reduceat(known.weight[at], np.cumsum(sizes) - sizes)
    with np.errstate(over="ignore"):
        return 2 * vote > total[:, None], _mix(sketch + np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def buckets_of(known: _Lexicon, at: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, line) of the lines ``which``: SimHash blocks, then sketches, then those of short lines."""
    mine = np.flatnonzero(which)
    if not len(mine):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, some = at[np.repeat(which, sizes)], sizes[mine]
    signs, sketch = prints(known, own, some)
    few = some <= SHORT
    line, label = np.repeat(np.arange(len(some)), some), _mix(known.hash[own])
    brief = few[line]
    with np.errstate(over="ignore"):
        total = np.add.reduceat(label, np.cumsum(some) - some)
        short = _mix(np.concatenate([total[few], total[line[brief]] - label[brief]]))
    each = np.concatenate([line_blocks(signs), sketch.astype(np.int64) & ~15 | BLOCKS + np.arange(SKETCHES)], axis=1)
    at_line = np.concatenate([np.repeat(np.arange(len(some)), each.shape[1]), np.flatnonzero(few), line[brief]])
    return np.concatenate([each.reshape(-1), short.astype(np.int64)]), mine[at_line]


def _lists(n: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.ListArray:
    """A list for each of ``n`` lines: of the (values, lines) in ``parts``, in order."""
    values, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[np.argsort(at, kind="stable")]))


def normal_lines(text: str | None) -> list[tuple[int, str, list[str]]]:
    """(position, line, words) of the lines that aren't blank."""
    return [(i, line, _WORD.findall(line)) for i, line in enumerate((text or "").lower().split("\n")) if line and not line.isspace()]


def name_of(words: list[str], line: str) -> bytes:
    """Sixteen bytes that name a line's words; a line without words is named by its signs."""
    return xxhash.xxh3_128_digest((" ".join(words) or line.strip()).encode("utf-8", "surrogatepass"))


def _words_of(seq: np.ndarray) -> np.ndarray:
    """The words of a ``seq``: the number of its words and of their characters, the words with all digits alike, the digits."""
    return seq[2 : 2 + int(seq[0])]


def seqs_of_lines(found: list[list[str]]) -> list[bytes]:
    words = [w for own in found for w in own]
    coded = pa.array(words, pa.string()).dictionary_encode()
    plain = hashes([w if w.isalpha() else _DIGIT.sub("0", w) for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]).astype(np.uint32)[coded.indices.to_numpy()]
    out, at = [], 0
    for own in found:
        line = "".join(own)
        digits = [] if line.isalpha() else _DIGIT.findall(line)
        head, tail = np.array([len(own), len(line)], "<u4"), np.fromiter(map(ord, digits), "<u4", len(digits))
        out.append(head.tobytes() + plain[at : at + len(own)].tobytes() + tail.tobytes())
        at += len(own)
    return out


def alike_lines(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether an alignment keeps a share of ``least`` of the words with all digits alike, and the digits that differ
    leave as much of the characters."""
    if not alike_edits(_words_of(a), _words_of(b), least):
        return False
    x, y = a[2 + int(a[0]) :], b[2 + int(b[0]) :]
    need = int(np.ceil((len(x) + len(y) - (1 - least) * (int(a[1]) + int(b[1]))) / 2 - 1e-9))
    return need <= 0 or lcs(x, y, need) >= need


def lines(docs: DataFrame, id_col: str, text_col: str, min_words: int, short_lines: bool, full: bool = True) -> DataFrame:
    """id, dealt (a hash of the text), pos, name of each line that takes part; with ``full`` also n (words), sig (parities) and buckets."""
    more = ", n int, sig array<long>, buckets array<long>" if full else ""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("dealt long, pos int, name binary" + more).fields])
    names = [f.name for f in schema]
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("dealt"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def heads(batch: pa.RecordBatch, row: list, pos: list, name: list) -> list[pa.Array]:
            return [*(c.take(pa.array(row, pa.int64())) for c in batch.columns[:2]), pa.array(pos, pa.int32()), pa.array(name, pa.binary())]

        def flush(batch: pa.RecordBatch, row: list, pos: list, name: list, words: list, count: list) -> pa.RecordBatch:
            sizes = np.array(count, np.int64)
            starts = np.cumsum(sizes) - sizes
            known = _Lexicon(words, True)
            at = known.at
            # Lines that are mostly numbers would all meet with their digits alike; lines in between have both kinds of buckets.
            share = np.add.reduceat(known.digits[at], starts) / np.add.reduceat(known.length[at], starts)
            numeric = share >= 0.3
            mine = np.flatnonzero(np.repeat(numeric, sizes))
            exact, other = _Lexicon([words[k] for k in mine.tolist()], False), np.zeros(len(at), np.int64)
            other[mine] = exact.at
            sig = parities_of_many((known.hash[at] & np.uint64(2**32 - 1)).astype(np.uint32), sizes, PARITIES)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, sig.shape[1], dtype=np.int32)), pa.array(sig.reshape(-1)))
            buckets = _lists(len(sizes), [buckets_of(known, at, sizes, share <= 0.5), buckets_of(exact, other, sizes, numeric)])
            return pa.RecordBatch.from_arrays([*heads(batch, row, pos, name), pa.array(sizes.astype(np.int32)), sig, buckets], names=names)

        def brief(batch: pa.RecordBatch, found: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
            """Lines that have no buckets: (row, position, name, words)."""
            row, pos, name, n = zip(*found, strict=True)
            rest = [pa.array(n, pa.int32()), *[pa.array([[]] * len(row), pa.list_(pa.int64()))] * 2] if full else []
            return pa.RecordBatch.from_arrays([*heads(batch, row, pos, name), *rest], names=names)

        for batch in batches:
            texts, row, pos, name, words, count, few = batch.column(2), [], [], [], [], [], []
            for i in range(batch.num_rows):
                for at, line, own in normal_lines(texts[i].as_py()):
                    if len(own) < min_words and not short_lines:
                        continue
                    if len(own) < min_words or not full:
                        few.append((i, at, name_of(own, line), len(own)))
                        continue
                    row.append(i)
                    pos.append(at)
                    name.append(name_of(own, line))
                    words += own
                    count.append(len(own))
                if len(words) > 100_000:
                    yield flush(batch, row, pos, name, words, count)
                    row, pos, name, words, count = [], [], [], [], []
                if len(few) > 50_000:
                    yield brief(batch, few)
                    few = []
            if row:
                yield flush(batch, row, pos, name, words, count)
            if few:
                yield brief(batch, few)

    return slim.mapInArrow(lean(run), schema)


def words_again(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """node, seq of the ``wanted`` lines (node, id, dealt, pos), from their texts."""
    dealt, text = F.xxhash64(F.col(f"`{text_col}`")), F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), dealt.alias("dealt"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    wanted = wanted.select(F.col("id").alias("w_id"), F.col("dealt").alias("w_dealt"), F.col("pos").alias("w_pos"), "node")
    if wanted.count() * 64 <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    found = rows.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("dealt") == F.col("w_dealt")) & (F.col("pos") == F.col("w_pos")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = seqs_of_lines([_WORD.findall(x.lower()) for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq, pa.binary())], names=["node", "seq"])

    # Rows that are equal in id and text have the same lines.
    return found.select("node", "line").dropDuplicates(["node"]).mapInArrow(lean(run), "node long, seq binary")


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, short_lines: bool = False, least: float = SIMILARITY) -> DataFrame:
    """id, dealt, drop (the positions of the lines to drop) of each text that has any."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "dealt", "pos")
    grouped = lines(docs, id_col, text_col, min_words, short_lines).groupBy("name").agg(F.min(order).alias("h"), F.max(order).alias("t"), *[F.first(c).alias(c) for c in ("n", "sig", "buckets")])
    # A number for each node, fixed by being written.
    nodes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    clear_shuffles(docs.sparkSession)
    pairs, crowds = meetings(nodes.select(F.explode("buckets").alias("bucket"), "node", "n", "sig"), least)
    clear_shuffles(docs.sparkSession)
    early = F.col("bucket").bitwiseAND(F.lit(15)).isin(0, BLOCKS, BLOCKS + 1)
    info = nodes.where(F.size("buckets") > 0).select("node", "n", "sig")

    def seqs_of(wanted: DataFrame) -> DataFrame:
        places = join_on(nodes.select("node", "h"), wanted, "node", 32).select("node", "h.id", "h.dealt", "h.pos")
        return words_again(docs, id_col, text_col, written(places, "wanted"))

    labels, _ = link(written(crowds.distinct(), "crowds"), early, info, seqs_of, alike_lines, least, pairs, True, PARITIES // 2, _words_of)
    # The first occurrence in each group, for the nodes of groups with more than one.
    heads = nodes.where("h != t").select("node", "name", "h")
    if labels is not None:
        linked = nodes.select("node", "name", "h").join(labels, "node")
        first = written(linked.groupBy("component").agg(F.min("h").alias("h")), "firsts")
        heads = heads.join(labels, "node", "left_anti").unionByName(join_on(linked.select("node", "name", "component"), first, "component", 80).select("node", "name", "h"))
    heads = written(heads.select("name", "h"), "heads")
    discard(nodes, labels)
    gone = join_on(lines(docs, id_col, text_col, min_words, short_lines, full=False), heads, "name", 96).where(order != F.col("h"))
    return gone.groupBy("id", "dealt").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", out: str | None = None, drop_empty: bool = False, **options) -> DataFrame:
    """``docs`` with the repeated lines left out of the text (or in a new column ``out`` instead).

    ``drop_empty``: leave out rows that lost lines and have no line left that isn't blank.
    """
    found = written(repeats(docs, id_col=id_col, text_col=text_col, **options), "drops")
    g_id, g_dealt, g_drop, dealt, rest = (private([*docs.columns, out or ""], f"_line_dedup_{x}") for x in ("id", "hash", "drop", "dealt", "rest"))
    gone = found.select(F.col("id").alias(g_id), F.col("dealt").alias(g_dealt), F.col("drop").alias(g_drop))
    if (found.select(F.sum(F.size("drop") * 8 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    text, own = F.col(f"`{text_col}`"), [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*own, F.xxhash64(text).alias(dealt))
    both = rows.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(g_id)) & (F.col(dealt) == F.col(g_dealt)), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(F.col(g_drop), i)), "\n")
    both = both.select(*own, g_drop, F.when(F.col(g_drop).isNull(), text).otherwise(left).alias(rest))
    if drop_empty:
        both = both.where(F.col(g_drop).isNull() | F.col(rest).rlike(r"(?U)\S"))
    names = [F.col(rest).alias(c) if c == text_col and out is None else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*names, *([F.col(rest).alias(out)] if out else []))
