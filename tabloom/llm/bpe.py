"""BPE encoding and decoding by a distinct-word table.

The tokenizer's pre-tokenizer never lets a token span white space, so the ids of a text are those of its words (runs
without white space) one after the other. Encoding therefore

1. splits the texts into words and lists each input partition's distinct words, dealt out by a hash of the word;
2. brings all partitions' entries of a word together, encodes it once, and returns its ids to the partitions that
   asked. A frequent word has one entry a partition, however often it occurs, so no word is hot. The answers are
   written to the shared folder, a directory for each partition;
3. joins ids to the words of each text by position, with the partition's part of the table as the hash side. A word that isn't in
   it (the input was dealt into other partitions by then, or the part is larger than ``most_words``) is encoded on the spot: what
   is read from the table saves work and never decides a result.

Decoding looks ids up in the id-to-piece table, whose size is the vocabulary's.

Nulls count as empty texts, which have no ids. Repeated rows and ties stay as they are, one row out for each row in; an
empty table gives an empty table; columns that aren't asked for in ``keep`` may have any name. Whole texts are encoded,
however long; what a task holds is bounded by its part of the table and by the longest text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.llm import bytecode
from tabloom.llm.common import filesystem, lean, scratch, width, written

#: Characters that Python takes for white space and the tokenizer's pattern doesn't.
_ODD = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")


def words_of(text: str | None) -> list[str]:
    """The runs without white space (in the tokenizer's sense)."""
    if not text:
        return []
    if _ODD.search(text):
        return [w for w in _WHITE.split(text) if w]
    return text.split()


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """The piece of each id, null where there is none."""
    t = tokenizer(path)
    by_id = {i: p for p, i in t.get_vocab(with_added_tokens=True).items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())


#: So many words are encoded as one text, with an added token between them.
TOGETHER = 256


@lru_cache(maxsize=2)
def divider(path: str) -> tuple[str, int] | None:
    """(text, id) of an added token that may stand between words without a part in their ids; None if there is none."""
    probe = ["a", "Ab,", "'s", "x's", "12", "\u00e9t\u00e9", "\u0301e", "\u3002", "<", "|>", "a"]
    own = [x.ids for x in _encode(path, probe)]
    for i, token in sorted(tokenizer(path).get_added_tokens_decoder().items()):
        text = token.content
        plain = not (token.single_word or token.lstrip or token.rstrip or token.normalized)
        # Without an end that is also a beginning, no token is found across its edges.
        if plain and text and not any(text[:k] == text[-k:] for k in range(1, len(text))):
            ids = [x for one in own for x in (*one, i)][:-1]
            if _encode(path, [text.join(probe)])[0].ids == ids:
                return text, i
    return None


def _encode(path: str, texts: list[str]) -> list:
    t = tokenizer(path)
    return getattr(t, "encode_batch_fast", t.encode_batch)(texts, add_special_tokens=False)


def encode_words(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, the number of each one's) of words. Most of the time for a word alone isn't spent on its ids, so that many are encoded together."""
    between, ids, n = divider(path), [], []

    def take(found: list[list[int]]) -> None:
        n.append(np.fromiter(map(len, found), np.int64, len(found)))
        ids.append(np.fromiter(chain.from_iterable(found), np.uint32, int(n[-1].sum())))

    groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
    for first in range(0, len(groups), 64):
        some = groups[first : first + 64]
        together = _encode(path, [between[0].join(g) for g in some]) if between else [None] * len(some)
        for own, e in zip(some, together, strict=True):
            found = np.array(e.ids, np.uint32) if e is not None else np.zeros(0, np.uint32)
            cuts = np.flatnonzero(found == between[1]) if between else found
            # Words that hold the token's text are encoded one by one.
            if e is None or len(cuts) != len(own) - 1 or any(between[0] in w for w in own):
                take([x.ids for x in _encode(path, own)])
            else:
                n.append(np.diff(np.concatenate([[-1], cuts, [len(found)]])) - 1)
                ids.append(found[found != between[1]])
    return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(n or [np.zeros(0, np.int64)])


def list_words(batches: Iterator[pa.RecordBatch], buckets: int, most_words: int) -> Iterator[pa.RecordBatch]:
    """Step 1: a row for each bucket, with the partition's distinct words (joined by line feeds, which no word has)."""
    from pyspark import TaskContext

    block, seen = TaskContext.get().partitionId(), {}

    def flush() -> Iterator[pa.RecordBatch]:
        dealt: dict[int, list[str]] = {}
        for w in seen:
            dealt.setdefault(zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets, []).append(w)
        for b, own in dealt.items():
            yield pa.RecordBatch.from_pydict({"block": [block], "bucket": [b], "words": ["\n".join(own)]}, schema=_WORDS)

    for batch in batches:
        for _, column in runs_of(batch.column(0)):
            for text in column.to_pylist():
                seen.update(dict.fromkeys(words_of(text)))
            if len(seen) >= most_words:
                yield from flush()
                seen = {}
    yield from flush()


_WORDS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("words", pa.string())])
_ANSWERS = pa.schema([("block", pa.int32()), ("words", pa.string()), ("sizes", pa.binary()), ("control", pa.binary()), ("data", pa.binary()), ("total", pa.binary())])


def answer(batches: Iterator[pa.RecordBatch], path: str, numbered: bool = False) -> Iterator[pa.RecordBatch]:
    """Step 2: the ids of each row's words. Each distinct word of the task's buckets is encoded once. If words have
    counts, a last row with a negative block has the numbers of occurrences of ids 0, 1 and so on in the task's words."""
    from pyspark import TaskContext

    # Numbered words aren't sent back: their bucket says which they are.
    schema, echo = (_NUMBERS, "bucket") if numbered else (_ANSWERS, "words")
    known, total = Part(path), np.zeros(0, np.int64)
    for batch in batches:
        block, texts = (batch.column(n).to_pylist() for n in ("block", "words"))
        counts = batch.column("counts").to_pylist() if numbered else [None] * len(block)
        out = []
        for text, count in zip(texts, counts, strict=True):
            own = text.split("\n") if text else []
            known.learn([w for w in own if w not in known])
            ids, n = known.gather(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
            if count is not None and len(ids):
                more = np.bincount(ids, weights=np.repeat(np.frombuffer(count, "<i8"), n), minlength=len(total)).astype(np.int64)
                more[: len(total)] += total
                total = more
            control, data = bytecode.pack(ids)
            out.append((n.astype(np.uint8).tobytes() if not numbered and (len(n) == 0 or n.max() < 256) else n.astype("<u4").tobytes(), control, data, None))
        yield pa.RecordBatch.from_arrays([pa.array(block, schema.field(0).type), batch.column(echo), *[pa.array([x[i] for x in out], pa.binary()) for i in range(4)]], schema=schema)
    if len(total):
        spread = -1 - TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_pydict({"block": [spread], echo: [0 if numbered else ""], "sizes": [b""], "control": [b""], "data": [b""], "total": [total.astype("<i8").tobytes()]}, schema=schema)


_NUMBERS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), *list(_ANSWERS)[2:]])


class Part(dict):
    """A partition's part of the distinct-word table: each word's number, and by it where its ids begin and how many."""

    def __init__(self, path: str) -> None:
        self.path, self.n, self.used = path, 0, 0
        self.start, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def load(self, answers: Iterator[tuple], most_words: int) -> Part:
        """Takes up rows of step 2, as far as there is room."""
        for words, sizes, control, data in answers:
            own = words.split("\n") if words else []
            if self.n + len(own) <= most_words:
                n = np.frombuffer(sizes, np.uint8 if len(sizes) == len(own) else "<u4").astype(np.int64)
                self._add(own, n, bytecode.unpack(control, data, int(n.sum())))
        return self

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet."""
        ids, n = encode_words(self.path, words)
        self._add(words, n, ids)

    def _add(self, words: list[str], n: np.ndarray, ids: np.ndarray) -> None:
        if self.n + len(words) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros(len(x) + len(words), np.int64)]) for x in (self.start, self.size))
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), np.uint32)])
        self.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.start[self.n : self.n + len(words)] = self.used + np.cumsum(n) - n
        self.size[self.n : self.n + len(words)] = n
        self.ids[self.used : self.used + len(ids)] = ids
        self.n, self.used = self.n + len(words), self.used + len(ids)

    def __missing__(self, word: str) -> int:
        self.learn([word])
        return self.n - 1

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the number of each one's) of words by their numbers."""
        return gather(self.start, self.size, self.ids, places)

    def encode(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the number of each text's) of some texts."""
        split = [words_of(t) for t in column.to_pylist()]
        n = np.fromiter(map(len, split), np.int64, len(split))
        ids, size = self.gather(np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum())))
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(n)])])


def gather(start: np.ndarray, size: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, the number of each one's) of words by their numbers."""
    size = size[places]
    upto = np.cumsum(size)
    at = np.repeat(start[places] - upto + size, size)
    at += np.arange(len(at))
    return ids[at], size


def split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(all words, the number of each text's), as ``words_of`` has them."""
    texts = pc.fill_null(texts, "")
    if pc.any(pc.match_substring_regex(texts, _ODD.pattern)).as_py():
        own = [words_of(t) for t in texts.to_pylist()]
        return pa.array(list(chain.from_iterable(own)), pa.string()), np.fromiter(map(len, own), np.int64, len(own))
    lists = pc.utf8_split_whitespace(texts)
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    # White space at a text's ends leaves empty words there.
    some = pc.greater(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(len(n)), n)
    return flat.filter(some), np.bincount(row[some.to_numpy(zero_copy_only=False)], minlength=len(n))


class NumberedWords:
    """The distinct-word table for texts that are split once only: each block of texts (a task's, up to ``most_bytes``) numbers its distinct
    words and writes its texts as numbers. The words go to their buckets once for each block and are encoded there; their ids come back in the
    order of the numbers, so that ``map`` needs neither texts nor words. The numbers are written before, and so are the same for both."""

    def __init__(self, docs: DataFrame, path: str, key: str, *, text_col: str = "text", most_bytes: int = 32 << 20):
        spark = docs.sparkSession
        buckets, schema = 4 * width(spark), "k long, codes binary, block long, bucket int, words string, counts binary"
        slim = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text_col}`").alias("t"))
        self.numbered = written(slim.mapInArrow(lean(lambda b: number_words(b, buckets, most_bytes)), schema), "numbered")
        words = self.numbered.where("words is not null").select("block", "bucket", "words", "counts").repartition(width(spark), "bucket")
        self.answers = words.mapInArrow(lean(lambda b: answer(b, path, True)), "block long, bucket int, sizes binary, control binary, data binary, total binary")
        self.folder, self.schema, self.docs = scratch(spark, "words"), self.answers.schema, docs
        self.answers.repartition(width(spark), "block").write.partitionBy("block").option("compression", "zstd").parquet(self.folder)

    def totals(self) -> DataFrame:
        """id, n: how often each id occurs in all texts."""
        return totals(self.docs.sparkSession.read.schema(self.schema).parquet(self.folder))

    def map(self, fn: Callable[[pa.Array, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
        """``fn(keys, ids, numbers of ids)`` for runs of rows."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, table = None, None
            for batch in batches:
                blocks, codes = batch.column(0).to_numpy(), batch.column(2)
                n = pc.binary_length(codes).to_numpy().astype(np.int64) // 4
                cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), batch.num_rows]
                for begin, end in zip(cuts, cuts[1:]):
                    if begin == end:
                        continue
                    if blocks[begin] != block:
                        block = int(blocks[begin])
                        table = numbers_of(f"{folder}/block={block}")
                    places = np.frombuffer(b"".join(codes.slice(begin, end - begin).to_pylist()), "<u4")
                    ids, size = gather(*table, places)
                    upto = np.concatenate([[0], np.cumsum(size)])
                    yield fn(batch.column(1).slice(begin, end - begin), ids, np.diff(upto[np.concatenate([[0], np.cumsum(n[begin:end])])]))

        return self.numbered.where("words is null").select("block", "k", "codes").mapInArrow(lean(run), schema)


def number_words(batches: Iterator[pa.RecordBatch], buckets: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of texts (k, codes: the numbers of the words, 32 bits each) and, for each block and bucket, of the words with consecutive numbers
    (joined by line feeds, which no word has) and how often they occur."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    names = ["k", "codes", "block", "bucket", "words", "counts"]

    def flush(held: list[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        keys, texts = (pa.concat_arrays(c.chunks) for c in rows.columns)
        words, n = split(texts)
        coded = words.dictionary_encode()
        own, at = coded.dictionary, coded.indices.to_numpy()
        bucket = np.fromiter(map(zlib.crc32, own.cast(pa.binary()).to_pylist()), np.int64, len(own)) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(own), "<u4")
        place[order] = np.arange(len(own))
        codes, ends = memoryview(place[at].tobytes()), np.concatenate([[0], np.cumsum(4 * n)])
        none = lambda many, kind: pa.nulls(many, kind)
        few = max(1, (1 << 22) * len(n) // max(1, len(codes)))
        for i in range(0, len(n), few):
            upto = ends[i : i + few + 1]
            data = pa.py_buffer(codes[upto[0] : upto[-1]])
            part = pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer((upto - upto[0]).astype("<i4")), data])
            many = len(part)
            yield pa.RecordBatch.from_arrays([keys.slice(i, many), part, pa.array(np.full(many, block)), none(many, pa.int32()), none(many, pa.string()), none(many, pa.binary())], names=names)
        if len(own):
            ranked = bucket[order]
            begin = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            stops = np.append(begin, len(own))
            joined_words = pc.binary_join(pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), own.take(pa.array(order))), "\n")
            count = np.bincount(at, minlength=len(own))[order].astype("<i8")
            counts = pa.array([count[a:b].tobytes() for a, b in zip(stops.tolist(), stops[1:].tolist())], pa.binary())
            many = len(begin)
            yield pa.RecordBatch.from_arrays([none(many, pa.int64()), none(many, pa.binary()), pa.array(np.full(many, block)), pa.array(ranked[begin].astype(np.int32)), joined_words, counts], names=names)

    held, size, block = [], 0, first
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most_bytes:
            yield from flush(held, block)
            held, size, block = [], 0, block + 1
    if held:
        yield from flush(held, block)


def numbers_of(folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, ids) of a block's words by their numbers: its buckets' one after the other."""
    sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for _, size, control, data in sorted(_read_part(folder, ["bucket", "sizes", "control", "data"]), key=lambda r: r[0]):
        n = np.frombuffer(size, "<u4").astype(np.int64)
        sizes.append(n)
        ids.append(bytecode.unpack(control, data, int(n.sum())))
    size = np.concatenate(sizes)
    return np.cumsum(size) - size, size, np.concatenate(ids)


def runs_of(column: pa.Array, most_chars: int = 1_000_000) -> Iterator[tuple[int, pa.StringArray]]:
    """(first row, texts) of runs of rows of a bounded number of bytes, or of one row."""
    upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64))])
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + most_chars, side="right")) - 1)
        yield first, column.slice(first, end - first)
        first = end


class WordTable:
    """Steps 1 and 2 of encoding: the distinct-word table of a set of rows; ``map`` does step 3."""

    def __init__(self, docs: DataFrame, path: str, *, text_col: str = "text", most_words: int = 1_000_000):
        self.docs, self.path, self.text_col, self.most_words = docs, path, text_col, most_words
        spark = docs.sparkSession
        buckets = 4 * width(spark)
        words = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(lambda b: list_words(b, buckets, most_words), "block int, bucket int, words string")
        answers = words.repartition(width(spark), "bucket").mapInArrow(lambda b: answer(b, path), "block int, words string, sizes binary, control binary, data binary, total binary")
        self.folder = scratch(spark, "words")
        answers.repartition(width(spark), "block").write.partitionBy("block").option("compression", "zstd").parquet(self.folder)

    def map(self, keep: list[str], fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch], schema: T.StructType) -> DataFrame:
        """Step 3: ``fn(rows, ids, numbers of ids)`` for runs of rows, which have the ``keep`` columns as k0, k1 ..."""
        slim = self.docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{self.text_col}`").alias("t"))
        folder, path, most = self.folder, self.path, self.most_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part = Part(path).load(_read_part(f"{folder}/block={TaskContext.get().partitionId()}", ["words", "sizes", "control", "data"]), most)
            for batch in batches:
                rows = batch.select(list(range(batch.num_columns - 1)))
                for first, texts in runs_of(batch.column(batch.num_columns - 1)):
                    if part.n > 2 * most:
                        part = Part(path)
                    yield fn(rows.slice(first, len(texts)), *part.encode(texts))

        return slim.mapInArrow(run, schema)


def totals(answers: DataFrame) -> DataFrame:
    """id, n: how often each id occurs, by the rows of step 2 with numbers of occurrences; as many rows from a task as ids at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0).drop_null().to_pylist():
                own = np.frombuffer(raw, "<i8")
                small, total = sorted((own, total), key=len)
                total = total.copy()
                total[: len(small)] += small
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": some.astype(np.int64), "n": total[some]})

    return answers.where("block < 0").select("total").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _read_part(folder: str, columns: list[str]) -> Iterator[tuple]:
    from pyarrow import fs as pafs

    fs, p = filesystem(folder)
    for info in sorted(fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(16, columns=columns):
                    yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def encode(docs: DataFrame, path: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids", decoded: str | None = None, most_words: int = 1_000_000) -> DataFrame:
    """The ``keep`` columns and the ids (array<int>, without special tokens added) of each row's whole text.

    ``path``: a tokenizers file whose pre-tokenizer splits at white space and drops it. ``decoded``: a column for what
    ``decode`` makes of the ids, in the same pass.
    """
    if out in keep:
        raise ValueError(f"{out} is among the kept columns")
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("text", T.StringType())] if decoded else [])])

    def lists(rows: pa.RecordBatch, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        column = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
        more = [_decoded(column, path)] if decoded else []
        return pa.RecordBatch.from_arrays([*rows.columns, column, *more], names=[*rows.schema.names, "ids", "text"][: rows.num_columns + 1 + len(more)])

    result = WordTable(docs, path, text_col=text_col, most_words=most_words).map(list(keep), lists, schema)
    return result.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("ids").alias(out), *([F.col("text").alias(decoded)] if decoded else []))


def decode(df: DataFrame, path: str, *, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "text") -> DataFrame:
    """The ``keep`` columns and the decoded text, special tokens included. Null ids give an empty text; ids that the
    vocabulary lacks are left out, as the tokenizers library does."""
    schema = T.StructType([*[T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)], T.StructField("text", T.StringType())])
    slim = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _decoded(batch.column(batch.num_columns - 1), path)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*batch.schema.names[:-1], "text"])

    result = slim.mapInArrow(run, schema)
    return result.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("text").alias(out))


def _decoded(column: pa.ListArray, path: str) -> pa.Array:
    t = tokenizer(path)
    if t.decoder is not None:
        return pa.array([t.decode(ids or [], skip_special_tokens=False) for ids in column.to_pylist()], pa.string())
    return joined(column, pieces(path))


def joined(column: pa.ListArray, table: pa.Array, most: int = 4_000_000) -> pa.Array:
    """Each row's pieces, looked up by id, with a space between; about ``most`` ids at a time."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, out, first = np.concatenate([[0], np.cumsum(counts)]), [], 0
    while first < len(counts):
        end = max(first + 1, int(np.searchsorted(upto, upto[first] + most, side="right")) - 1)
        out.append(_joined(column.slice(first, end - first), counts[first:end], table))
        first = end
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _joined(column: pa.ListArray, counts: np.ndarray, table: pa.Array) -> pa.Array:
    ids = column.flatten()
    known = pc.and_(pc.less(ids, len(table)), pc.greater_equal(ids, 0))
    found = table.take(pc.if_else(pc.fill_null(known, False), ids, None))
    if found.null_count:
        row = np.repeat(np.arange(len(counts)), counts)
        fine = found.is_valid().to_numpy(zero_copy_only=False)
        counts, found = np.bincount(row[fine], minlength=len(counts)), found.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), found), " ")
