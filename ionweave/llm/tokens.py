"""Encoding of a whole corpus with a public tokenizer, through a table of distinct words.

Spark splits every text into the tokenizer's words. The most frequent distinct words are encoded once for the whole
corpus into a table of bounded size; ids are joined back to the texts by position, batch by batch: the words of a batch
are turned into positions in its own list of distinct words, and that list meets the table. Words outside the table, rare
by construction, are encoded once in each task that meets them. Decoding joins ids to their pieces.

Scale: only distinct words with counts are shuffled, never texts or positions. The table has at most ``TABLE_WORDS``
entries of at most ``TABLE_WORD_CHARS`` characters, which bounds what is broadcast.

Null and empty texts have no ids: an empty list.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.session import materialise

#: Most frequent distinct words that are encoded once for all tasks.
TABLE_WORDS = 50_000
#: Longer words are left to the tasks.
TABLE_WORD_CHARS = 40
#: Distinct rare words that a task remembers before it forgets them all.
TASK_WORDS = 200_000

_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The public word pattern of byte_bpe_50k in the regular expressions of the JVM.
WORD = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    return importlib.import_module("public_tokenizers").path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The byte-level encoder of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=importlib.import_module("public_tokenizers").PATTERN, mergeable_ranks=ranks, special_tokens={})


def words(text: Column) -> Column:
    """The words of a text, which concatenated give the text; none for a null one."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def unassigned(text: Column) -> Column:
    """Whether a text has characters that the JVM's Unicode tables lack; its words may be split otherwise there."""
    return F.coalesce(text.rlike(r"\p{Cn}"), F.lit(False))


def frequent_words(docs: DataFrame, text: str = "text", size: int = TABLE_WORDS) -> list[str]:
    """The ``size`` most frequent words, ties in order of the word.

    Counts are put into narrow classes, and the table takes all words of the highest classes that together fit. The class that
    no longer fits is ordered on the driver up to ``4 size`` words; a larger one is sorted by range and read from its beginning, one partition after the other. So the driver receives the classes (at most
    64 a doubling of the count) and about the table's words, not a table's worth of candidates from every partition.
    """
    each = docs.select(F.explode(words(F.col(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    each = each.where((F.col("n") > 1) & (F.length("w") <= TABLE_WORD_CHARS)).withColumn("class", F.floor(F.log2("n") * 64).cast("int"))
    each = materialise(each, "words")  # read for the classes and for the words
    above, cut, room, n_cut = None, None, size, 0
    for c, n in sorted(((r["class"], r["count"]) for r in each.groupBy("class").count().collect()), reverse=True):
        if n > room:
            cut, n_cut = c, n
            break
        above, room = c, room - n
    top = [] if above is None else each.where(F.col("class") >= above).select("n", "w").collect()
    out = [r["w"] for r in sorted(top, key=lambda r: (-r["n"], r["w"]))]
    if cut is not None and room:
        rest = each.where(F.col("class") == cut)
        if n_cut <= 4 * size:
            return out + [r["w"] for r in sorted(rest.select("n", "w").collect(), key=lambda r: (-r["n"], r["w"]))[:room]]
        tail = rest.sort(F.desc("n"), "w").select("w").mapInArrow(_first(room), "w string")
        out += [r["w"] for r in islice(tail.toLocalIterator(), room)]
    return out


def _first(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = limit
        for b in batches:
            yield b.slice(0, left)
            left -= min(left, b.num_rows)
            if not left:
                return

    return run


class WordTable:
    """Ids of distinct words: the shared table first, then what this task has met itself."""

    def __init__(self, table: dict[str, list[int]], path: str, limit: int = TASK_WORDS):
        self.table, self.own, self.encode, self.limit = table, {}, encoder(path).encode_ordinary, limit

    def ids(self, word: str) -> list[int]:
        got = self.table.get(word)
        if got is None:
            got = self.own.get(word)
            if got is None:
                if len(self.own) >= self.limit:
                    self.own = {}
                got = self.own[word] = self.encode(word)
        return got


def join_back(lists: pa.Array, table: WordTable) -> tuple[pa.Array, np.ndarray]:
    """Ids by position: a flat id array and the offsets of each row of ``lists`` in it."""
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    per_word = [table.ids(w) for w in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, per_word), dtype=np.int64, count=len(per_word))
    at = coded.indices.to_numpy(zero_copy_only=False)
    pieces = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array([i for ids in per_word for i in ids], pa.int32()))
    ids = pieces.take(coded.indices).flatten() if len(at) else pa.array([], pa.int32())
    ends = np.concatenate(([0], np.cumsum(sizes[at]))) if len(at) else np.zeros(1, dtype=np.int64)
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return ids, ends[np.concatenate(([0], np.cumsum(counts)))]


def _encode_batches(table, path: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordTable(table.value, path)
        for b in batches:
            keys, lists, whole = b.column(0), b.column(1), b.column(2)
            ids, offsets = join_back(lists, known)
            odd = [i for i, w in enumerate(whole.to_pylist()) if w is not None]
            if counts_only:
                n = np.diff(offsets)
                for i in odd:
                    n[i] = len(known.encode(whole[i].as_py()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64())], ["key", "n_tokens"])
            elif odd:
                rows = [ids[offsets[i] : offsets[i + 1]].to_pylist() for i in range(len(keys))]
                for i in odd:
                    rows[i] = known.encode(whole[i].as_py())
                yield pa.RecordBatch.from_arrays([keys, pa.array(rows, pa.list_(pa.int32()))], ["key", "ids"])
            else:
                yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)], ["key", "ids"])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", *, path: str | None = None, counts_only: bool = False, size: int = TABLE_WORDS) -> DataFrame:
    """``key, ids`` of every row (or ``key, n_tokens``), without special tokens; rows with equal keys each come out."""
    spark = docs.sparkSession
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    enc = encoder(path)
    table = spark.sparkContext.broadcast({w: enc.encode_ordinary(w) for w in frequent_words(docs.where(~unassigned(F.col(text))), text, size)})
    odd = unassigned(F.col(text))
    kind = docs.schema[key].dataType.simpleString()
    x = docs.select(F.col(key).alias("key"), F.when(~odd, words(F.col(text))).alias("w"), F.when(odd, F.col(text)).alias("whole"))
    out = x.mapInArrow(_encode_batches(table, path, counts_only), f"key {kind}, " + ("n_tokens long" if counts_only else "ids array<int>"))
    return out.withColumnRenamed("key", key)


def pieces(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``id, piece`` (bytes as hex digits) of the whole vocabulary, which is fixed."""
    with open(path or tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as f:
        rows = [(int(b), base64.b64decode(a).hex()) for a, b in map(bytes.split, f)]
    return spark.createDataFrame(rows, "id int, piece string")


def decode(encoded: DataFrame, key: str = "doc_id", path: str | None = None) -> DataFrame:
    """``key, text`` by a join of ids to pieces; rows must have unique keys. No ids give an empty text."""
    at = encoded.select(key, F.posexplode_outer("ids").alias("pos", "id"))
    joined = at.join(F.broadcast(pieces(encoded.sparkSession, path)), "id", "left")
    rows = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return rows.select(key, F.decode(F.unhex(F.array_join(F.transform("p", lambda x: F.coalesce(x.piece, F.lit(""))), "")), "UTF-8").alias("text"))
