"""Token-ID output: whole texts to token ids in Parquet list columns, read back selectively.

The file format: one row per document in ascending id order; ``tokens`` is a
dictionary-encoded ``list<int32>``, the metadata columns (``doc_id``, ``part``,
``part_start``, ``n_tokens``) are delta-encoded, row groups and pages have set sizes, and
the writer adds page indexes, so a reader fetches metadata alone or the pages of some ids.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, prepare

#: Words whose ids a worker remembers, and the longest word it remembers (bytes).
MEMO_WORDS = 800_000
MEMO_BYTES = 48
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000

#: A run of letters whose NFC form is itself, then ASCII punctuation without the apostrophe.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\\[-`{-~]*)")


#: What a tokenizer file must say for its ids to be those of words in a row: it lower-cases, drops white space and cuts at it.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def by_words(tokenizer) -> bool:
    """Whether a text's ids are its words' ids in a row, as WordIds takes them."""
    parts = json.loads(tokenizer.to_str())
    model, cuts = parts["model"], parts["pre_tokenizer"] or {}
    return (
        parts["normalizer"] == _NORMAL
        and cuts.get("pretokenizers") == _CUTS
        and model["type"] == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in parts["added_tokens"])
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] for t in parts["added_tokens"])
    )


class WordIds(dict):
    """Word (bytes without ASCII white space, A-Z lowered) -> its ids as little-endian uint32 bytes.

    For a tokenizer that lower-cases, drops white space and never merges across it, so that
    a text's ids are its words' ids in a row. A word of plain letters goes straight to the
    BPE model; any other word takes the tokenizer's whole path. With any other tokenizer, a
    text takes that path as a whole.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.whole = not by_words(self.tokenizer)
        self.model = self.tokenizer.model
        level = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tails: dict[bytes, bytes] = {}
        self.shown = lambda s: "".join(x for x, _ in level.pre_tokenize_str(s))

    def __missing__(self, word: bytes) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            text = word.decode("utf-8", "replace")
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            out = array("I", ids).tobytes()
        elif plain[2]:
            if plain[1] not in self:  # the word before the punctuation is new, so the two together may well not come again
                return self[plain[1]] + self._tail(plain[2])
            out = self[plain[1]] + self._tail(plain[2])
        else:
            text = word.decode("ascii") if word.isascii() else self.shown(word.decode().lower())
            out = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        if len(self) < MEMO_WORDS and len(word) <= MEMO_BYTES:
            self[word] = out
        return out

    def _tail(self, tail: bytes) -> bytes:
        if tail not in self.tails:
            ids = self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids
            found = np.asarray(ids, dtype="<u4").tobytes()
            if len(tail) > 8:
                return found
            self.tails[tail] = found
        return self.tails[tail]

    def text(self, raw: bytes) -> bytes:
        if self.whole:
            return np.asarray(self.tokenizer.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = raw.lower().split()
        if b"<|" in raw:  # special tokens are matched before lower-casing
            words = [own if b"<|" in own else low for own, low in zip(raw.split(), words, strict=True)]
        return b"".join(map(self.__getitem__, words))


_ENCODERS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token files of docs at path, in ascending id order.

    Null text counts as empty (the end id alone). Null ids come last; rows of one id are
    all kept, in the order of their text's hash. An empty table gives an empty file set.
    Other columns of docs are ignored. A text is encoded whole, however long.
    """
    prepare(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()
    kind = dict(docs.dtypes)[id_col]

    def encode(batches):
        words, part, at = word_ids(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            ids = [words.text(t) + end if t else end for t in texts]
            counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            offsets = np.concatenate([[0], np.cumsum(counts)])
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32))
            tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(at + offsets[:-1]), pa.array(counts), tokens],
                names=["doc_id", "part", "part_start", "n_tokens", "tokens"],
            )
            at += int(offsets[-1])

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = own.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.mapInArrow(encode, f"doc_id {kind}, part int, part_start long, n_tokens long, tokens array<int>")
    options = {
        "parquet.block.size": ROW_GROUP_BYTES,
        "parquet.page.size": PAGE_BYTES,
        "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "v2",
        "parquet.enable.dictionary": "true",
    }
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "part_start", "n_tokens")}
    writer = rows.write
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, n_tokens and start (ids of all documents before it), without reading tokens."""
    return _with_start(spark, path, spark.read.parquet(path).drop("tokens"))


def read_tokens(spark: SparkSession, path: str, where=None) -> DataFrame:
    """All columns and start; where is a condition on metadata, which prunes row groups and pages."""
    rows = spark.read.parquet(path)
    return _with_start(spark, path, rows if where is None else rows.where(where))


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    # one row per file, so the running sum over files is small
    sums = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = rows.join(F.broadcast(base), "part")
    return rows.withColumn("start", F.col("part_start") + F.col("base")).drop("base", "part_start")


def token_digests(rows: DataFrame) -> DataFrame:
    """Per row of read_tokens: doc_id, start, n_tokens and the crc32 of its ids as little-endian uint32."""
    prepare(rows.sparkSession)
    kind = dict(rows.dtypes)["doc_id"]

    def digest(batches):
        for batch in batches:
            tokens = batch.column(3)
            flat = tokens.values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)
            at = tokens.offsets.to_numpy()
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    out = rows.select("doc_id", "start", "n_tokens", "tokens")
    return out.mapInArrow(digest, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of every document and give each one's digest from what is read back."""
    import public_tokenizers

    from .common import table

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_digests(read_tokens(spark, path))
