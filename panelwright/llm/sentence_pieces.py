"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the model's pieces drives a Viterbi pass: at each position
its output links give every piece that ends there, and each relaxes the best score so far.
A character that is no piece goes to byte pieces (or the unknown id). Spaces are shown as
the model's mark; where no piece holds the mark after another character, a text is cut in
front of each run of marks, and around characters that only stand alone, without changing
the best path; the ids of such chunks are remembered.

With a unigram model the ids are the library's. A BPE model's merge ranks are added up like
scores here, so its ids differ from the library's merges.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, table

MARK = "▁"
#: Chunks a worker remembers, and the longest (characters).
MEMO_CHUNKS = 150_000
MEMO_CHARS = 32
#: Columns that encoding makes.
MADE = {"n_pieces": T.LongType(), "ids_crc32": T.LongType(), "round_trip": T.BooleanType(), "pieces": T.ArrayType(T.IntegerType())}


class Pieces(dict):
    """Chunk -> its ids as little-endian int32 bytes, for one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.unk = lib.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if lib.is_byte(i)}
        normal = [i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i, lib.get_score(i)))
        self.automaton.make_automaton()
        own = [self.pieces[i] for i in normal]
        self.single = {p for p in own if len(p) == 1}
        self.floor = min((lib.get_score(i) for i in normal), default=0.0) - 10
        joined = {c for p in own if len(p) > 1 for c in p}
        alone = "".join(c for c in map(chr, range(128)) if c not in joined)
        inner = any(MARK in p.lstrip(MARK) for p in own)
        self.chunks = None if inner else re.compile(f"[{re.escape(alone)}]|{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.plain = [MARK.encode() if p == MARK else p.encode() for p in self.pieces]
        for value, i in self.bytes.items():
            self.plain[i] = bytes([value])
        for i in range(size):
            if lib.is_control(i):
                self.plain[i] = b""
        self.plain = [p.replace(MARK.encode(), b" ") for p in self.plain]
        self.plain[self.unk] = " ⁇ ".encode()

    def best(self, text: str) -> list[int]:
        """Ids of the best path; of equal scores, the longer last piece."""
        n, low = len(text), float("-inf")
        score, back = [low] * (n + 1), [None] * (n + 1)
        score[0], done = 0.0, 0

        def settle(upto: int, done: int) -> int:
            """Characters that are no piece, for positions up to upto whose pieces have all been seen."""
            while done < upto:
                done += 1
                if text[done - 1] not in self.single and score[done - 1] + self.floor > score[done]:
                    score[done], back[done] = score[done - 1] + self.floor, (1, -1)
            return done

        for end, (length, piece, gain) in self.automaton.iter(text):
            done = settle(end, done)
            new = score[end + 1 - length] + gain
            if new > score[end + 1]:
                score[end + 1], back[end + 1] = new, (length, piece)
        settle(n, done)
        out, at = [], n
        while at:
            length, piece = back[at]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode())]
            else:
                out.append(self.unk)
            at -= length
        return out[::-1]

    def __missing__(self, chunk: str) -> bytes:
        ids = np.asarray(self.best(chunk), dtype="<i4").tobytes()
        if len(self) < MEMO_CHUNKS and len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as bytes; none for an empty text."""
        if not text:
            return b""
        shown = MARK + text.replace(" ", MARK)
        if self.chunks is None:
            return np.asarray(self.best(shown), dtype="<i4").tobytes()
        return b"".join(map(self.__getitem__, self.chunks.findall(shown)))

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids: marks as spaces, without the space in front."""
        out = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return out[1:] if out[:1] == b" " else out


_MODELS: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: id (or the columns named in keep), n_pieces, ids_crc32 (of the ids as little-endian int32), round_trip, pieces array<int>.

    A space is put in front of a text, spaces become the mark, and nothing else is
    normalised. Null and empty text have no pieces. round_trip says that decoding gives
    the text again; it fails only for texts that hold the mark itself, or, with a model
    without byte pieces, unknown characters. Texts are read whole; repeated rows and null
    ids are kept; other columns are ignored, and of those in keep, columns with the names
    of these results give way to them. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    kept = docs.select(*[c for c in keep or [id_col] if c not in MADE])

    def encode(batches):
        model = pieces_of(model_path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            ids = [model.encode(t or "") for t in texts]
            same = [model.decode(i) == (t or "").encode() for i, t in zip(ids, texts, strict=True)]
            counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(counts), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same, pa.bool_()), pa.ListArray.from_arrays(at, flat)],
                names=[*batch.schema.names[:-1], *MADE],
            )

    rows = docs.select(*kept.columns, F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType(kept.schema.fields)
    for name, made in MADE.items():
        schema = schema.add(name, made)
    return rows.mapInArrow(encode, schema)


def decode_pieces(rows: DataFrame, model_path: str, pieces_col: str = "pieces", text_col: str = "text") -> DataFrame:
    """rows with text_col decoded from pieces_col; null for null. Bytes that are no UTF-8 are replaced."""
    prepare(rows.sparkSession)

    @F.pandas_udf("string")
    def decode(ids):
        model = pieces_of(model_path)
        return ids.map(lambda x: None if x is None else model.decode(np.asarray(x, dtype="<i4").tobytes()).decode("utf-8", "replace"))

    return rows.withColumn(text_col, decode(pieces_col))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, their digest, and whether they decode to the text."""
    import public_tokenizers

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
