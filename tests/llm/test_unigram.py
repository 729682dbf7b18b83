"""The Viterbi pass against the sentencepiece library on a unigram model, whose pieces and scores a rule makes."""

import itertools
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from panelwright.llm.sentence_pieces import MARK, Pieces

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def model_file(path, score, digits=False):
    """A unigram model with byte pieces: letters, and pairs and triples that a hash picks, with and without the mark in front."""
    m = proto.ModelProto()
    kinds = proto.ModelProto.SentencePiece

    def add(piece, kind, value=0.0):
        m.pieces.add(piece=piece, score=value, type=kind)

    add("<unk>", kinds.UNKNOWN)
    add("<s>", kinds.CONTROL)
    add("</s>", kinds.CONTROL)
    for value in range(256):
        add(f"<0x{value:02X}>", kinds.BYTE)
    known = [MARK, *LETTERS, *"ETAOS,.;-", *("01" if digits else "")]
    for size, share in ((2, 4), (3, 40)):
        known += [p for p in map("".join, itertools.product(LETTERS, repeat=size)) if zlib.crc32(p.encode()) % share == 0]
    known += [MARK + p for p in known[1:] if p.isalpha() and zlib.crc32(p.encode()) % 3 == 0]
    for piece in dict.fromkeys(known):
        add(piece, kinds.NORMAL, score(piece))
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    m.trainer_spec.byte_fallback = True
    m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id, m.trainer_spec.pad_id = 0, 1, 2, -1
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    path.write_bytes(m.SerializeToString())
    return str(path)


def by_hash(piece):
    """In eighths, so that the library's single precision adds them up exactly."""
    return -(8 + zlib.crc32(piece.encode()) % 64) / 8


@pytest.mark.parametrize("digits", [False, True])
def test_ids_are_the_librarys_on_all_documents(tmp_path, digits):
    path = model_file(tmp_path / "unigram.model", by_hash, digits)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path)
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    texts += ["é", "日本 x", "a  b", " lead", "trail ", "\n\n", "x" * 5_000]
    for text in texts:
        ids = own.encode(text)
        assert np.frombuffer(ids, "<i4").tolist() == lib.encode(text) and own.decode(ids).decode() == text


def test_of_equal_scores_the_longer_last_piece(tmp_path):
    """Every path of as many pieces scores the same, and the library breaks the tie the same way."""
    path = model_file(tmp_path / "ties.model", lambda piece: -float(len(piece)))
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), Pieces(path)
    for text in ("the quick brown fox jumps over the lazy dog", "abcabcabc" * 40, "zzz yy x"):
        ids = lib.encode(text)
        assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)
        shown = MARK + text.replace(" ", MARK)
        longest = max((p for p in own.pieces if len(p) < 5 and shown.endswith(p) and p in own.automaton), key=len)
        assert own.pieces[ids[-1]] == longest
