import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from tablejury.llm import sentencepiece_fst as fst
from tablejury.llm.common import text_buffer

SF = "/root/testdata/sf0.001"
EDGE = ["", None, " ", "  ", "   a", "a   b  c ", "a\n b\t\tc", "▁", "a▁b", "▁ b", " ▁b", "x ▁ ▁▁ y", "日本語 тест 😀", "a" * 40,
        "<0x0A><s></s><unk>", "\x00a", "é", " " * 36 + "x", "def f(x):\n    return x**2  # ok", "http://a.b/c?d=e isn't 12345", "no_spaces" * 300]


def batch(machine, texts):
    ids, n = machine.batch(*text_buffer(pa.array(texts)))
    cuts = np.append(0, np.cumsum(n))
    return [ids[cuts[i]:cuts[i + 1]].tolist() for i in range(len(texts))]


def test_byte_pair_model_equals_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=fst.model_path())
    machine, rng = fst.transducer(fst.model_path()), random.Random(1)
    texts = EDGE + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ▁.,'AB\n1é") for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    for text, ids in zip(texts, batch(machine, texts), strict=True):
        assert ids == library.encode(text or "")
        assert machine.decoded(ids) == library.decode(ids)


def unigram(fallback, squeeze=False):
    """A small unigram model, written down rather than trained."""
    model, kinds = proto.ModelProto(), proto.ModelProto.SentencePiece
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = proto.TrainerSpec.UNIGRAM, fallback
    model.trainer_spec.unk_id = 0
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = squeeze, True
    pieces = [("<unk>", 0, kinds.UNKNOWN), ("<s>", 0, kinds.CONTROL), ("</s>", 0, kinds.CONTROL)]
    pieces += [(f"<0x{b:02X}>", 0, kinds.BYTE) for b in range(256)] if fallback else []
    pieces += [(p, s, kinds.NORMAL) for p, s in [("▁", -3.1), ("a", -3.3), ("b", -3.7), ("c", -4.9), ("ab", -4.05), ("bc", -5.13), ("abc", -8.7),
                                                 ("▁a", -4.2), ("▁ab", -6.01), ("ca", -5.5), ("cab", -7.77)]]  # no two paths of equal weight
    for p, s, kind in pieces:
        model.pieces.add(piece=p, score=s, type=kind)
    return model.SerializeToString()


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_model_equals_the_library(fallback):
    serialized = unigram(fallback)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=serialized), fst.Transducer(serialized)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcabc  ") for _ in range(rng.randint(1, 30))) for _ in range(1000)] + ["abc", "", "cabcab"]
    texts += ["aéb", "a日c"] if fallback else ["aéb"]
    for text, ids in zip(texts, batch(machine, texts), strict=True):
        assert ids == library.encode(text), text


def test_models_that_are_not_compiled_are_refused():
    model = proto.ModelProto()
    model.ParseFromString(unigram(True))
    model.normalizer_spec.precompiled_charsmap = b"x"
    with pytest.raises(ValueError):
        fst.Transducer(model.SerializeToString())


def test_documents_round_trip(spark, awkward, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=fst.model_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in fst.decode(fst.encode(docs)).collect():
        assert r.text == texts[r.doc_id] and np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text) and r.n_tokens * 4 == len(r.ids)
    got = fst.decode(fst.encode(awkward)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(r.doc_id), r.text or "") for r in awkward.collect())
    assert fst.decode(fst.encode(empty)).count() == 0
