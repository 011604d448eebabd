import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablejury.llm import packing
from tablejury.llm.common import text_buffer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", ["", "  a  b", "a \n b", "x\n \ny", "a\n  b ", "x   y\n\n z\t\tq ", "don't  we'll 12 3,4", "a b c\xa0 d　 e",
                                  " ", "  ", " lead", "é à", " \n ", "a\xa0b – c “d”   e", "end\n", "　 x", "naïve café 東京 tower",
                                  "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y z <|endoftext", "plain <| words"])
def test_ids_equal_the_tokenizers(reference, text):
    import pyarrow as pa

    ids, n = packing.encoder(packing.tokenizer_path()).batch(*text_buffer(pa.array(["first", text, "last one"])), 1)
    want = [reference.encode(t, add_special_tokens=False).ids + [1] for t in ("first", text, "last one")]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def check(rows, texts, reference, sequence):
    """Every id of every document in exactly one piece, pieces gapless in sequences, sequences full but the last."""
    total = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert (r.sequence_id, r.offset) == divmod(total, sequence)
        total += r.length
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {}
    for i, t in texts:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault((i, len(ids)), []).append(np.array(ids, "<u4"))
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        assert sum(p.length for p in pieces) == key[1] * len(want[key])
        if len(want[key]) == 1:
            for p in pieces:
                assert p.ids_crc32 == zlib.crc32(want[key][0][p.start:p.start + p.length].tobytes())


@pytest.mark.parametrize("sequence", [2048, 7])
def test_documents(spark, reference, sequence):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.repartition(5) if sequence == 7 else docs
    rows = packing.pack_digest(packing.pack(docs, sequence=sequence)).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], reference, sequence)


def test_awkward_rows(awkward, empty, reference):
    rows = packing.pack_digest(packing.pack(awkward)).collect()
    check(rows, [(r.doc_id, r.text) for r in awkward.collect()], reference, 2048)
    assert packing.pack(empty).count() == 0
