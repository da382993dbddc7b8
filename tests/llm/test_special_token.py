"""The special token's literal in a document, against the tokenizer as it is by default."""

import random
import zlib

import numpy as np

from quillon.llm import packing


def default_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_document_ids_equal_the_tokenizers_default():
    want, e, r = default_ids(), packing.Encoder(), random.Random(2)
    bits = [" ", " ", "a", "the", "\n", "é", "'s", "  ", "\t", "<|endoftext|>", "<|endoftext|>", "<|endo"]
    for _ in range(3000):
        x = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        assert e.document(x) == want(x), x


def test_packed_ids_of_the_literal(spark):
    text = "one two <|endoftext|> three<|endoftext|>"
    row = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ids = default_ids()(text) + (0).to_bytes(4, "little")
    assert (row["length"], row.ids_crc32) == (len(ids) // 4, zlib.crc32(ids))
