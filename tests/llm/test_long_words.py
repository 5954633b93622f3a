"""Words without a break, up to a megabyte, are encoded as the library does, in seconds."""

import random
import time

from gridloom.llm import bpe, queries


def test_a_megabyte_without_a_break():
    from tokenizers import Tokenizer

    lib, model, rng = Tokenizer.from_file(queries.VOCABULARY), bpe.load(queries.VOCABULARY), random.Random(8)
    for word in ("".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000)), "a" * 300_000, "ab" * 2_000 + "Ünder" * 2_000):
        start = time.perf_counter()
        ids = model.encode_batch([word])[0]
        assert time.perf_counter() - start < 60
        assert ids.tolist() == lib.encode(word, add_special_tokens=False).ids


def test_heap_and_search_merge_alike():
    model, rng = bpe.load(queries.VOCABULARY), random.Random(3)
    for _ in range(400):
        symbols = model.symbols("".join(rng.choice("aaabetohnis") for _ in range(rng.randrange(2, 60))) + bpe.SUFFIX)
        assert model.merge_long(symbols) == model.merge(symbols)
