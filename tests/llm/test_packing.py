"""Best-fit packing: the rules of the contract, and tightness against a sequential best fit."""

import bisect
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cadentia.llm import queries, tokens
from cadentia.llm.packing import best_fit, pack_documents
from cadentia.llm.tokens import BYTE_BPE, token_ids

from .helpers import documents

VOCABULARY = public_tokenizers.path(BYTE_BPE)


def sequential(lengths, capacity):
    gaps = []
    n = 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        g = gaps.pop(i) if i < len(gaps) else capacity
        n += i == len(gaps) and g == capacity
        bisect.insort(gaps, g - x)
    return n


@pytest.mark.parametrize("kind", ["mixed", "tiny", "equal", "halves"])
def test_best_fit_is_valid_and_tight(spark, kind):
    rnd = random.Random(4)
    make = {"mixed": lambda: rnd.randint(1, 100), "tiny": lambda: rnd.randint(1, 6), "equal": lambda: 30, "halves": lambda: rnd.choice([50, 51, 49])}
    lengths = [make[kind]() for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "id long, length long")
    bins = defaultdict(list)
    for r in best_fit(frame, 100).collect():
        bins[r.sequence_id].append((r.offset, lengths[r.id]))
    assert sum(map(len, bins.values())) == len(lengths)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) <= sequential(lengths, 100) * 1.02 + 2


def test_pack_documents_cuts_and_digests(spark):
    rnd = random.Random(40)
    say = lambda n: " ".join(rnd.choice(["the", "größe", "x1", "naïve", "<|endoftext|>", "\n\n  ", "日本"]) for _ in range(n))
    rows = [(i, t) for i, t in enumerate([None, "", "a", say(30), say(500), say(2047), say(6000)])]
    rows += [(3, rows[3][1]), (None, say(12))] + [(100 + i, say(rnd.randint(1, 80))) for i in range(40)]
    found = pack_documents(documents(spark, rows), VOCABULARY).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or min(2048, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(str(i), p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(x for _, x in parts[:i]) for i in range(len(parts))] and sum(x for _, x in parts) <= 2048
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert pack_documents(documents(spark, []), VOCABULARY).count() == 0


def test_ids_are_those_of_the_tokenizer_file():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ["", " a  b\n\n c", "it's 12 €\t<|endoftext|> ß　x", "  \n"]:
        assert token_ids(text, VOCABULARY).tolist() == t.encode(text, add_special_tokens=False).ids


def test_the_query_takes_ids_as_the_file_is_loaded(spark, tmp_path):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " x <|endoftext|><|endoftext|>\n\n y", "<|endoftext|", "a" + " " * 70_000 + "<|endoftext|> é"]
    for text in texts:
        assert token_ids(text, VOCABULARY, tokens.ADDED).tolist() == t.encode(text, add_special_tokens=False).ids
    documents(spark, list(enumerate(texts)), extra=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r)[:5] for r in queries.QUERIES["op4_best_fit_packing"](spark, str(tmp_path)).collect())
    want = []
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or min(2048, len(ids)), len(ids) + 1, 2048)]
        want += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(want)
