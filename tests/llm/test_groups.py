"""SimHash near-duplicates and sharding against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cadentia.llm.sharding import differenced, shard_documents
from cadentia.llm.simhash import links, near_duplicates, text_fingerprint

from .helpers import documents


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_links_equal_all_pairs(spark):
    rnd = random.Random(7)
    values = {0, 2**64 - 1, 1 << 63}
    for _ in range(40):
        x = rnd.getrandbits(64)
        values.add(x)
        for _ in range(12):
            y = x
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                y ^= 1 << b
            values.add(y)
    signed = sorted(v - (v >> 63 << 64) for v in values)
    got = {(r.a, r.b) for r in links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert got == want and len(want) > 300


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(70)
    say = lambda n: [rnd.choice("ab cd efg hi jkl mn Éo".split()) + str(rnd.randint(0, 30)) for _ in range(n)]
    texts = [None, "", " \t\n", "one", "ONE", "one two three"]
    for _ in range(12):
        base = say(rnd.randint(60, 300))
        for _ in range(rnd.randint(1, 5)):
            copy = list(base)
            copy[rnd.randrange(len(copy))] = "changed"
            texts.append(rnd.choice([" ", "\n"]).join(copy))
    rows = [*((100 - i, t) for i, t in enumerate(texts)), (94, texts[6]), (None, texts[7]), (None, "alone in null land")]
    fps = [plain_fingerprint(t) for _, t in rows]
    assert fps == [text_fingerprint(t) & (2**64 - 1) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = defaultdict(list)
    for c, (i, _) in zip(comp, rows, strict=True):
        least[c] += [i] * (i is not None)
    want = sorted((str(i), f"{f:016x}", str(min(least[c], default=None))) for c, f, (i, _) in zip(comp, fps, rows, strict=True))
    found = near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == want
    assert near_duplicates(documents(spark, [])).count() == 0


def test_long_texts_are_hashed_in_steps(monkeypatch):
    from cadentia.llm import simhash

    text = " ".join(str(i * i % 97) for i in range(1000))
    whole = text_fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert text_fingerprint(text) == whole


def test_differencing_is_tight():
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(1, 10_000, 2000)
    sums = np.zeros((2000, 24), np.int64)
    sums[:, 0] = sizes
    labels, total = differenced(sums)
    assert total.sum() == sizes.sum() and np.ptp(total) <= 2
    assert (np.bincount(labels[:, 0], weights=sizes, minlength=24) == total).all()


def test_shards_hold_groups_and_number_them(spark):
    rnd = random.Random(10)
    texts = [None, "", "é" * 50, "x" * 30_000] + ["t" * rnd.randint(1, 900) + str(i) for i in range(600)]
    rows = [*enumerate(texts)] + [(1000 + i, "a copy") for i in range(90)] + [(5, texts[5]), (None, texts[6])]
    found = shard_documents(documents(spark, rows), shards=5, heavy=3, factor=4, cell_groups=40).collect()
    assert Counter(str(r.doc_id) for r in found) == Counter(str(i) for i, _ in rows)
    text_of = {i: t or "" for i, t in rows}
    by_text, load, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in found:
        t = text_of[r.doc_id]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes", None)
        by_text[t].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) <= 64
    assert shard_documents(documents(spark, [])).count() == 0
    assert shard_documents(documents(spark, [(1, None)]).withColumn("size", F.lit(1))).count() == 1
