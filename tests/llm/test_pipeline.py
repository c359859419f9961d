"""The pipeline end to end against its stages written plainly."""

import random
import sys
from collections import defaultdict

import corpus_pipeline
from cadentia.llm.secrets import scan_text
from cadentia.llm.simhash import text_fingerprint
from cadentia.llm.tokens import token_ids

from .helpers import words


def test_pipeline_equals_brute_force(spark, tmp_path):
    assert "corpus_pipeline" in sys.modules
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(90).collect()
    rnd = random.Random(3)
    rows = [tuple(r) for r in source]
    bench = [(i, " ".join(rnd.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(30))) for i in range(5)]
    rows += [(1000, None, "en", None, None), (1001, "123", "en", "s", 3), (1002, rows[0][1], None, "s", 5), (1002, rows[0][1], None, "s", 5)]
    rows += [(1003, "the and of " * 5 + bench[1][1], "en", "s", 9), (1004, "that the token = 'abcdef0123456789abcd' was with the of", "en", "s", 9)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, names).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        done = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert done.columns == docs.columns
        done.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept.append([tuple(r) for r in docs.collect()])
    key = lambda r: str(r[0])
    lettered = [r for r in rows if r[1] and words(r[1]) and any(c.isalpha() for c in r[1])]
    assert sorted(map(key, kept[0])) == sorted(map(key, lettered))
    fps, comp = [text_fingerprint(r[1]) for r in kept[0]], list(range(len(kept[0])))
    for _ in range(6):
        for i in range(len(fps)):
            for j in range(len(fps)):
                if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = defaultdict(list)
    for c, r in zip(comp, kept[0], strict=True):
        least[c].append(r[0])
    assert sorted(map(key, kept[1])) == sorted(str(min(v)) for v in least.values())
    assert sorted(map(key, kept[2])) == sorted(k for k in map(key, kept[1]) if k != "1003")
    redacted = {r[0]: r for r in kept[3]}
    assert sorted(map(key, kept[3])) == sorted(map(key, kept[2]))
    assert all(not scan_text(r[1])[1] for r in kept[3]) and "[SECRET]" in redacted[1004][1]
    assert all(r[4] == len(r[1]) for r in kept[3])
    assert all(redacted[r[0]][1] == r[1] for r in kept[2] if not scan_text(r[1])[0])
    path = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert sum(r[3] for r in kept[4]) == sum(len(token_ids(r[1], path)) + 1 for r in kept[3])
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(tuple(r)[:5] for r in ran.collect()) == sorted(r[:5] for r in kept[4])
