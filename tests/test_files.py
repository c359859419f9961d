"""Files are hashed block by block, by scheme, and judged against a manifest."""

import hashlib

from cadentia.sources import files as S

LARGEST = 2**31 - 1  # bytes of one value in Spark


def test_digests_and_statuses(spark, tmp_path):
    blocks = {"empty": b"", "small": b"abc", "block": b"x" * S.BLOCK, "long": bytes(range(256)) * 20_000, "odd name %é.bin": b"\0\1"}
    for name, data in blocks.items():
        (tmp_path / name).write_bytes(data)
    want = {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in blocks.items()}
    assert {S.digest_of(str(tmp_path / n), 7) for n in ("small", "empty")} == {want["small"][1], want["empty"][1]}
    found = {r.file: (r.bytes, r.sha256) for r in S.file_digests(spark, str(tmp_path)).collect()}
    assert {n: v for n, v in found.items() if "%" not in n} == {n: v for n, v in want.items() if "%" not in n}
    assert len(found) == len(want) and set(found.values()) == set(want.values())
    manifest = [("small", 3, want["small"][1]), ("block", 7, ""), ("long", want["long"][0], "0" * 64), ("gone", 1, "")]
    judged = S.verify_files(spark, str(tmp_path), spark.createDataFrame(manifest, "file string, bytes long, sha256 string"))
    got = {r.file: r.status for r in judged.collect()}
    assert (got["small"], got["block"], got["long"], got["gone"], got["empty"]) == (
        "ok", "size mismatch", "checksum mismatch", "missing", "unexpected")


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "large", "wb") as f:
        f.truncate(LARGEST + S.BLOCK)  # sparse: takes no disk
    (row,) = S.file_digests(spark, str(tmp_path)).collect()
    digest, zeros = hashlib.sha256(), b"\0" * S.BLOCK
    for _ in range(LARGEST // S.BLOCK + 1):
        digest.update(zeros)
    digest.update(zeros[: row.bytes % S.BLOCK])
    assert (row.file, row.bytes, row.sha256) == ("large", LARGEST + S.BLOCK, digest.hexdigest())


def test_stores_that_only_spark_opens(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    spark.conf.set("spark.hadoop.fs.viewfs.mounttable.files.link./in", f"file://{tmp_path}")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.files.link./in", f"file://{tmp_path}")
    (row,) = S.file_digests(spark, "viewfs://files/in").collect()
    assert (row.file, row.bytes, row.sha256) == ("a", 3, hashlib.sha256(b"abc").hexdigest())
