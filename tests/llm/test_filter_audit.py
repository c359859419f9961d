"""The filter audit against a loop over documents, orders and steps."""

import random
import re

from pyspark.sql import functions as F

from cadentia.llm.filter_audit import ORDERS, audit, outcome_fields, packed, unpacked

from .helpers import documents


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out, fails = {}, []
    for i, t, lang in docs:
        text = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
               "D": bool(set(text) & set("#$%&*|")), "E": i is not None and i > least[text]}
        fails.append((lang or "", {f for f in bad if bad[f]}, i in good, i in toxic))
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in ORDERS:
            for step, f in enumerate(order, 1):
                gone = [bool(x[1] & set(order[: step - 1])) for x in mine]
                here = [x for x, g in zip(mine, gone, strict=True) if not g and f in x[1]]
                out[part, order, step] = [
                    sum(not g and f not in x[1] for x, g in zip(mine, gone, strict=True)), len(here),
                    sum(g and f in x[1] for x, g in zip(mine, gone, strict=True)), sum(x[1] == {f} for x in mine),
                    sum(x[2] for x in here), sum(x[3] for x in here)]
                shares[f] += len(here)
        for order in ORDERS:
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shares[f])
    return out


def test_audit_equals_brute_force(spark):
    rnd = random.Random(13)
    texts = [None, "", " \x0b  ", "A B", "a|b"]
    for _ in range(60):
        words = [rnd.choice(["Ab", "cd", "$", "é", "x" + str(rnd.randint(0, 500)), "y" + str(rnd.randint(0, 500))]) for _ in range(rnd.choice([5, 99, 100, 130]))]
        texts.append(rnd.choice([" ", "\t", "\n"]).join(words[:: rnd.choice([1, 1, 7])]))
    texts.append(" ".join(f"w{i}" for i in range(60_000)))
    docs = [(i, t, rnd.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    docs += [(100 + i, rnd.choice(texts), rnd.choice(["en", None])) for i in range(300)]
    docs += [(None, texts[7], "en"), (None, texts[7], "fr"), docs[9], docs[9], (9, "other", "en")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 250)] + [(9, 1, 1), (9, 0, 0), (None, 1, 1), (9999, 1, 1)]
    frame = spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, lang string, digest string, quality int")
    labelled = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality long, toxic long, lang string")
    got = audit(frame.repartition(3), labelled).collect()
    want = brute_audit(docs, labels)
    assert len(got) == len(want) == 600 * 4
    assert {tuple(r)[:3]: list(r)[3:] for r in got} == want
    bare = {(r.part, r.filter_order, r.step): (r.good_lost, r.toxic_lost) for r in audit(frame, labelled.where("doc_id < 0")).collect()}
    assert set(bare.values()) == {(0, 0)}


def test_audit_without_rows(spark):
    docs = documents(spark, [])
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality long, toxic long")
    assert audit(docs, labels).count() == 0
    one = audit(documents(spark, [(1, None)]).withColumn("part", F.lit(1)), labels).collect()
    assert len(one) == 600 and {r.removed for r in one if r.filter_order[r.step - 1] == "A"} == {1}


def test_fields_do_not_run_over():
    for width in (1, 2, 5):
        top = 256**width - 1
        wide = {mask: packed(outcome_fields(mask), width) for mask in range(32)}
        for mask, number in wide.items():
            assert unpacked(top * number, width) == [top * f for f in outcome_fields(mask)]
    total = 200 * wide[0] + 3 * wide[31]
    assert unpacked(total, 5) == [200 * a + 3 * b for a, b in zip(outcome_fields(0), outcome_fields(31), strict=True)]
