"""License scans, decontamination and syncmer fingerprints against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadentia.llm.decontaminate import decontaminate, without_contaminated
from cadentia.llm.licenses import BASE, NOTICES, license_report, license_spans
from cadentia.llm.syncmers import BAND, K, S, anchors, fingerprints
from cadentia.session import materialise

from .helpers import documents, words


def test_license_report_counts_base_places(spark):
    rnd = random.Random(5)
    vocabulary = "cc by general public license all rights reserved the of Éa".split()
    texts = [None, "", " \n", "CC-BY", "cc by cc by", "All rights reserved. ALL RIGHTS RESERVED", "by cc", "GENERAL public\nlicense"]
    texts += [rnd.choice(" -\n").join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60))) for _ in range(60)]
    texts.append("x " * 30_000 + "general public license")
    rows = [*enumerate(texts), (3, "CC-BY"), (None, "cc by")]
    got = sorted(map(str, license_report(documents(spark, rows)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()))
    want = []
    for i, t in rows:
        w, at, labels = words(t), [], set()
        for phrase, label in BASE:
            p = phrase.split()
            hits = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        want.append(f"Row(doc_id={i}, n_words={len(w)}, n_base={len(at)}, first_word={min(at, default=None)}, "
                    f"last_word={max(at, default=None)}, base_labels={','.join(sorted(labels))!r})")
    assert got == sorted(want)


def test_license_spans_survive_an_inserted_word(spark):
    text = "foo Licensed under the big Apache License, Version 2.0 bar"
    rows = license_spans(documents(spark, [(1, text), (2, "licensed under the sun")])).collect()
    assert [(r.doc_id, r.label, r.start, r.end) for r in rows] == [(1, "apache-2.0", 1, 10)]
    assert license_report(documents(spark, [])).count() == 0


def verified(text, cover=0.8):
    """Labels of templates of which one path through three neighbouring diagonals shows enough, found by trying them all."""
    w, found = words(text), set()
    for phrase, label in (*BASE, *NOTICES):
        t = phrase.split()
        hits = {(p - i, i) for p in range(len(w) - 1) for i in range(len(t) - 1) if w[p : p + 2] == t[i : i + 2]}
        for d in {d for d, _ in hits}:
            best = {}
            for i in range(len(t) - 1):
                for k in (d, d + 1, d + 2):
                    stay = best.get((i - 1, k), 0)
                    move = max(best.get((i - 2, j), 0) for j in (d, d + 1, d + 2) if j != k)
                    best[i, k] = ((k, i) in hits) + max(stay, move)
            if max(best.values()) / (len(t) - 1) >= cover:
                found.add(label)
    return ",".join(sorted(found))


def test_license_spans_are_verified(spark):
    rnd = random.Random(15)
    texts = [
        "general public transport public license", "general public license", "public license general public",
        "the Apache license, version 2.0 licensed under the", "licensed under the mit license", "licensed under mit license",
        "permission is hereby granted, free of any charge, to any person obtaining a copy", "cc cc by by", None, "",
    ]
    vocabulary = " ".join(p for p, _ in NOTICES).split()
    for _ in range(80):
        w = rnd.choice(NOTICES)[0].split()
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w))
            w[at : at + rnd.randint(0, 1)] = rnd.choice([[], [rnd.choice(vocabulary)], ["new", "words"]])
            w = w or ["x"]
        texts.append(" ".join(rnd.choices(vocabulary, k=5) + w + rnd.choices(vocabulary, k=5)))
    got = {r.doc_id: r.labels for r in license_report(documents(spark, list(enumerate(texts)))).collect()}
    assert got == {i: verified(t) for i, t in enumerate(texts)}
    assert got[0] == got[2] == got[3] == "" and got[1] == "gpl" and got[4] == "mit" and got[6] == "mit"


def test_decontaminate_equals_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "é"]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, say(rnd.choice([1, 2, 4, 13, 20, 40]))) for i in range(12)] + [(20, None), (21, ""), (3, say(15)), (10, "W1 w2")]
    texts = [None, "", "..."] + [say(rnd.randint(1, 60)) for _ in range(30)]
    for _ in range(20):
        piece = (rnd.choice(items)[1] or "").split()
        cut = rnd.randint(0, 3)
        texts.append(say(rnd.randint(0, 200)) + " " + ", ".join(piece[cut:]).upper() + " " + say(rnd.randint(0, 90)))
    rows = [*enumerate(texts), (5, texts[5]), (None, texts[-1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit(1))
    found = decontaminate(documents(spark, rows), bench, block_rows=7).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + n]), set()).add(item)
    want = []
    for i, t in rows:
        w, hit, its = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    its |= windows[k]
        sha = hashlib.sha256(",".join(sorted(map(str, its))).encode()).hexdigest()
        want.append((str(i), len(w), len(hit), len(its), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert got == sorted(want)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate(documents(spark, rows[:3]), empty).where("contaminated").count()


def test_fingerprints_follow_the_edit_rule(spark):
    rnd = random.Random(9)
    say = lambda n: "".join(rnd.choice("abcdefgh éß😀") for _ in range(n))
    texts = [None, "", "a", "abcdefg", say(40), say(500), say(3000), say(3000), "x" * 90_000]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(2, texts[5]), (6, "abcdefg"), (None, say(100))]
    found = fingerprints(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    edits = []
    for j, (i, t) in enumerate(order):
        t, after = t or "", order[(j + 1) % len(order)][1] or ""
        q = len(t) // 4
        edits.append((str(i), len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256) for r in found]
    differ = {g for g in got if g not in edits}
    assert {g[0] for g in differ} <= {"3", "6"}  # doc_id 6 stands twice: either may come first
    by_id = {r.doc_id: r for r in found if r.doc_id not in (3, 6)}
    assert by_id[2].fingerprint == by_id[15].fingerprint
    assert by_id[18].near_edited > 0.5 > by_id[18].near_next
    assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    assert fingerprints(documents(spark, [(1, "one text alone, quite short")])).first().near_next == 1.0
    assert fingerprints(documents(spark, [])).count() == 0


def positional(a, b, same):
    """Likeness of two lists of (place, hash): matches of the best two neighbouring bands of offsets."""
    if not a and not b:
        return float(same)
    votes, places = defaultdict(int), [defaultdict(list), defaultdict(list)]
    for side, found in zip(places, (a, b), strict=True):
        for p, h in found:
            side[h].append(p)
    for h in places[0].keys() & places[1].keys():
        votes[(min(places[0][h]) - min(places[1][h])) // BAND] += min(len(places[0][h]), len(places[1][h]))
    best = max((votes[k] + votes.get(k + 1, 0) for k in [*votes, *[k - 1 for k in votes]]), default=0)
    return 2 * best / (len(a) + len(b))


def in_place(a, b, same):
    """Likeness where only offsets of less than a band count."""
    if not a and not b:
        return float(same)
    places = [defaultdict(list), defaultdict(list)]
    for side, found in zip(places, (a, b), strict=True):
        for p, h in found:
            side[h].append(p)
    hits = [min(len(places[0][h]), len(places[1][h])) for h in places[0].keys() & places[1].keys()
            if abs(min(places[0][h]) - min(places[1][h])) < BAND]
    return 2 * sum(hits) / (len(a) + len(b))


def test_likeness_equals_brute_force(spark):
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do é".split()) + str(rnd.randint(0, 50)) for _ in range(n))
    passage, block = say(60), [say(50) for _ in range(30)]
    whole = " ".join(block)
    shuffled = " ".join(rnd.sample(block, 30))
    moved = whole.replace(block[3], block[3] + " new", 1)
    texts = [whole, shuffled, moved, say(200) + passage + say(100), say(50) + passage + say(250), "", None, "short", "short", "a" * 5000, "a" * 4000 + "b" * 900]
    texts += [say(rnd.randint(1, 300)) for _ in range(8)]
    rows = list(enumerate(texts))
    stored = materialise(documents(spark, rows).repartition(3), "docs")
    found = {r.doc_id: r for r in fingerprints(stored).collect()}
    edited = []
    for i, t in rows:
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(t) // 4
        edited.append(t[: len(t) - q] + after[:q])
    frame = spark.createDataFrame([(f"t{i}", t or "") for i, t in rows] + [(f"e{i}", t) for i, t in enumerate(edited)], "k string, data string")
    marks = defaultdict(list)
    for r in anchors(frame.select("k", F.col("data").cast("binary").alias("data")), ["k"]).collect():
        marks[r.k].append((r.place, r.h))
    for i, t in rows:
        j = (i + 1) % len(rows)
        assert found[i].near_next == pytest.approx(positional(marks[f"t{i}"], marks[f"t{j}"], (t or "") == (rows[j][1] or ""))), i
        assert found[i].near_edited == pytest.approx(in_place(marks[f"t{i}"], marks[f"e{i}"], (t or "") == edited[i])), i
    assert found[0].near_next < 0.3 and found[1].near_next < 0.3  # the same blocks in another order
    assert found[3].near_next > 0.8 * 60 / 360  # a passage counts with its length
    assert found[5].near_next == 1.0 and found[7].near_next == 1.0 and found[8].near_next == 0.0
    assert all(r.near_edited > 0.6 for i, r in found.items() if len(texts[i] or "") > 400)


def test_anchors_are_context_free(spark):
    rnd = random.Random(1)
    core = "".join(rnd.choice("abcdef ") for _ in range(400))
    frame = spark.createDataFrame([(0, core), (1, "some other text " + core + " and an end")], "id long, data string")
    frame = frame.select("id", F.col("data").cast("binary").alias("data"))
    found = {i: {(r.place, r.h) for r in anchors(frame, ["id"]).where(F.col("id") == i).collect()} for i in (0, 1)}
    assert {(p + 16, h) for p, h in found[0]} <= found[1] and found[0]
    inside = {(p, h) for p, h in found[1] if 16 <= p <= 16 + len(core) - K}
    assert len(inside) == len(found[0]) and S < K


def test_an_item_without_id_hits_words_but_is_not_listed(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    items = spark.createDataFrame([(None, passage), (3, "w0 w1")], "item_id long, text string")
    rows = decontaminate(documents(spark, [(1, f"x {passage} y"), (2, "z w0 w1"), (3, "z")]), items).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in rows] == [(17, 15, 1, True), (3, 2, 1, True), (1, 0, 0, False)]
    none = hashlib.sha256(b"").hexdigest()
    assert [r.items_sha256 == hashlib.sha256(b"3").hexdigest() for r in rows] == [True, True, False] and rows[2].items_sha256 == none


def test_few_contaminated_rows_do_not_shuffle_the_texts(spark):
    rnd = random.Random(8)
    passage = " ".join(rnd.choice("alpha beta gamma delta".split()) for _ in range(20))
    rows = [(i, f"{passage} w{i}" if i % 10 == 0 else f"only words of its own w{i}") for i in range(200)]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = without_contaminated(materialise(documents(spark, rows), "docs"), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(200) if i % 10]
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
