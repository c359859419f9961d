"""Prefix tries and chat formatting against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cadentia.llm import prefix_trie as trie
from cadentia.llm.chat import TRAP, format_conversations, formatting_report, with_trap
from cadentia.session import materialise

NAMES = "conv_id long, turn long, role string, text string"


def table(spark, rows, parts=3):
    """A stored table in several files, with extra columns whose names clash with those the operators make."""
    full = [(*r, 1, "x", 2, 3, 4) for r in rows]
    names = NAMES + ", ref long, digest string, part int, depth long, slot long"
    return materialise(spark.createDataFrame(full, names).repartition(parts), "rows")


def ordered(spark, rows):
    """Turns of every conversation in order; ties are broken by Spark's hash of role and text."""
    digest = F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    out = defaultdict(list)
    for r in spark.createDataFrame(rows, NAMES).withColumn("digest", digest).collect():
        out[r.conv_id].append((r.turn is not None, r.turn or 0, r.digest, r.role or "", r.text or ""))
    return {c: [(role, text) for *_, role, text in sorted(turns)] for c, turns in out.items()}


def brute_trie(spark, rows):
    own = {c: t for c, t in ordered(spark, rows).items() if c is not None}
    rebuilt = {}
    for c, turns in own.items():
        base, h = c - int(c / 5) * 5, zlib.crc32(str(c).encode()) % 9
        base = c - base
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        key = hashlib.sha256(b"").digest()
        members[(0, key)].append((c, None, None))
        for d, turn in enumerate(turns, 1):
            parent, key = (d - 1, key), hashlib.sha256(key + repr(turn).encode()).digest()
            members[(d, key)].append((c, parent, turn))
    children, ends = defaultdict(list), defaultdict(list)
    for node, found in members.items():
        if node[0]:
            children[found[0][1]].append(node)
        ends[node] = sorted(c for c, *_ in found if len(rebuilt[c]) == node[0])
    sums = {}
    for node in sorted(members, reverse=True, key=lambda n: n[0]):
        found, below = members[node], [sums[x] for x in children[node]]
        saved = (len(found) - 1) * len(found[0][2][1].encode()) if node[0] else 0
        sums[node] = (sum(x for x, _ in below) or 0 if below else 1, saved + sum(x for _, x in below))
    out = []
    for node, found in members.items():
        parent = found[0][1]
        listed = ",".join(map(str, ends[node])).encode()
        out.append((min(c for c, *_ in found), node[0], min(c for c, *_ in members[parent]) if parent else None, len(found),
                    len(children[node]), *sums[node], hashlib.sha256(listed).hexdigest()))
    return sorted(out, key=str)


def conversations(rnd):
    rows = []
    say = lambda: rnd.choice(["", None, "é", "yes", "no " * rnd.randint(1, 4), "\U0001f600 ok"])
    for c in [*range(0, 60), *range(-12, -1), 10**15, 10**15 + 5]:
        if c % 7 == 3:
            continue
        for t in range(rnd.choice([0, 1, 2, 3, 9, 14])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), say()))
    rows += [(7, None, "user", "first of all"), (7, 1, "user", "tie a"), (7, 1, "user", "tie b"), (7, 1, "user", "tie b")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    return rows


def test_trie_equals_brute_force(spark):
    rows = conversations(random.Random(11))
    got = sorted((tuple(r) for r in trie.prefix_trie(table(spark, rows)).collect()), key=str)
    assert got == brute_trie(spark, rows)


def test_trie_of_long_and_of_equal_conversations(spark):
    """Long conversations lie in many slots; the list of those that end in one node lies in many chunks."""
    rnd = random.Random(12)
    long = [(rnd.choice(["user", "assistant"]), str(rnd.random())) for _ in range(700)]
    rows = [(5 * c, t, *turn) for c, n in ((0, 700), (1, 700), (2, 699), (9, 350)) for t, turn in enumerate(long[:n])]
    rows += [(1000 + 5 * c, t, "user", f"copy {t}") for c in range(400) for t in range(2)]
    rows.append((2, 0, "user", "x" * 200_000))
    # A growing log: every conversation adds one turn to the one before.
    rows += [(10_000 + 5 * c, t, "user", f"log {t}") for c in range(30) for t in range(c + 1)]
    got = sorted((tuple(r) for r in trie.prefix_trie(table(spark, rows, 5)).collect()), key=str)
    assert got == brute_trie(spark, rows)


def test_trie_survives_equal_fingerprints_and_no_rows(spark, monkeypatch):
    assert trie.prefix_trie(table(spark, [])).count() == 0
    assert trie.prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(0, 40, 5) for t in range(3)]
    real = F.xxhash64
    # The first seed gives every turn the same hash in every lane.
    first = lambda *c: F.lit(5).cast("long") if len(c) == 3 and tries[0] == 1 else real(*c)
    tries, running = [0], trie.running_products

    def counted(frame, seed):
        tries[0] += 1
        return running(frame, seed)

    monkeypatch.setattr(trie, "running_products", counted)
    monkeypatch.setattr(trie.F, "xxhash64", first)
    got = sorted((tuple(r) for r in trie.prefix_trie(table(spark, rows)).collect()), key=str)
    monkeypatch.undo()
    assert tries[0] == 2 and got == brute_trie(spark, rows)
    with pytest.raises(RuntimeError):
        trie.prefix_trie(table(spark, rows), seeds=range(0))


def parse(formatted):
    """The grammar read plainly."""
    out = []
    for piece in formatted.split("### ")[1:]:
        role, rest = piece.split(": ", 1)
        text, end = rest.split("</turn>", 1)
        assert end == "\n"
        out.append(tuple(re.sub(r"\\([.-])", lambda m: "\\" if m[1] == "-" else "", x) for x in (role, text)))
    return out


def awkward(rnd):
    parts = ["### ", "</turn>", "\\", "\\.", "\\-", ": ", "#", "##", "<", "</tur", "n>", "\n", "a", "é", "\U0001f600", " ", "user", "assistant"]
    say = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
    rows = [(c, t, rnd.choice(["user", "assistant", None, say()]), rnd.choice([None, "", say(), say()])) for c in range(80) for t in range(rnd.randint(1, 9))]
    return rows + [(3, None, "assistant", "first"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, 0, "user", "nobody"), (4, 99, "assistant", "< \\" * 40_000)]


def digests(turns):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    loss = "".join(text for role, text in turns if role == "assistant")
    return len(turns), sha("".join(f"{role}\n{text}\n" for role, text in turns)), len(loss), sha(loss)


@pytest.mark.parametrize("most", [1024, 3])
def test_chat_round_trip(spark, most):
    rows = awkward(random.Random(13))
    want = ordered(spark, rows)
    frame = table(spark, rows)
    texts, loss = defaultdict(str), defaultdict(str)
    for r in sorted(format_conversations(frame, most).collect(), key=lambda r: r.part):
        texts[r.conv_id] += r.formatted
        for s in r.spans:
            assert r.formatted[s.turn_start : s.turn_start + 4] == "### "
            loss[r.conv_id] += re.sub(r"\\([.-])", lambda m: "\\" if m[1] == "-" else "", r.formatted[s.start : s.end])
    assert {c: parse(t) for c, t in texts.items()} == want
    assert dict(loss) == {c: "".join(x for role, x in t if role == "assistant") for c, t in want.items()}
    got = {r.conv_id: r for r in formatting_report(frame, most).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == {c: digests(t) for c, t in want.items()}
    assert {c: r.formatted_chars for c, r in got.items()} == {c: len(t) for c, t in texts.items()}


def test_chat_trap_and_no_rows(spark):
    assert format_conversations(table(spark, [])).count() == 0
    (row,) = formatting_report(with_trap(table(spark, []))).collect()
    assert (row.conv_id, row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (-7, *digests([("user", TRAP), ("assistant", TRAP)]))
    (text,) = format_conversations(with_trap(table(spark, []))).collect()
    assert text.formatted.count("### ") == 2 and text.formatted.count("</turn>") == 2
    plain = format_conversations(table(spark, [(1, 0, "user", "a \\ b")])).collect()
    assert plain[0].formatted == "### user: a \\ b</turn>\n"
