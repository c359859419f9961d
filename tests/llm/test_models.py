"""Language identification, token ledgers and surrogates."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from cadentia.llm import language, ledger, pii
from cadentia.llm.tokens import BYTE_BPE, token_ids

from .helpers import documents

PIECES = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "/root/testdata/sf0.01/documents.parquet"
KEY = b"a test key"


def cuts(word):
    for marks in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *[i + 1 for i, m in enumerate(marks) if m], len(word)]
        yield [word[a:b] for a, b in zip(edges, edges[1:])]


def test_forward_sums_all_segmentations():
    index = language.pieces(PIECES)
    rng = np.random.default_rng(2)
    weights = rng.dirichlet(np.ones(len(index)), 3).T
    model = language.Model(PIECES, ["a", "b", "c"], weights)
    words = ["▁the", "▁ça", "▁größer", "▁lüße", "▁ﬄz"]
    got = language.word_scores(words, model)
    for word, row in zip(words, got, strict=True):
        for at in range(3):
            total = sum(
                math.prod(weights[index[p], at] if p in index else language.UNKNOWN if len(p) == 1 else 0 for p in cut)
                for cut in cuts(word)
            )
            assert row[at] == pytest.approx(math.log(total))
    long = "▁" + "größer" * 40
    table = language._lifted(weights, index)
    short = language._long_score("▁größer", index, table)
    assert short == pytest.approx(got[2]) and np.isfinite(language.word_scores([long], model)).all()


def test_long_words_of_unknown_letters_stay_finite():
    index = language.pieces(PIECES)
    model = language.Model(PIECES, ["a", "b"], np.full((len(index), 2), 1 / len(index)))
    for n in (30, 31, 32, 33, 60, 64, 65, 500):
        word = "▁" + "ꙮ" * n
        assert language.word_scores([word], model) == pytest.approx(
            np.full((1, 2), n * math.log(language.UNKNOWN) + math.log(1 / len(index))), rel=1e-9
        )
        langs, scores = language.Scorer(model).predict([word[1:]])
        assert langs == ["a"] and scores == [pytest.approx(0.5)]
        assert np.isfinite(language.expected_counts([word], np.array([1]), model.weights[:, 0], index)).all()


def test_token_ids_of_long_unbroken_texts():
    path = public_tokenizers.path(BYTE_BPE)
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    blanks = "\u3000\t \n " * 14_000
    for text in (" " * 1_200_000, "a" + "\n" * 1_200_000 + " b", f"{blanks}word{blanks}\x1c{blanks} ", "<|endoftext|>" + " " * 65_536 + "é"):
        assert token_ids(text, path).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_expected_counts_equal_enumeration():
    index = language.pieces(PIECES)
    weights = np.random.default_rng(3).dirichlet(np.ones(len(index)))
    got = language.expected_counts(["▁them"], np.array([3]), weights, index)
    shares = [(c, math.prod(weights[index[p]] if p in index else language.UNKNOWN if len(p) == 1 else 0 for p in c)) for c in cuts("▁them")]
    total = sum(p for _, p in shares)
    for piece in ("▁the", "m", "▁", "em"):
        want = 3 * sum(p / total * c.count(piece) for c, p in shares)
        assert got[index[piece]] == pytest.approx(want)


def test_language_report_on_held_out_rows(spark):
    docs = spark.read.parquet(DOCS)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !"), (None, "und der die das nicht")], "doc_id long, text string")
    whole = docs.select("doc_id", "text", "lang").unionByName(odd.withColumn("lang", F.lit(None).cast("string")))
    found = language.language_report(whole, PIECES, fit_rows=80)
    rows = found.join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(rows) == 1004
    held = [r for r in rows if r.held_out and r.lang]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sorted((r.doc_id, r.lang_pred, r.score) for r in rows if (r.doc_id or 0) < 0) == [(-3, "und", 0.0), (-2, "und", 0.0), (-1, "und", 0.0)]
    assert [r.lang_pred for r in rows if r.doc_id is None] == ["de"]
    assert all(0 <= r.score <= 1 for r in rows)
    unlearned = language.language_report(documents(spark, [(1, "some text")]).withColumn("lang", F.lit(None).cast("string")), PIECES)
    assert [r.lang_pred for r in unlearned.collect()] == ["und"]


def test_ledger_commits_once_and_revises(spark, tmp_path):
    book = ledger.TokenLedger(spark, str(tmp_path / "book"))
    deltas = lambda rows: spark.createDataFrame(rows, "source string, lang string, tokenizer string, docs long, tokens long")
    assert book.totals().count() == 0
    assert book.commit("a", deltas([("s", "en", "t1", 1, 10), ("s", "en", "t1", 1, 5), (None, None, "t1", 1, 0)]))
    assert not book.commit("a", deltas([("s", "en", "t1", 1, 10)]))
    assert book.commit("b", deltas([("s", "en", "t1", -1, -5), ("s", "en", "t2", 1, 4), ("gone", "en", "t1", -1, -2)]))
    assert {tuple(r) for r in book.totals().collect()} == {("s", "en", "t1", 1, 10), (None, None, "t1", 1, 0), ("s", "en", "t2", 1, 4), ("gone", "en", "t1", -1, -2)}
    assert [r.source for r in book.open_groups().collect()] == ["gone"]
    # A commit that failed before its list of batches was complete leaves the old version in force.
    (tmp_path / "book" / "v3" / "totals").mkdir(parents=True)
    assert book.version() == 2 and book.commit("c", deltas([("gone", "en", "t1", 1, 2)]))
    assert book.version() == 3 and book.open_groups().count() == 0 and book.totals().count() == 3


def test_maintained_counts_equal_a_recount(spark):
    path = public_tokenizers.path(BYTE_BPE)
    texts = [None, "", "one text", "one text", " padded\n", " padded\n", "größer 日本", "x" * 5000]
    rows = [*enumerate(texts), (None, "alone"), (7, texts[7])]
    found = ledger.maintained_counts(documents(spark, rows), {"v1": path}).collect()
    first, kept = {}, []
    for i, t in rows:
        first[t or ""] = min(x for x in (first.get(t or ""), i) if x is not None) if i is not None else first.get(t or "")
    for i, t in rows:
        if first[t or ""] == i:
            kept.append((t or "").strip())
    assert [(r.source, r.lang, r.tokenizer, r.docs, r.tokens) for r in found] == [("src0", "en", "v1", len(kept), sum(len(token_ids(t, path)) for t in kept))]
    assert ledger.maintained_counts(documents(spark, []), {"v1": path}).count() == 0


def test_phone_surrogates_permute_their_class_and_end():
    for key in range(30):
        for numbers in ([f"0{i}" for i in range(10)], [str(i) for i in range(10, 100)]):
            new = [pii.surrogate("phone", f"|{n}", b"%d" % key) for n in numbers]
            assert sorted(new) == [f"|{n}" for n in numbers]


def test_surrogates_keep_type_and_distinctness():
    rnd = random.Random(1)
    cards = ["4" + "".join(rnd.choice("0123456789") for _ in range(14)) for _ in range(300)]
    cards = [c + str(pii.luhn(c)) for c in cards]
    new = [pii.surrogate("card", c, KEY) for c in cards]
    assert len(set(new)) == len(set(cards)) and all(n[0] == "4" and pii.luhn(n[:-1]) == int(n[-1]) for n in new)
    two = [f"{a}{b}" for a in range(10) for b in range(10)]
    assert sorted("".join(map(str, pii._permuted([int(c) for c in x], 10, KEY, "t"))) for x in two) == two
    three = {tuple(pii._permuted([a, b, c], 5, KEY, "t")) for a in range(5) for b in range(5) for c in range(5)}
    assert len(three) == 125
    text = "Mrs Anna Schmidt, +1 (499) 555-6503, Bob.X9@Mail.example.com 42.144.35.254 and Mrs Schmidt; г-жа Иванова 4785 3805 9239 1139."
    got, kinds = pii.rewrite(text, KEY, {})
    assert kinds == ["given_f", "surname", "phone", "email", "ip", "surname", "surname", "card"]
    for real in ("Schmidt", "Anna", "499", "6503", "Bob", "42.144", "Иванова", "9239"):
        assert real not in got
    words = got.replace(",", "").replace(";", "").split()
    assert words[2] == words[words.index("and") + 2] and words[1].endswith("a")
    assert all("Ѐ" <= c <= "ӿ" for c in words[words.index("г-жа") + 1])
    assert pii.rewrite("+1 499 555 6503", KEY, {})[0].replace(" ", "") == "".join(c for c in got.split(", ")[1] if c.isdigit() or c == "+")
    assert pii.rewrite("nothing here 12 in 1999", KEY, {}) == ("nothing here 12 in 1999", [])


def test_pseudonymise_checks_collisions(spark, monkeypatch):
    # Every first draw of an address is the same or a real one; later draws differ.
    taken = pii.surrogate
    rows = [(1, "a@b.co and c@d.co"), (2, "c@d.co, e@f.co"), (3, None), (4, ""), (None, "A@B.co"), (1, "a@b.co and c@d.co")]
    mapping = {}
    found = pii.pseudonymise(documents(spark, rows), KEY).collect()
    assert len(found) == len(rows)
    text = {r.doc_id: r.text for r in found}
    mapping = dict(zip(["a", "c"], text[1].split(" and "), strict=True))
    assert text[2].split(", ")[0] == mapping["c"] and text[None].lower() == mapping["a"] and text[3] is None and text[4] == ""
    entities = spark.createDataFrame([("ip", f"1.2.3.{i}") for i in range(40)] + [("ip", taken("ip", "1.2.3.4", KEY))], "kind string, entity string")
    attempts = {(r.kind, r.entity): r.attempt for r in pii.checked_attempts(entities, KEY).collect()}
    assert attempts["ip", "1.2.3.4"] == 1 and len(attempts) == 41
    chosen = [taken(k, e, KEY, a) for (k, e), a in attempts.items()]
    assert len(set(chosen)) == 41 and not set(chosen) & {e for _, e in attempts}
    assert pii.pseudonymise(documents(spark, []), KEY).count() == 0


def test_surrogate_names_do_not_run_out(spark):
    # More surnames than three syllables can name.
    n = len(pii.SYLLABLES["latin"]) ** 3 + 3000
    names = spark.range(n).select(F.lit("surname").alias("kind"), F.concat(F.lit("q"), F.conv("id", 10, 26)).alias("entity"))
    found = pii.checked_attempts(names, KEY, most=8).collect()
    chosen = {pii.surrogate(r.kind, r.entity, KEY, r.attempt) for r in found}
    assert len(found) == len({r.entity for r in found}) == len(chosen) == n
    assert len({pii.surrogate("given_f", "anna", KEY, a) for a in range(40)}) == 40


def test_whole_names_and_bare_mentions_are_replaced(spark):
    shown = lambda text: [(text[a:b], k) for a, b, k, _ in pii.mentions(text)]
    assert shown("Mrs. Anna Maria Schmidt met us") == [("Anna", "given_f"), ("Maria", "given_f"), ("Schmidt", "surname")]
    text = "Dr. John F. Kennedy came. Then Kennedy said to John: Mr. J.-P. van der Berg and Dr O'Brien's dog"
    assert shown(text) == [
        ("John", "given_x"), ("F", "initial"), ("Kennedy", "surname"), ("Kennedy", "surname"), ("John", "given_x"),
        ("J", "initial"), ("P", "initial"), ("Berg", "surname"), ("O'Brien", "surname"),
    ]
    assert shown("Mrs Schmidt Dr Kennedy, Schmidt@mail.com") == [("Schmidt", "surname"), ("Kennedy", "surname"), ("Schmidt@mail.com", "email")]
    assert shown("Dr. Παπάς είναι καλός") == [("Παπάς", "surname")]
    assert shown("Kennedy alone, and Dr. in front of none 123-45-6789") == [("123-45-6789", "ssn")]
    new = pii.rewrite(text, KEY, {})[0]
    assert not any(x in new for x in ("John", "F.", "Kennedy", "J.", "P.", "Berg", "Brien"))
    assert len({pii.surrogate("initial", c, KEY) for c in "abcdefghijklmnopqrstuvwxyz"}) == 26
    # One person, with and without a title that tells the gender, in one text and in two.
    rows = [(1, "Mrs. Anna Schmidt"), (2, "Dr. Anna Schmidt"), (3, "Prof. Anna Schmidt, later Mrs. Anna and Ms. Anna Schmidt")]
    found = {r.doc_id: r.text.replace(",", "").split() for r in pii.pseudonymise(documents(spark, rows), KEY).collect()}
    assert found[1][1:] == found[2][1:] == found[3][1:3] == found[3][-2:] and found[3][5] == found[1][1]
