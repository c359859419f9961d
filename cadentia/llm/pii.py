"""Surrogates for personal data.

Detected entities are replaced by keyed surrogates of the same type: digits stay digits, letters
letters of the same script, separators, lengths, country codes, card issuers and check
digits keep their form, given names keep the gender of their title. The same entity gets the same surrogate
everywhere, in whatever format it is written. Digit and letter strings go through a keyed Feistel
permutation, walked until the result is of the same class as the original, which keeps different entities
different. Names are built from syllables, one more with each attempt, so that names do not run out.

A name behind a title is the whole run of capitalised words, initials and particles; particles stay, and initials
become other initials. A name behind a title is also replaced where the text mentions it without one. A single word
counts as surname unless the text has it as a given name only. A given name behind a title that tells no gender
is the one with a gender, if the text or else the corpus has it with one gender only.

Collision check: all distinct entities of the corpus get their surrogate in one table. A surrogate that
another entity also has, or that is itself an entity of the corpus, is drawn again with the
next attempt number, until none is left.

Scale: detection is a map over Arrow batches. Only distinct (kind, entity) rows are shuffled, combined
on the map side, so an entity in a third of all documents is a row per task. Texts are not shuffled
unless entities were drawn again or got their gender from elsewhere; then the rows that mention those are joined with them.

Edge cases: null text stays null, empty text empty. Repeated rows are rewritten row by row. Null
doc_ids are kept. Only the named columns are read. An empty table gives an empty result. The input must be deterministic.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadentia.session import materialise

FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|г-жа|госпожа"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Signor|г-н|господин"
EITHER = "Dr|Prof"
_CAPITAL = r"[^\W\d_a-zà-öø-ÿа-я]"
_NAME = rf"{_CAPITAL}(?:[^\W\d_]+(?:['’]{_CAPITAL}[^\W\d_]+)*|['’]{_CAPITAL}[^\W\d_]+)(?:-[^\W\d_]+)*"
_INITIAL = rf"{_CAPITAL}(?:\.(?:-?{_CAPITAL}\.)*|(?= {_CAPITAL}))"
PARTICLE = "von|vom|van|zu|zur|zum|der|den|dem|ter|ten|de|del|della|di|da|do|dos|du|des|la|le|los|las|e|y|af|av|bin|ibn|al|el|ben|фон|ван|де"
_WORD = rf"(?!(?:{FEMALE}|{MALE}|{EITHER})(?!\w))(?:{_NAME}|{_INITIAL})"
FIND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
    rf"|(?<!\w)(?:(?P<f>{FEMALE})|(?P<m>{MALE})|(?P<x>{EITHER}))\.?"
    rf" (?P<name>(?:(?:{PARTICLE}) )*{_WORD}(?: (?:(?:{PARTICLE}) )*{_WORD})*)"
)
SPACED = re.compile(r"[^ ]+")
BARE = re.compile(rf"(?<!\w){_NAME}(?!\w)")
# Most texts hold nothing of the kind; this is cheaper than the search above.
HINT = re.compile(rf"@|\d[\d ().-]{{5}}|[A-Z]{{2}}\d\d|(?<!\w)(?:{FEMALE}|{MALE}|{EITHER})\.? ")

SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve".split(),
    "cyrillic": "ба бе бо ва ве ви да де до за зи ка ки ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се та те ти то".split(),
    "greek": "βα βε γα γι δα δε δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρι σα σε τα τε τι το".split(),
}
ENDINGS = {"latin": {"f": "a", "m": "n", "x": "l"}, "cyrillic": {"f": "на", "m": "н", "x": "ль"}, "greek": {"f": "α", "m": "ος", "x": "ι"}}

Mention = tuple[int, int, str, str]


def mentions(text: str) -> list[Mention]:
    """(start, end, kind, entity) of every entity, in order, without overlaps."""
    if not HINT.search(text):
        return []
    found, people, at = [], [], 0
    while m := FIND.search(text, at):
        at = m.end()
        if (title := m["f"] and "f" or m["m"] and "m" or m["x"] and "x") and m["name"]:
            words = []
            for word in SPACED.finditer(text, *m.span("name")):
                # The pattern takes small letters of some alphabets for capitals; a name ends there.
                if word[0][0].islower() and not re.fullmatch(PARTICLE, word[0]):
                    at = word.start()
                    break
                words.append((word.start(), word.end(), word[0]))
            people.append((title, [w for w in words if not w[2][0].islower()]))
            continue
        found.append((m.start(), m.end(), m.lastgroup, _entity(m.lastgroup, m.group())))
    return sorted(found + _names(text, people, found)) if people else found


def _is_initial(word: str) -> bool:
    return len(word) == 1 or "." in word


def _names(text: str, people: list, others: list[Mention]) -> list[Mention]:
    """Mentions of the people whose ``(title, words)`` are given, behind their titles and bare."""
    given, surnames, found = {}, set(), []
    for title, words in people:
        full = [w.lower() for *_, w in words if not _is_initial(w)]
        if len(words) > 1 and full:
            surnames.add(full[-1])
        for word in full[:-1]:
            given.setdefault(word, set()).add(title)
    kinds = {word: "given_" + (min(t - {"x"}) if len(t - {"x"}) == 1 else "x") for word, t in given.items()}
    known = dict(kinds)
    for title, words in people:
        full = [w for w in words if not _is_initial(w[2])]
        for start, end, word in words:
            entity = word.lower()
            if _is_initial(word):
                found += [(start + i, start + i + 1, "initial", c.lower()) for i, c in enumerate(word) if c.isalpha()]
            elif (start, end, word) != full[-1]:
                found.append((start, end, kinds[entity] if title == "x" else f"given_{title}", entity))
            else:
                kind = kinds[entity] if len(words) == 1 and entity in kinds and entity not in surnames else "surname"
                found.append((start, end, kind, entity))
                # As a bare word it is the surname, unless it is nobody's.
                known[entity] = kind
    taken, at = sorted((s, e) for s, e, *_ in found + others), 0
    for m in BARE.finditer(text):
        whole = m[0].lower()
        spots = [m.span()] if whole in known else [p.span() for p in re.compile(r"[^-]+").finditer(text, *m.span())]
        for start, end in spots:
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if (entity := text[start:end].lower()) in known and not (at < len(taken) and taken[at][0] < end):
                found.append((start, end, known[entity], entity))
    return found


def _entity(kind: str, shown: str) -> str:
    """The entity behind a mention, whatever its format."""
    if kind in ("email", "ip"):
        return shown.lower()
    if kind == "iban":
        return shown.replace(" ", "")
    digits = re.sub(r"\D", "", shown)
    if kind == "phone" and shown[0] == "+":
        code = re.match(r"\+(\d{1,3}?)(?=[ .(-]|\d{7,10}$)", shown)
        n = len(code[1]) if code else 1
        return f"{digits[:n]}|{digits[n:]}"
    return f"|{digits}" if kind == "phone" else digits


def _number(secret: bytes, *parts) -> int:
    told = "\x1f".join(map(str, parts)).encode()
    return int.from_bytes(hashlib.blake2b(told, key=secret, digest_size=8).digest(), "big")


def _permuted(values: list[int], radix: int, secret: bytes, tweak: str) -> list[int]:
    """Keyed permutation of the strings of this length over digits 0 .. radix - 1."""
    n = len(values)
    if n == 0:
        return values
    if n == 1:
        return [(values[0] + _number(secret, tweak, "one")) % radix]
    whole = lambda digits: sum(d * radix**i for i, d in enumerate(digits))
    half = n // 2
    sizes = (radix**half, radix ** (n - half))
    a, b = whole(values[:half]), whole(values[half:])
    for i in range(8):
        a, b = b, (a + _number(secret, tweak, n, i, b)) % sizes[i % 2]
    # After an even number of rounds the halves are back in their places.
    out = []
    for x, k in ((a, half), (b, n - half)):
        for _ in range(k):
            out.append(x % radix)
            x //= radix
    return out


def _characters(text: str, secret: bytes, tweak: str) -> str:
    """Permute the letters among letters and the digits among digits; the rest is the text's shape."""
    shape = "".join("a" if c.isalpha() else "0" if c.isdigit() else c for c in text)
    letters = iter(_permuted([ord(c) - 97 for c in text if "a" <= c <= "z"], 26, secret, f"{tweak}:a:{shape}"))
    digits = iter(_permuted([int(c) for c in text if c.isdigit()], 10, secret, f"{tweak}:0:{shape}"))
    return "".join(chr(97 + next(letters)) if "a" <= c <= "z" else str(next(digits)) if c.isdigit() else c for c in text)


def luhn(digits: str) -> int:
    """The check digit that belongs behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def surrogate(kind: str, entity: str, secret: bytes, attempt: int = 0) -> str:
    """The entity that stands in for ``entity``."""
    tweak = f"{kind}:{attempt}"
    if kind == "initial":
        low, n = next((b for b in ((0x61, 26), (0x430, 32), (0x3B1, 25)) if b[0] <= ord(entity) < sum(b)), (0x61, 26))
        # Never the letter itself; other letters than these become one of the first alphabet.
        return chr(low + (ord(entity) - low + 1 + _number(secret, kind, low) % (n - 1)) % n)
    if kind == "email":
        local, _, domain = entity.partition("@")
        # The reserved top-level name keeps surrogates from being anyone's address.
        return f"{_characters(local, secret, f'{tweak}:{domain}')}@{_characters(domain, secret, f'domain:{attempt}')}.example"
    if kind == "ip":
        first, *rest = map(int, entity.split("."))
        low = _permuted(rest, 256, secret, f"{tweak}:{first}")
        public = [i for i in range(1, 224) if i not in (10, 100, 127, 169, 172, 192)]
        if first in public:
            order = sorted(public, key=lambda i: _number(secret, tweak, "first", i))
            first = order[public.index(first)]
        return ".".join(map(str, [first, *low]))
    if kind == "card":
        off = (int(entity[-1]) - luhn(entity[:-1])) % 10
        body = entity[0] + "".join(map(str, _permuted(list(map(int, entity[1:-1])), 10, secret, tweak + entity[0])))
        return body + str((luhn(body) + off) % 10)
    if kind == "iban":
        own = _characters(entity[4:].lower(), secret, tweak + entity[:2]).upper()
        number = "".join(str(int(c, 36)) for c in own + entity[:2] + "00")
        return f"{entity[:2]}{98 - int(number) % 97:02d}{own}"
    if kind == "ssn":
        return "".join(map(str, _permuted(list(map(int, entity)), 10, secret, tweak)))
    if kind == "phone":
        code, _, digits = entity.partition("|")
        dialled = lambda d: (len(d) != 10 or (d[0] > "1") + 2 * (d[3] > "1"), d[0] == "0")
        turned = lambda d: "".join(map(str, _permuted(list(map(int, d)), 10, secret, tweak)))
        # The walk ends at the number itself at the latest; the collision check then draws it again.
        now = turned(digits)
        while dialled(now) != dialled(digits):
            now = turned(now)
        return f"{code}|{now}"
    return _name_like(entity, kind[-1] if kind.startswith("given") else "x", secret, tweak, attempt)


def _name_like(word: str, gender: str, secret: bytes, tweak: str, attempt: int) -> str:
    first = next((c for c in word if c.isalpha()), "a")
    script = "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" else "latin"
    if script == "latin" and first > "ɏ":
        # Letters of another script: draw from the letters of the same block.
        block = [chr(c) for c in range(ord(first) & ~0x7F, (ord(first) & ~0x7F) + 128) if chr(c).isalpha()]
        return "".join(block[_number(secret, tweak, word, i) % len(block)] for i in range(max(2, len(word)) + attempt))
    draw, out = _number(secret, tweak, word), ""
    for i in range(3 + attempt):
        if i and i % 10 == 0:  # a number is good for ten syllables
            draw = _number(secret, tweak, word, i)
        draw, at = divmod(draw, len(SYLLABLES[script]))
        out += SYLLABLES[script][at]
    return out + ENDINGS[script][gender]


def shown_as(kind: str, mention: str, entity: str) -> str:
    """Write a surrogate entity in the format of the mention."""
    if kind in ("card", "ssn", "phone", "iban"):
        characters = iter(entity.replace("|", ""))
        return "".join(next(characters) if c.isalnum() else c for c in mention)
    if mention.isupper() and len(mention) > 1:
        return entity.upper()
    return entity.title() if mention[0].isupper() and kind not in ("email", "ip") else entity


def rewrite(
    text: str, secret: bytes, attempts: dict[tuple[str, str], int], gendered: dict[str, str] | None = None
) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced; ``gendered`` holds kinds of given names without one."""
    out, at, kinds = [], 0, []
    for start, end, kind, entity in mentions(text):
        if kind == "given_x" and gendered:
            kind = gendered.get(entity, kind)
        chosen = surrogate(kind, entity, secret, attempts.get((kind, entity), 0))
        out += [text[at:start], shown_as(kind, text[start:end], chosen)]
        at = end
        kinds.append(kind)
    return "".join([*out, text[at:]]), kinds


def _mentioned(rows: DataFrame) -> DataFrame:
    """``row, kind, entity`` of every mention."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(r, k, e) for r, t in zip(frame["row"], frame["text"], strict=True) for *_, k, e in mentions(t or "") if k != "initial"]
            yield pd.DataFrame(found, columns=["row", "kind", "entity"])

    return rows.mapInPandas(find, "row long, kind string, entity string")


def checked_attempts(entities: DataFrame, secret: bytes, most: int = 100) -> DataFrame:
    """``kind, entity, attempt`` of distinct entities, such that no surrogate is shared or an entity itself."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["chosen"] = [surrogate(k, e, secret, a) for k, e, a in zip(frame.kind, frame.entity, frame.attempt, strict=True)]
            yield frame

    schema = "kind string, entity string, attempt int, chosen string"
    real = entities.select("kind", F.col("entity").alias("chosen"))
    settled, waiting = None, entities.select("kind", "entity", F.lit(0).alias("attempt"))
    for _ in range(most):
        drawn = materialise(waiting.mapInPandas(draw, schema), "drawn")
        free = drawn.join(real, ["kind", "chosen"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "chosen"), ["kind", "chosen"], "left_anti")
        first = free.groupBy("kind", "chosen").agg(F.min("entity").alias("entity"))
        won = materialise(free.join(first, ["kind", "chosen", "entity"], "left_semi").select(*drawn.columns), "won")
        settled = won if settled is None else settled.unionByName(won)
        lost = drawn.join(won, ["kind", "entity"], "left_anti")
        waiting = materialise(lost.select("kind", "entity", (F.col("attempt") + 1).alias("attempt")), "waiting")
        if waiting.isEmpty():
            return settled.select("kind", "entity", "attempt")
    raise RuntimeError(f"surrogates still collide after {most} attempts")


def pseudonymise(docs: DataFrame, secret: bytes) -> DataFrame:
    """Per row of ``docs``: doc_id, the text with surrogates, and how many entities of which kinds it had."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = _mentioned(rows.select("row", "text"))
    entities = materialise(found.select("kind", "entity").distinct(), "entities")
    # Given names without a gender that have one elsewhere in the corpus.
    sure = entities.where(F.col("kind").isin("given_f", "given_m")).groupBy("entity")
    sure = sure.agg(F.min("kind").alias("as_kind"), F.count("*").alias("n")).where("n = 1").drop("n")
    told = entities.where("kind = 'given_x'").join(sure, "entity").select("kind", "entity", "as_kind")
    own = entities.join(told, ["kind", "entity"], "left_anti")
    drawn = checked_attempts(own, secret).where("attempt > 0").select("kind", "entity", "attempt")
    also = told.join(drawn.withColumnRenamed("kind", "as_kind"), ["as_kind", "entity"], "left")
    again = drawn.withColumn("as_kind", F.col("kind")).unionByName(
        also.select("kind", "entity", F.coalesce("attempt", F.lit(0)).alias("attempt"), "as_kind")
    )
    again = materialise(again, "drawn-again")
    none = F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int,as_kind:string>>")
    if again.isEmpty():
        rows = rows.withColumn("again", none)
    else:
        touched = _mentioned(rows.select("row", "text")).distinct().join(again, ["kind", "entity"])
        lists = touched.groupBy("row").agg(F.collect_list(F.struct("kind", "entity", "attempt", "as_kind")).alias("again"))
        rows = rows.join(lists, "row", "left")

    @F.pandas_udf("text string, n_entities long, kinds string")
    def replaced(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, agains in batches:
            out = []
            for text, again in zip(texts, agains, strict=True):
                if text is None:
                    out.append((None, 0, ""))
                    continue
                again = again if again is not None else ()
                attempts = {(a["as_kind"], a["entity"]): a["attempt"] for a in again}
                gendered = {a["entity"]: a["as_kind"] for a in again if a["kind"] != a["as_kind"]}
                new, kinds = rewrite(text, secret, attempts, gendered)
                out.append((new, len(kinds), ",".join(f"{k}:{kinds.count(k)}" for k in sorted(set(kinds)))))
            yield pd.DataFrame(out, columns=["text", "n_entities", "kinds"])

    return rows.select("doc_id", replaced("text", "again").alias("r")).select("doc_id", "r.*")
