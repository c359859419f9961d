"""Secret scans by dictionary-primed zstandard novelty.

Candidates are the matches of the base kinds, every long unbroken string that
stands behind a sensitive word, and the strings that run on behind one of these with only a separator
between (lines of a key, parts of a token). Private keys between their BEGIN and END marks are one candidate. A candidate's novelty is the number of compressed bytes it
adds to the text around it, per character, with the compressor primed by
a dictionary of identifiers usual in code. Words, paths and repeated strings
cost few bytes; random keys cost what their entropy demands. Base matches are
always reported; the other candidates only where their novelty is high, and as a whole if a base match of
digits lies inside them. A rest shorter than ``LEAST`` is reported with the part before it, if it is no word or number.

Scale: a map over Arrow batches without any shuffle. Work is in proportion to the length of a candidate:
every window of ``MEASURED`` bytes, each half over the one before, is compressed behind ``AROUND`` characters of
context on each side, and the highest value counts. Spans always cover the whole match.

Edge cases: null and empty texts have no spans, and their digest is that of the empty string.
Repeated rows and null doc_ids are scanned row by row. Only doc_id and text are read.
An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds, in the order in which ties are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(
    r"passw|passphrase|secret|token|api_?key|credential|private|auth|bearer|access|signature", re.I | re.A
)
LEAST = 20  # characters of a candidate
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PART = re.compile("[A-Za-z0-9+/_=-]+")
# What may stand between the parts of one secret; blanks only around the end of a line.
JOINT = re.compile(r"""(?:[.:"'`\\]|[\x20\t]*+[\r\n]++[\x20\t]*+)++""")
# Shorter parts that are no word, number or rule: letters with digits or signs, or capitals behind small letters.
REST = re.compile("(?=[^A-Za-z]*+[A-Za-z])(?:[A-Za-z_-]*+[0-9+/=]|[A-Z_-]*+[a-z_-]++[A-Z])")
KEY_MARK = re.compile("-{4,5} ?(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-{4,5}")
REACH = 40  # characters before a candidate in which a sensitive word counts
AROUND = 256  # characters of context on each side
MEASURED = 512  # bytes of a candidate that are compressed at a time
NOVELTY = 0.5  # compressed bytes added per byte

IDENTIFIERS = b"""
abstract apache application argument array async attribute author await base64 boolean branch buffer build
callback catch char class client close color column com commit component config configuration connect const
content context continue controller copyright count create current data database date debug default define
delete description dev directory document double element else email encode encrypt endpoint enum environment
error event exception export extends false file filter final float folder for format function generate get
github handler hash header height hidden host html http https id implements import include index init input
insert instance int integer interface item json key label lambda length level library license link list
local localhost location log login long main manager map master message metadata method model module name
namespace new node null number object option order org output package page param parameter parent parse
password path pattern port position prefix print private process production project property protected
protocol public query random read record regex release remove repository request required resource response
result return root row run schema secret select self server service session set setting size sort source
spec src start state static status string struct style sub success super switch system table tag target
task template test text this thread time timeout timestamp title token true try type undefined unit update
upload uri url user username util value var variable vector version view void while width window www xml
abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ 0000000000000000 example placeholder changeme
"""


@functools.cache
def _dictionary() -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


@functools.cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(
        level=9, dict_data=_dictionary(), write_checksum=False, write_content_size=False, write_dict_id=False
    )


def novelty(before: str, candidate: str, after: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, per byte (0 to about 1), in its newest window."""
    own = candidate.encode()
    head, tail = before[-AROUND:].encode(), after[:AROUND].encode()
    compress = _compressor().compress
    # The surroundings come first in all, so that the candidate may point back into all of them.
    around = head + b"\n" + tail + b"\n"
    alone = len(compress(around))
    # The last window is as long as the others: a short one would look newer than it is.
    starts = [*range(0, len(own) - MEASURED, MEASURED // 2), max(0, len(own) - MEASURED)]
    windows = (own[i : i + MEASURED] for i in starts)
    return max(0.0, *((len(compress(around + w)) - alone) / max(1, len(w)) for w in windows))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of every base match that is long enough."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def key_blocks(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, start and end of the body) of every private key that has both marks."""
    marks = list(KEY_MARK.finditer(text)) if "PRIVATE KEY" in text else []
    return [
        (a.start(), b.end(), a.end(), b.start())
        for a, b in zip(marks, marks[1:], strict=False)
        if a[1] == "BEGIN" and b[1] == "END"
    ]


def candidates(text: str, base: list) -> list[tuple[int, int, int | None]]:
    """(start, end, start of the part before) of the strings to measure, in order; -1 is a base match."""
    found: dict[int, tuple[int, int | None]] = {}
    seen: set[int] = set()

    def follow(at: int, before: int) -> int:
        """Add the parts that run on behind ``at``; returns where they end."""
        while (joint := JOINT.match(text, at)) and (part := PART.match(text, joint.end())):
            if part.start() in seen:
                break
            seen.add(part.start())
            at = part.end()
            if at - part.start() >= LEAST:
                found[part.start()] = at, None
                before = part.start()
            elif REST.match(part.group()):
                found[part.start()] = at, before
                before = part.start()
        return at

    reached = 0
    for m in SENSITIVE.finditer(text):
        # Candidates that begin within reach of the sensitive word; each is looked at once. The search
        # ends where the last of them would have its least length, so that no text is read again and again.
        within = m.end() + REACH + LEAST
        while near := CANDIDATE.search(text, max(m.end(), reached), within):
            c = CANDIDATE.match(text, near.start())
            found[c.start()] = c.end(), None
            reached = follow(c.end(), c.start())
    for _, kind, end, _ in base:
        if kind != 2:
            follow(end, -1)
    return sorted((s, e, before) for s, (e, before) in found.items())


def scan_text(text: str | None, threshold: float = NOVELTY) -> tuple[list, list, float]:
    """All spans, the base spans among them, and the highest novelty seen."""
    text = text or ""
    base = base_spans(text)
    top = 0.0

    def measured(start: int, end: int) -> float:
        nonlocal top
        found = novelty(text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND])
        top = max(top, found)
        return found

    for _, _, end, value in base:
        measured(value, end)
    more = [(s, 3, e, s) for s, e, body, rest in key_blocks(text) if measured(body, rest) >= threshold]
    # Spans that a candidate may lie in, without those inside others, so that they end in order. A candidate
    # that only touches an assignment is the name in front of its value.
    taken: list[tuple[int, int, bool]] = []
    for span in sorted([(s, e, k == 0) for s, k, e, _ in base] + [(s, e, False) for s, _, e, _ in more]):
        if not taken or span[1] > taken[-1][1]:
            taken.append(span)
    at, accepted = 0, {-1}
    for start, end, before in candidates(text, base):
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        over = itertools.takewhile(lambda t: t[0] < end, map(taken.__getitem__, range(at, len(taken))))  # noqa: B023
        if any(assigned or (s <= start and end <= e) for s, e, assigned in over):
            accepted.add(start)
        elif before in accepted if before is not None else measured(start, end) >= threshold:
            accepted.add(start)
            more.append((start, 3, end, start))
    return sorted(base + more), base, top


def _listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def secret_report(docs: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    """Per row of ``docs``: counts per base kind, digest of the base spans, all spans, top novelty."""
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, novelty double"

    @F.pandas_udf(schema)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                spans, base, top = scan_text(text, threshold)
                kinds = [k for _, k, _, _ in base]
                digest = hashlib.sha256(_listed(base).encode()).hexdigest()
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), digest, _listed(spans), top))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", scanned("text").alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, text: str = "text", threshold: float = NOVELTY) -> DataFrame:
    """``docs`` with every reported span replaced by ``[SECRET]``; texts without spans stay as they are."""

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else _without(t, scan_text(t, threshold)[0]) for t in texts], dtype=object)

    return docs.withColumn(text, cleaned(text))


def _without(text: str, spans: list) -> str:
    if not spans:
        return text
    out, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
