"""Small document tables with awkward rows, and the rules written plainly in Python."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def documents(spark, rows, extra=True):
    """rows of (doc_id, text); with extra columns whose names clash with those of results."""
    full = [(i, t, "en", "src0", len(t or ""), 7, "x", 0.5) for i, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, row long, label string, score double"
    frame = spark.createDataFrame(full, names)
    return frame if extra else frame.select("doc_id", "text", "lang", "source", "n_chars")
