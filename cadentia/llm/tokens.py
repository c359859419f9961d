"""Token ids of whole texts by public byte-level BPE vocabularies, cached per Python worker."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
import tiktoken

# The ids of byte_bpe_50k.json; the rank file holds the same vocabulary and is read faster.
BYTE_BPE = "byte_bpe_50k.tiktoken"
# The tokens that byte_bpe_50k.json adds to it; the tokenizer as loaded from that file takes them out of a text first.
ADDED = (("<|endoftext|>", 50256),)


@functools.lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoder of a rank file; no string is special to it."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


# The encoder's own splitting gives up on white space of about a million characters.
BLANKS = 65_536
LONG_BLANK = regex.compile(rf"\p{{White_Space}}{{{BLANKS},}}")


def _split(text: str) -> Iterator[tuple[str, bool]]:
    """The text in parts that are encoded independently, and whether a part is one unbroken piece.

    White space in front of a word leaves its last character to the word, so a long run
    without that character is a piece of its own.
    """
    at = 0
    for run in LONG_BLANK.finditer(text) if len(text) >= BLANKS else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


def token_ids(text: str | None, path: str, added: tuple[tuple[str, int], ...] = ()) -> np.ndarray:
    """Little-endian unsigned 32-bit ids of a text, where each string of ``added`` is one id; null has none."""
    coder = encoding(path)
    ids_of = dict(added)
    found = any(word in (text or "") for word in ids_of)
    pieces = regex.split("(" + "|".join(map(regex.escape, ids_of)) + ")", text) if found else [text or ""]
    parts = []
    for piece in pieces:
        if found and piece in ids_of:
            parts.append(np.array([ids_of[piece]], "<u4"))
            continue
        for part, whole in _split(piece):
            ids = coder._encode_single_piece(part) if whole else coder.encode_to_numpy(part, disallowed_special=())
            parts.append(np.asarray(ids).astype("<u4", copy=False))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)
