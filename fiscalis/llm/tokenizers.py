"""Public tokenizers, loaded once per Python worker from files whose paths are parameters."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: What the vocabularies' pattern takes for white space; runs from this length on are cut out before the pattern sees them, as it backtracks over each whole run.
LONG_BLANKS = re.compile("[\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def byte_bpe(path: str):
    """The byte-level BPE encoding of a .tiktoken file, and the bytes that each id stands for."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def byte_ids(text: str, path: str) -> list[int]:
    """The ids of a text of any length under a byte-level vocabulary.

    The pattern makes one part of a run of blanks but its last one, which goes with what follows; a run at the end is one
    part. Long runs are therefore encoded as such parts, and the texts between them by the pattern.
    """
    encoding, _ = byte_bpe(path)
    if len(text) < 10000:
        return encoding.encode_ordinary(text)
    out, at = [], 0
    for m in LONG_BLANKS.finditer(text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += encoding.encode_ordinary(text[at : m.start()])
        out += encoding._encode_single_piece(text[m.start() : stop].encode())
        at = stop
    return out + encoding.encode_ordinary(text[at:])


def end_mark(path: str) -> tuple[int, int]:
    """The first id that a byte-level vocabulary leaves free, which ends a document in token streams, and the bytes that an id takes there."""
    free = len(byte_bpe(path)[1])
    return free, 2 if free < 1 << 16 else 4


@lru_cache(2)
def sentencepiece(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
