"""Token ids of whole texts, as the byte-level ``tokenizers`` vocabulary gives them.

The vocabulary file exists in two forms with equal ids.  Texts of Latin letters,
ASCII and common punctuation, for which the two libraries' character classes
agree, go through the rank form, which is about four times as fast; every other
text goes through the ``tokenizers`` form itself.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np

_SHARED = re.compile("[\\x20-\\x7e\\n\\r\\t¡-¬®-ɏ‐-‧‰-⁞€]*")
#: Longer texts are encoded in parts that end where no token can cross.
PART = 1 << 16
_SAFE = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in parts; cuts lie before a single space between letters, where a new match always starts."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@functools.cache
def _rank_form(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _json_form(path: str):
    from tokenizers import Tokenizer

    form = Tokenizer.from_file(path)
    form.encode_special_tokens = True
    return form


def encode(text: str, json_path: str, rank_path: str, pattern: str) -> np.ndarray:
    """Ids of a whole text without special tokens, as uint32."""
    if not text:
        return np.zeros(0, np.uint32)
    if _SHARED.fullmatch(text):
        ranks = _rank_form(rank_path, pattern)
        found = [ranks.encode_to_numpy(p, disallowed_special=()) for p in parts(text)]
    else:
        form = _json_form(json_path)
        found = [np.array(form.encode(p, add_special_tokens=False).ids, np.uint32) for p in parts(text)]
    return np.concatenate(found).astype(np.uint32)
