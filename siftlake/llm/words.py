"""Words of texts in blocks, so that a huge text is never held as one list of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Fixed value: letters and digits of ASCII and every other character, on UTF-8 bytes in lower case.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
BLOCK = 1 << 20


def word_blocks(text: bytes | None, size: int = BLOCK) -> Iterator[list[bytes]]:
    """Lists of words in order; a list covers about `size` bytes and no word is cut.

    A-Z are lowered; other letters stay, as only bytes below 128 change.
    """
    text = text or b""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            # Capitals are word signs too, so the border is sought in the lowered text.
            while end < len(text) and not BREAK.match(text[end : end + 1].lower()):
                end += 1
        yield WORD.findall(text[at:end].lower())
        at = end
