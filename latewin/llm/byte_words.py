"""Words of UTF-8 texts by a byte table and bytes.split.

A table of 256 bytes lower-cases A-Z and turns every ASCII byte that is neither a letter
nor a digit into a blank; bytes from 0x80 on, the parts of all other characters, stay.
Splitting what is left at blanks gives the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes split at once. Longer texts are cut at a blank, so a task holds the words of one
#: such stretch and not those of the whole text.
STRETCH = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
_KEPT = _LETTER | ((_BYTES >= 48) & (_BYTES <= 57)) | (_BYTES >= 128)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
TABLE = bytes(np.where(_KEPT, _LOWER, 32).astype(np.uint8))


def words_of(data: bytes) -> list[bytes]:
    """All words of a text."""
    return data.translate(TABLE).split()


def stretches(data: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of a text in order, a list for every stretch of about ``size`` bytes.

    A text without words may give an empty list or none.
    """
    if len(data) <= size:
        yield words_of(data)
        return
    blanked, at = data.translate(TABLE), 0
    while at < len(blanked):
        end = blanked.find(b" ", at + size)
        end = len(blanked) if end < 0 else end
        yield blanked[at:end].split()
        at = end
