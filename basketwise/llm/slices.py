"""Long texts worked on in slices, so that memory follows a slice and not the text."""

from __future__ import annotations

import re
from collections.abc import Iterator

SLICE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def slices(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut before ASCII white space only; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]
