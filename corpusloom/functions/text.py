"""Text functions as Column expressions, so that they stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts of an Arrow array that Python takes at once, at most: by their number, and by their bytes unless it is one text.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 20
WORD = r"[\p{L}\p{N}]+"
#: Latin letters with marks, and what is left without them.
_MARKED = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
MARKED, BARE = "".join(a for a, _ in _MARKED), "".join(b for _, b in _MARKED)
PUNCTUATION = r"[\p{P}!-/:-@\[-`{-~]"
IDEOGRAPHS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B920}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"


def normalise_query(text: str) -> str:
    """Compatibility composition; applied to queries only."""
    return unicodedata.normalize("NFKC", text)


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(text), MARKED, BARE)


_BARE_OF = dict(zip(MARKED, BARE))


def fold_query(text: str) -> str:
    text = text.lower()
    for c in () if text.isascii() else _BARE_OF.keys() & set(text):
        text = text.replace(c, _BARE_OF[c])
    return text


def words(text: Column) -> Column:
    """The tokens of full-text search: runs of letters and digits, folded; empty for null."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def query_words(text: str) -> list[str]:
    """The same tokens of a query, in order and once each."""
    import regex

    return list(dict.fromkeys(regex.findall(WORD, fold_query(text))))


def unix_lines(text: Column) -> Column:
    """CR LF becomes LF, so that offsets count it once."""
    return F.regexp_replace(text, "\r\n", "\n")


def clean_text(text: Column) -> Column:
    """Without control, format, private and unassigned characters (but tab and line ends) and replacement characters."""
    return F.regexp_replace(text, r"[\p{C}&&[^\t\n\r]]|\x{FFFD}", "")


def pad_ideographs(text: Column) -> Column:
    return F.regexp_replace(text, f"({IDEOGRAPHS})", " $1 ")


def basic_tokens(text: Column) -> Column:
    """Split at blanks, then before and after each punctuation mark."""
    p = PUNCTUATION[1:-1]
    return F.regexp_extract_all(text, F.lit(rf"[{p}]|[^\s{p}]+"), 0)


def clamp(x, low, high):
    """The value within bounds, for columns and numbers alike."""
    if any(isinstance(v, Column) for v in (x, low, high)):
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.least(F.greatest(as_col(x), as_col(low)), as_col(high))
    return min(max(x, low), high)


def surrounded(text: Column, by: str) -> Column:
    return F.concat(F.lit(by), text, F.lit(by))


def slices(texts: pa.Array, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The array in parts of a bounded number of rows and bytes; a part has one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield texts.slice(at, end - at)
        at = end
