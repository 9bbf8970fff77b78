"""Text columns: cleaning, words and fixed word lists."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space, the characters that are kept, and the shortest word.
WHITE_SPACE = r"\t\n\x0B\f\r \x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
KEPT = "a-zA-Z0-9가-힣"
MIN_WORD = 2

# Sentiment lexicon.
POSITIVE = ["good", "great", "excellent", "positive", "wonderful", "fantastic", "happy", "love", "best", "amazing"]
NEGATIVE = ["bad", "terrible", "poor", "negative", "awful", "horrible", "hate", "worst", "disappointing"]

# Spark's English stop words (StopWordsRemover).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()


def _kept(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), f"[^{KEPT}{WHITE_SPACE}]+", "")


def clean(c: Column) -> Column:
    """Lower case; only letters, digits and Hangul; single blanks."""
    return F.trim(F.regexp_replace(_kept(c), f"[{WHITE_SPACE}]+", " "))


def words(text: Column) -> Column:
    """The words of a text as it reads after cleaning; there may be empty ones at both ends."""
    return F.split(_kept(text), f"[{WHITE_SPACE}]+")


def cleaned(listed: list[str]) -> list[str]:
    """Listed words as they read in a cleaned text: don't becomes dont."""
    return sorted({re.sub(f"[^{KEPT}]+", "", w.lower()) for w in listed} - {""})


def is_term(word: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """At least two characters and no stop word."""
    return (F.length(word) >= MIN_WORD) & ~word.isin(*cleaned(stop_words))


def terms(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """The terms of a text as an array."""
    return F.filter(words(text), lambda w: is_term(w, stop_words))


def _any_of(listed: list[str]) -> Column:
    """A pattern that matches any of the listed words as a whole word of a cleaned text."""
    some = "|".join(cleaned(listed)) or "[^\\s\\S]"
    return F.lit(f"(?<![^{WHITE_SPACE}])(?:{some})(?![^{WHITE_SPACE}])")


def occurrences(text: Column, listed: list[str]) -> Column:
    """How many words of the text are listed: one pass of a pattern, no array of words."""
    return F.regexp_count(_kept(text), _any_of(listed))


def listed_words(text: Column, listed: list[str]) -> Column:
    """The listed words among the words of the text, in order."""
    return F.regexp_extract_all(_kept(text), _any_of(listed), F.lit(0))


# ---- the same terms on Arrow arrays -------------------------------------------------------

SLICE = 1 << 21  # bytes of texts that are split at a time
_WHITE = np.zeros(1 << 16, bool)
_WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
        0x205F, 0x3000]] = True
_DROP, _KEEP, _SPACE = 0, 1, 2
_KIND = np.where(_WHITE[:256] & (np.arange(256) < 128), _SPACE, _DROP).astype(np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = _KEEP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def split_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """Some texts at a time: how many, and (number of the text among them, word) of all their words; texts are not null.
    The words are those of `words` without empty ones."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
        some = texts.slice(first, last - first)
        # The two other characters whose lower case has a letter from a to z.
        some = pc.replace_substring(pc.replace_substring(some, "\u212a", "k"), "\u0130", "i")
        _, ends, data = some.buffers()
        ends = np.frombuffer(ends, np.int64)[some.offset:some.offset + len(some) + 1]
        number, word = _split(np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]], ends - ends[0])
        yield len(some), number.astype(np.int32), word
        first = last


def _split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    kind = _KIND[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        more = np.append(data, np.zeros(2, np.uint8)).astype(np.int32)
        two = lead[data[lead] == 0xC2]
        kind[two[_WHITE[more[two + 1] & 0xFF]]] = _SPACE
        three = lead[(data[lead] >= 0xE1) & (data[lead] <= 0xED)]
        code = (more[three] & 0x0F) << 12 | (more[three + 1] & 0x3F) << 6 | more[three + 2] & 0x3F
        kind[three[_WHITE[code]]] = _SPACE
        hangul = three[(code >= 0xAC00) & (code <= 0xD7A3)]
        for i in range(3):
            kind[hangul + i] = _KEEP
    ends = (kind == _SPACE).astype(np.int8)
    ends[at[:-1][at[:-1] < len(data)]] = 1  # a text ends the word before it
    place = np.flatnonzero(kind == _KEEP)
    start = np.flatnonzero(np.diff(np.cumsum(ends, dtype=np.int32)[place], prepend=-1))
    offsets = np.append(start, len(place)).astype(np.int32)
    word = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[place]]))
    return np.searchsorted(at, place[start], "right") - 1, word


def coded_terms(word: pa.ChunkedArray, stop_words: Sequence[str] = STOP_WORDS) -> tuple[np.ndarray, pa.Array]:
    """Places of the words in a dictionary of their terms, -1 for what is no term, and the dictionary."""
    coded = word.dictionary_encode().combine_chunks()
    names = coded.dictionary
    stop = pa.array(cleaned(list(stop_words)), pa.string())
    good = pc.and_(pc.greater_equal(pc.utf8_length(names), MIN_WORD), pc.invert(pc.is_in(names, stop)))
    is_good = good.to_numpy(zero_copy_only=False)
    place = np.where(is_good, np.cumsum(is_good) - 1, -1).astype(np.int32)
    return place[coded.indices.to_numpy()], names.filter(good)
