"""Statistics of the passages of whole texts, over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of a passage; bytes that are worked on at once (a longer text is cut at a blank).
WORDS, SLICE = 50, 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_GROUPS = ["upper", "digit", "mark", "bar", "stop", "symbol", "wide"]
_GROUP = np.zeros(256, np.uint8)
for _c in range(33, 127):
    _ch = chr(_c)
    _GROUP[_c] = (1 if _ch.isupper() else 2 if _ch.isdigit() else 0 if _ch.isalpha() else 3 if _ch in "!?" else
                  4 if _ch in "|" else 5 if _ch in ".,;:'\"-()" else 6)
_GROUP[128:] = 7
_SALT = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_SALT[_BLANK] = 0
FEATURES = [*_GROUPS, "word_bytes", "single", "repeat_1", "repeat_2", "repeat_3", "symbol_words", "words"]


def slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, documents) of parts of about ``SLICE`` bytes; ``documents`` are places in the column."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    cuts, docs = [], []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while b - a > SLICE:
            blanks = np.flatnonzero(_BLANK[data[a:a + SLICE]])
            end = a + (int(blanks[-1]) + 1 if len(blanks) else SLICE)
            cuts.append((a, end))
            docs.append(i)
            a = end
        cuts.append((a, b))
        docs.append(i)
    first = 0
    while first < len(cuts):
        last = first + 1
        while last < len(cuts) and cuts[last][1] - cuts[first][0] <= SLICE:
            last += 1
        base = cuts[first][0]
        starts = np.array([c[0] - base for c in cuts[first:last]])
        yield data[base:cuts[last - 1][1]], starts, np.array(docs[first:last])
        first = last


def passage_features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the part (index into ``starts``) that it belongs to."""
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    inside = starts[(starts > 0) & (starts < len(data))]
    begins[inside] = ~blank[inside]
    words = np.flatnonzero(begins)
    if not len(words):
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0, np.int64)
    part = np.searchsorted(starts, words, "right") - 1
    counts = np.bincount(part, minlength=len(starts))
    place = np.arange(len(words)) - (np.cumsum(counts) - counts)[part]
    opens = place % WORDS == 0
    passage = np.cumsum(opens) - 1
    first = words[opens]
    n_words = np.bincount(passage)
    group = _GROUP[data]
    solid = np.add.reduceat(~blank, first, dtype=np.int64)
    columns = [np.add.reduceat(group == g, first, dtype=np.int64) / solid for g in range(1, len(_GROUPS) + 1)]
    size = np.add.reduceat(~blank, words, dtype=np.int64)
    symbols = np.add.reduceat((group == 3) | (group == 4) | (group == 6), words, dtype=np.int64) > 0
    sign = np.add.reduceat(_SALT[data], words)
    columns += [np.minimum(solid / n_words, 50) / 10, np.bincount(passage, size == 1) / n_words]
    for lag in (1, 2, 3):
        same = np.zeros(len(words))
        same[lag:] = (sign[lag:] == sign[:-lag]) & (part[lag:] == part[:-lag])
        columns.append(np.bincount(passage, same) / n_words)
    columns += [np.bincount(passage, symbols) / n_words, n_words / WORDS]
    return np.stack(columns, axis=1).astype(np.float32), part[opens]


def bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, document) of all passages of a column; a text without words has one passage of zeros."""
    for data, starts, docs in slices(column):
        x, part = passage_features(data, starts)
        empty = np.setdiff1d(np.arange(len(starts)), part)
        x = np.concatenate([x, np.zeros((len(empty), len(FEATURES)), np.float32)])
        doc = docs[np.concatenate([part, empty])]
        order = np.argsort(doc, kind="stable")
        yield x[order], doc[order]
