"""Byte-level BPE over whole texts, with a cache of the segments between single spaces."""

from __future__ import annotations

import array
import base64
import functools

#: Segments that one generation of the cache holds; there are two, so its memory is bounded.
CACHE = 300_000
#: The vocabulary's special string and its id as little-endian 32-bit bytes.
END, END_ID = "<|endoftext|>", (50256).to_bytes(4, "little")


class Segments(dict):
    """Ids of `` word`` as little-endian 32-bit bytes, by word.

    When a generation is full it becomes the older one, from which segments still in use come back. ``unsafe`` is
    set when a word begins or ends with a blank, or is empty: two blanks then meet at the cut.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older, self.unsafe = encode, {}, False

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            if not word or word[0].isspace() or word[-1].isspace():
                self.unsafe = True
                return b""
            ids = array.array("I", self.encode(" " + word)).tobytes()
            if len(word) > 64:
                return ids
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    """``ids(text)``: the ids of a whole text as little-endian 32-bit bytes; special strings are plain text.

    ``marked_ids(text)``: the same, but ``END`` gets its own id, as the tokenizer gives it.

    The pattern that cuts a text into words always starts a new one at a single space with no blank next to
    it, so the segments between such spaces can be encoded one by one and looked up when they occur again.
    """

    def __init__(self, ranks_file: str, pattern: str):
        import tiktoken

        with open(ranks_file, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks,
                                        special_tokens={}).encode_ordinary
        self.segments = Segments(self.encode)

    def whole(self, text: str) -> bytes:
        return array.array("I", self.encode(text)).tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not rest or first[-1:].isspace():
            return self.whole(text)
        self.segments.unsafe = False
        found = b"".join(map(self.segments.__getitem__, rest))
        return self.whole(text) if self.segments.unsafe else self.whole(first) + found

    def marked_ids(self, text: str) -> bytes:
        return END_ID.join(map(self.ids, text.split(END))) if END in text else self.ids(text)


@functools.cache
def encoder(ranks_file: str | None = None) -> Encoder:
    """One encoder for each Python worker. Default: the public 50k byte-level vocabulary as ranks."""
    import public_tokenizers

    return Encoder(ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
