"""Token ids of whole texts under a public word-level BPE vocabulary.

The vocabulary normalises (NFC, white space, lower case), drops white space and encodes each word
alone. A text is therefore the sequence of the ids of what stands between its white space, and those
are kept in a bounded table per Python worker. Texts with characters whose treatment could depend on the
Unicode version of a library, or with an added token of the vocabulary, go through the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Callable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEPT_CHUNKS = 200_000  # some 40 MB a worker
LETTER = "a-zªµºß-öø-ſ"
DIGIT = "0-9²³¹¼-¾"
SPACE = r" \t\n\r\x0b\x0c"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{DIGIT}]|[^{SPACE}{LETTER}{DIGIT}]+")
# all but printable ASCII, white space, and letters and marks that are composed and stable
USUAL = bytes([*range(32, 127), *b"\t\n\r\x0b\x0c"])  # of ASCII
UNUSUAL = re.compile("[^ -~\t\n\r\x0b\x0c¡-¬®-įı-ſ–-…€]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _word_ids(tokenizer) -> Callable[[str], list[int]]:
    """Ids of one word in lower case: of the merges alone if all else that the tokenizer does is to spell it in bytes."""
    from tokenizers.pre_tokenizers import ByteLevel

    steps = (json.loads(tokenizer.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    last, tokenize = steps[-1], tokenizer.model.tokenize
    if last.get("type") != "ByteLevel" or last.get("add_prefix_space") or last.get("use_regex"):
        return lambda word: tokenizer.encode(word, add_special_tokens=False).ids
    spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    spelled = {ord(c): spell(c)[0][0] for c in map(chr, range(0xA1, 0x20AD)) if not UNUSUAL.match(c)}
    return lambda word: [t.id for t in tokenize(word if word.isascii() else word.translate(spelled))]


class _Known(dict):
    """Ids by chunk, a text without white space in lower case; unknown ones are encoded and, while there is room, kept."""

    def __init__(self, word_ids: Callable[[str], list[int]]):
        super().__init__()
        self.word_ids = word_ids

    def __missing__(self, chunk: str) -> bytes:
        words = WORD.findall(chunk)
        ids = b"".join(map(self.__getitem__, words)) if len(words) > 1 else _packed(self.word_ids(chunk))
        if len(self) < KEPT_CHUNKS:
            self[chunk] = ids
        return ids


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers in `bytes`."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # in any case, as an added token may be looked for in the normalised text
        self.added = re.compile("|".join(added) or "(?!)", re.IGNORECASE)
        self.known = _Known(_word_ids(self.tokenizer))

    def encode(self, text: str) -> bytes:
        unusual = text.encode().translate(None, USUAL) if text.isascii() else UNUSUAL.search(text)
        if unusual or self.added.search(text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.known.__getitem__, text.lower().split()))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
