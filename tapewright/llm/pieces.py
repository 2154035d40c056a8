"""Exact tokenization by pieces: texts are cut where no token can reach across, and each distinct piece is encoded once.

Two kinds of vocabulary have such cuts at spaces:

* byte level with the split pattern of `public_tokenizers.PATTERN`: a token may begin with one space and holds no other
  white space beside letters, so a space after a non-space begins a new piece, and what precedes it has no influence;
* word level, where the pattern drops white space: every space is a cut.

Other vocabularies are given whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain

from tapewright.llm.common import MEMO_MOST, Memo

_SPACE_AFTER_SPACE = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S)(?= )")

# The split pattern of the two public vocabularies with cuts at spaces.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def kind_of(tokenizer_json: bytes) -> str:
    """'byte', 'word' or 'whole': how texts may be cut for this vocabulary."""
    spec = json.loads(tokenizer_json)
    if any(re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", [])):
        return "whole"
    if spec.get("post_processor") or spec.get("truncation") or spec.get("padding"):
        return "whole"
    if spec.get("normalizer") is None and spec.get("pre_tokenizer") == BYTE_LEVEL:
        return "byte"
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if parts and parts[0].get("type") == "Split" and parts[0].get("pattern") == {"Regex": WORD_PATTERN} and parts[0].get("invert") and parts[0].get("behavior") == "Removed":
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if steps == ["NFC", "Replace", "Lowercase"]:
            return "word"
    return "whole"


def chunks(text: str, most: int = 1 << 18) -> Iterator[str]:
    """A long text in parts of about `most` characters, cut before a space that follows a non-space."""
    start = 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while at > 0 and text[at - 1].isspace():
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[start:at]
        start = at
    yield text[start:] if start else text


class PieceCache:
    """Values of pieces; `encode` gets the distinct new ones of a batch at once. Memory is bounded by Memo's bytes and a batch's."""

    def __init__(self, encode: Callable[[list[str]], list], spaced: bool, most: int = MEMO_MOST):
        self.encode, self.spaced = encode, spaced
        self.words = Memo(most)  # of a word after one space
        self.plain = Memo(most // 4)  # of a piece as it stands

    def _fill(self, cache: Memo, new: list[str], prefix: str) -> None:
        if new:
            cache.fill(new, self.encode([prefix + w for w in new] if prefix else new))

    def of(self, texts: list[str]) -> list[list]:
        """For each text the values of its pieces, in order."""
        self.words.room(), self.plain.room()
        split, odd = [], {}
        first: list[str] = []
        for i, text in enumerate(texts):
            if self.spaced and _SPACE_AFTER_SPACE.search(text):
                odd[i] = [x for x in _SAFE.split(text) if x]
                split.append(())
                first += odd[i]
            else:
                words = text.split(" ")
                split.append(words)
                if self.spaced:
                    first.append(words[0])
        words_of = [w[1:] for w in split] if self.spaced else split
        self._fill(self.words, list(set(chain.from_iterable(words_of)).difference(self.words)), " " if self.spaced else "")
        if self.spaced:
            self._fill(self.plain, list(set(first).difference(self.plain)), "")
        out, get, plain = [], self.words.__getitem__, self.plain
        for i, words in enumerate(words_of):
            if i in odd:
                out.append([plain[x] for x in odd[i]])
            elif self.spaced:
                out.append([plain[split[i][0]], *map(get, words)])
            else:
                out.append(list(map(get, words)))
        return out


def batched(values, texts: list[str], most: int = 1 << 18) -> Iterator[list[list]]:
    """For each text, its parts' values; only texts of over `most` characters have more than one part."""
    if all(len(t) <= most for t in texts):
        yield from ([x] for x in values(texts))
    else:
        for t in texts:
            yield [values([part])[0] for part in chunks(t, most)]
