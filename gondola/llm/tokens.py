"""Token ids of whole texts with a public tokenizer, inside tasks.

A text is cut at blanks, and the ids of each blank with the word behind it are kept: a
pre-token never crosses a blank that stands between a character and a word, so words
met before cost a look-up. A new word is cut further between letters and the signs that
end it, where the tokenizer's own pre-tokenization always cuts; the units between these
cuts are encoded by the library once and kept as well, so its cost follows the
vocabulary of a task and not its text. A unit that is one pre-token goes to the
library's model directly.

Texts with a blank between two white spaces are cut by the pattern of the units alone;
texts with white space beyond ASCII or with the string of a special token are encoded
whole. All this rests on a byte-level tokenizer without normalizer, with the usual
pattern, which is looked up when it is loaded: of any other one all texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import islice

import numpy as np

#: Units and words a worker keeps before it lets go of the older half.
CACHE_UNITS = 600_000

# Only letters that every version of Unicode calls letters; signs without the apostrophe, which starts contractions.
_LETTERS, _SIGNS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
_UNIT = re.compile(
    rf" ?[{_LETTERS}]+(?=[{_SIGNS}]*(?!\S))|(?<=[{_LETTERS}])[{_SIGNS}]+(?!\S)|\s+(?!\S)| ?\S+|\s", re.ASCII
)
_SINGLE = re.compile(rf" ?[{_LETTERS}]+|[{_SIGNS}]+", re.ASCII)
_WORD = re.compile(rf"( [{_LETTERS}]+)([{_SIGNS}]*)", re.ASCII)
#: A blank behind white space, which may belong to a longer run of it.
_BLANKS = ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")
_WHOLE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_encoders: dict[str, Callable[[list[str]], list[bytes]]] = {}


def _byte_letters() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _is_usual(tokenizer) -> bool:
    """Byte-level BPE without normalizer and with the pattern that ``_UNIT`` refines."""
    made = json.loads(tokenizer.to_str())
    model, split = made["model"], made["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "ignore_merges"))
    usual = split.get("type") == "ByteLevel" and not split["add_prefix_space"] and split["use_regex"]
    return made["normalizer"] is None and usual and model["type"] == "BPE" and plain


def _load(path: str) -> Callable[[list[str]], list[bytes]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, _byte_letters()
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")
    raw = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    class Units(dict):
        """Ids of units, encoded when first asked for."""

        def __missing__(self, unit: str) -> bytes:
            if _SINGLE.fullmatch(unit):
                made = model.tokenize(unit.encode().decode("latin-1").translate(letters))
                ids = b"".join([raw[t.id] for t in made])
            else:
                ids = whole([unit])[0]
            self[unit] = ids
            return ids

    class Words(dict):
        """Ids of words, each with the blank before it: letters and the signs behind them, or units by the pattern."""

        def __missing__(self, word: str) -> bytes:
            m = _WORD.fullmatch(f" {word}")
            if m:
                ids = units[m[1]] + units[m[2]] if m[2] else units[m[1]]
            else:
                ids = by_units(f" {word}")
            self[word] = ids
            return ids

    units, words = Units(), Words()

    def by_units(text: str) -> bytes:
        return b"".join([units[u] for u in _UNIT.findall(text)])

    def by_words(text: str) -> bytes:
        head, *rest = text.split(" ")
        return by_units(head) + b"".join([words[w] for w in rest])

    def whole(texts: list[str]) -> list[bytes]:
        made = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in made]

    usual = _is_usual(tokenizer)

    def encode(texts: list[str]) -> list[bytes]:
        ids, left = [], []
        for i, text in enumerate(texts):
            if not usual or _WHOLE.search(text) or special.search(text):
                left.append(i)
                ids.append(b"")
            elif any(x in text for x in _BLANKS):
                ids.append(by_units(text))
            else:
                ids.append(by_words(text))
        for i, one in zip(left, whole([texts[i] for i in left]) if left else [], strict=True):
            ids[i] = one
        for cache in (words, units):
            if len(cache) > CACHE_UNITS:
                for key in list(islice(cache, len(cache) // 2)):
                    del cache[key]
        return ids

    return encode


def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian unsigned 32-bit ids; one tokenizer per worker process."""
    if path not in _encoders:
        _encoders[path] = _load(path)
    return _encoders[path]


def encode_batches(values, path: str, chars: int = 2_000_000):
    """Yield (first index, list of id bytes) over a list of texts, a bounded part at a time."""
    first, size = 0, 0
    for i, value in enumerate(values):
        size += len(value)
        if size > chars or i == len(values) - 1:
            yield first, encoder(path)(values[first : i + 1])
            first, size = i + 1, 0
