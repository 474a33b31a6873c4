"""A byte-level BPE vocabulary file, applied one distinct pre-token at a time."""

from __future__ import annotations

import json
import os
import re
import unicodedata

import regex

#: The places at which the byte-level pattern splits a text without unusual characters.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
CONTROLS = re.compile("[\x1c-\x1f]")
FAR = re.compile("[\U00010000-\U0010ffff]")


#: The same places for any text, as slow as a pattern with Unicode classes is.
ANY_PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


class PreTokenizer:
    r"""Splits a text where the byte-level pattern does, or gives None if only the library can tell.

    Python's own classes differ from \p{L}, \p{N} and white space in numbers that are no
    decimal digits, in four control characters, and may differ beyond the basic plane;
    texts with these take the slower pattern. None is for added tokens, and for
    characters that Python's Unicode version does not know yet, which the library's may.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.special = added_strings(self.tokenizer)
        odd = [chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("Nl", "No")]
        self.near = re.compile("[\x1c-\x1f" + "".join(odd) + "]")

    def __call__(self, text: str) -> list[str] | None:
        if self.special is not None and self.special.search(text):
            return None
        if text.isascii():
            return (ANY_PRE_TOKEN if CONTROLS.search(text) else PRE_TOKEN).findall(text)
        if self.near.search(text) or FAR.search(text):
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                return None
            return ANY_PRE_TOKEN.findall(text)
        return PRE_TOKEN.findall(text)

    def whole(self, text: str) -> int:
        """Tokens of a text as the library counts them."""
        return len(self.tokenizer.encode(text, add_special_tokens=False))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is visible, else one from 256 on."""
    visible = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


class PreTokenModel:
    """The model of a tokenizer applied to one pre-token at a time, without the library's work around it."""

    def __init__(self, tokenizer) -> None:
        self.pieces = tokenizer.model.tokenize
        self.letters = byte_letters()
        self.space = self.letters[32]

    def ids(self, pre_token: str) -> list[int]:
        body = pre_token[1:] if pre_token[:1] == " " else pre_token
        if body.isalnum() and body.isascii():
            spelled = self.space + body if len(body) < len(pre_token) else body
        else:
            spelled = pre_token.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.pieces(spelled)]


def rank_encoder(tokenizer):
    """The tokenizer's own vocabulary as ranks for a faster encoder of plain text with the same ids, or None.

    Merging by rank equals merging by the vocabulary's list if the ids of merged pieces
    rise along that list, which is checked.
    """
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:])):
        return None
    byte = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(byte[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in byte for c in piece)}
    for special in tokenizer.get_added_tokens_decoder().values():
        ranks.pop(special.content.encode(), None)
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def added_strings(tokenizer) -> re.Pattern | None:
    """Matches the strings that the tokenizer takes as whole added tokens inside a text."""
    added = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, added))) if added else None
