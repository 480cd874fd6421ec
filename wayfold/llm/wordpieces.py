"""Token ids of texts, exactly as the tokenizers library gives them, each distinct word being encoded once a worker."""

from __future__ import annotations

import array
import json
import os
import re

#: Fixed values of word_bpe_49k.json, on which the word-wise way below rests.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that lower-casing and composition leave alone once they are lower-case, besides a-z.
_LATIN = "a-zß-öø-ÿ"
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]*")
#: The pre-tokens of word_bpe_49k.json, for text of the characters above.
_PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
#: Signs that are one pre-token after a word of letters. Bytes of a word up to which its ids are kept: longer ones seldom come again.
_SIGNS, _LONGEST = b".,;:!?", 64


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


class _Filled(dict):
    """A dictionary that makes what it lacks; it keeps `most` short keys at most and is emptied when it is full."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= _LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


def words_of(text: bytes) -> list[bytes]:
    """The white-space separated words of a text, ASCII capitals lowered where that can't change an id.

    The tokenizer composes characters before it lowers them. Some capitals have no composed form with a mark where the
    lower-case letter has one; all such marks are among U+0300 to U+037F, in UTF-8 those that begin with CC or CD.
    """
    keep = b"<|" in text or not text.isascii() and (b"\xcc" in text or b"\xcd" in text)
    return (text if keep else text.lower()).split()


class PieceCache:
    """Ids (unsigned 16-bit, little-endian) of white-space separated words, and the pre-tokens of words.

    The tokenizer's pre-tokens never contain white space, composition never joins a character to white space, and the
    special strings contain none, so a text's ids are those of its words one after another. Words of plain Latin text go
    to the model by pre-token; all others go through the whole library. Words and their pre-tokens are kept in one cache,
    within bounds that neither a long text nor long words pass.
    A file with another normaliser or pre-tokenizer is refused: its words might not stand alone.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        parts = (form.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        known = form.get("normalizer") == NORMALIZER and parts[0].get("pattern") == {"Regex": SPLIT} and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        if not known or any("<|" not in t["content"] or re.search(r"\s", t["content"]) for t in form["added_tokens"]):
            raise ValueError(f"{path}: another normaliser, pre-tokenizer or other special strings than those of word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of over 16 bits")
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words: dict[bytes, bytes] = _Filled(self.word, most)

    def _level(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.letters)

    def _piece(self, piece: str) -> bytes:
        """The ids of a pre-token in the byte-level alphabet."""
        return array.array("H", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def word(self, word: bytes) -> bytes:
        letters = word.rstrip(_SIGNS)
        if letters.isalpha():  # of ASCII alone
            return self._piece(word.decode().lower()) if letters == word else self.words[letters] + self.words[word[len(letters) :]]
        text = word.decode("utf-8", "replace")
        if b"<|" not in word and _PLAIN.fullmatch(text):
            parts = _PRE.findall(text.lower())
            return self._piece(self._level(parts[0])) if len(parts) == 1 else b"".join([self.words[p.encode()] for p in parts])
        return array.array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        get = self.words.__getitem__
        return [b"".join(map(get, words_of(t))) for t in texts]

    def pre_tokens(self, word: bytes) -> list[bytes]:
        """The pre-tokens of a word in the byte-level alphabet; a word that may hold a special string is one, marked by a space."""
        text = word.decode("utf-8", "replace")
        if b"<|" in word:
            return [b" " + word]
        if _PLAIN.fullmatch(text):
            return [self._level(p).encode() for p in _PRE.findall(text.lower())]
        return [p.encode() for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def count(self, pre_token: bytes) -> int:
        """The number of pieces of a pre-token."""
        if pre_token.startswith(b" "):
            return len(self.word(pre_token[1:])) // 2
        return len(self.model.tokenize(pre_token.decode()))


_OPEN: dict[str, PieceCache] = {}


def cache(path: str) -> PieceCache:
    """One cache for each worker process and tokenizer file."""
    if path not in _OPEN:
        _OPEN[path] = PieceCache(path)
    return _OPEN[path]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
