"""Encoding by a public tokenizer with a memory of words.

The tokenizers in question never let a token cross ASCII white space, so a text's tokens are
its words' tokens one after another. Each worker process keeps the words it has met; the
library encodes only the rest. ``splits_on_space`` says which vocabularies allow that.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np

#: Words kept per worker process; the older half goes when the younger half is full.
MEMORY_WORDS = 400_000
#: Longer words are encoded and not kept.
KEPT_BYTES = 64
ENCODE_AT_ONCE = 500
RANKED_AT_ONCE = 50_000


def vocabulary_path(name: str) -> str:
    """A public vocabulary's place on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(name: str) -> str:
    """The tokenizer's version: the SHA-256 of its vocabulary file."""
    with open(vocabulary_path(name), "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


#: A word of letters with closing punctuation, which is a token run of its own.
_CLOSED = re.compile(rb"(.*[A-Za-z0-9])([.,;:!?]+)", re.S)


def _byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte.

    Printable Latin-1 characters stand for themselves, the others follow from U+0100 on.
    """
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Encodes words of one ``tokenizers`` vocabulary that drops or splits at white space.

    ``ids(words)`` gives one array of little-endian unsigned 32-bit ids as bytes per word.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        special = [
            (token.content, i)
            for i, token in self.library.get_added_tokens_decoder().items()
            if token.special and not (token.lstrip or token.rstrip or token.normalized)
        ]
        self.mark, self.mark_id = special[-1] if special else (None, None)
        self.letters = _byte_letters()
        self.tokenize = self.library.model.tokenize
        self.closing: dict[bytes, bytes] = {}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _letters_ids(self, word: bytes) -> bytes | None:
        """The ids of a word of Latin letters below U+0130, straight from the model's merges.

        Normalising only lower-cases such a word, and it is one piece; None for other words.
        """
        text = word.decode()
        if not text.isalpha() or max(text) >= "\u0130":
            return None
        if text.isascii():
            piece = text.lower()
        else:
            letters = self.letters
            piece = "".join([letters[b] for b in text.lower().encode()])
        return np.array([t.id for t in self.tokenize(piece)], "<u4").tobytes()

    def _fast_ids(self, word: bytes) -> bytes | None:
        """The ids of letters with or without closing punctuation; None for other words."""
        closed = _CLOSED.fullmatch(word)
        if closed is None:
            return self._letters_ids(word)
        stem, stop = closed.groups()
        head = self.young.get(stem) or self.old.get(stem) or self._letters_ids(stem)
        if head is None:
            return None
        if stop not in self.closing:
            got = self.library.encode(stop.decode(), add_special_tokens=False).ids
            self.closing[stop] = np.array(got, "<u4").tobytes()
        return head + self.closing[stop]

    def _library_ids(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids by the library; plain words share a call, parted by a special token."""
        out = [self._fast_ids(w) for w in words]
        plain = [i for i, w in enumerate(words) if out[i] is None and b"<|" not in w]
        if not self.mark:
            plain = []
        for low in range(0, len(plain), ENCODE_AT_ONCE):
            some = plain[low : low + ENCODE_AT_ONCE]
            text = self.mark.join(words[i].decode() for i in some)
            got = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(got == self.mark_id)
            if len(cuts) != len(some) - 1:
                continue
            starts, stops = [0, *(cuts + 1)], [*cuts, len(got)]
            raw = got.tobytes()
            for i, a, b in zip(some, starts, stops):
                out[i] = raw[4 * a : 4 * b]
        for i, done in enumerate(out):
            if done is None:
                ids = self.library.encode(words[i].decode(), add_special_tokens=False).ids
                out[i] = np.array(ids, "<u4").tobytes()
        return out

    def table(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A mapping that holds every one of these words."""
        table, missing = {}, []
        young, old = self.young, self.old
        for word in words:
            ids = young.get(word)
            if ids is None:
                ids = old.get(word)
                if ids is None:
                    missing.append(word)
                    continue
                young[word] = ids
            table[word] = ids
        for word, ids in zip(missing, self._library_ids(missing)):
            table[word] = ids
            if len(word) <= KEPT_BYTES:
                young[word] = ids
        if len(young) > MEMORY_WORDS // 2:
            self.old, self.young = young, {}
        return table

    def decoded(self, ids: np.ndarray) -> bytes:
        """The text of ``decode(ids, skip_special_tokens=False)`` where there is no decoder."""
        if self.library.decoder is not None:
            return self.library.decode(ids.tolist(), skip_special_tokens=False).encode()
        names = self.names
        return b" ".join([names[i] for i in ids.tolist()])


def _latin(word: bytes) -> bool:
    """Whether a word has letters below U+0130 only, which normalising only lower-cases."""
    text = word.decode()
    return text.isalpha() and max(text) < "\u0130"


class RankedWordEncoder(WordEncoder):
    """The same ids, with words of Latin letters merged together in one call by the vocabulary as ranks.

    A line feed stands for the end of a word. Its pairs with a letter have lower ids than any merge, so they
    are merged first, as the vocabulary's last letters of words are.
    """

    def __init__(self, name: str):
        super().__init__(name)
        import tiktoken

        byte_of = {c: bytes([b]) for b, c in enumerate(self.letters)}
        added = self.library.get_added_tokens_decoder()
        ranks = {}
        for i, token in enumerate(self.names):
            text = token.decode()
            stem = text.removesuffix("</w>")
            if stem and i not in added and all(c in byte_of for c in stem):
                raw = b"".join([byte_of[c] for c in stem])
                if raw == b"\n" and stem == text or b"\n" not in raw:
                    ranks[raw if stem == text else raw + b"\n"] = i
        self.ranks = tiktoken.Encoding("words", pat_str=r"[^\n]*\n", mergeable_ranks=ranks, special_tokens={})
        self.is_end = np.zeros(len(self.names), bool)
        self.is_end[[i for raw, i in ranks.items() if raw.endswith(b"\n")]] = True

    def _library_ids(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        plain, rest = [], []
        for i, word in enumerate(words):
            stem = word.rstrip(b".,;:!?")
            if len(stem) <= KEPT_BYTES and (stem.isalpha() or _latin(stem)):
                plain.append((i, stem, word[len(stem) :]))
            else:
                rest.append(i)
        closing = self.closing
        for stop in {stop for _, _, stop in plain} - closing.keys():
            got = self.library.encode(stop.decode(), add_special_tokens=False).ids
            closing[stop] = np.array(got, "<u4").tobytes()
        for low in range(0, len(plain), RANKED_AT_ONCE):
            some = plain[low : low + RANKED_AT_ONCE]
            lines = b"\n".join([stem for _, stem, _ in some]).decode().lower() + "\n"
            ids = np.asarray(self.ranks.encode_to_numpy(lines), "<u4")
            stops = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(stops) != len(some):
                raise RuntimeError(f"{len(some)} words have {len(stops)} ends")
            raw = ids.tobytes()
            for (i, _, stop), a, b in zip(some, [0, *stops], stops):
                out[i] = raw[a:b] + closing[stop]
        for i, ids in zip(rest, super()._library_ids([words[i] for i in rest])):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(name: str) -> WordEncoder:
    """This process's encoder of a vocabulary."""
    return WordEncoder(name)


@lru_cache(maxsize=1)
def ranked_encoder(name: str) -> RankedWordEncoder:
    """This process's encoder of a vocabulary of words by ranks."""
    return RankedWordEncoder(name)


def splits_on_space(name: str) -> bool:
    """True if no token of the vocabulary's texts spans ASCII white space, which it drops."""
    return name == "word_bpe_49k.json"


def slices(texts: list[bytes], most: int = 4_000_000):
    """Runs of neighbouring texts of about so many bytes together; a longer text stands alone."""
    low, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > most:
            yield low, i
            low, total = i, 0
        total += len(text)
    if low < len(texts):
        yield low, len(texts)
