"""Token ids of whole texts by the tokenizers library, with the ids of words remembered between texts."""

from __future__ import annotations

import os
import re

import numpy as np
from tokenizers import Tokenizer

WORDS = 500_000  # words that a worker remembers; beyond that it keeps the third that it used most
CHUNK_CHARS = 1_000_000  # characters of texts that are encoded together
COMBINING = re.compile("[̀-ͯ]")
JOINED = 1000  # words per call of the library


class _Numbers(dict):
    """Numbers words in the order of their first use and lists the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes texts with a tokenizer whose pre-tokenizer never joins what a space or line feed separates.

    Ids then depend only on the parts between spaces and line feeds, so each distinct part goes through the library
    once: many new parts at a time, with the text of a special token between them.  Texts that hold text of a special
    token themselves go through the library whole.  A to Z are lowered first where the tokenizer lowers them anyway
    and no combining mark could make a difference.
    """

    def __init__(self, path: str, words: int = WORDS) -> None:
        # A task has one core; the library's own threads would take those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.limit = words
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content for t in added.values()]
        self.mark_id, token = max(added.items())
        self.mark = token.content
        self.lowers = self._ids("ABC XYZ") == self._ids("abc xyz")
        self._clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _clear(self) -> None:
        self.numbers, self.used, self.uses = _Numbers(), 0, np.empty(0, np.int64)
        self.begin, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(1 << 20, np.uint32)

    def _forget(self) -> None:
        """Keep the third of the words that were used most, and more than once."""
        kept = np.argsort(-self.uses, kind="stable")[: self.limit // 3]
        kept = np.sort(kept[self.uses[kept] > 1])
        words = list(self.numbers)
        self.numbers = _Numbers()
        self.numbers.update((words[k], n) for n, k in enumerate(kept.tolist()))
        sizes = self.size[kept]
        total = np.r_[0, np.cumsum(sizes)]
        ids = self.flat[np.repeat(self.begin[kept] - total[:-1], sizes) + np.arange(total[-1])]
        self.begin, self.size, self.uses, self.used = total[:-1], sizes, self.uses[kept] // 2, len(ids)
        self.flat[: len(ids)] = ids

    def _learn(self) -> None:
        """Encode the new words and append their ids."""
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        texts = [self.mark.join(new[at : at + JOINED]) + self.mark for at in range(0, len(new), JOINED)]
        ids = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids)
        ends = np.flatnonzero(ids == self.mark_id)
        sizes = np.diff(np.r_[-1, ends]) - 1
        ids = ids[ids != self.mark_id]
        self.begin = np.r_[self.begin, self.used + np.cumsum(sizes) - sizes]
        self.size = np.r_[self.size, sizes]
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.empty_like(self.flat)]
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the ends of the texts in them."""
        if len(self.numbers) > self.limit:
            self._forget()
        whole = {k for k, t in enumerate(texts) if any(m[:2] in t for m in self.marks)}
        counts, parts = [], []
        for k, text in enumerate(texts):
            if k in whole:
                counts.append(0)
                continue
            if self.lowers and (text.isascii() or not COMBINING.search(text)):
                text = text.lower() if text.isascii() else text.encode("utf-8", "replace").lower().decode()
            words = text.replace("\n", " ").split(" ")
            counts.append(len(words))
            parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self._learn()
        number = np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.uses = np.r_[self.uses, np.zeros(len(self.numbers) - len(self.uses), np.int64)]
        self.uses += np.bincount(number, minlength=len(self.uses))
        sizes = self.size[number]
        total = np.r_[0, np.cumsum(sizes)]
        ids = self.flat[np.repeat(self.begin[number] - total[:-1], sizes) + np.arange(total[-1])]
        ends = total[np.cumsum(counts, dtype=np.int64)] if counts else np.empty(0, np.int64)
        if not whole:
            return ids, ends
        starts = np.r_[0, ends[:-1]]
        by_text = [
            np.array(self._ids(t), dtype=np.uint32) if k in whole else ids[starts[k] : ends[k]]
            for k, t in enumerate(texts)
        ]
        return np.concatenate(by_text), np.cumsum([len(x) for x in by_text])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Path of a tokenizer file of the installed collection."""
    import public_tokenizers

    return public_tokenizers.path(name)
