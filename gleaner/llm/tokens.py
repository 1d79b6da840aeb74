"""Token ids of whole texts inside tasks, through a memo of words."""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner.llm import ranks
from gleaner.llm.ranks import BYTES

#: Words that a worker remembers; beyond it, those that came only once are forgotten. It does not change results.
MEMO_WORDS = 400_000
ENCODE_AT_ONCE = 4096

#: A line break, Latin letters that have one lower-case form of one code point, marks; a blank marks a first word.
PLAIN = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*) ?")

#: Such a word with a space before it.
SPACED = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?]*")

def _as_bytes(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(BYTES)


#: White space other than the blank and the line break, and the separators that only some libraries take for white space.
OTHER_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Separators that Arrow and Python take for white space and the tokenizers' patterns do not.
SEPARATORS = OTHER_SPACES[4:8]
MARKS = ".,;:!?"
BEFORE_MARKS = re.compile(r"([^.,;:!?])(?=[.,;:!?])")
#: Code points of a word up to which it is encoded together with others.
LONGEST = 200


class WordMemo:
    """Encodes texts as the tokenizer would, but each distinct word only once.

    Byte-pair merges never cross the boundaries of the tokenizer's first split. For `spaces="dropped"` (white space only
    separates) those include every run of white space. For `spaces="leading"` (a space belongs to the word after it) they
    include every single space or line break between two words. Texts in which other white space occurs are encoded whole.
    `by_bytes` says that `ranks.by_bytes` (for leading spaces `ranks.spaced_by_bytes`) holds for the vocabulary.
    """

    def __init__(self, path: str, spaces: str, by_bytes: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.leading = {"leading": True, "dropped": False}[spaces]
        self.encoder = (ranks.spaced_encoding if self.leading else ranks.encoding)(path) if by_bytes else None
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {"": 0}  # the empty word has no ids
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.hits = np.zeros(1 << 16, np.int64)
        self.used, self.entries = 0, 1

    def _shrink(self) -> None:
        """Keeps the words that came more than once, at most half of the memo, the most frequent ones."""
        hits, words = self.hits[: self.entries], list(self.place)
        hits[0] = 0
        kept = np.flatnonzero(hits > 1)
        if len(kept) > MEMO_WORDS // 2:
            kept = np.sort(kept[np.argsort(-hits[kept], kind="stable")[: MEMO_WORDS // 2]])
        found = [self.ids[s: s + n].tolist() for s, n in zip(self.starts[kept].tolist(), self.lengths[kept].tolist())]
        kept_words = [words[i] for i in kept.tolist()]
        self._clear()
        self.place.update(zip(kept_words, self._keep(found)))

    def _store(self, texts: list[str]) -> range:
        """Encodes texts and keeps their ids; the numbers of their entries."""
        first = self.entries
        for i in range(0, len(texts), ENCODE_AT_ONCE):
            self._keep([e.ids for e in self.tokenizer.encode_batch(texts[i: i + ENCODE_AT_ONCE], add_special_tokens=False)])
        return range(first, self.entries)

    def _keep(self, found: list[list[int]]) -> range:
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return self._add(np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> range:
        first, need, entries = self.entries, self.used + len(ids), self.entries + len(lengths)
        while need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while entries > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.ids[self.used: need] = ids
        self.starts[first: entries] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first: entries] = lengths
        self.used, self.entries = need, entries
        return range(first, entries)

    def _learn_plain(self, words: list[str]) -> list[str]:
        """Encodes the words of Latin letters, perhaps with marks behind them, in one call; the others are given back."""
        encoder, numbers, ends = self.encoder
        plain = [len(w) <= LONGEST and PLAIN.fullmatch(w) is not None for w in words]
        chosen = list(compress(words, plain))
        if chosen:
            marked = np.fromiter((w[-1] in MARKS for w in chosen), bool, len(chosen))
            text = " ".join([w if not m else BEFORE_MARKS.sub(r"\1 ", w, count=1) for w, m in zip(chosen, marked.tolist())]).lower()
            found = np.array(encoder.encode_ordinary(text + " "), np.int64)
            last = np.flatnonzero(ends[found])[np.cumsum(1 + marked) - 1]  # a word with marks has two ends
            self.place.update(zip(chosen, self._add(numbers[found], np.diff(last, prepend=-1))))
        return [w for w, p in zip(words, plain) if not p]

    def _learn_spaced(self, words: list[str]) -> list[str]:
        """The same where spaces lead, for words with a space before them."""
        encoder, numbers, begins = self.encoder
        plain = [len(w) <= LONGEST and SPACED.fullmatch(w) is not None for w in words]
        chosen = list(compress(words, plain))
        if chosen:
            found = np.array(encoder.encode_ordinary(" " + " ".join(chosen)), np.int64)
            first = np.flatnonzero(begins[found])
            self.place.update(zip(chosen, self._add(numbers[found], np.diff(first, append=len(found)))))
        return [w for w, p in zip(words, plain) if not p]

    def _learn(self, words: list[str]) -> None:
        if self.encoder and self.leading:
            words = self._learn_spaced(words)
        elif self.encoder:
            rest = self._learn_plain(words)
            self.place.update(zip(rest, self._store(rest)))
            return
        plain = list(map(self._plain, words))
        simple = [(w, ids) for w, ids in zip(words, plain) if ids is not None]
        self.place.update(zip((w for w, _ in simple), self._keep([ids for _, ids in simple])))
        rest = [w for w, ids in zip(words, plain) if ids is None]
        # a first word, marked by a blank behind it, has no space before it
        as_text = [w[:-1] if w[-1] == " " else w if w[0] == "\n" else " " + w for w in rest] if self.leading else rest
        self.place.update(zip(rest, self._store(as_text)))

    def _plain(self, word: str) -> list[int] | None:
        """The ids of a word of Latin letters, perhaps with marks behind it: its pieces need no normaliser or splitter."""
        m = PLAIN.fullmatch(word)
        if not m:
            return None
        line, letters, marks = m.groups()
        if self.leading:
            before = "" if word[-1] == " " else BYTES[10] if line else BYTES[32]
            pieces = ([before] if line else []) + [("" if line else before) + _as_bytes(letters)]
        else:
            pieces = [_as_bytes(letters.lower())]
        if marks:
            pieces.append(marks)
        return [t.id for p in pieces for t in self.model.tokenize(p)]

    def _words(self, text: str) -> list[str] | None:
        """The words to look up, where spaces lead; None if the text has to be encoded whole."""
        lines = text.replace("\n", " \n")
        if not text or "  " in lines or "\n " in lines or lines[0] == " " or lines[-1] in " \n" or any(c in text for c in OTHER_SPACES):
            return None
        words = lines.split(" ")
        words[0] += " "
        return words

    def _distinct(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
        """Words to look up, the number among them of every word of the texts, words per text, and which texts to encode whole.

        A text without words and one to encode whole have one empty word.
        """
        if self.leading:
            words = [self._words(t) for t in texts]
            flat = list(chain.from_iterable(w if w is not None else ("",) for w in words))
            counts = np.fromiter((1 if w is None else len(w) for w in words), np.int64, len(words))
            return flat, np.arange(len(flat)), counts, [i for i, w in enumerate(words) if w is None]
        whole = [i for i, t in enumerate(texts) if any(c in t for c in SEPARATORS)]
        some = dict.fromkeys(whole, "")
        split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array([some.get(i, t) for i, t in enumerate(texts)], pa.large_string())))
        flat = split.flatten().dictionary_encode()
        return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64), whole

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and their number per text."""
        if self.entries > MEMO_WORDS:
            self._shrink()
        words, numbers, counts, whole = self._distinct(texts)
        entry = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(entry < 0).tolist()
        if new:
            missing = list(map(words.__getitem__, new))
            self._learn(list(dict.fromkeys(missing)))
            entry[new] = list(map(self.place.__getitem__, missing))
        at = entry[numbers]
        entries, used = self.entries, self.used
        self.hits[:entries] += np.bincount(at, minlength=entries)
        upto = np.append(0, np.cumsum(counts))
        at[upto[np.array(whole, np.int64)]] = self._store([texts[i] for i in whole])
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        source = np.repeat(self.starts[at] - (ends - lengths), lengths)
        source += np.arange(len(source))
        out = self.ids[source]
        self.entries, self.used = entries, used  # whole texts are not remembered
        return out, np.diff(np.append(0, ends)[upto])


@lru_cache(maxsize=2)
def memo(path: str, spaces: str, by_bytes: bool = False) -> WordMemo:
    """One memo per worker, kept from task to task."""
    return WordMemo(path, spaces, by_bytes)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end_id` after each text."""
    ends = np.cumsum(counts) + np.arange(len(counts))
    out = np.empty(len(ids) + len(counts), np.uint32)
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = ids
    out[ends] = end_id
    return out, counts + 1
