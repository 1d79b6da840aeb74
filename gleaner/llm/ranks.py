"""Byte-pair merges of a vocabulary as ranks of byte strings, so that many words are encoded in one call.

In a vocabulary with word ends, a word is followed by a blank that stands for its end, which joins the last byte before any
other merge; in one without, a blank before the word is a byte of it. After that, pairs
merge by the rank of the bytes they make, not by the rank of the pair. Both give the same ids if every token of the vocabulary,
taken alone, is merged into itself: what happens inside the bytes of a token depends on these bytes only, as long as nothing
merges across their border, so two neighbours that make a token's bytes are the pair that the vocabulary merges.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

WORD_END = "</w>"
#: Byte-level vocabularies write each byte as a visible character: itself, or the next free one from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in VISIBLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in VISIBLE)}
#: Words are sequences of anything but blanks, each with its end.
WORDS = r"[^ ]+ "
#: A blank and letters, or marks.
SPACED = r" [^ .,;:!?]+|[.,;:!?]+"


@lru_cache(maxsize=2)
def _model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)["model"]


def _pairs(model: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]


def _alone(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    while len(symbols) > 1:
        found = [ranks.get(p, len(ranks)) for p in zip(symbols, symbols[1:])]
        at = found.index(min(found))
        if found[at] == len(ranks):
            break
        symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2:]]
    return symbols


@lru_cache(maxsize=2)
def by_bytes(path: str) -> bool:
    """Whether the merges of the vocabulary at `path` can be ranked by the bytes that they make."""
    model = _model(path)
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != WORD_END or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
        return False
    pairs, vocab = _pairs(model), model["vocab"]
    merged = [a + b for a, b in pairs]
    singles = [*BYTES.values(), *(c + WORD_END for c in BYTES.values())]
    ranks = {p: i for i, p in enumerate(pairs)}
    if len({*merged, *singles}) < len(merged) + len(singles) or not all(t in vocab for t in [*merged, *singles]):
        return False
    for token in merged:
        body = token.removesuffix(WORD_END)
        if not all(c in _byte_of() for c in body) or _alone([*body[:-1], body[-1] + token[len(body):]], ranks) != [token]:
            return False
    return True


@lru_cache(maxsize=2)
def spaced_by_bytes(path: str) -> bool:
    """The same for a vocabulary without word ends."""
    model = _model(path)
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    pairs, vocab, byte_of = _pairs(model), model["vocab"], _byte_of()
    merged = [a + b for a, b in pairs]
    ranks = {p: i for i, p in enumerate(pairs)}
    if len({*merged, *BYTES.values()}) < len(merged) + len(BYTES) or not all(t in vocab for t in [*merged, *BYTES.values()]):
        return False
    return all(all(c in byte_of for c in token) and _alone([*token], ranks) == [token] for token in merged)


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    return {c: b for b, c in BYTES.items()}


def encoding(path: str):
    """The encoder of words that blanks end, the vocabulary's ids by its numbers, and which numbers end a word."""
    import tiktoken

    model, byte_of = _model(path), _byte_of()
    merged = [a + b for a, b in _pairs(model)]
    tokens = [*BYTES.values(), *(c + WORD_END for c in BYTES.values()), *merged]
    bodies = [t.removesuffix(WORD_END) for t in tokens]
    raw = [bytes(map(byte_of.__getitem__, b)) + b" " * (t != b) for t, b in zip(tokens, bodies)]
    encoder = tiktoken.Encoding("words", pat_str=WORDS, mergeable_ranks={r: i for i, r in enumerate(raw)}, special_tokens={})
    return encoder, np.array([model["vocab"][t] for t in tokens], np.uint32), np.array([t != b for t, b in zip(tokens, bodies)])


def spaced_encoding(path: str):
    """The encoder of words that follow a blank, the vocabulary's ids by its numbers, and which numbers begin a word."""
    import tiktoken

    model, byte_of = _model(path), _byte_of()
    tokens = [*BYTES.values(), *(a + b for a, b in _pairs(model))]
    raw = [bytes(map(byte_of.__getitem__, t)) for t in tokens]
    encoder = tiktoken.Encoding("spaced words", pat_str=SPACED, mergeable_ranks={r: i for i, r in enumerate(raw)}, special_tokens={})
    return encoder, np.array([model["vocab"][t] for t in tokens], np.uint32), np.array([r[0] == 32 for r in raw])
