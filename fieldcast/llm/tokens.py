"""Token ids of texts by the tokenizers library, with the ids of words remembered.

A vocabulary splits a text into pieces by a pattern and encodes each piece by
itself, so a piece that was seen before need not be encoded again.  That is
done for texts of plain characters, for which the pattern is stated here;
any other text goes to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts of these characters, and no "<|", are plain.
_PLAIN = re.compile("[\t\n\r -~\xa1-\xff]*")
#: The patterns of the vocabularies by file name, for plain texts.
_PIECES = {
    "byte_bpe_50k.json": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\t\n\r {_LETTER}{_NUMBER}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"),
    "word_bpe_49k.json": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t\n\r {_LETTER}{_NUMBER}]+"),
}
#: Pieces that a task remembers (some 200 bytes each), and new pieces that are encoded in one go.
REMEMBERED, TOGETHER = 800_000, 4_000
#: Pieces that a text of many keeps apart, how to join them, and the mark of a token at a word's edge.
_WORD = {
    "byte_bpe_50k.json": (re.compile(f" [{_LETTER}]+"), "", "\u0120", True),
    "word_bpe_49k.json": (re.compile(f"[{_LETTER}]+"), " ", "</w>", False),
}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _memory(path: str) -> dict[str, bytes]:
    return {}


def forget() -> None:
    """Give back what was remembered, at the end of a task: the Python worker goes on to other work."""
    _memory.cache_clear()


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    """Ids of each text as unsigned 32-bit integers, without special tokens."""
    tokenizer, memory = _tokenizer(path), _memory(path)
    pattern = _PIECES.get(os.path.basename(path))
    out: list[np.ndarray | None] = [None] * len(texts)
    lower = os.path.basename(path) == "word_bpe_49k.json"
    plain = [i for i, t in enumerate(texts) if pattern and "<|" not in t and _PLAIN.fullmatch(t)]
    pieces = {i: pattern.findall(texts[i].lower() if lower else texts[i]) for i in plain}
    new = list(set().union(*pieces.values()).difference(memory)) if pieces else []
    fresh = _encode_pieces(new, path)
    known = memory
    if len(memory) + len(fresh) <= REMEMBERED:
        memory.update(fresh)
    elif fresh:
        known = _Two(fresh, memory)
    for i, found in pieces.items():
        out[i] = np.frombuffer(b"".join(map(known.__getitem__, found)), dtype="<u4")
    rest = [i for i in range(len(texts)) if out[i] is None]
    for i, e in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, dtype="<u4")
    return out


@lru_cache(maxsize=2)
def _edges(path: str) -> np.ndarray:
    """For each id whether its token stands at the edge of a word."""
    _, _, mark, at_start = _WORD[os.path.basename(path)]
    vocabulary_ = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary_.values()) + 1, dtype=bool)
    out[[i for t, i in vocabulary_.items() if (t.startswith(mark) if at_start else t.endswith(mark))]] = True
    return out


def _encode_pieces(pieces: list[str], path: str) -> dict[str, bytes]:
    """Ids of each piece: words many at a time, cut apart at the tokens that stand at an edge; other pieces singly."""
    tokenizer, out = _tokenizer(path), {}
    form, between, _, at_start = _WORD.get(os.path.basename(path), (None, "", "", True))
    words = [p for p in pieces if form and form.fullmatch(p)]
    for k in range(0, len(words), TOGETHER):
        some = words[k : k + TOGETHER]
        ids = np.array(tokenizer.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
        edge = np.flatnonzero(_edges(path)[ids])
        if len(edge) == len(some):
            cuts = 4 * (np.r_[edge, len(ids)] if at_start else np.r_[0, edge + 1])
            data, at = ids.tobytes(), cuts.tolist()
            out.update(zip(some, [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
    singly = [p for p in pieces if p not in out]
    out.update((p, array("I", e.ids).tobytes()) for p, e in zip(singly, tokenizer.encode_batch_fast(singly, add_special_tokens=False), strict=True))
    return out


class _Two(dict):
    """The pieces of this call, and behind them the remembered ones."""

    def __init__(self, first: dict, second: dict):
        super().__init__(first)
        self.second = second

    def __missing__(self, key: str) -> bytes:
        return self.second[key]


def size(path: str) -> int:
    """Ids of the vocabulary."""
    return _tokenizer(path).get_vocab_size()
