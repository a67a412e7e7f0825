"""Vocabulary of a public SentencePiece model as plain tables: pieces, ids, scores, bytes, and a trie.

The file is read, never trained or copied; its path is a parameter everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Mark of a word's start in the pieces (U+2581).
MARK = "▁"


@dataclass
class Vocabulary:
    pieces: list[str]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: list[int]
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces))

    @cached_property
    def trie(self) -> Trie:
        return Trie(self.pieces)


@lru_cache(maxsize=4)
def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read the ordinary pieces and the 256 byte pieces of the model at ``path``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    ordinary = [i for i in range(n) if not special[i] and not model.is_byte(i)]
    return Vocabulary([model.id_to_piece(i) for i in ordinary], np.array(ordinary, np.int32),
                      np.array([model.get_score(i) for i in ordinary], np.float64), byte_ids)


class Trie:
    """Nodes are numbers, 0 the root; ``keys`` holds node * 2**21 + code point sorted, ``to`` the child reached."""

    def __init__(self, pieces: list[str]):
        children: dict[int, int] = {}
        ends: dict[int, int] = {}
        self.parent = [-1]
        self.char = [0]
        for number, piece in enumerate(pieces):
            node = 0
            for c in map(ord, piece):
                key = node << 21 | c
                if key not in children:
                    children[key] = len(self.parent)
                    self.parent.append(node)
                    self.char.append(c)
                node = children[key]
            ends[node] = number
        self.children = children
        self.piece = np.full(len(self.parent), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        keys = np.array(sorted(children), np.int64)
        self.keys, self.to = keys, np.array([children[k] for k in keys.tolist()], np.int32)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node by each code point, -1 where there is none."""
        want = nodes.astype(np.int64) << 21 | chars
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)
