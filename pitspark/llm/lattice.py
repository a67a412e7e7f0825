"""Segmentations of many words at once: the lattice of pieces over each word, walked through the trie with numpy.

A word is read behind the word mark. Edges are all substrings that are pieces; a character that is no piece
of its own is spelt by the byte pieces of its UTF-8 bytes, so every word has a segmentation. Piece numbers
run over the ordinary pieces, then the 256 bytes, then the stop of a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .pieces import MARK, Vocabulary

#: Characters of the words that are worked on together.
CELLS = 1 << 17


def symbols(vocabulary: Vocabulary) -> int:
    return len(vocabulary.pieces) + 256 + 1


def prior(vocabulary: Vocabulary) -> np.ndarray:
    """Log weights from the scores of the vocabulary file, normalised.

    The scores of the file order the pieces; the r-th best gets weight 1 / (r + 1), as in Zipf's law. Bytes
    and the stop get the weight of the last piece.
    """
    order = np.argsort(-vocabulary.scores, kind="stable")
    weight = np.empty(symbols(vocabulary))
    weight[order] = 1.0 / (np.arange(len(order)) + 1)
    weight[len(order):] = 1.0 / len(order)
    return np.log(weight / weight.sum())


@dataclass
class Lattice:
    """``edges``: (start, end, words, piece numbers), by start; ``spelt``: (start, words, byte matrix, byte counts) of characters without a piece."""

    length: np.ndarray
    edges: list[tuple[int, int, np.ndarray, np.ndarray]]
    spelt: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def build(words: list[str], vocabulary: Vocabulary) -> Lattice:
    trie = vocabulary.trie
    length = np.array([len(w) + 1 for w in words])
    chars = np.zeros((len(words), length.max()), np.int64)
    flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    chars[np.arange(chars.shape[1]) < length[:, None]] = flat
    edges, spelt = [], {}
    for start in range(chars.shape[1]):
        rows = np.flatnonzero(length > start)
        here, nodes, single = rows, np.zeros(len(rows), np.int64), np.zeros(len(words), bool)
        for end in range(start + 1, min(start + vocabulary.longest, chars.shape[1]) + 1):
            inside = length[rows] >= end
            rows, nodes = rows[inside], nodes[inside]
            nodes = trie.step(nodes, chars[rows, end - 1])
            there = nodes >= 0
            rows, nodes = rows[there], nodes[there]
            if not len(rows):
                break
            piece = trie.piece[nodes]
            ends = piece >= 0
            if end == start + 1:
                single[rows[ends]] = True
            if ends.any():
                edges.append((start, end, rows[ends], piece[ends]))
        bare = here[~single[here]]
        if len(bare):
            spelling = [chr(c).encode("utf-8", "surrogatepass") for c in chars[bare, start]]
            matrix = np.frombuffer(b"".join(b.ljust(4, b"\0") for b in spelling), np.uint8).reshape(-1, 4).astype(np.int64)
            spelt[start] = bare, matrix + len(vocabulary.pieces), np.array([len(b) for b in spelling])
    return Lattice(length, edges, spelt)


def _spelling(log_p: np.ndarray, matrix: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.where(np.arange(4) < counts[:, None], log_p[matrix], 0.0).sum(1)


def _ordered(lattice: Lattice, log_p: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Edges as (start, end, words, log weights) by start."""
    out = [(a, b, rows, log_p[piece]) for a, b, rows, piece in lattice.edges]
    out += [(a, a + 1, rows, _spelling(log_p, matrix, counts)) for a, (rows, matrix, counts) in lattice.spelt.items()]
    return sorted(out, key=lambda e: e[0])


def forward(lattice: Lattice, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log of the summed weight of all segmentations, up to every position and of the whole word."""
    alpha = np.full((len(lattice.length), lattice.length.max() + 1), -np.inf)
    alpha[:, 0] = 0.0
    for a, b, rows, weight in _ordered(lattice, log_p):
        alpha[rows, b] = np.logaddexp(alpha[rows, b], alpha[rows, a] + weight)
    return alpha, alpha[np.arange(len(lattice.length)), lattice.length]


def expected(lattice: Lattice, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, each counted ``times``, over all segmentations."""
    alpha, whole = forward(lattice, log_p)
    beta = np.full(alpha.shape, -np.inf)
    beta[np.arange(len(whole)), lattice.length] = 0.0
    for a, b, rows, weight in reversed(_ordered(lattice, log_p)):
        beta[rows, a] = np.logaddexp(beta[rows, a], beta[rows, b] + weight)
    out = np.zeros(len(log_p))
    for a, b, rows, piece in lattice.edges:
        share = np.exp(alpha[rows, a] + log_p[piece] + beta[rows, b] - whole[rows]) * times[rows]
        out += np.bincount(piece, share, minlength=len(out))
    for a, (rows, matrix, counts) in lattice.spelt.items():
        share = np.exp(alpha[rows, a] + _spelling(log_p, matrix, counts) + beta[rows, a + 1] - whole[rows]) * times[rows]
        inside = np.arange(4) < counts[:, None]
        out += np.bincount(matrix[inside], np.repeat(share, counts), minlength=len(out))
    return out


def together(words: list[str], cells: int = CELLS) -> Iterator[np.ndarray]:
    """Numbers of words to work on together, of like length, at most ``cells`` characters with padding."""
    length = np.array([len(w) + 1 for w in words])
    order = np.argsort(length, kind="stable")
    first = 0
    while first < len(order):
        last = first + max(1, min(len(order) - first, cells // int(length[order[first]])))
        while last - first > 1 and (last - first) * length[order[last - 1]] > cells:
            last = first + max(1, (last - first) // 2)
        yield order[first:last]
        first = last
