"""Token counts by a linear longest-match automaton.

The pieces form a trie whose nodes carry a failure link and the number of pieces popped on the way along
it. Reading a word once, character by character, then counts the pieces that greedy longest match would
cut, without building one: a failing step adds the popped count and follows the link, so the work is
linear in the word. Text needs no shuffle; the automaton is as large as the vocabulary file and travels
as one broadcast of that bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import DEFAULT_MODEL, MARK, Trie, load
from .shared import WORD

#: Words a task remembers before it starts again; bounds its memory and changes no result.
REMEMBER = 200_000


class Automaton:
    def __init__(self, pieces: list[str]):
        trie = Trie(pieces)
        self.goto = trie.children
        n = len(trie.parent)
        self.fail, self.popped = [-1] * n, [0] * n
        depth = [0] * n
        for node in range(1, n):
            depth[node] = depth[trie.parent[node]] + 1
        for node in sorted(range(1, n), key=depth.__getitem__):
            if trie.piece[node] >= 0:
                self.fail[node], self.popped[node] = 0, 1
                continue
            above, char = trie.parent[node], trie.char[node]
            link, count = self.fail[above], self.popped[above]
            while link >= 0 and (to := self.goto.get(link << 21 | char)) is None:
                count += self.popped[link]
                link = self.fail[link]
            if link >= 0:
                self.fail[node], self.popped[node] = to, count

    def count(self, word: str) -> int:
        """Pieces of greedy longest match over the whole of ``word``; -1 if some part matches no piece."""
        goto, fail, popped = self.goto, self.fail, self.popped
        node = total = 0
        for char in map(ord, word):
            while (to := goto.get(node << 21 | char)) is None:
                if fail[node] < 0:
                    return -1
                total += popped[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return -1
            total += popped[node]
            node = fail[node]
        return total


def count_tokens(df: DataFrame, model: str = DEFAULT_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_tokens, n_unknown`` (long) of every row.

    A word is a run of characters outside space and 0x09-0x0D; it is read behind the word mark of the
    vocabulary. A word that greedy longest match cannot cut whole is one unknown token. A null or empty
    text has zero of each. Rows are independent: repeated rows and null ids stay, other columns are left out.
    """
    automaton = df.sparkSession.sparkContext.broadcast(Automaton(load(model).pieces))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType)] + [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, words_of, seen = automaton.value.count, re.compile(WORD).findall, {}
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for text in batch.column(1):
                n = tokens = unknown = 0
                for word in words_of(text.as_py() or ""):
                    got = seen.get(word)
                    if got is None:
                        if len(seen) >= REMEMBER:
                            seen.clear()
                        got = seen[word] = count(MARK + word)
                    n += 1
                    if got < 0:
                        unknown += 1
                    else:
                        tokens += got
                for column, value in zip(columns, (n, tokens + unknown, unknown), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)
