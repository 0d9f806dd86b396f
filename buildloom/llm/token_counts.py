"""Word-piece counts by a linear longest-match automaton.

The vocabulary is a trie.  A node whose string is not matched any further fails over to the node
reached by taking off the longest pieces, and carries how many were popped; so a word's number of
greedy longest-match pieces comes from one walk over its characters, and no piece is ever built.
Each worker remembers the counts of a bounded number of words.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 200_000
START = "▁"


class PieceAutomaton:
    """Trie, failure links and popped-piece counts of a set of pieces."""

    def __init__(self, pieces):
        self.kids: list[dict[str, int]] = [{}]
        parent, letter, final = [0], [""], [False]
        for piece in pieces:
            at = 0
            for c in piece:
                nxt = self.kids[at].get(c)
                if nxt is None:
                    nxt = self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    parent.append(at)
                    letter.append(c)
                    final.append(False)
                at = nxt
            if at:
                final[at] = True
        #: failure node (-1: none) and pieces popped on the way there
        self.fail, self.pops = [-1] * len(self.kids), [0] * len(self.kids)
        level = [0]
        while level:
            level = [k for v in level for k in self.kids[v].values()]
            for v in level:
                if final[v]:
                    self.fail[v], self.pops[v] = 0, 1
                    continue
                u = parent[v]
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and letter[v] not in self.kids[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.kids[z][letter[v]], popped

    def count(self, word: str) -> int:
        """Pieces of the word by greedy longest match; 0 if some part of it matches no piece."""
        kids, fail, pops = self.kids, self.fail, self.pops
        v = n = 0
        for c in word:
            while (nxt := kids[v].get(c)) is None:
                if fail[v] < 0:
                    return 0
                n += pops[v]
                v = fail[v]
            v = nxt
        while v:
            if fail[v] < 0:
                return 0
            n += pops[v]
            v = fail[v]
        return n


def read_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


@lru_cache(maxsize=2)
def automaton(path: str) -> PieceAutomaton:
    return PieceAutomaton(read_pieces(path))


def _count(path: str):
    def run(batches):
        pieces, known = automaton(path), {}
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                new = [w for w in set(words) if w not in known]
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, set(words)
                for w in new:
                    known[w] = pieces.count(START + w)
                found = list(map(known.__getitem__, words))
                unknown = found.count(0)
                rows.append((len(words), sum(found) + unknown, unknown))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) of each row of docs.

    Words are what Unicode white space parts; each is matched from its start mark on.  A word with a
    part that no piece matches counts as one unknown token.  A null or blank text has no words.
    Repeated rows and null ids stay; other columns are not read; an empty table gives an empty one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_count(path), f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
