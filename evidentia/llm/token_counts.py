"""Operator 5: token counts of a unigram vocabulary by a trie over pre-tokens.

A pre-token is a word between white space with the mark of a word's start before it. All distinct
pre-tokens (but for those of more than ``LONGEST`` characters, whose forward states are kept only as far as the longest
piece reaches back) go into one trie whose nodes hold the forward state of the text on their path: the best sum of
piece scores and, of equal sums, the fewest pieces. The state of a prefix is computed once, whatever the
number of words that share it; a word's count is what its last node holds. Scores are whole numbers, so
that sums and ties do not depend on their order. A character that no piece holds costs one piece for each
of its bytes.

Defined cases: a null or empty text has no words and no tokens. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import held, text_slices
from .session import bounded_batches, table

#: Nodes a worker's trie may hold before it starts anew; a longer word is counted without the trie, which it would fill.
MOST_NODES, LONGEST = 1_500_000, 4096
#: Characters of a text that are split into words at once.
LONG = 1 << 20
_SPACE = re.compile(r"\s")
MARK = "▁"
UNIT = 1_000_000


def unigram_scores(model_file: str) -> dict[str, int]:
    """Pieces of a public vocabulary with scores by rank (Zipf's law), in millionths; the pieces are not trained."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usable = [k for k in range(pieces.get_piece_size()) if not (pieces.is_control(k) or pieces.is_unknown(k) or pieces.is_byte(k) or pieces.is_unused(k))]
    total = sum(1 / (rank + 10) for rank in range(len(usable)))
    return {pieces.id_to_piece(k): round(UNIT * -math.log((rank + 10) * total)) for rank, k in enumerate(usable)}


class UnigramTrie:
    """Forward scores of every prefix of the words seen so far."""

    def __init__(self, scores: dict[str, int]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0) - 10 * UNIT
        self._clear()

    def _clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.pieces = [0], [0]
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces in the best segmentation of a word (without the mark, which is put before it)."""
        got = self.known.get(word)
        if got is None:
            if len(word) > LONGEST:
                return self._walk(MARK + word)
            if len(self.best) > MOST_NODES:
                self._clear()
            got = self.known[word] = self._insert(MARK + word)
        return got

    def _walk(self, text: str) -> int:
        """What ``_insert`` gives, without nodes: the states of the last ``longest`` places in a ring."""
        size, get = self.longest + 1, self.scores.get
        best, pieces = [0] * size, [0] * size
        for j, c in enumerate(text):
            n = len(c.encode())
            top, fewest = best[j % size] + n * self.byte, pieces[j % size] + n
            for i in range(max(0, j + 1 - self.longest), j + 1):
                s = get(text[i : j + 1])
                if s is not None:
                    total = best[i % size] + s
                    if total > top or (total == top and pieces[i % size] + 1 < fewest):
                        top, fewest = total, pieces[i % size] + 1
            best[(j + 1) % size], pieces[(j + 1) % size] = top, fewest
        return pieces[len(text) % size]

    def _insert(self, text: str) -> int:
        node, path = 0, [0]
        child, best, pieces, get = self.child, self.best, self.pieces, self.scores.get
        for j, c in enumerate(text):
            after = child.get((node, c))
            if after is None:
                n = len(c.encode())
                top, fewest = best[node] + n * self.byte, pieces[node] + n
                for i in range(max(0, j + 1 - self.longest), j + 1):
                    s = get(text[i : j + 1])
                    if s is not None:
                        at = path[i]
                        total = best[at] + s
                        if total > top or (total == top and pieces[at] + 1 < fewest):
                            top, fewest = total, pieces[at] + 1
                after = child[node, c] = len(best)
                best.append(top)
                pieces.append(fewest)
            node = after
            path.append(node)
        return pieces[node]


def parts(text: str) -> Iterator[str]:
    """A long text in parts that end before white space."""
    start = 0
    while len(text) - start > LONG:
        found = _SPACE.search(text, start + LONG)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _trie(shared) -> UnigramTrie:
    scores = shared.value
    return held(("trie", len(scores), sum(scores.values())), lambda: UnigramTrie(scores))


def count_tokens(docs: DataFrame, scores: dict[str, int]) -> DataFrame:
    """doc_id, n_words and n_tokens of every row of ``docs``; the vocabulary is broadcast (its size is fixed)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    @F.arrow_udf("struct<n_words:bigint,n_tokens:bigint>")
    def counts(column: pa.Array) -> pa.Array:
        trie, words, tokens = _trie(shared), [], []
        for start, stop, _, _ in text_slices(column):
            for text in column.slice(start, stop - start).to_pylist():
                n = total = 0
                for part in parts(text or ""):
                    found, known = part.split(), trie.known
                    n += len(found)
                    try:
                        total += sum([known[w] for w in found])
                    except KeyError:
                        total += sum([trie.count(w) for w in found])
                words.append(n)
                tokens.append(total)
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["n_words", "n_tokens"])

    return docs.select("doc_id", counts(F.col("text")).alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


def op5_trie_counts(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """Words and unigram tokens of every document."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), unigram_scores(model_file or public_tokenizers.path("piece_bpe_32k.model")))
