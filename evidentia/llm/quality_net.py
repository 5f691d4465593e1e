"""Operator 2: quality classifier, a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Each byte is one of 512 symbols: its value, and whether its word repeats the
word before it. The symbols are embedded, learned filters run over them, and the whole document is cut
into overlapping chunks: each filter's largest response in a chunk is kept, the chunks' responses are
averaged, and a logistic unit makes one probability of them. No byte is left out, however long the text; a long
one is worked through some blocks at a time.

It learns from a bounded sample of the labelled rows of the documents, ``SAMPLE`` of each class in the order of a
hash of their id, whatever their length: of texts of more than ``SAMPLE_CHARS`` characters it reads ``PIECES`` pieces
spread evenly over the text, of that length together (scoring reads all). The loss weighs the two classes by
their counts among all labelled rows of the documents.

Defined cases: a null or empty text scores as no response of any filter; with no labelled rows every
score is 0.5; with one class, a constant by the rule of succession. Null labels are ignored; repeated rows
of a label count once, by their smallest value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import held, text_slices, word_pieces
from .session import bounded_batches, small_table, table

SAMPLE, SAMPLE_CHARS, PIECES = 600, 131_072, 4
WIDTH, STRIDE, DEPTH, FILTERS = 8, 4, 8, 16
#: Filter positions in a block, blocks in a chunk, and blocks from one chunk to the next: chunks overlap by a block.
BLOCK, CHUNK, STEP = 64, 4, 3
PAD = 512
#: Bytes of a run of texts beyond which it is worked through by so many blocks of one text at a time.
LONG, AT_ONCE = 4 << 20, 4096
#: Bytes of texts that are scored together.
SCORED = 1 << 19


class ByteConvNet:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (PAD + 1, DEPTH)).astype(np.float32)
        self.embed[PAD] = 0
        self.filters = rng.normal(0, 1 / np.sqrt(WIDTH * DEPTH), (WIDTH * DEPTH, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.weights = rng.normal(0, 0.1, FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.constant: float | None = None

    @staticmethod
    def again(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each byte is of a word that repeats the word before it."""
        out = np.zeros(len(raw), bool)
        last, last_row = np.zeros(1, np.uint64), np.full(1, -1)
        for hashed, row, begins, ends in word_pieces(raw, offsets, False):
            same = np.flatnonzero((hashed == np.concatenate((last, hashed[:-1]))) & (row == np.concatenate((last_row, row[:-1]))))
            if len(same):
                mark = np.zeros(ends[same[-1]] - begins[same[0]] + 1, np.int8)
                mark[begins[same] - begins[same[0]]] = 1
                mark[ends[same] - begins[same[0]]] -= 1
                out[begins[same[0]] : ends[same[-1]]] = np.cumsum(mark[:-1], dtype=np.int8)
            if len(hashed):
                last, last_row = hashed[-1:], row[-1:]
        return out

    @classmethod
    def layout(cls, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a run of texts, each padded so that no filter sees two texts; first filter position of each text."""
        symbol = raw.astype(np.int16) + (cls.again(raw, offsets).astype(np.int16) << 8)
        size = np.diff(offsets)
        first = np.zeros(len(size) + 1, np.int64)
        np.cumsum(cls.places(size), out=first[1:])
        out = np.full(first[-1] * STRIDE + WIDTH, PAD, np.int16)
        out[np.arange(len(raw)) + np.repeat(first[:-1] * STRIDE + WIDTH - offsets[:-1], size)] = symbol
        return out, first

    @staticmethod
    def places(size):
        """Filter positions of a text."""
        return (size + STRIDE - 1) // STRIDE + WIDTH // STRIDE

    def long_tops(self, raw: np.ndarray) -> np.ndarray:
        """Each filter's largest response in each block of one text, which is laid out some blocks at a time."""
        again, places = self.again(raw, np.array([0, len(raw)])), int(self.places(len(raw)))
        out = []
        for start in range(0, places, AT_ONCE * BLOCK):
            stop = min(start + AT_ONCE * BLOCK, places)
            symbols = np.full((stop - start) * STRIDE + WIDTH, PAD, np.int16)
            low, high = max(0, start * STRIDE - WIDTH), min(len(raw), stop * STRIDE)
            put = low + WIDTH - start * STRIDE
            symbols[put : put + high - low] = raw[low:high].astype(np.int16) + (again[low:high].astype(np.int16) << 8)
            _, response = self.responses(symbols, stop - start)
            out.append(np.maximum.reduceat(response, np.arange(0, stop - start, BLOCK), axis=0))
        return np.concatenate(out)

    def responses(self, symbols: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows of embedded symbols, and every filter's response to each."""
        x = self.embed[symbols]
        shape = (places, WIDTH * DEPTH)
        seen = np.lib.stride_tricks.as_strided(x, shape, (STRIDE * DEPTH * 4, 4))
        return seen, seen @ self.filters

    @staticmethod
    def chunks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place of each block; the blocks of each chunk; the text of each chunk."""
        places = np.diff(first)
        blocks = (places + BLOCK - 1) // BLOCK
        block_at = np.zeros(len(blocks) + 1, np.int64)
        np.cumsum(blocks, out=block_at[1:])
        text = np.repeat(np.arange(len(blocks)), blocks)
        starts = first[text] + (np.arange(block_at[-1]) - block_at[text]) * BLOCK
        count = np.maximum(1, -(-(blocks - 1) // STEP))
        owner = np.repeat(np.arange(len(blocks)), count)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        member = number[:, None] * STEP + np.arange(CHUNK)[None, :]
        return starts, block_at[owner][:, None] + np.minimum(member, blocks[owner][:, None] - 1), owner

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's average over its chunks of the filters' largest responses."""
        if len(offsets) == 2 and len(raw) > LONG:
            tops = self.long_tops(raw)
            _, member, owner = self.chunks(np.array([0, self.places(len(raw))]))
        else:
            symbols, first = self.layout(raw, offsets)
            _, response = self.responses(symbols, int(first[-1]))
            starts, member, owner = self.chunks(first)
            tops = np.maximum.reduceat(response, starts, axis=0)
        top = tops[member].max(axis=1)
        top = np.maximum(top + self.shift, 0)
        total = np.zeros((len(offsets) - 1, FILTERS))
        np.add.at(total, owner, top)
        total /= np.bincount(owner, minlength=len(total))[:, None]
        total[np.diff(offsets) == 0] = 0
        return total

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.pooled(raw, offsets) @ self.weights.astype(np.float64) + float(self.bias[0]), -30, 30)))

    def _gradient(self, text: bytes, label: int, weight: float, out: list[np.ndarray]) -> None:
        raw, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        symbols, first = self.layout(raw, offsets)
        seen, response = self.responses(symbols, int(first[-1]))
        _, member, _ = self.chunks(first)
        best = [np.argmax(response[m[0] * BLOCK : (m[-1] + 1) * BLOCK], axis=0) + m[0] * BLOCK for m in member]
        where = np.array(best)  # chunk x filter
        every = np.arange(FILTERS)
        top = response[where, every] + self.shift
        active = (top > 0) / len(where)
        mean = np.maximum(top, 0).mean(axis=0)
        p = 1 / (1 + np.exp(-np.clip(mean @ self.weights + self.bias[0], -30, 30)))
        slope = weight * (p - label)
        back = (slope * self.weights)[None, :] * active  # chunk x filter
        d_embed, d_filters, d_shift, d_weights, d_bias = out
        for c, places in enumerate(where):
            d_filters += seen[places].T * back[c][None, :]
            d_shift += back[c]
            into = (self.filters * back[c][None, :]).T.reshape(FILTERS * WIDTH, DEPTH)
            np.add.at(d_embed, symbols[(places[:, None] * STRIDE + np.arange(WIDTH)[None, :]).ravel()], into)
        d_weights += slope * mean
        d_bias += slope

    def fit(self, texts: list[bytes], labels: list[int], weights: list[float], epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        """Adam on the weighted log loss; the rate falls to a tenth over the epochs."""
        rng = np.random.default_rng(seed)
        params = [self.embed, self.filters, self.shift, self.weights, self.bias]
        one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order, step = np.arange(len(texts)), 0
        total = epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            rng.shuffle(order)
            for k in range(0, len(order), batch):
                grads = [np.zeros_like(p) for p in params]
                for i in order[k : k + batch]:
                    self._gradient(texts[i], labels[i], weights[i], grads)
                step += 1
                now = rate * 0.1 ** (step / total)
                for p, g, m, v in zip(params, grads, one, two, strict=True):
                    g /= len(order[k : k + batch])
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
                self.embed[PAD] = 0
        return self


def learned_rows(labels: DataFrame) -> DataFrame:
    """One row (doc_id, quality) for each labelled document that may be learned from."""
    usable = F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))
    return labels.select("doc_id", "quality").filter(usable).groupBy("doc_id").agg(F.min("quality").alias("quality"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _spread(text: Column, chars: int) -> Column:
    """A text, or of a longer one ``PIECES`` pieces spread evenly over it, ``chars`` characters together."""
    size = chars // PIECES
    step = (F.length(text) - size) / (PIECES - 1)
    pieces = [F.substring(text, F.floor(step * k).cast("int") + 1, F.lit(size)) for k in range(PIECES)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(*pieces))


def fit_network(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> ByteConvNet:
    """Fit on a bounded sample of the labelled rows of ``docs``."""
    spark = docs.sparkSession
    # ids alone are joined; the texts of the chosen ones are read in a second pass
    usable = docs.select("doc_id").distinct().join(learned_rows(labels), "doc_id")
    place = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ranked = usable.withColumn("place", place).filter(F.col("place") <= sample).select("doc_id", "quality")
    count = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    net = ByteConvNet()
    if len(count) < 2:
        n, ones = sum(count.values()), count.get(1, 0)
        net.constant = (ones + 1) / (n + 2)
        return net
    ids = small_table(spark, ranked.collect(), "doc_id bigint, quality int")  # at most 2 * sample rows of two numbers
    rows = docs.select("doc_id", _spread(F.coalesce(F.col("text"), F.lit("")), chars).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = sorted(rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect(), key=lambda r: r["doc_id"])
    got = {q: sum(r["quality"] == q for r in rows) for q in (0, 1)}
    weight = {q: count[q] / got[q] * len(rows) / (count[0] + count[1]) for q in (0, 1)}
    return net.fit([r["text"].encode() for r in rows], [r["quality"] for r in rows], [weight[r["quality"]] for r in rows])


def score_texts(text: Column, shared) -> Column:
    """The probability of good quality of each text; ``shared`` is a broadcast network (some 20 kB)."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        held("net", lambda: None)  # other operators' models go
        net = shared.value
        found = [net.scores(raw, offsets) for _, _, raw, offsets in text_slices(column, SCORED)]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return score(text)


def quality_scores(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    scored = docs.select("doc_id", score_texts(F.col("text"), shared).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, net: ByteConvNet) -> DataFrame:
    """The rows of ``docs`` that the network does not reject, with their own columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.filter(score_texts(F.col("text"), shared) >= 0.5)


def op2_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document by a network fitted on the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit_network(docs, table(spark, sf_dir, "labels")))
