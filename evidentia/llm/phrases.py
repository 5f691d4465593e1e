"""Operator 11: phrase collocations by level-wise passes.

A text is lower-cased (A-Z only) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words ``[^\\x20\\x09]+``. Pass k
counts the phrases of k words whose first and last k-1 words are both frequent, for no other phrase of k words can be
frequent. What is frequent goes to the workers as a table of bits by hash: up to ``SENT_BITS`` as a broadcast variable,
larger ones as files of the shared folder that workers map, ``MOST_BITS`` at most. Two phrases that share a bit only make a worker
count a phrase more; every count is taken over the phrase itself and cut at the threshold afterwards, so that the
tables of levels are exact at every size. Within a run of some megabyte of text, words are told apart by 64 bits.

A phrase's score is that of its weakest cut, floor(1000 * a * n / (l * r)), looked up in the tables of levels, in whole numbers of
38 digits. Every part of a frequent phrase is frequent, so that the tables hold all that is asked of them. A phrase is dropped
that lies in a longer one which is as frequent; if such a longer one has two words more or three, one of those
between has the same count, so that phrases of one word more are enough to find it.

Defined cases: a null or empty text has no words; a null language is ``und``, with the documents of a language of that name; repeated
rows count each time; other columns are ignored; an empty table gives no rows. A text of any length is worked through in
pieces, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import mix64, text_slices, word_pieces
from .session import SENT_ROWS, bounded_batches, cut, shared_folder, table
from .shared_arrays import mapped, save

LONGEST, LEAST, BEST, UNNAMED = 5, 100, 2000, "und"
#: Bits of a table that each frequent phrase has; logarithms of the most bits of a table that is sent, of any, and of a file.
BITS_EACH, SENT_BITS, MOST_BITS, FILE_BITS = 16, 26, 33, 27

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
_SPACES = _BREAKS.copy()
_SPACES[[9, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


class BitTable:
    """Whether the bit of a hash is set; the parts of the table lie in order of the hash's highest bits."""

    def __init__(self, bits: int, parts: list[np.ndarray]) -> None:
        self.bits, self.parts, self.within = bits, parts, bits - (len(parts).bit_length() - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        if len(self.parts) == 1:
            return self._in(self.parts[0], at)
        out, part = np.zeros(len(keys), bool), at >> self.within
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(len(self.parts) + 1))
        for k in np.flatnonzero(np.diff(edges)):
            own = order[edges[k] : edges[k + 1]]
            out[own] = self._in(self.parts[k], at[own] & ((1 << self.within) - 1))
        return out

    @staticmethod
    def _in(part: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (part[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _hashes(langs: pa.Array, phrases: pa.Array, k: int) -> np.ndarray:
    """Hashes of phrases of ``k`` words each."""
    langs = langs.dictionary_encode()
    salts = np.array([hash_of(name) for name in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
    out = []
    for start, stop, raw, offsets in text_slices(phrases):
        word = np.concatenate([w for w, *_ in word_pieces(raw, offsets, lower=False, spaces=_SPACES)]).reshape(-1, k)
        h = mix64(word[:, 0] ^ salts[start:stop])
        for j in range(1, k):
            h = mix64(h * _ODD + word[:, j])
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bit_table(level: DataFrame, k: int) -> Callable[[], BitTable]:
    """The table of the phrases of a level, of ``k`` words each, built by tasks that own a range of hashes each; gives what opens it."""
    spark = level.sparkSession
    bits = min(max((max(level.count(), 1) * BITS_EACH - 1).bit_length(), 12), MOST_BITS)
    high = max(4, bits - FILE_BITS)
    folder = None if bits <= SENT_BITS else shared_folder(spark, "phrase-bits")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _hashes(batch.column(0), batch.column(1), k)
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - high)).astype(np.int32)), pa.array(h.view(np.int64))], ["part", "h"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part, number = np.zeros(1 << (bits - high - 3), np.uint8), batch.column(0)[0].as_py()
            at = ((batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - bits)) & np.uint64((1 << (bits - high)) - 1)).astype(np.int64)
            np.bitwise_or.at(part, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if part is not None:
            if folder:
                save(folder, f"{number:07d}", part)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([b"" if folder else part.tobytes()], pa.binary())], ["part", "data"])

    keyed = level.select("lang", "phrase").mapInArrow(hashed, "part int, h bigint")
    found = {r["part"]: r["data"] for r in keyed.repartitionById(1 << high, "part").mapInArrow(build, "part int, data binary").collect()}  # 8 MB at most
    none = np.zeros(1 << (bits - high - 3), np.uint8)
    if folder:
        return lambda: BitTable(bits, [mapped(folder, f"{k:07d}", np.uint8) if k in found else none for k in range(1 << high)])
    sent = spark.sparkContext.broadcast(b"".join(found.get(k, none.tobytes()) for k in range(1 << high)))
    return lambda: BitTable(bits, [np.frombuffer(sent.value, np.uint8)])


def joined(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Phrases from the words of each row of ``begins`` and ``ends``, with one space between."""
    n, k = begins.shape
    sizes = ends - begins
    sizes[:, : k - 1] += 1
    flat = sizes.ravel()
    offsets = np.concatenate(([0], np.cumsum(flat)))
    source = np.repeat(begins.ravel() - offsets[:-1], flat) + np.arange(offsets[-1])
    out = raw[np.minimum(source, len(raw) - 1)]
    if k > 1:
        out[offsets[1:].reshape(n, k)[:, : k - 1].ravel() - 1] = 32
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets[::k].astype(np.int32)), pa.py_buffer(out))


def _lowered(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)


def _counts(k: int, frequent: Callable[[], BitTable] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What counts the phrases of ``k`` words of batches (lang, text). Pass 1 also gives the words of each language, with a null phrase."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = frequent() if frequent else None
        for batch in batches:
            langs = batch.column(0).fill_null(UNNAMED).dictionary_encode()
            names, codes = langs.dictionary, langs.indices.to_numpy()
            salts = np.array([hash_of(name) for name in names.to_pylist()], np.uint64)
            for start, stop, raw, offsets in text_slices(batch.column(1)):
                raw = _lowered(raw)
                own = codes[start:stop]
                for lang, _, words, n in _run(raw, offsets, own, salts, k, seen):
                    phrases = joined(raw, *words)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), phrases, pa.array(n)], schema=_COUNTED)
                    if k == 1:
                        total = np.bincount(lang, weights=n, minlength=len(names)).astype(np.int64)
                        some = np.flatnonzero(total)
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.nulls(len(some), pa.string()), pa.array(total[some])], schema=_COUNTED)

    return count


def hash_of(text: str) -> int:
    """64 bits of a language's name."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def _run(raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray, salts: np.ndarray, k: int, seen: BitTable | None):
    """Of a run of texts, a piece at a time: language, hash, (first bytes, bytes after the last) of the words, and count of each phrase that may be frequent."""
    held: tuple[np.ndarray, ...] | None = None  # the last k - 1 words, for the phrases that end in the next piece
    done = breaks = 0
    for word, row, begins, ends in word_pieces(raw, offsets, lower=False, spaces=_SPACES):
        if not len(word):
            continue
        cuts = np.flatnonzero(_BREAKS[raw[done : ends[-1]]]) + done
        piece = np.searchsorted(cuts, begins) + breaks
        done, breaks = int(ends[-1]), breaks + len(cuts)
        new = (word, row, piece, begins, ends)
        word, row, piece, begins, ends = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        if k > 1:
            held = tuple(x[-(k - 1) :] for x in (word, row, piece, begins, ends))
        n = len(word) - k + 1
        if n <= 0:
            continue
        h = mix64(word ^ salts[langs[row]])
        for j in range(1, k - 1):
            h = mix64(h[:-1] * _ODD + word[j:])
        if k > 1:
            found = seen.has(h)
            starts = np.flatnonzero(found[:-1] & found[1:] & (row[:n] == row[k - 1 :]) & (piece[:n] == piece[k - 1 :]))
            h = mix64(h[starts] * _ODD + word[starts + k - 1])
        else:
            starts = np.arange(n)
        h, first, counts = np.unique(h, return_index=True, return_counts=True)
        if len(h):
            which = starts[first][:, None] + np.arange(k)
            yield langs[row[which[:, 0]]], h, (begins[which], ends[which]), counts


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n), and the table (lang, phrase, f) of the frequent phrases of each length that has any."""
    bounded_batches(docs.sparkSession)
    texts, tables, frequent, totals = docs.select("lang", "text"), [], None, None
    for k in range(1, longest + 1):
        counted = texts.mapInArrow(_counts(k, frequent), "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        found = cut(counted.filter((F.col("f") >= least) | F.col("phrase").isNull()), f"phrases-{k}")
        if k == 1:
            totals = found.filter("phrase is null").select("lang", F.col("f").alias("n"))
            found = found.filter("phrase is not null")
        if found.isEmpty():
            break
        tables.append(found)
        if k < longest:
            frequent = bit_table(found, k)
    return totals, tables


def _decimal(column: str, digits: int = 38) -> Column:
    return F.col(column).cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``best`` phrases of each language."""
    totals, tables = levels(docs, longest, least)
    spark = docs.sparkSession
    if len(tables) < 2:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    parts = tables[0].select("lang", "phrase", "f", F.lit(1).alias("k"))
    for k, level in enumerate(tables[1:], 2):
        parts = parts.unionByName(level.select("lang", "phrase", "f", F.lit(k).alias("k")))
    phrases = parts.filter("k >= 2").select("lang", "phrase", F.col("f").alias("a"), "k", F.split("phrase", " ").alias("words"))
    # what lies in a phrase of one word more that is as frequent
    inner = phrases.filter("k >= 3").select("lang", "a", F.explode(F.array(F.expr("slice(words, 1, k - 1)"), F.expr("slice(words, 2, k - 1)"))).alias("w"))
    inner = inner.select("lang", F.array_join("w", " ").alias("phrase"), "a").distinct()
    left = phrases.join(inner, ["lang", "phrase", "a"], "left_anti")
    at = left.select("lang", "phrase", "a", F.posexplode(F.expr("transform(sequence(1, k - 1), i -> struct(array_join(slice(words, 1, i), ' ') as first, array_join(slice(words, i + 1, k), ' ') as rest))")).alias("cut", "x"))
    at = at.select("lang", "phrase", "a", "cut", "x.first", "x.rest")
    of = lambda name, value: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(value))
    totals = F.broadcast(totals) if totals.count() <= SENT_ROWS else totals
    scored = at.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    # a decimal keeps 38 digits; a long, which l * r or 1000 * a * n may pass, does not
    scored = scored.withColumn("score", F.expr("cast((cast(a as decimal(19,0)) * cast(1000 as decimal(4,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)"))
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("lang", "phrase", "a", "n", "m.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of ``documents`` by the score of their weakest cut."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
    SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts
), worded AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), windows AS (
    SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM worded, (SELECT unnest(range(1, 6)) AS k)
), grams AS (
    SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase FROM windows
), counted AS (
    SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang
), phrases AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM counted WHERE k >= 2 AND f >= 100
), inner_ones AS (
    SELECT DISTINCT b.lang, array_to_string(b.words[i:i + j - 1], ' ') AS phrase, b.a
    FROM phrases b, (SELECT unnest(range(2, 5)) AS j), (SELECT unnest(range(1, 5)) AS i)
    WHERE j < b.k AND i + j - 1 <= b.k
), kept AS (
    SELECT p.* FROM phrases p ANTI JOIN inner_ones o ON p.lang = o.lang AND p.phrase = o.phrase AND o.a >= p.a
), cuts AS (
    SELECT kept.lang, kept.phrase, a, c, array_to_string(words[1:c], ' ') AS head, array_to_string(words[c + 1:], ' ') AS tail
    FROM kept, (SELECT unnest(range(1, 5)) AS c) WHERE c < k
), scored AS (
    SELECT cuts.lang, cuts.phrase, a, c, h.f AS l, t.f AS r, n, (1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f) AS score
    FROM cuts JOIN counted h ON h.lang = cuts.lang AND h.phrase = head AND h.k = c
    JOIN counted t ON t.lang = cuts.lang AND t.phrase = tail
    JOIN totals ON totals.lang = cuts.lang
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
