"""Operator 13: spelling variants by merging the light subtrees of a trie, with one character skipped or replaced.

Words are maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, lower-cased (A-Z only); a run whose CRC with its document's id is divisible by
``EVERY`` loses a character. Those of at least ``SHORTEST`` characters that occur twice or more make a trie. A node of it is
a prefix; its heavy child is the one with the most words below (ties: the largest character), the others are light, so
that a word lies in at most log2 of all words light subtrees. Two words part at one node, where one of them at least goes a light way.
Every light subtree is therefore merged, by hash joins of whole strings in place of walks:

* with its first character skipped, into the subtrees beside it (a deletion),
* with its first character replaced, into the heavy subtree and the other light ones (a replacement),
* with the heavy character put before it, into the heavy subtree (an insertion),

and terminals that coincide are near. Each near pair is met once, at the node where its words part. Light subtrees merged with each other by replacement meet in
groups of one prefix and one rest, which have as many members as there are characters, 90, at most; of a group only its size and its two best are told.

A word's form is its most frequent near word that is ``TIMES`` as frequent; roots are found by pointer jumping, whose rounds are few, as
frequencies on the way rise tenfold.

Defined cases: a null or empty text has no words; a null doc_id counts as an empty text before the colon; repeated rows count
each time; other columns are ignored; an empty table gives no rows. A text of any length is worked through in pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import mix64, text_slices, word_pieces
from .phrases import joined
from .session import bounded_batches, cut, table

EVERY, SHORTEST, LEAST, TIMES = 31, 7, 2, 10
#: Prefixes of so many characters, of which there are 90 ** 2 + 90 + 1 at most, go to every task; longer ones are joined by a shuffle.
SHALLOW = 2
_ROW = np.uint64(0xD6E8FEB86659FD93)
_COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _letters(raw: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased and all that is not a letter as a space; the letters beyond ASCII are the byte C3 and the one after it."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    wide = raw == 0xC3
    letter = ((raw >= 97) & (raw <= 122)) | wide
    letter[1:] |= wide[:-1]
    return np.where(letter, raw, 32).astype(np.uint8)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of batches (id, text) with their counts, those of a run of texts together."""
    for batch in batches:
        starts = np.array([zlib.crc32(f"{i}:".encode()) for i in batch.column(0).fill_null("").to_pylist()], np.int64)
        for start, _, raw, offsets in text_slices(batch.column(1)):
            raw = _letters(raw)
            for word, row, begins, ends in word_pieces(raw, offsets, lower=False):
                wide = np.flatnonzero(raw[begins[0] : ends[-1]] == 0xC3) + begins[0] if len(begins) else begins
                length = ends - begins - (np.searchsorted(wide, ends) - np.searchsorted(wide, begins))
                long = np.flatnonzero(length >= SHORTEST)
                word, row, begins, ends, length = (x[long] for x in (word, row, begins, ends, length))
                _, at, n = np.unique(mix64(word + row.astype(np.uint64) * _ROW), return_index=True, return_counts=True)
                if not len(at):
                    continue
                said, before = raw.tobytes() if len(raw) < 1 << 21 else memoryview(raw), starts[start + row[at]].tolist()
                h = np.array([zlib.crc32(said[b:e], c) for b, e, c in zip(begins[at].tolist(), ends[at].tolist(), before, strict=True)], np.int64)
                less = h % EVERY == 0
                shortened: Counter[str] = Counter()
                for k in np.flatnonzero(less):
                    i = at[k]
                    if length[i] > SHORTEST:
                        full, gone = bytes(said[begins[i] : ends[i]]).decode(), int(h[k] % length[i])
                        shortened[full[:gone] + full[gone + 1 :]] += int(n[k])
                at, n = at[~less], n[~less]
                _, first, which = np.unique(word[at], return_index=True, return_inverse=True)
                total = np.bincount(which, weights=n, minlength=len(first)).astype(np.int64)
                first = at[first]
                if len(first):
                    yield pa.RecordBatch.from_arrays([joined(raw, begins[first, None], ends[first, None]), pa.array(total)], schema=_COUNTED)
                if shortened:
                    yield pa.RecordBatch.from_arrays([pa.array(list(shortened), pa.string()), pa.array(list(shortened.values()), pa.int64())], schema=_COUNTED)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that take part."""
    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(_count_words, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def light_ways(words: DataFrame) -> DataFrame:
    """For each word and each node where it goes a light way: prefix, its own character ('' at its end), rest, heavy character."""
    steps = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("depth"))
    steps = steps.select("word", "n", "depth", F.expr("substring(word, 1, depth)").alias("prefix"), F.expr("substring(word, depth + 1, 1)").alias("own"))
    sizes = steps.groupBy("prefix", "own").agg(F.count("*").alias("size"))
    heavy = sizes.groupBy("prefix").agg(F.max(F.struct("size", "own")).alias("most"), F.count("*").alias("ways")).filter("ways > 1").select("prefix", F.col("most.own").alias("heavy"))
    heavy = cut(heavy, "heavy")
    near = steps.filter(F.col("depth") <= SHALLOW).join(F.broadcast(heavy.filter(F.length("prefix") <= SHALLOW)), "prefix")
    far = steps.filter(F.col("depth") > SHALLOW).join(heavy.filter(F.length("prefix") > SHALLOW), "prefix")
    return near.unionByName(far).filter("own <> heavy").select("word", "n", "prefix", "own", F.expr("substring(word, depth + 2)").alias("rest"), "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of the words that have near ones; best is (minus its n, the word)."""
    light = cut(light_ways(words), "light")
    me = F.struct((-F.col("n")).alias("less"), F.col("word").alias("name"))
    groups = light.filter("own <> ''").groupBy("prefix", "rest", "heavy").agg(F.array_sort(F.collect_list(me)).alias("members"))
    groups = groups.select(F.concat("prefix", "heavy", "rest").alias("target"), "members")
    one = light.select("*", F.array(me).alias("members"))
    skipped = one.filter("own <> '' and (rest = '' or substring(rest, 1, 1) <> own)").select(F.concat("prefix", "rest").alias("target"), "members")
    put = one.select(F.concat("prefix", "heavy", "own", "rest").alias("target"), "members")
    asked = groups.unionByName(skipped).unionByName(put)
    found = asked.join(words.select(F.col("word").alias("target"), F.col("n").alias("target_n")), "target")
    both = found.select(
        F.explode(
            F.concat(
                F.array(F.struct(F.col("target").alias("word"), F.size("members").cast("long").alias("many"), F.col("members")[0].alias("best"))),
                F.transform("members", lambda m: F.struct(m["name"].alias("word"), F.lit(1).cast("long").alias("many"), F.struct((-F.col("target_n")).alias("less"), F.col("target").alias("name")).alias("best"))),
            )
        ).alias("x")
    ).select("x.*")
    beside = groups.filter(F.size("members") > 1).select("members", F.explode("members").alias("m"))
    beside = beside.select(F.col("m.name").alias("word"), (F.size("members") - 1).cast("long").alias("many"), F.when(F.col("m") == F.col("members")[0], F.col("members")[1]).otherwise(F.col("members")[0]).alias("best"))
    return both.unionByName(beside).groupBy("word").agg(F.sum("many").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last form on the way."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.alias("a").join(now.alias("b"), F.col("a.root") == F.col("b.word"), "left")
        step = cut(step.select("a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = cut(vocabulary(docs), "words")
    near = words.join(near_words(words), "word", "left")
    near = near.withColumn("form_n", F.when(-F.col("best.less") >= TIMES * F.col("n"), -F.col("best.less")))
    near = cut(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.name")).alias("form"), "form_n"), "near")
    last = roots(near.filter("form is not null"))
    return near.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of ``documents``."""
    return spelling_variants(table(spark, sf_dir, "documents"))


# The SQL finds near words by another way: what is left of words when one character is taken out.
ORACLE = r"""
WITH RECURSIVE polynomial AS (
    SELECT 0 AS step, i AS i, i::BIGINT AS c FROM range(256) t(i)
    UNION ALL
    SELECT step + 1, i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM polynomial WHERE step < 8
), crc AS (
    SELECT list(c ORDER BY i) AS t FROM polynomial WHERE step = 8
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
), lowered AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2
), bytes AS (
    SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM lowered
), hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM bytes, crc
), occurrences AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM occurrences WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), holes AS (
    SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.hole = b.word
    UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.hole = b.word
), near AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM pairs GROUP BY word
), forms AS (
    SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * words.n THEN best END AS form, CASE WHEN best_n >= 10 * words.n THEN best_n END AS form_n FROM words LEFT JOIN near USING (word)
), ways AS (
    SELECT word, word AS here, 0 AS steps FROM forms
    UNION ALL
    SELECT ways.word, forms.form, steps + 1 FROM ways JOIN forms ON forms.word = ways.here WHERE forms.form IS NOT NULL
)
SELECT forms.word, form, here AS root, n, n_near, form_n FROM forms JOIN (SELECT word, last(here ORDER BY steps) AS here FROM ways GROUP BY word) USING (word)
"""
