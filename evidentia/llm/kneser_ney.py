"""Operator 9: language-model scores by an interpolated modified Kneser-Ney model of order three.

The model is counted in Spark over all training texts, in three scans. Each scan sums in the worker what it
counts, sends it as sorted, packed runs to the shard of its key range, and a task for each shard merges the runs
into a sorted hash array in the shared folder:

1. trigrams with their counts;
2. bigrams: how often each occurs, the number of distinct words before it (each of the c occurrences of a
   trigram adds 1/c; a bigram that begins a text counts by its occurrences), and the numbers of distinct words
   that follow it once, twice and more often;
3. words in the same way, by the counts of bigrams, with the number of distinct words before each.

Scoring is a fourth scan that maps the arrays into memory. Nothing is cut off: every trigram, bigram and word is
in the model. Shards are as many as the text asks for, each of at most ``SHARD_BYTES`` of text, and a task merges
one of them. Words are known by 64-bit hashes, also where they are counted. N-grams are known by so many bits that a lookup takes
one for another with a chance of about 6 in 100,000, at every size of the corpus.

    p(w | u v) = (max(c(uvw) - D(c(uvw)), 0) + (D1 N1(uv) + D2 N2(uv) + D3 N3(uv)) p(w | v)) / c(uv)

with p(w | v) the same form over numbers of distinct predecessors, p(w) likewise, and at its end an equal share
for each of V words and one unknown word. A context that was never seen hands its whole weight down.

Defined cases: a null or empty text is one end token; without training texts every probability is that of
the equal share; a row with a null id is scored and learned from. Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import held, mix64, text_slices, word_pieces, words
from .session import bounded_batches, shared_folder, table
from .shared_arrays import HashTable, pack, save, shard_bits, shard_file, sum_by_key, unpack

#: Tokens a worker sums before it sends a run; bytes of text to a shard of trigrams and bigrams, and of words; bytes of text that are scored together.
RUN, SHARD_BYTES, WORD_BYTES, SCORED = 1_400_000, 24 << 20, 96 << 20, 2 << 20
#: Bits of an n-gram's key below its shard; words have all 64.
BELOW = 36
START, END = np.uint64(0x5353535353535353), np.uint64(0x4545454545454545)
#: Columns of the tables, in this order.
BIGRAM = ("count", "before", "once", "twice", "often")
WORD = ("count", "before", "total", "once", "twice", "often")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def bigram_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(before) + word)


#: The context of a text's first token.
BEGIN = bigram_key(np.array([START]), np.array([START]))[0]


def trigram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(mix64(context ^ np.uint64(0x3C3C3C3C3C3C3C3C)) + word)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The tokens of a run of texts, some at a time: each with the token before it, the hash of the two before it, its row, and
    whether it is the first of its text. A text ends with END and begins after START."""
    n = len(offsets) - 1
    if n == 1:  # a text of any length, piece by piece
        last, pair, first = START, BEGIN, True
        for word, *_ in itertools.chain(word_pieces(raw, offsets, True), [(np.array([END]),)]):
            if len(word):
                before = np.concatenate(([last], word[:-1]))
                both = bigram_key(before, word)
                flag = np.zeros(len(word), bool)
                flag[0] = first
                yield word, before, np.concatenate(([pair], both[:-1])), np.zeros(len(word), np.int64), flag
                last, pair, first = word[-1], both[-1], False
        return
    word, row = words(raw, offsets, True)
    ends = np.cumsum(np.bincount(row, minlength=n) + 1) - 1
    out = np.full(len(word) + n, END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = word
    first = np.zeros(len(out), bool)
    first[np.concatenate(([0], ends[:-1] + 1))] = True
    before = np.concatenate(([START], out[:-1]))
    before[first] = START
    context = np.concatenate(([BEGIN], bigram_key(before, out)[:-1]))
    context[first] = BEGIN
    yield out, before, context, np.repeat(np.arange(n), np.diff(np.concatenate(([-1], ends)))), first


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, their predecessors, contexts and whether they are the first of a text, some ``RUN`` at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    join = lambda: tuple(np.concatenate(x) for x in zip(*held, strict=True))
    for batch in batches:
        for _, _, raw, offsets in text_slices(batch.column(0)):
            for word, before, context, _, first in tokens(raw, offsets):
                held.append((word, before, context, first))
                n += len(word)
                if n >= RUN:
                    yield join()
                    held, n = [], 0
    if held:
        yield join()


def _send(keys: np.ndarray, values: list[np.ndarray], below: int) -> pa.RecordBatch:
    """One packed row for each shard of sorted keys."""
    shard = (keys >> np.uint64(below)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate((shard[1:] != shard[:-1], [True]))) + 1 if len(keys) else []
    full = [(int(shard[a]), a, b) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
    columns = [pa.array([s for s, _, _ in full], pa.int32()), pa.array([pack(keys[a:b], True) for _, a, b in full], pa.binary())]
    columns.append(pa.array([[pack(v[a:b]) for v in values] for _, a, b in full], pa.list_(pa.binary())))
    return pa.RecordBatch.from_arrays(columns, ["shard", "keys", "vals"])


_SENT = "shard int, keys binary, vals array<binary>"


def _merged(batches: Iterator[pa.RecordBatch], dtypes: list[str]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """Merge the runs of each shard of a partition that is sorted by shard."""
    shard, held, size, merged = -1, [], 0, 0

    def close():
        keys = np.concatenate([h[0] for h in held])
        return shard, sum_by_key(keys, *[np.concatenate([h[1 + i] for h in held]) for i in range(len(dtypes))])

    for batch in batches:
        for k, keys, values in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if k != shard and held:
                yield close()
                held, size, merged = [], 0, 0
            shard = k
            held.append((unpack(keys.as_py(), np.uint64, True), *[unpack(v.as_py(), t).astype(_SUMS[t], copy=False) for v, t in zip(values, dtypes, strict=True)]))
            size += len(held[-1][0])
            if size >= merged + max(1 << 20, merged):  # runs are merged as they come, so that a shard holds its distinct keys and little more
                held = [close()[1]]
                size = merged = len(held[0][0])
    if held:
        yield close()


#: What sent numbers are summed as. Shares go in single precision: their sums are whole numbers to within rounding
#: up to 2**24, and from there on good to seven digits.
_SUMS = {"uint32": np.int64, "float32": np.float64}


def _classes(counts: np.ndarray) -> list[int]:
    """How many items are seen one to four times, and three times or more."""
    return [*(int((counts == k).sum()) for k in (1, 2, 3, 4)), int((counts >= 3).sum())]


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ of the modified method from the numbers of items seen one to four times; a half where these say
    nothing, and a tenth at least, so that each context leaves some weight to what it was not seen with."""
    if min(n[:4]) <= 0:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.1), float(k)) for k in (1, 2, 3)]


_SHARD = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("classes", pa.list_(pa.int64())), ("total", pa.int64()), ("types", pa.int64())])
_SAID = "shard int, n bigint, classes array<bigint>, total bigint, types bigint"


def fit(texts: DataFrame, name: str = "lm") -> dict:
    """Count the model of a table with one text column; gives the description that workers open it by."""
    spark = texts.sparkSession
    bounded_batches(spark)
    folder = shared_folder(spark, name)
    size = texts.select(F.octet_length(texts.columns[0]).cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    bits, few = shard_bits(size, SHARD_BYTES), shard_bits(size, WORD_BYTES)
    short = lambda keys: keys >> np.uint64(64 - BELOW - bits)

    def counted(label: str, bits: int, below: int, send, dtypes: list[str], finish) -> dict:
        """Send runs, merge them by shard and save each shard; the shard's number is its task's."""

        def merge(batches):
            for shard, (keys, *sums) in _merged(batches, dtypes):
                columns, classed = finish([np.rint(s).astype(np.int64) for s in sums])
                save(folder, f"{label}-{shard:07d}", shard_file(keys, columns, below))
                seen = columns[0]
                yield pa.RecordBatch.from_pylist([{"shard": shard, "n": int((seen > 0).sum()), "classes": _classes(classed), "total": int(seen.sum()), "types": int(classed.sum())}], schema=_SHARD)

        runs = texts.mapInArrow(send, _SENT).repartitionById(1 << bits, "shard").sortWithinPartitions("shard")
        rows = runs.mapInArrow(merge, _SAID).collect()  # one row a shard
        classes = [sum(r["classes"][k] for r in rows) for k in range(5)]
        add = lambda c: sum(r[c] for r in rows)
        return {"label": label, "bits": bits, "below": below, "shards": [r["shard"] for r in rows], "n": add("n"), "total": add("total"), "types": add("types"), "classes": classes}

    def send_trigrams(batches):
        for word, _, context, _ in _runs(batches):
            keys = np.sort(short(trigram_key(context, word)))
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            yield _send(keys[starts], [np.diff(starts, append=len(keys)).astype(np.uint32)], BELOW)

    trigrams = counted("trigram", bits, BELOW, send_trigrams, ["uint32"], lambda sums: (sums, sums[0]))

    def send_bigrams(batches):
        known = HashTable(folder, "trigram", bits, BELOW, trigrams["shards"], 1)
        for word, before, context, first in _runs(batches):
            # whole keys tell apart what shares a short one, so that each n-gram's occurrences go to its own parts
            keys, at, local = np.unique(trigram_key(context, word), return_index=True, return_counts=True)
            count = known.find(short(keys))[0]
            share = local / np.maximum(count, 1)
            # what a bigram that is the end of trigrams gets: occurrences, and predecessors less occurrences; both are equal
            # in trigrams that occur once, so that the second is mostly zero and packs to nothing
            more = np.where(first[at] | (before[at] == START), 0, share - local)
            many = np.flatnonzero(count >= 2)  # of these contexts: followers seen twice, more often, and all their occurrences
            none, few_ = np.zeros(len(keys)), np.zeros(len(many))
            begun = int(first.sum())
            ends = np.concatenate((short(bigram_key(before[at], word[at])), short(context[at[many]]), short(np.array([BEGIN]))))
            columns = [
                np.concatenate((local, few_, [begun])),
                np.concatenate((more, few_, [0])),
                np.concatenate((none, np.where(count[many] == 2, share[many], 0), [0])),
                np.concatenate((none, np.where(count[many] >= 3, share[many], 0), [0])),
                np.concatenate((none, local[many], [0])),
            ]
            sent, occurs, *rest = sum_by_key(ends, *columns)
            yield _send(sent, [occurs.astype(np.uint32), *[x.astype(np.float32) for x in rest]], BELOW)

    def finish_bigrams(sums):
        count, more, twice, often, repeated = sums
        before = np.maximum(count + more, count > 0)  # one at least, also where shares of very many occurrences are rounded
        return [count, before, np.maximum(count - repeated, 0), twice, often], before

    bigrams = counted("bigram", bits, BELOW, send_bigrams, ["uint32", *["float32"] * 4], finish_bigrams)

    def send_words(batches):
        known = HashTable(folder, "bigram", bits, BELOW, bigrams["shards"], len(BIGRAM))
        for word, before, _, _ in _runs(batches):
            keys, at, local = np.unique(bigram_key(before, word), return_index=True, return_counts=True)
            count, types = known.find(short(keys), (0, 1))
            share = local / np.maximum(count, 1)
            none = np.zeros(len(keys))
            both = np.concatenate((word[at], before[at]))
            columns = [np.concatenate((local, none)), np.concatenate((share, none)), np.concatenate((none, share * types))]
            columns += [np.concatenate((none, np.where(x, share, 0))) for x in (types == 1, types == 2, types >= 3)]
            sent, *sums = sum_by_key(both, *columns)
            yield _send(sent, [sums[0].astype(np.uint32), *[x.astype(np.float32) for x in sums[1:]]], 64 - few)

    vocabulary = counted("word", few, 64 - few, send_words, ["uint32", *["float32"] * (len(WORD) - 1)], lambda sums: (sums, sums[1]))
    return {
        "folder": folder,
        "tables": [trigrams, bigrams, vocabulary],
        "tokens": vocabulary["total"],
        "distinct": vocabulary["n"],
        "discounts": [discounts(t["classes"]) for t in (trigrams, bigrams, vocabulary)],
    }


class KneserNey:
    """A fitted model, opened from the shared folder."""

    def __init__(self, model: dict) -> None:
        self.model = model
        self.trigrams, self.bigrams, self.words = (HashTable(model["folder"], t["label"], t["bits"], t["below"], t["shards"], n) for t, n in zip(model["tables"], (1, len(BIGRAM), len(WORD)), strict=True))
        lowest = model["tables"][2]
        self.types = lowest["types"]
        # of the lowest order: the weight that its discounts leave to the equal share
        once, twice, _, _, often = lowest["classes"]
        d = model["discounts"][2]
        self.left = (d[0] * once + d[1] * twice + d[2] * often) / self.types if self.types else 1.0

    @staticmethod
    def _discounted(count: np.ndarray, d: list[float]) -> np.ndarray:
        return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0)

    @staticmethod
    def _looked_up(found: HashTable, keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The columns of distinct keys, and the place of each key among these."""
        keys, place = np.unique(keys >> np.uint64(64 - found.below - found.bits), return_inverse=True)
        return found.find(keys), place

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens, known tokens, base score and model score."""
        m, n = self.model, len(offsets) - 1
        third, second, lowest = m["discounts"]
        out = np.zeros((4, n))
        for word, before, context, row, first in tokens(raw, offsets):
            (count,), place = self._looked_up(self.trigrams, trigram_key(context, word))
            triple = count[place]
            # the context of a token is the bigram that ends with the token before it
            found, place = self._looked_up(self.bigrams, np.append(bigram_key(before, word), context[0]))
            of_context = np.concatenate(([place[-1]], place[:-2]))
            if first[0]:
                of_context[first] = place[-1]
            total, once, twice, often = (found[k][of_context] for k in (0, 2, 3, 4))
            types = found[1][place[:-1]]
            known, place = self._looked_up(self.words, np.concatenate((word, before)))
            w, v = place[: len(word)], place[len(word) :]
            seen = known[0][w]
            base = np.log10((seen + 0.1) / (m["tokens"] + 0.1 * (m["distinct"] + 1)))
            p = self._discounted(known[1][w], lowest) / max(self.types, 1) + self.left / (m["distinct"] + 1)
            p = self._mixed(types, known[2][v], [known[k][v] for k in (3, 4, 5)], second, p)
            p = self._mixed(triple, total, [once, twice, often], third, p)
            for k, x in enumerate((None, seen > 0, base, np.log10(p))):
                out[k] += np.bincount(row, weights=x, minlength=n)
        return out[0].astype(np.int64), out[1].astype(np.int64), out[2], out[3]

    def _mixed(self, count: np.ndarray, total: np.ndarray, followers: list[np.ndarray], d: list[float], lower: np.ndarray) -> np.ndarray:
        """One order over the next lower one; a context that was not seen leaves all to that."""
        # a context that was seen has a follower, also where n-grams that share a short key have shared its count among them
        back = np.maximum(d[0] * followers[0] + d[1] * followers[1] + d[2] * followers[2], min(d))
        return np.where(total > 0, (self._discounted(count, d) + back * lower) / np.maximum(total, 1), lower)


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, counts and scores of every row of ``docs`` by a fitted model."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>")
    def score(column: pa.Array) -> pa.Array:
        opened, parts = _opened(model), []
        for _, _, raw, offsets in text_slices(column, SCORED):
            parts.append(opened.score(raw, offsets))
        joined = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(4)]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(joined, types, strict=True)], ["n_tokens", "n_known", "base_score", "score"])

    scored = docs.select("doc_id", score(F.col("text")).alias("s"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "s.n_tokens", "s.n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "s.base_score", "s.score")


def _opened(model: dict) -> KneserNey:
    return held(("lm", model["folder"]), lambda: KneserNey(model))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of every document; the documents that are not held out are learned from."""
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs.filter(~held_out(F.col("doc_id"))).select("text")))
