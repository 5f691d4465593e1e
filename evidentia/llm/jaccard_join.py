"""Operator 6: n-gram Jaccard self-join by set relations, and the components of its links.

Sets are the distinct word n-grams of a text as 64-bit hashes; equal sets are one set. Two sets link when
100 * intersection >= 85 * union. The join is exact:

1. A first scan counts in how many sets each hash bucket occurs, into a table of two bits a bucket (once, a
   few, tens, hundreds), which lies in the shared folder and is mapped by workers. It gives one order of all
   n-grams, rare ones first.
2. By that order two linked sets share an n-gram in their prefixes. A set whose prefix holds an n-gram that
   is proved to occur in it alone at each place links with nothing and is left behind here. The sets of the
   others are sent only once the index lists are known, and only those of lists with two sets or more.
3. An index list holds the sets with one prefix n-gram. Its pivot is its most shared set. Each set is
   compared with its pivots first, and the answers of the others are derived from theirs: what is linked
   to the pivot is one component already and needs no comparison, and with a pivot at distance d(x, p),
   only a set with |d(x, p) - d(y, p)| within the bound of a link can still be one. The intersections of a set
   that is like the pivot are the pivot's, plus those of the n-grams that it has beyond the pivot, less those of
   the n-grams that it lacks. Sets lie in the order of their size, so that sizes that cannot link are a range
   of positions, and each index list is entered and left at that range: what lies before and after it is skipped.
4. Lists of any size are whole: those of at most ``WHOLE`` sets are worked through by one task each, larger
   ones in pairs of blocks, so that no task holds more than two blocks.

Only links that join two components of a block are written, so a group of copies gives links in proportion
to its size, and no link between different components is lost. Components are made in Spark.

Defined cases: a text without words has no n-grams and no links; one with fewer words than an n-gram is one
n-gram of them all; rows with a null id are no nodes (their component is null); rows with one id are one
node. Columns beside doc_id and text are ignored. Sets are told apart by 64-bit digests, and the n-grams of two
sets that are compared by 48 bits: different ones that agree in these count as equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .kernels import distinct_by_row, held, mix64, text_slices, windows, word_pieces, words
from .session import SENT_ROWS, bounded_batches, cut, shared_folder, table, without
from .shared_arrays import mapped, pack, save, unpack

#: Buckets for each byte of text, as a share; the least and the most buckets (two bits each) as powers of two.
BUCKETS_PER_BYTE, LEAST_BITS, MOST_BITS = 1 / 4, 22, 34
#: Buckets of a file of the table, and the most files that a worker has mapped at once.
CHUNK_BITS, MOST_OPEN = 22, 4096
#: The most buckets of the table that marks the sets of index lists.
MARK_BITS = 32
RUN = 3_000_000
#: Largest list that one task works through; sets of a block of larger ones.
WHOLE, BLOCK = 512, 1024


class Rule:
    """Two sets link when ``per_cent`` * union <= 100 * intersection."""

    def __init__(self, per_cent: int = 85, width: int = 4) -> None:
        self.per_cent, self.width = per_cent, width

    def least_overlap(self, n: np.ndarray) -> np.ndarray:
        return -(-n * self.per_cent // 100)

    def links(self, overlap: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (100 + self.per_cent) * overlap >= self.per_cent * (n + m)

    def within(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of a link."""
        return (100 - self.per_cent) * (n + m) / (100 + self.per_cent)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their distinct n-gram hashes and the row (in the run) of each, ordered by row and hash."""
    held("sets", lambda: None)
    for start, stop, raw, offsets in text_slices(column):
        if stop - start == 1:
            hashed = _long_set(raw, offsets, width)
            yield start, stop, hashed, np.zeros(len(hashed), np.int64)
            continue
        word, row = words(raw, offsets, True)
        yield start, stop, *distinct_by_row(*windows(word, row, width, stop - start, True))


def _long_set(raw: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The set of one text, whose words are taken piece by piece."""
    last, found = np.zeros(0, np.uint64), []
    for word, *_ in word_pieces(raw, offsets, True):
        last = np.concatenate((last, word))
        found.append(windows(last, np.zeros(len(last), np.int64), width, 1, False)[0])
        last = last[max(0, len(last) - width + 1) :]
    if not any(map(len, found)):
        found.append(windows(last, np.zeros(len(last), np.int64), width, 1, True)[0])
    every = np.concatenate(found)
    found.clear()
    every.sort()
    return every[np.concatenate(([True], every[1:] != every[:-1]))] if len(every) else every


def _key_sums(hashed: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and an order-free 64-bit digest of each row's set."""
    n = np.bincount(row, minlength=rows)
    out = np.zeros(rows, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(mix64(hashed), np.searchsorted(row, full))
    return n, mix64(out + n.astype(np.uint64)).view(np.int64)


_SEEN = "kind int, doc_id bigint, n bigint, d1 bigint, chunk int, buckets binary, counts binary"


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in _SEEN.split(", ")])


def _seen_batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _packed_counts(hashed: np.ndarray, bits: int, least: int = 1) -> pa.RecordBatch:
    """How often each bucket of some hashes occurs, packed by chunks of buckets; each occurrence counts at least ``least``."""
    bucket = np.sort(hashed >> np.uint64(64 - bits))
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    many, bucket = np.clip(np.diff(starts, append=len(bucket)), least, 65535).astype(np.uint16), bucket[starts]
    chunks = 1 << (bits - CHUNK_BITS)
    at = np.searchsorted(bucket >> np.uint64(CHUNK_BITS), np.arange(chunks + 1, dtype=np.uint64))
    full = [k for k in range(chunks) if at[k + 1] > at[k]]
    cuts = [slice(at[k], at[k + 1]) for k in full]
    return _seen_batch(kind=[1] * len(full), chunk=full, buckets=[pack((bucket[c] & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint32), True) for c in cuts], counts=[pack(many[c]) for c in cuts])


def _scan(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """Rows of kind 0: a document with its set's size and digests; of kind 1: packed counts of a chunk of buckets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for start, stop, hashed, row in shingle_sets(b.column(1), width):
                n, one = _key_sums(hashed, row, stop - start)
                yield _seen_batch(kind=np.zeros(stop - start, np.int32), doc_id=b.column(0).slice(start, stop - start), n=n, d1=one)
                held.append(hashed)
                size += len(hashed)
                if size >= RUN:
                    yield _packed_counts(np.concatenate(held), bits)
                    held, size = [], 0
        if size:
            yield _packed_counts(np.concatenate(held), bits)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, _SEEN)


def _marks(keys: DataFrame, bits: int) -> DataFrame:
    """Buckets of some 64-bit keys, in the form of counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield _packed_counts(b.column(0).to_numpy().view(np.uint64), bits, 2)

    return keys.mapInArrow(scan, _SEEN)


class Levels:
    """Two bits for each bucket, in files of ``2**CHUNK_BITS`` buckets in the shared folder that workers map when they meet
    one of their buckets. A bucket of no file has level 0."""

    def __init__(self, folder: str, bits: int, chunks: list[int]) -> None:
        self.folder, self.bits, self.chunks = folder, bits, set(chunks)
        self._open: dict[int, np.ndarray] = {}

    def _chunk(self, k: int) -> np.ndarray:
        if k not in self._open:
            if len(self._open) >= MOST_OPEN:
                self._open.pop(next(iter(self._open)))
            self._open[k] = mapped(self.folder, f"levels-{k:06d}", np.uint8).view(np.ndarray)
        return self._open[k]

    def of(self, hashed: np.ndarray) -> np.ndarray:
        """The level of each hash."""
        bucket = hashed >> np.uint64(64 - self.bits)
        out = np.zeros(len(hashed), np.uint8)
        chunk = (bucket >> np.uint64(CHUNK_BITS)).astype(np.int64)
        order = np.argsort(chunk, kind="stable")
        chunk, bucket = chunk[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1], [True]))) if len(chunk) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if (k := int(chunk[a])) in self.chunks:
                at = bucket[a:b] & np.uint64((1 << CHUNK_BITS) - 1)
                out[order[a:b]] = (self._chunk(k)[at >> np.uint64(2)] >> ((at & np.uint64(3)) << np.uint64(1)).astype(np.uint8)) & 3
        return out


def _levels(seen: DataFrame, bits: int, name: str) -> Levels:
    """Sum the counts of each chunk in a task of its own, and save their levels."""
    folder = shared_folder(seen.sparkSession, name)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, total = [], -1, np.zeros(1 << CHUNK_BITS, np.uint32)

        def close() -> None:
            level = np.searchsorted(np.array([2, 10, 100], np.uint32), total, side="right").astype(np.uint8).reshape(-1, 4)
            save(folder, f"levels-{now:06d}", level[:, 0] | level[:, 1] << 2 | level[:, 2] << 4 | level[:, 3] << 6)
            done.append(now)
            total[:] = 0

        for b in batches:
            for k, buckets, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                if k != now and now >= 0:
                    close()
                now = k
                at = unpack(buckets.as_py(), np.uint32, True)
                total[at] = np.minimum(total[at] + unpack(counts.as_py(), np.uint16), 1 << 20)
        if now >= 0:
            close()
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(done, pa.int32())})

    sent = seen.filter("kind = 1").select("chunk", "buckets", "counts").repartitionById(1 << (bits - CHUNK_BITS), "chunk").sortWithinPartitions("chunk")
    return Levels(folder, bits, [r["chunk"] for r in sent.mapInArrow(merge, "chunk int").collect()])  # one number a file


def _prefixes(docs: DataFrame, rule: Rule, levels: Levels) -> DataFrame:
    """Sets that may link at all: key d1, size n, how many of its n-grams may be shared, and its prefix n-grams."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(["d1", "n", "shared", "prefix"], types, strict=True)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, hashed, row in shingle_sets(b.column(0), rule.width):
                rows = stop - start
                n, one = _key_sums(hashed, row, rows)
                rank = levels.of(hashed)
                shared = np.bincount(row, weights=rank > 0, minlength=rows).astype(np.int64)
                most = n - rule.least_overlap(n) + 1
                may = (n > 0) & (n - shared < most)
                if not may.any():
                    continue
                inside = may[row]
                hashed, row, rank = hashed[inside], row[inside], rank[inside]
                order = np.lexsort((hashed, rank, row))
                place = np.arange(len(row)) - np.searchsorted(row, np.arange(rows))[row]
                head = order[(place < most[row]) & (rank[order] > 0)]  # order keeps the rows together
                which = np.flatnonzero(may)
                cuts = np.searchsorted(row[head], np.concatenate((which, [rows])))
                prefix = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashed[head].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(one[which]), pa.array(n[which]), pa.array(shared[which]), prefix], schema=schema)

    found = docs.filter("doc_id is not null").select("text").mapInArrow(scan, "d1 bigint, n bigint, shared bigint, prefix array<bigint>")
    return found.groupBy("d1").agg(*[F.first(c).alias(c) for c in ("n", "shared", "prefix")])


#: Bytes of an n-gram in a set that is sent; two sets of one pivot are compared by these.
GRAM_BYTES = 6


def _grams(docs: DataFrame, rule: Rule, marked: Levels) -> DataFrame:
    """The sets (d1, grams) whose keys are marked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, hashed, row in shingle_sets(b.column(0), rule.width):
                n, one = _key_sums(hashed, row, stop - start)
                which = np.flatnonzero((n > 0) & (marked.of(one.view(np.uint64)) > 0))
                if not len(which):
                    continue
                _, first = np.unique(one[which], return_index=True)  # copies within a run are sent once
                which = which[np.sort(first)]
                raw = np.ascontiguousarray(hashed.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :GRAM_BYTES]
                at, ends = np.searchsorted(row, which), np.searchsorted(row, which, side="right")
                sets = [raw[x:y].tobytes() for x, y in zip(at, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(one[which]), pa.array(sets, pa.binary())], ["d1", "grams"])

    found = docs.filter("doc_id is not null").select("text").mapInArrow(scan, "d1 bigint, grams binary")
    return found.groupBy("d1").agg(F.first("grams").alias("grams"))


class _Forest:
    """Union-find over positions; ``join`` says whether two trees became one."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


class _Index:
    """Index lists of a block of sets: for each n-gram the positions of the sets that hold it, in the order of their size."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = np.array([len(s) for s in sets])
        self.gram, place = np.unique(np.concatenate(sets), return_inverse=True)
        # all lists end to end; an entry is its list's number and its position, so that a range of positions is found by bisection
        self.entry = np.sort(place * len(sets) + np.repeat(np.arange(len(sets)), self.n))

    def overlaps(self, s: np.ndarray, low: int, high: int) -> np.ndarray:
        """Sizes of the intersections of a set with the sets low to high - 1 of the block; only that range of each list is read."""
        hit = np.minimum(np.searchsorted(self.gram, s), len(self.gram) - 1)
        base = hit[self.gram[hit] == s] * len(self.n)
        first, last = np.searchsorted(self.entry, base + low), np.searchsorted(self.entry, base + high)
        size = last - first
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        read = self.entry[np.arange(total) + np.repeat(first - (ends - size), size)] - np.repeat(base, size)
        return np.bincount(read - low, minlength=high - low)

    def derived(self, s: np.ndarray, pivot: np.ndarray, of_pivot: np.ndarray, low: int, high: int) -> np.ndarray:
        """The same from the pivot's intersections with these sets, by the n-grams in which the two differ."""
        more, less = np.setdiff1d(s, pivot, assume_unique=True), np.setdiff1d(pivot, s, assume_unique=True)
        if len(more) + len(less) >= len(s):
            return self.overlaps(s, low, high)
        return of_pivot + self.overlaps(more, low, high) - self.overlaps(less, low, high)


def _skip(index: _Index, n: int, rule: Rule) -> tuple[int, int]:
    """The block's sets whose size can link with a set of n (the sets are in the order of size)."""
    low = np.searchsorted(index.n, -(-rule.per_cent * n // 100), side="left")
    return int(low), int(np.searchsorted(index.n, 100 * n // rule.per_cent, side="right"))


def join_block(keys: list[int], sets: list[np.ndarray], rule: Rule, pivot: int | None) -> list[tuple[int, int]]:
    """Links that span the components of one list's sets; the pivot's answers come first."""
    order = sorted(range(len(keys)), key=lambda k: (len(sets[k]), keys[k]))
    keys, sets = [keys[k] for k in order], [sets[k] for k in order]
    index, forest, out = _Index(sets), _Forest(len(keys)), []
    first = keys.index(pivot) if pivot in keys else 0
    far = of_first = None
    for k in [first, *(x for x in range(len(keys)) if x != first)]:
        if k != first and forest.root(k) == forest.root(first) and len({forest.root(x) for x in range(len(keys))}) == 1:
            break  # all are one component
        low, high = _skip(index, len(sets[k]), rule)
        if k == first:
            overlap = of_first = index.overlaps(sets[k], 0, len(keys))
            far = index.n + len(sets[k]) - 2 * overlap
            near = np.flatnonzero(rule.links(overlap, index.n, len(sets[k])))
        else:
            if forest.root(k) == forest.root(first) and not any(forest.root(x) != forest.root(first) for x in range(low, high)):
                continue  # all it could reach has the pivot's component already
            open_ = np.abs(far[low:high] - far[k]) <= rule.within(index.n[low:high], len(sets[k]))
            if open_.sum() <= 1:
                continue
            overlap = index.derived(sets[k], sets[first], of_first[low:high], low, high)
            near = low + np.flatnonzero(open_ & rule.links(overlap, index.n[low:high], len(sets[k])))
        for x in near.tolist():
            if x != k and forest.join(k, x):
                out.append((keys[k], keys[x]))
    return out


def join_blocks(left: list[tuple], right: list[tuple], pivot: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that span the components of sets of two blocks of one list; rows are (key, set, distance to the pivot, linked to it).

    Every set of ``left`` is unlinked to the pivot; those of ``right`` that are linked to it are one component.
    """
    right = sorted(right, key=lambda r: (len(r[1]), r[0]))
    index = _Index([r[1] for r in right])
    place = {r[0]: i for i, r in enumerate(right)}
    extra = [r for r in left if r[0] not in place]
    place |= {r[0]: len(right) + i for i, r in enumerate(extra)}
    forest, out = _Forest(len(place)), []
    linked = [i for i, r in enumerate(right) if r[3]]
    for i in linked[1:]:
        forest.join(linked[0], i)
    far = np.array([r[2] for r in right])
    of_pivot = (index.n + len(pivot) - far) // 2
    for key, s, d, _ in left:
        low, high = _skip(index, len(s), rule)
        if low >= high:
            continue
        open_ = np.abs(far[low:high] - d) <= rule.within(index.n[low:high], len(s))
        if not open_.any():
            continue
        near = low + np.flatnonzero(open_ & rule.links(index.derived(s, pivot, of_pivot[low:high], low, high), index.n[low:high], len(s)))
        for x in near.tolist():
            if forest.join(place[key], x):
                out.append((key, right[x][0]))
    return out


def _set(data) -> np.ndarray:
    """A sent set as numbers, in order."""
    raw = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, GRAM_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - GRAM_BYTES :] = raw
    return out.view(">u8").ravel().astype(np.uint64)


_LINKS = "a bigint, b bigint"


def _link_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal first columns."""
    now, held = None, []
    for b in batches:
        heads = list(zip(*[b.column(i).to_pylist() for i in range(keys)], strict=True))
        for i, head in enumerate(heads):
            if head != now:
                if held:
                    yield now, held
                now, held = head, []
            held.append(tuple(b.column(j)[i] for j in range(keys, b.num_columns)))
    if held:
        yield now, held


def list_members(prefixes: DataFrame) -> DataFrame:
    """(pivot, d1): the sets of each index list with its pivot, the most shared one; lists of one set are left out."""
    postings = prefixes.select("d1", (F.col("shared") / F.col("n")).alias("share"), F.explode("prefix").alias("gram"))
    lists = postings.groupBy("gram").agg(F.max(F.struct("share", "d1")).alias("top"), F.count("*").alias("n_sets")).filter("n_sets > 1")
    return postings.select("gram", "d1").join(lists.select("gram", F.col("top.d1").alias("pivot")), "gram").select("pivot", "d1").distinct()


def linked_sets(docs: DataFrame, prefixes: DataFrame, rule: Rule) -> DataFrame:
    """Spanning links (a, b) between the keys d1 of the candidate sets."""
    members = cut(list_members(prefixes), "members")
    # every pivot is a member of its own lists, so that these are all keys
    bits = min(MARK_BITS, max(CHUNK_BITS, (8 * members.count()).bit_length()))
    marked = _levels(_marks(members.select("d1"), bits), bits, "marks")
    sizes = members.groupBy("pivot").agg(F.count("*").alias("size"))
    sized = members.join(sizes.filter("size > 1"), "pivot")
    full = cut(sized.join(_grams(docs, rule, marked), "d1").select("pivot", "size", "d1", "grams"), "list-sets")

    def whole(batches):
        for (pivot,), rows in _groups(batches, 1):
            if len(rows) > 1:
                found = join_block([r[0].as_py() for r in rows], [_set(r[1]) for r in rows], rule, pivot)
                if found:
                    yield _link_batch(found)

    small = full.filter(F.col("size") <= WHOLE).select("pivot", "d1", "grams").repartition("pivot").sortWithinPartitions("pivot").mapInArrow(whole, _LINKS)

    def measure(batches):
        for b in batches:
            out = []
            for mine, other in zip(b.column(2), b.column(3), strict=True):
                x, p = _set(mine), _set(other)
                overlap = int(np.isin(x, p, assume_unique=True).sum())
                out.append((len(x) + len(p) - 2 * overlap, bool(rule.links(np.int64(overlap), len(x), len(p)))))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.bool_())], ["pivot", "d1", "grams", "far", "linked"])

    of_pivot = full.filter((F.col("size") > WHOLE) & (F.col("pivot") == F.col("d1"))).select("pivot", F.col("grams").alias("p_grams"))
    large = full.filter(F.col("size") > WHOLE).select("pivot", "d1", "grams").join(of_pivot, "pivot").select("pivot", "d1", "grams", "p_grams")
    large = cut(large.mapInArrow(measure, "pivot bigint, d1 bigint, grams binary, far bigint, linked boolean"), "measured")
    counts = large.groupBy("pivot").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("u")).filter("u > 0")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    dealt = large.join(counts.select("pivot", parts("m").alias("nm"), parts("u").alias("nu")), "pivot")
    own = lambda n: F.pmod(F.xxhash64("d1"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["d1", "grams", "far", "linked"]
    left = dealt.filter(~F.col("linked")).select("pivot", own("nu").alias("i"), every("nm").alias("j"), F.lit(0).alias("side"), *columns)
    right = dealt.select("pivot", every("nu").alias("i"), own("nm").alias("j"), F.lit(1).alias("side"), *columns)
    # the pivot's set goes with each pair of blocks, as their answers are derived from its own
    middle = dealt.filter("d1 = pivot").select("pivot", every("nu").alias("i"), every("nm").alias("j"), F.lit(2).alias("side"), *columns)

    def pairs(batches):
        for _, rows in _groups(batches, 3):
            parsed = [[(r[1].as_py(), _set(r[2]), r[3].as_py(), r[4].as_py()) for r in rows if r[0].as_py() == side] for side in (0, 1, 2)]
            if all(parsed):
                found = join_blocks(parsed[0], parsed[1], parsed[2][0][1], rule)
                if found:
                    yield _link_batch(found)

    blocks = left.unionByName(right).unionByName(middle).repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j").mapInArrow(pairs, _LINKS)
    direct = large.filter("linked and d1 <> pivot").select(F.col("pivot").alias("a"), F.col("d1").alias("b"))
    return small.unionByName(blocks).unionByName(direct)


def jaccard_components(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    rule = rule or Rule()
    bounded_batches(docs.sparkSession)
    size = docs.select(F.octet_length("text").cast("long").alias("n")).agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size * BUCKETS_PER_BYTE).bit_length()))
    seen = cut(_scan(docs, rule.width, bits), "seen")
    stats = seen.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "d1")
    prefixes = cut(_prefixes(docs, rule, _levels(seen, bits, "levels")), "prefixes")
    links = cut(linked_sets(docs, prefixes, rule), "set-links")
    nodes = cut(stats.filter("doc_id is not null and n_shingles > 0").groupBy("d1").agg(F.min("doc_id").alias("least")), "nodes")
    named = links.join(nodes.select(F.col("d1").alias("a"), F.col("least").alias("x")), "a").join(nodes.select(F.col("d1").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    # a document with rows of several sets is one node
    several = stats.filter("doc_id is not null and n_shingles > 0").join(nodes, "d1").filter("doc_id <> least").select("doc_id", "least").distinct()
    ties = several.join(several.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1"), "doc_id").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    joined = components(named.unionByName(ties))
    placed = stats.join(nodes, "d1", "left").join(joined.withColumnRenamed("node", "least"), "least", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "least", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row of ``docs`` for each component, with its own columns: of the smallest doc_id, and of rows that repeat it the
    one whose text comes first by its hash. Rows with a null id are no documents of a component and stay. The ids that go
    are joined by themselves, so that no text moves while they are few."""
    found = cut(jaccard_components(docs, rule).filter("doc_id is not null").select("doc_id", "component_id"), "components")
    left = without(docs, found.filter("doc_id <> component_id"), {"doc_id": F.col("doc_id")}, "not-first")
    repeated = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    single = without(left, repeated, {"doc_id": F.col("doc_id")}, "repeated")
    order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    several = left.join(F.broadcast(repeated) if repeated.count() <= SENT_ROWS else repeated, "doc_id", "left_semi")
    first = several.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == 1).select(*docs.columns)
    return single.unionByName(first)


def op6_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the documents whose sets of four-word shingles link at 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"))
