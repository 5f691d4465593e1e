"""Operator 1: BPE encoding and decoding.

Encoding does not replay merges. A pre-token is matched once by an Aho-Corasick automaton, which gives
the longest vocabulary token at each place. The encoder walks from left to right taking the longest
token that is *compatible* with the one before it and falls back to shorter prefixes; where none fits it
takes back its last token and marks the place as dead, so that each place is left at most once and the
work is linear. Two tokens are compatible when the merges, run over the two together, leave exactly
these two; a row of tokens is what the merges give if and only if all neighbours are compatible, so the
result equals that of the merges. Compatibility is kept in a table that fills as pairs turn up.

Decoding takes the pieces of all ids from one array of bytes by a table of offsets.

Defined cases: a null or empty text has no tokens; its decoded text is empty. Strings of special tokens
inside a text become their ids, as the vocabulary file says. A column of the input that has the name of
an output column is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .kernels import held, text_slices
from .session import bounded_batches, table

#: Runs whose ids a worker keeps, before all but the half that was used most often make room; pairs it keeps before it starts anew.
WORD_CACHE, PAIR_CACHE = 250_000, 400_000

#: Characters of a text, and tokens, that are worked through at once.
LONG, PART = 1 << 20, 1 << 18

END = "</w>"
_FINAL = 0x4000  # added to a symbol's code point where it ends a word

_LETTER = "a-zªµºß-öø-ſ"
_NUMBER = "0-9²³¹¼-¾"
#: Characters that no normaliser changes (lower case aside) and whose classes are the same in every Unicode version.
_PLAIN = re.compile("[^\t\n\r -~¡-įı-ſ]")
_PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 is kept, the rest is moved up."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(moved)) for b in range(256)]


_CUT = re.compile("[ \n](?=[A-Za-z0-9])")


def parts(text: str) -> Iterator[str]:
    """A long text in parts that are encoded alone: cut before a plain letter or digit after a plain space, where
    neither the normaliser nor a special token nor a pre-token reaches over."""
    start = 0
    while len(text) - start > LONG:
        found = _CUT.search(text, start + LONG)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


class _Known(dict):
    """Table keys of runs; ``learn`` gives the key of a run that is not there yet."""

    def __init__(self, learn: Callable[[str], int]) -> None:
        super().__init__()
        self._learn = learn

    def __missing__(self, run: str) -> int:
        return self._learn(run)


class OffsetTable:
    """Byte strings end to end with their offsets; ``gather`` joins the strings of many keys at once."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.offsets = np.zeros(len(pieces) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in pieces], out=self.offsets[1:])

    def gather(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined bytes, and where each key's piece ends in them (with a leading 0)."""
        start = self.offsets[keys]
        size = self.offsets[keys + 1] - start
        ends = np.zeros(len(keys) + 1, dtype=np.int64)
        np.cumsum(size, out=ends[1:])
        index = np.arange(ends[-1], dtype=np.int64) + np.repeat(start - ends[:-1], size)
        return self.data[index], ends


class BacktrackingBPE:
    """Exact BPE over a word vocabulary with an end-of-word suffix, from the text of a tokenizer file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        if model["end_of_word_suffix"] != END:
            raise ValueError("the vocabulary needs the suffix </w> at the end of words")
        self._source = source
        self._alphabet = dict(enumerate(byte_alphabet()))
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        self.pieces = dict(self._special)
        self.pieces.update(model["vocab"])
        self._form = {self._inner(piece): i for piece, i in model["vocab"].items()}
        self._string = {i: s for s, i in self._form.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._rank: dict[tuple[str, str], int] = {}
        for rank, (left, right) in enumerate(pairs):
            self._rank.setdefault((self._inner(left), self._inner(right)), rank)
        self._pair_rank, self._made = {}, {}
        for (left, right), rank in self._rank.items():
            a, b, made = self._form[left], self._form[right], self._form[left + right]
            self._pair_rank[a, b] = rank
            self._made.setdefault(made, (rank, a, b))
        self._automaton = ahocorasick.Automaton()
        for form, i in self._form.items():
            self._automaton.add_word(form, (len(form), i))
        self._automaton.make_automaton()
        self._shorter: dict[int, int] = {}
        self._size = {i: len(s) for i, s in self._string.items()}
        self._compatible: dict[tuple[int, int], bool] = {}
        self._sound: dict[int, bool] = {}
        names = [""] * (1 + max(self.pieces.values()))
        for piece, i in self.pieces.items():
            names[i] = piece
        self._decimal = OffsetTable([b"%d " % i for i in range(len(names))])
        self._spoken = OffsetTable([n.encode() + b" " for n in names])
        self._key = _Known(self._learn)
        self._flat, self._ends = array("i"), array("q", [0])
        self._uses = np.zeros(0, np.int64)

    @functools.cached_property
    def _library(self) -> Tokenizer:
        """The library's normaliser and splitter, made when a text first needs them."""
        return Tokenizer.from_str(self._source)

    @staticmethod
    def _inner(piece: str) -> str:
        """A piece with its end-of-word mark folded into the last symbol."""
        return piece[: -len(END) - 1] + chr(ord(piece[-len(END) - 1]) + _FINAL) if piece.endswith(END) and len(piece) > len(END) else piece

    def _make_room(self) -> None:
        """Keep the runs that were used more than once, half the cache at most and those used most; older uses count half."""
        self._uses.resize(len(self._key), refcheck=False)
        order = np.argsort(-self._uses, kind="stable")[: WORD_CACHE // 2]
        kept = np.sort(order[self._uses[order] > 1])
        ends, flat = np.frombuffer(self._ends, dtype=np.int64), np.frombuffer(self._flat, dtype=np.int32)
        start, size = ends[kept], ends[kept + 1] - ends[kept]
        stop = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.arange(stop[-1]) + np.repeat(start - stop[:-1], size)]
        names = list(self._key)  # in the order of their keys
        self._key.clear()
        self._key.update((names[k], n) for n, k in enumerate(kept.tolist()))
        self._flat, self._ends = array("i", ids.astype(np.int32).tobytes()), array("q", stop.astype(np.int64).tobytes())
        self._uses = self._uses[kept] // 2

    def _merged(self, symbols: list[str]) -> list[str]:
        """What the merges leave of a few symbols; only tables are filled from it."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda k: self._rank.get((symbols[k], symbols[k + 1]), 1 << 60))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self._rank:
                break
            out, k = [], 0
            while k < len(symbols):
                if k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            symbols = out
        return symbols

    def _fits(self, left: int | None, right: int) -> bool:
        sound = self._sound.get(right)
        if sound is None:
            form = self._string[right]
            sound = self._sound[right] = self._merged(list(form)) == [form]
        if left is None or not sound:
            return sound
        known = self._compatible.get((left, right))
        if known is None:
            if len(self._compatible) >= PAIR_CACHE:
                self._compatible.clear()
            known = self._compatible[left, right] = self._seam_holds(left, right)
        return known

    def _seam_holds(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the seam: the merges that made the two are undone latest first along the
        seam, and each pair that then faces the other must not be one that would have merged before that moment."""
        before = 1 << 60
        while True:
            rank = self._pair_rank.get((left, right))
            if rank is not None and rank < before:
                return False
            made_left, made_right = self._made.get(left), self._made.get(right)
            if made_left is None and made_right is None:
                return True
            if made_right is None or (made_left is not None and made_left[0] > made_right[0]):
                before, left = made_left[0], made_left[2]
            else:  # of equal merges the left one comes first, so a crossing one of the same rank wins too
                before, right = made_right[0] + 1, made_right[1]

    def _next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of a token; -1 if none."""
        known = self._shorter.get(token)
        if known is None:
            form = self._string[token]
            known = next((self._form[form[:k]] for k in range(len(form) - 1, 0, -1) if form[:k] in self._form), -1)
            self._shorter[token] = known
        return known

    def _greedy(self, word: str) -> list[int] | None:
        """The longest match at each place after the last one, where these spell the word and all neighbours are
        compatible: no other row of tokens is, so it is the answer. None otherwise."""
        out, at, last, known = [], 0, None, self._compatible
        for end, (size, token) in self._automaton.iter_long(word):
            if end - size + 1 != at or not (known.get((last, token)) or self._fits(last, token)):
                return None
            out.append(token)
            last, at = token, end + 1
        return out if at == len(word) else None

    def encode_pretoken(self, symbols: str) -> list[int]:
        """Ids of one pre-token that is given in the byte alphabet."""
        word = symbols[:-1] + chr(ord(symbols[-1]) + _FINAL)
        if word in self._form and self._fits(None, self._form[word]):
            return [self._form[word]]
        greedy = self._greedy(word)
        if greedy is not None:
            return greedy
        n = len(word)
        longest: list[tuple[int, int]] = [(0, -1)] * n
        for end, found in self._automaton.iter(word):
            at = end - found[0] + 1
            if found > longest[at]:
                longest[at] = found
        fits, size, shorter = self._fits, self._size, self._shorter
        out: list[int] = []
        alive = [True] * (n + 1)
        at, token, last = 0, longest[0][1], None
        while at < n:
            while token >= 0 and not (alive[at + size[token]] and fits(last, token)):
                token = shorter[token] if token in shorter else self._next_shorter(token)
            if token >= 0:
                out.append(token)
                last = token
                at += size[token]
                token = longest[at][1] if at < n else -1
            elif out:
                alive[at] = False
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else None
            else:
                raise ValueError(f"the vocabulary cannot spell {symbols!r}")
        return out

    def _learn(self, chunk: str) -> int:
        """Encode a run without white space (or, after a "\\0", a pre-token in the byte alphabet) and keep its ids."""
        if chunk[0] == "\0":
            self._flat.extend(self.encode_pretoken(chunk[1:]))
        else:
            found = _PRETOKEN.findall(chunk)
            if len(found) == 1:
                self._flat.extend(self.encode_pretoken(chunk if chunk.isascii() else "".join(map(self._alphabet.__getitem__, chunk.encode()))))
            else:
                for key in [self._key[pretoken] for pretoken in found]:
                    self._flat.extend(self._flat[self._ends[key] : self._ends[key + 1]])
        key = self._key[chunk] = len(self._ends) - 1
        self._ends.append(len(self._flat))
        return key

    def _special_key(self, content: str) -> int:
        name = "\1" + content
        if name not in self._key:
            self._key[name] = len(self._ends) - 1
            self._flat.append(self._special[content])
            self._ends.append(len(self._flat))
        return self._key[name]

    def _keys(self, text: str) -> list[int]:
        """Table keys of a text's runs."""
        if self._special_pattern is not None and any(s in text for s in self._special):
            out: list[int] = []
            for k, part in enumerate(self._special_pattern.split(text)):
                out += [self._special_key(part)] if k % 2 else self._plain_keys(part)
            return out
        return self._plain_keys(text)

    def _plain_keys(self, text: str) -> list[int]:
        if _PLAIN.search(text) is None:
            found = text.lower().split()  # no pre-token holds white space
        else:  # the library's own normaliser and splitter; "\0" keeps its byte alphabet apart in the table
            plain = self._library.normalizer.normalize_str(text)
            found = ["\0" + w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(plain)]
        known = self._key
        return [known[w] for w in found]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of the texts in them."""
        if len(self._key) > WORD_CACHE:
            self._make_room()
        keys: list[int] = []
        cuts = np.zeros(len(texts) + 1, dtype=np.int64)
        for k, text in enumerate(texts):
            keys += self._keys(text)
            cuts[k + 1] = len(keys)
        where, ends, flat = np.array(keys, dtype=np.int64), np.frombuffer(self._ends, dtype=np.int64), np.frombuffer(self._flat, dtype=np.int32)
        self._uses.resize(len(self._key), refcheck=False)
        self._uses += np.bincount(where, minlength=len(self._uses))
        start = ends[where]
        size = ends[where + 1] - start
        done = np.zeros(len(where) + 1, dtype=np.int64)
        np.cumsum(size, out=done[1:])
        ids = flat[np.arange(done[-1], dtype=np.int64) + np.repeat(start - done[:-1], size)] if len(flat) else np.zeros(0, np.int32)
        return ids, done[cuts]

    def digest_long(self, text: str) -> tuple[int, str, str]:
        """Number of tokens and both digests of one text of any length, worked through in parts."""
        n, hashes = 0, (hashlib.sha256(), hashlib.sha256())
        for part in parts(text):
            ids, _ = self.encode_many([part])
            for lo in range(0, len(ids), PART):
                for pieces, sha in zip((self._decimal, self._spoken), hashes, strict=True):
                    data = pieces.gather(ids[lo : lo + PART].astype(np.int64))[0].tobytes()
                    sha.update((b" " if n + lo else b"") + data[:-1])  # the space is between the tokens, not after them
            n += len(ids)
        return n, hashes[0].hexdigest(), hashes[1].hexdigest()

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text or ""])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The pieces of the ids with one space between them."""
        data, _ = self._spoken.gather(np.asarray(ids, dtype=np.int64))
        return data.tobytes()[:-1].decode()

    def digests(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[list[str], list[str]]:
        """SHA-256 of each text's decimal ids and of its decoded text."""
        out = []
        for pieces in (self._decimal, self._spoken):
            data, ends = pieces.gather(ids.astype(np.int64))
            view, at = memoryview(data), ends[cuts]
            out.append([hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        return out[0], out[1]


def _worker_encoder(vocabulary) -> BacktrackingBPE:
    source = vocabulary.value
    return held(("bpe", hashlib.sha256(source.encode()).hexdigest()), lambda: BacktrackingBPE(source))


def broadcast_vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read once on the driver; it does not grow with the data (under 2 MB)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _runs(column: pa.Array):
    """Lists of texts of about half a megabyte each; a null is an empty text."""
    for start, stop, _, _ in text_slices(column, 1 << 19):
        yield [t or "" for t in column.slice(start, stop - start).to_pylist()]


def encode(df: DataFrame, text: str, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Add the ids of ``text`` as ``array<int>``; the file ``vocabulary`` is read on the driver."""
    shared = broadcast_vocabulary(df.sparkSession, vocabulary)
    bounded_batches(df.sparkSession)

    @F.arrow_udf("array<int>")
    def ids_of(column: pa.Array) -> pa.Array:
        encoder, flat, ends = _worker_encoder(shared), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for texts in _runs(column):
            if len(texts) == 1:
                found = np.concatenate([encoder.encode_many([p])[0] for p in parts(texts[0])])
                cuts = np.array([0, len(found)])
            else:
                found, cuts = encoder.encode_many(texts)
            flat.append(found)
            ends.append(cuts[1:] + ends[-1][-1])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(flat), pa.int32()))

    return df.withColumn(ids, ids_of(F.col(text)))


def decode(df: DataFrame, ids: str, vocabulary: str, text: str = "decoded") -> DataFrame:
    """Add the text of ``ids``; null ids give an empty text."""
    shared = broadcast_vocabulary(df.sparkSession, vocabulary)

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        encoder = _worker_encoder(shared)
        return pa.array([encoder.decode(x or []) for x in column.to_pylist()], pa.string())

    return df.withColumn(text, text_of(F.col(ids)))


def token_digests(column: Column, shared) -> Column:
    """A struct of n_tokens, ids_sha256 and decoded_sha256 for each text; the ids are encoded and decoded in the worker."""

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digests_of(texts: pa.Array) -> pa.Array:
        encoder, n, a, b = _worker_encoder(shared), [], [], []
        for run in _runs(texts):
            if len(run) == 1 and len(run[0]) > LONG:
                for out, x in zip((n, a, b), encoder.digest_long(run[0]), strict=True):
                    out.append(x)
                continue
            ids, cuts = encoder.encode_many(run)
            one, two = encoder.digests(ids, cuts)
            n += np.diff(cuts).tolist()
            a += one
            b += two
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests_of(column)


def encode_round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    shared = broadcast_vocabulary(docs.sparkSession, vocabulary)
    return docs.select("doc_id", token_digests(F.col("text"), shared).alias("_found")).select("doc_id", "_found.*")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document's token count and the digests of its ids and of their decoded text."""
    import public_tokenizers

    return encode_round_trip(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
