"""Operator 7, best-fit packing with large-item matching.

Pieces above a third of the capacity fit at most twice into a sequence, so they
are matched first: the largest with the largest that still fits. Smaller pieces
then go, largest first, into the tightest gap that takes them.

Lengths are whole numbers up to the capacity, so everything that a packing
depends on is the number of pieces of each length. The plan is made from that
histogram (at most ``capacity`` rows, whatever the corpus) and moves runs of
equal pieces at once; every piece then finds its place by its rank among the
pieces of its length. Ranks are found in hash buckets of a length, as one
length may hold most pieces.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.llm.common import documents, materialize, slices

CAPACITY = 4096
#: Characters from which on a word is not remembered.
LONG_WORD = 1000


class WordIds:
    """Token ids of texts by a word-level tokenizer, remembered per white-space separated word.

    The tokenizer drops white space and never joins across it, so a text's ids
    are those of its words one after another. Where loading shows that it folds
    case and cuts punctuation off the letters before it, both are done for a
    whole block at once, which leaves fewer distinct words; words of letters
    alone then skip the library's normalisation. All others go through the
    library whole. What is remembered is bounded by bytes: a full generation
    becomes the old one, from which words that come again move on, so frequent
    words stay and rare ones leave.
    """

    SPLIT = "<|endoftext|>"  # an added token, which the library cuts out before anything else
    #: Memory of a remembered word beside its own bytes.
    OVERHEAD = 200

    def __init__(self, path: str, most_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.most_bytes = Tokenizer.from_file(path), most_bytes
        self.split_id = self.tokenizer.token_to_id(self.SPLIT)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.n_bytes = 0
        self.letters = self._letters()
        self.simple = re.compile(f"[{''.join(map(chr, self.letters))}]+") if self.letters else re.compile(r"(?!)")
        cut = self._cuts
        self.behind = "".join(c for c in ".,;:!?" if self.letters and all(cut(f"ab{c}{x}") == ["ab", c + x] for x in ("", c, ".,")))

    def _cuts(self, text: str) -> list[str]:
        """What the tokenizer splits a text into before it looks for pieces."""
        plain = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def _letters(self) -> dict[int, str]:
        """Latin letters that the tokenizer replaces one by one, with what it puts there; none if it keeps upper case."""
        if self._cuts(string.ascii_letters) != [string.ascii_lowercase * 2]:
            return {}
        found = {}
        for cp in (*map(ord, string.ascii_letters), *range(0xC0, 0x250)):
            cut = self._cuts(f"a{chr(cp)}a")
            if chr(cp).isalpha() and len(cut) == 1:
                found[cp] = cut[0][1:-1]
        return found

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _library(self, words: list[str], group: int = 500) -> Iterator[bytes]:
        """Ids of each word, many words to a call."""
        for at in range(0, len(words), group):
            some = words[at : at + group]
            if any("<|" in w for w in some):
                yield from (self._raw(e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False))
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([self.SPLIT + self.SPLIT.join(some) + self.SPLIT], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(ids == self.split_id) * 4).tolist()
            raw = ids.tobytes()
            yield from (raw[a + 4 : b] for a, b in zip(ends, ends[1:], strict=False))

    def _keep(self, word: str, ids: bytes) -> None:
        self.young[word] = ids
        self.n_bytes += len(word) + len(ids) + self.OVERHEAD
        if 2 * self.n_bytes > self.most_bytes:
            self.old, self.young, self.n_bytes = self.young, {}, 0

    def look_up(self, words: list[str]) -> list[bytes]:
        """Ids of each of these distinct words."""
        found: list[bytes | None] = []
        others: list[int] = []
        for i, word in enumerate(words):
            ids = self.young.get(word)
            if ids is None:
                ids = self.old.get(word)
                if ids is None:
                    if not self.simple.fullmatch(word):
                        others.append(i)
                        found.append(None)
                        continue
                    ids = self._raw([t.id for t in self.tokenizer.model.tokenize(word.translate(self.letters))])
                if len(word) < LONG_WORD:
                    self._keep(word, ids)
            found.append(ids)
        for i, ids in zip(others, self._library([words[i] for i in others]), strict=True):
            found[i] = ids
            if len(words[i]) < LONG_WORD:
                self._keep(words[i], ids)
        return found

    def encode(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """Little-endian 32-bit ids of all ``texts`` one after another, and where each text's begin and the last one's end."""
        plain = pc.replace_substring(texts, "\n", " ")
        if self.letters and not pc.any(pc.match_substring(plain, "<|")).as_py():  # added tokens are told by their case
            plain = pc.ascii_lower(plain)
            if self.behind:
                plain = pc.replace_substring_regex(plain, f"([a-z])([{self.behind}])", r"\1 \2")
        parts = pc.split_pattern(plain, " ")
        words = parts.flatten().dictionary_encode()
        known = self.look_up(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        ends = np.cumsum(sizes[at])
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(b"".join(known), dtype="<u4")[np.repeat(first[at] - ends + sizes[at], sizes[at]) + np.arange(total)]
        cuts = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])
        return ids.tobytes(), np.concatenate([[0], ends])[cuts]


#: Bytes of texts that are encoded at once; a longer text is taken apart at white space.
BLOCK_BYTES = 1 << 20

_LOADED: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    """One tokenizer with what it remembers per Python worker."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _parts(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array, bool]]:
    """(row of the first, texts, whether the last goes on) with about ``most`` bytes each; long texts come in parts that end at white space."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes, most):
        if b > a + 1 or sizes[a] <= 2 * most:
            yield a, texts[a:b], False
            continue
        text, at = texts[a].as_py(), 0
        while at < len(text):
            space = re.compile(r"[ \n]").search(text, at + most)
            stop = space.end() if space else len(text)
            yield a, pa.array([text[at:stop]]), stop < len(text)
            at = stop


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every row of ``docs`` (doc_id, text).

    A row's ids are the tokenizer's, then ``end_id``; null and empty texts have
    that one alone. Only rows of over ``capacity`` ids have several pieces. Very
    long texts are read in blocks, so beside the text only a block's ids are
    held. Repeated rows each get their pieces; other columns are ignored; an
    empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, step = loaded(tokenizer_path), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            start = held = crc = 0  # of the row that is open: bytes in whole pieces, bytes of the piece begun, its sum

            def add(row: int, raw: memoryview | bytes, last: bool) -> None:
                nonlocal start, held, crc
                at = 0
                while at < len(raw) or (last and held):
                    part = raw[at : at + step - held]
                    crc, held, at = zlib.crc32(part, crc), held + len(part), at + len(part)
                    if held < step and not last:
                        return
                    rows.append(row)  # noqa: B023
                    pieces.append(start // step)  # noqa: B023
                    starts.append(start // 4)  # noqa: B023
                    lengths.append(held // 4)  # noqa: B023
                    sums.append(crc)  # noqa: B023
                    start, held, crc = start + held, 0, 0

            for first, texts, more in _parts(batch.column("text").cast(pa.string()).fill_null(""), BLOCK_BYTES):
                raw, at = words.encode(texts)
                view, at = memoryview(raw), (at * 4).tolist()
                for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    add(first + i, view[a:b], False)
                    if not (more and i + 1 == len(texts)):
                        add(first + i, end, True)
                        start = held = crc = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs of equal pieces and their places, from the number of pieces of each length.

    Columns: length, first rank, number of pieces, first sequence, pieces a
    sequence, offset of the first. Piece r of a run goes to sequence first + r //
    pieces, at offset + (r % pieces) * length.
    """
    left = {n: c for n, c in histogram.items() if c}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, number of sequences)
    open_gaps: list[int] = []
    next_sequence = 0

    def put(length: int, count: int, sequence: int, each: int, offset: int) -> None:
        runs.append((length, rank[length], count, sequence, each, offset))
        rank[length] += count
        left[length] -= count

    def free(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((sequence, count))

    def fill(length: int, sequence: int, n_sequences: int, gap: int) -> int:
        """Put pieces into sequences with this gap, as many as fit each; the number of sequences touched."""
        each = gap // length
        full = min(n_sequences, left[length] // each)
        if full:
            put(length, full * each, sequence, each, capacity - gap)
            free(gap - each * length, sequence, full)
        rest = left[length] if full < n_sequences else 0
        if rest:
            put(length, rest, sequence + full, rest, capacity - gap)
            free(gap - rest * length, sequence + full, 1)
        return full + bool(rest)

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1
            while at >= 0 and left[large[at]] < 1 + (large[at] == a):  # one piece alone is no mate of itself
                at -= 1
            b = large[at] if at >= 0 else None
            if b is None:
                count = left[a]
                put(a, count, next_sequence, 1, 0)
                free(capacity - a, next_sequence, count)
            else:
                count = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, count, next_sequence, 1, 0)
                put(b, count, next_sequence, 1, a)
                free(capacity - a - b, next_sequence, count)
            next_sequence += count
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                next_sequence += fill(length, next_sequence, -(-left[length] // (capacity // length)), capacity)
                continue
            gap = open_gaps[at]
            sequence, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            used = fill(length, sequence, count, gap)
            free(gap, sequence + used, count - used)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 500) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32).

    ``pieces`` must give the same rows whenever it is read (a stored table).
    Equal rows are interchangeable; null doc_ids are packed like others; an
    empty table gives no rows. Lengths must be 1 to ``capacity``. Pieces of one
    length are ranked in buckets of about ``bucket_rows``, as many as it takes.
    """
    spark = pieces.sparkSession
    lengths = materialize(pieces.groupBy("length").agg(F.count("*").alias("n")))  # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in lengths.collect()}
    plan = spark.sparkContext.broadcast(plan_packing(histogram, capacity))  # follows the number of lengths, not of pieces
    buckets = lengths.select("length", F.ceil(F.col("n") / bucket_rows).alias("n_buckets"))
    keyed = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.col("n_buckets")))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.join(offsets.hint("merge"), ["length", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(inside) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        key = runs[:, 0] << 48 | runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            run = runs[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            nth = rank - run[:, 1]
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)], names=[*kept.schema.names, "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places in sequences of at most ``capacity`` tokens.

    Nulls, empty and very long texts, repeated rows and empty tables as in
    :func:`token_pieces`; other columns are ignored.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, end_id, capacity)), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op7_packing": op7_packing}
ORACLE_SQL: dict[str, str] = {}
