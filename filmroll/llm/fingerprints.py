"""Operator 8, document fingerprints by consistent weighted sampling.

For every sample k and term t with weight w, gamma variables r and c and a
uniform b, drawn from a generator that only k and t decide, give
    level = floor(ln w / r + b),  a = c / (exp(r (level - b)) e^r);
the sample is the (term, level) of least a. Two texts agree in a sample with a
probability equal to their generalised Jaccard similarity, the sum of the
smaller weights over the sum of the larger ones (Ioffe, "Improved Consistent
Sampling, Weighted Minhash and L1 Sketching", ICDM 2010). Terms are the
64-bit hashes of words, never folded further, weights their numbers. The values
of a term at a weight never change, so those met often are remembered, in a
table of fixed size per worker.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.llm.common import documents, materialize, mix64, partitions, word_hashes

SAMPLES = 64
#: Values of (term, weight) that a worker remembers, and terms handled at once.
SLOTS, TERM_BLOCK = 1 << 17, 4096


class Sampler:
    """Consistent weighted sampling over 64-bit terms."""

    def __init__(self, samples: int = SAMPLES, slots: int = SLOTS, seed: int = 7):
        self.samples, self.slots = samples, slots
        streams = np.arange(1, 3 * samples + 1, dtype=np.uint64) + np.uint64(seed << 32)
        self.streams = mix64(streams * np.uint64(0x9E3779B97F4A7C15)).reshape(3, samples)
        self.tags = np.zeros(slots, dtype=np.uint64)
        self.kept = np.empty((slots, samples), dtype=np.float32)

    @staticmethod
    def _uniforms(terms: np.ndarray, streams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two uniform numbers above 0 and below 1 that the term and the stream decide."""
        x = mix64(terms ^ streams)
        return ((x >> np.uint64(32)) + 0.5) * 2.0**-32, ((x & np.uint64(0xFFFFFFFF)) + 0.5) * 2.0**-32

    def draws(self, terms: np.ndarray, k: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """r (the sum of two exponentials, a gamma variable) and b of the terms in the samples ``k``."""
        u, v = self._uniforms(terms, self.streams[0, k])
        return -np.log(u * v), self._uniforms(terms, self.streams[1, k])[0]

    def log_a(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """ln a of each term at its weight, a column per sample."""
        column = terms.reshape(-1, 1)
        r, b = self.draws(column)
        u, v = self._uniforms(column, self.streams[2])
        level = np.floor(np.log(weights.reshape(-1, 1)) / r + b)
        return (np.log(-np.log(u * v)) - r * (level - b) - r).astype(np.float32)

    def values(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """``log_a``, from the table where it holds the term at the weight; what is new takes its place there."""
        tags = mix64(terms + mix64(weights.astype(np.uint64))) | np.uint64(1)
        slot = (tags >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        found, new = self.kept[slot], np.flatnonzero(self.tags[slot] != tags)
        if len(new):
            found[new] = self.log_a(terms[new], weights[new])
            self.kept[slot[new]] = found[new]
            self.tags[slot[new]] = tags[new]
        return found

    def signature(self, text: str) -> np.ndarray:
        """One 16-bit value per sample; texts without words share one."""
        words = word_hashes(text.encode("utf-8", "surrogatepass"))
        if not len(words):
            return np.zeros(self.samples, dtype=np.uint16)
        terms, weights = np.unique(words, return_counts=True)
        best = np.full(self.samples, np.inf, dtype=np.float32)
        chosen, k = np.zeros(self.samples, dtype=np.int64), np.arange(self.samples)
        for a in range(0, len(terms), TERM_BLOCK):
            found = self.values(terms[a : a + TERM_BLOCK], weights[a : a + TERM_BLOCK])
            at = np.argmin(found, axis=0)
            low = found[at, k]
            better = low < best
            best, chosen = np.where(better, low, best), np.where(better, a + at, chosen)
        term, level = terms[chosen], np.zeros(self.samples, dtype=np.int64)
        more = np.flatnonzero(weights[chosen] > 1)  # at weight 1 the level is floor(b) = 0
        if len(more):
            r, b = self.draws(term[more], more)
            level[more] = np.floor(np.log(weights[chosen[more]]) / r + b).astype(np.int64)
        return (mix64(term + mix64(level.astype(np.uint64))) >> np.uint64(48)).astype(np.uint16)


_SAMPLERS: list[Sampler] = []


def sampler() -> Sampler:
    """One sampler per Python worker."""
    if not _SAMPLERS:
        _SAMPLERS.append(Sampler())
    return _SAMPLERS[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, an estimate of the generalised Jaccard similarity."""
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _row(doc_id: object, text: str, own: np.ndarray, following: str, next_print: np.ndarray) -> tuple:
    new = edited(text, following)
    changed = own if new == text else sampler().signature(new)
    digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), digest, own.astype("<u2").tobytes(), changed.astype("<u2").tobytes(), likeness(own, changed), likeness(own, next_print))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text) and of its edited text.

    The document after a row is the next in descending doc_id (nulls last, ties
    by text), the first one for the last. The table is dealt into ranges of
    doc_id, so a row's follower stands beside it, but for the last row of a
    range: it takes the first text of the next range that has rows, by a join on
    the range. Null text counts as empty; a single row follows itself; an empty
    table gives no rows.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(partitions(spark), order[0]).sortWithinPartitions(*order)
    names = ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))]
    schema = pa.schema([("part", pa.int32()), ("head", pa.string()), ("tail", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def batch_of(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        """rows: part, head, tail and then the result; a head or a tail has no result."""
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[3], id_type), *(pa.array(c, f.type) for c, f in zip((*columns[:3], *columns[4:]), schema, strict=True))], names=["doc_id", *schema.names])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, none, last, id_type = TaskContext.get().partitionId(), (None,) * 6, None, pa.null()
        for batch in batches:
            rows, id_type = [], batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = last[2] if last and last[1] == text else sampler().signature(text)
                rows.append((part, None, None, *_row(*last, text, own)) if last else (part, text, None, None, *none))
                last = (doc_id, text, own)
            if rows:
                yield batch_of(rows, id_type)
        if last:
            yield batch_of([(part, None, last[1], last[0], *none)], id_type)

    done = materialize(dealt.mapInArrow(neighbours, f"doc_id {kind}, part int, head string, tail string, {FIELDS}"))
    heads, tails = done.where("head IS NOT NULL").select("part", "head"), done.where("tail IS NOT NULL").select("doc_id", "part", "tail")
    whole = W.partitionBy(F.lit(0)).orderBy("part")  # a row per range, without texts
    following = heads.select("part").withColumn("next", F.coalesce(F.lead("part").over(whole), F.min("part").over(W.partitionBy(F.lit(0)))))
    ends = tails.join(following.hint("merge"), "part").join(heads.withColumnRenamed("part", "next").hint("merge"), "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(d, t, sampler().signature(t), h, sampler().signature(h)) for d, t, h in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "tail", "head")), strict=True)]
            if rows:
                found = batch_of([(0, None, None, *r) for r in rows], batch.schema.field("doc_id").type)
                yield found.select(names)

    inner = done.where("head IS NULL AND tail IS NULL").select(*names)
    return inner.unionByName(ends.select("doc_id", "tail", "head").mapInArrow(finish, f"doc_id {kind}, {FIELDS}"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, as hexadecimal strings."""
    text = lambda name: F.lower(F.hex(name)).alias(name)
    found = fingerprint(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", "edited_sha256", text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLE_SQL: dict[str, str] = {}
