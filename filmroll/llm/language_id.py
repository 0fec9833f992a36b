"""Operator 4, language identification by multinomial naive Bayes over hashed character n-grams.

Texts become arrays of code points, lower-cased, with everything but letters
folded into single spaces. Every n-gram of the chosen orders is hashed into a
bucket; a language is a vector of log probabilities over the buckets. The
matrix (languages x buckets, a fixed size per language) is sent to the workers
once, and a batch is scored by gathering the rows' n-gram ids and summing by row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filmroll.llm.common import documents, put_back, set_aside, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Most labelled rows that one language is learnt from; larger tables are sampled by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Languages learnt and scored at once (a matrix of 33 MB).
LANGUAGES = 256
#: Most languages; more mean that the label column holds something else, and raise a ValueError.
MAX_LANGUAGES = 65_536

_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point its lower-case letter, or a space."""
    if not _TABLE:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha() or unicodedata.category(ch)[0] == "M":
                low = ch.lower()
                table[cp] = ord(low) if len(low) == 1 else cp
        _TABLE.append(table)
    return _TABLE[0]


def ngram_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams of ``texts``, the index of the text each belongs to, and whether a text has a letter.

    Texts are laid out one after another with spaces between; an n-gram that
    would reach over more than one space is left out, so none mixes two texts.
    """
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    gap = np.full(1, 10, dtype=np.uint32)
    parts = [x for c in codes for x in (gap, c)] + [gap]
    owner = np.repeat(np.arange(len(texts) + 1), [1 + len(c) for c in codes] + [1])
    chars = _letters()[np.concatenate(parts)]
    space = chars == 32
    letters = np.zeros(len(texts) + 1, dtype=bool)
    letters[owner[~space]] = True
    keep = ~(space & np.concatenate([[False], space[:-1]]))
    chars, owner, space = chars[keep].astype(np.uint32), owner[keep], space[keep]
    ids, owners = [], []
    for n in ORDERS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ chars[k : k + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inner = np.zeros(m, dtype=bool)
        for k in range(1, n - 1):
            inner |= space[k : k + m]
        use = ~inner if n > 1 else ~space[:m]
        ids.append(h[use] & np.uint32(BUCKETS - 1))
        owners.append((np.where(space[:m], owner[1 : m + 1], owner[:m]) if n > 1 else owner[:m])[use])  # the owner of the first letter
    return (np.concatenate(ids), np.concatenate(owners), letters[:-1]) if ids else (np.empty(0, np.uint32), np.empty(0, np.int64), letters[:-1])


def blocks(batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Parts of a batch's texts, about ``most`` characters at once, and the row that each belongs to.

    Longer texts are taken apart before a character that is no letter, where no
    n-gram is lost; a run of letters is never cut, so memory follows the longest.
    """
    parts = [(i, part) for i, t in enumerate(batch.column("text").to_pylist()) for part in _parts(t or "", most)]
    for a, b in slices(np.array([len(t) for _, t in parts], dtype=np.int64), most):
        yield np.array([i for i, _ in parts[a:b]], dtype=np.int64), [t for _, t in parts[a:b]]


def _parts(text: str, most: int) -> Iterator[str]:
    letters, at = _letters(), 0
    while len(text) - at > 2 * most:
        stop = at + most
        while stop < len(text):
            ahead = text[stop : stop + most]
            gaps = np.flatnonzero(letters[np.frombuffer(ahead.encode("utf-32-le", "surrogatepass"), dtype="<u4")] == 32)
            stop += int(gaps[0]) if len(gaps) else len(ahead)
            if len(gaps):
                break
        yield text[at:stop]
        at = stop
    yield text[at:]


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """lang and counts (a vector of BUCKETS sums) for every lang of ``labelled`` (text, lang)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            for rows, texts in blocks(batch):
                ids, owner, _ = ngram_ids(texts)
                for lang in set(langs[rows]):
                    mine = np.append(langs[rows] == lang, False)
                    sums[lang] = sums.get(lang, 0) + np.bincount(ids[mine[owner]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["lang", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from partial_sums(batches)

    vectors = labelled.select("text", "lang").mapInArrow(partial, "lang string, counts binary")
    return vectors.repartition("lang").mapInArrow(total, "lang string, counts binary")


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the count vectors of equal langs, one at a time."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + np.frombuffer(raw, dtype="<i8")
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["lang", "counts"])


def languages(labelled: DataFrame) -> dict[str, int]:
    """Rows of each language of ``labelled``, in the languages' order; more than MAX_LANGUAGES raise a ValueError."""
    rows = labelled.where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the label column holds something else")
    return dict(sorted((r["lang"], r["n"]) for r in rows))


def fit(labelled: DataFrame, sizes: dict[str, int], train_rows: int = TRAIN_ROWS, smoothing: float = 0.1) -> np.ndarray:
    """The log-probability matrix of the languages in ``sizes``, a row each, from ``labelled`` (doc_id, text, lang).

    Uses at most about ``train_rows`` whole texts of each language, picked by a
    hash of doc_id; the counts decide the share, so nothing but the narrow
    columns is read of the rest.
    """
    if not sizes:
        return np.zeros((0, BUCKETS), dtype=np.float32)
    shares = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, train_rows / n)))])
    ticket = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = labelled.where(F.col("lang").isin(list(sizes))).where(ticket < F.element_at(shares, F.col("lang")))
    found = {r["lang"]: np.frombuffer(r["counts"], dtype="<i8") for r in count_ngrams(sample).collect()}  # one vector a language
    counts = np.array([found.get(lang, np.zeros(BUCKETS)) for lang in sizes], dtype=np.float64) + smoothing
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


STATE = "lang_pred string, top double, odds double, has_letter boolean"


def score_block(docs: DataFrame, langs: list[str], matrix: np.ndarray) -> DataFrame:
    """``docs`` (text and columns that clash with none of STATE) with the best of ``langs``, or of those scored before, if it beats them.

    ``top`` is the best tempered log likelihood, ``odds`` the sum over all languages of their odds to the best.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))  # LANGUAGES rows of BUCKETS numbers at most
    before, kept = "top" in docs.columns, [c for c in docs.columns if c not in ("lang_pred", "top", "odds", "has_letter")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        for batch in batches:
            rows, k = len(batch), len(names)
            sums, n, letters = np.zeros((k, rows)), np.zeros(rows), np.zeros(rows, dtype=bool)
            for part_of, texts in blocks(batch):
                ids, owner, has = ngram_ids(texts)
                row = np.append(part_of, 0)[owner]  # what belongs to no text comes last and counts for none
                real = owner < len(texts)
                ids, row = ids[real], row[real]
                n += np.bincount(row, minlength=rows)
                np.logical_or.at(letters, part_of, has)
                for i, w in enumerate(weights):
                    sums[i] += np.bincount(row, weights=w[ids], minlength=rows)
            tempered = sums / np.sqrt(np.maximum(n, 1))
            best, top = np.argmax(tempered, axis=0), tempered.max(axis=0)
            odds, preds = np.exp(tempered - top).sum(axis=0), np.array(names, dtype=object)[best]
            if before:
                old, old_odds, old_preds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("top", "odds", "lang_pred"))
                high = np.maximum(old, top)
                odds, preds, top = old_odds * np.exp(old - high) + odds * np.exp(top - high), np.where(old >= top, old_preds, preds), high
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(preds, pa.string()), pa.array(top), pa.array(odds), pa.array(letters)], names=[*kept, "lang_pred", "top", "odds", "has_letter"])

    fields = [f for f in docs.schema.fields if f.name in kept]
    return docs.mapInArrow(scored, T.StructType([*fields, *T.StructType.fromDDL(STATE).fields]))


def predict(docs: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS, langs_at_once: int = LANGUAGES) -> DataFrame:
    """``docs`` (text and any other columns) with lang_pred and score, learnt from ``labelled`` (doc_id, text, lang).

    The score is the posterior probability under equal priors, with the
    evidence tempered by the square root of the text's length, since n-grams of
    one text are far from independent; of languages equally good the first.
    Languages are learnt and met ``langs_at_once`` at a time, so that neither
    driver nor workers hold more than their matrix. Null texts, texts without a
    letter, and all texts when nothing was learnt, are ``und`` with score 0.
    Columns named lang_pred or score are replaced.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found, sizes = set_aside(docs, "text"), languages(labelled)
    names = list(sizes)
    for at in range(0, len(names), langs_at_once):
        some = names[at : at + langs_at_once]
        found = score_block(found, some, fit(labelled, {x: sizes[x] for x in some}, train_rows))
    if not names:
        found = found.selectExpr("*", "'und' AS lang_pred", "0D AS top", "1D AS odds", "false AS has_letter")
    back = put_back(found.select("text", "rest"), columns)
    return found.select(*back, F.when(F.col("has_letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("has_letter"), 1 / F.col("odds")).otherwise(0.0).alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang), learnt from the rows not held out.

    Nulls and empty texts as in :func:`predict`; very long texts are read in
    blocks; repeated rows each get a row; other columns are ignored; an empty
    table gives none.
    """
    return predict(docs.select("doc_id", "text"), docs.where(~held_out(F.col("doc_id")))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang and any others) in a language learnt from it, at a score of ``min_score`` at least.

    Null and empty texts, and those without a letter, go; repeated rows are
    judged alike; columns keep any names; an empty table gives no rows.
    """
    found = set_aside(docs, "text")
    scored = predict(found, docs.where(~held_out(F.col("doc_id"))))
    kept = scored.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).select("text", "rest")
    return kept.select(*put_back(kept, docs.columns))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(documents(spark, sf_dir))


QUERIES = {"op4_language_id": op4_language_id}
ORACLE_SQL: dict[str, str] = {}
