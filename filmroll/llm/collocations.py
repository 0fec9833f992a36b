"""Operator 11, collocation mining on FM-indexes of word ids.

Texts are dealt into shards of one language. Words that are frequent over all
shards get ids; everything else ends a piece. Each shard is held as a
bidirectional index: the Burrows-Wheeler transforms of its word ids and of their
reversal. Intervals of phrases are extended to the right by one transform and to
the left by the other, all intervals of a depth at once; their sizes are counts.
Every pair is extended by the word behind it and then by the word before it, or
by an end of its piece, so a shard hands on at most one entry for each of its
words, whatever is frequent. Entries go to parts by their pair; a part holds all
counts of its phrases of two, three and four words.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.llm.common import batches_of, documents, materialize, mix64, partitions, slices

#: Least count of a candidate, rows of a language, and the share of a phrase that a longer one must hold to replace it (in per cent).
MIN_COUNT, TOP, COVER = 30, 2000, 80
#: Words of a language that a worker gathers before it writes their shard, and of all languages before it writes every shard.
SHARD_WORDS, HELD_WORDS = 1 << 20, 1 << 21
#: Bytes of shards or entries that a worker is handed at once, and words of an index whose phrases are extended together.
ROW_BYTES, SLICE_WORDS = 1 << 21, 1 << 18
#: Pairs of neighbours that a part of the counting should hold, repeated ones included; never less than ``LEAST_PAIRS``.
PAIR_ROWS, LEAST_PAIRS = 2_000_000, 100
#: Bytes of a text that are cut into words at once.
BLOCK_BYTES = 1 << 20
#: Parts of a language whose best phrases are found on their own, before they meet.
RANK_PARTS = 64
#: What an entry holds, in the order of the columns.
ENTRY = ("before", "first", "second", "behind", "n")

_TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r][ \t.,;:!?\n-\r]*")
_BREAK = re.compile(rb"[ \t.,;:!?\n-\r]")
_ENDS = frozenset(b".,;:!?\n\x0b\x0c\r")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32 as compressed bytes, those of equal weight together, behind their count."""
    return len(values).to_bytes(8, "little") + pa.compress(values.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: pa.BinaryScalar, dtype: type = np.int32) -> np.ndarray:
    data = memoryview(raw.as_buffer())
    planes = np.frombuffer(pa.decompress(data[8:], 4 * int.from_bytes(data[:8], "little"), codec="zstd"), dtype="u1")
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1).astype(dtype)


class _Ids(dict):
    """Numbers of tokens as they are met: words from 1, ends of pieces 0."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        if token[0] in _ENDS:
            return 0
        self.words.append(token)
        self[token] = len(self.words)
        return len(self.words)


def _blocks(text: bytes) -> Iterator[bytes]:
    """A text in blocks that end between words."""
    at = 0
    while at < len(text):
        end = at + BLOCK_BYTES
        if end < len(text):
            cut = max(text.rfind(bytes([c]), at, end) for c in b" \t.,;:!?\n\x0b\x0c\r")
            found = None if cut > at else _BREAK.search(text, end)
            end = cut if cut > at else found.start() if found else len(text)
        yield text[at:end]
        at = end


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as word ids of their language, in shards that end between pieces."""
    held: dict[str, tuple[_Ids, array]] = {}
    number, total = TaskContext.get().partitionId() << 32, 0

    def flush(langs: list[str]) -> Iterator[pa.RecordBatch]:
        nonlocal number, total
        for lang in langs:
            known, ids = held.pop(lang)
            row = np.frombuffer(ids, dtype=np.int32)
            counts = np.bincount(row, minlength=len(known.words) + 1)[1:]
            number, total = number + 1, total - len(row)
            columns = [[number], [lang], [_packed(row)], [[w.decode() for w in known.words]], [counts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], names=["shard", "lang", "ids", "words", "counts"])

    def full(lang: str) -> list[str]:
        """The languages whose shards are due."""
        return list(held) if total >= HELD_WORDS else [lang] if lang in held and len(held[lang][1]) >= SHARD_WORDS else []

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for block in _blocks(text.as_buffer().to_pybytes().translate(_LOWER)):
                known, ids = held.setdefault(lang, (_Ids(), array("i")))
                before = len(ids)
                ids.extend(map(known.__getitem__, _TOKEN.findall(block)))
                total += len(ids) - before
                if ids and not ids[-1]:
                    yield from flush(full(lang))
            if lang in held:
                held[lang][1].append(0)
                total += 1
                yield from flush(full(lang))
    yield from flush(list(held))


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``seq`` in order, by doubling; zeros end a suffix, and the earlier one is the less.

    ``seq`` ends with a zero, so suffixes that are still alike never reach its end.
    """
    n, zero = len(seq), seq == 0
    rank = np.where(zero, np.cumsum(zero) - 1, seq + (zero.sum() - 1))
    order = np.argsort(rank, kind="stable")
    todo, key, depth = np.arange(n), rank[order].astype(np.int64), 1
    rank = np.empty(n, dtype=np.int64)
    while True:
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(fresh)
        rank[order[todo]] = np.repeat(todo[starts], np.diff(np.append(starts, len(todo))))
        alone = fresh & np.append(fresh[1:], True)
        todo = todo[~alone]
        if not len(todo):
            return order
        at = order[todo]
        key = rank[at] * n + rank[at + depth]
        sort = np.argsort(key, kind="stable")
        order[todo], key, depth = at[sort], key[sort], depth * 2


def transform(seq: np.ndarray) -> np.ndarray:
    """The Burrows-Wheeler transform: what stands before each suffix, in their order."""
    return seq[suffix_order(seq) - 1].astype(np.int32)


class Index:
    """Both transforms of a shard, and the interval extension on them."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, n_words: int) -> None:
        self.size = n_words + 1
        self.counts = np.bincount(forward, minlength=self.size)
        self.sides = [(t, self._steps(t)) for t in (forward, backward)]

    @staticmethod
    def _steps(symbols: np.ndarray) -> np.ndarray:
        """Where the suffix that a row's symbol begins has its own row."""
        steps = np.empty(len(symbols), dtype=np.int32)
        steps[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
        return steps

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals of the single words: starts in either order, and sizes."""
        starts = np.cumsum(self.counts)[:-1]
        return starts, starts.copy(), self.counts[1:]

    def extend(self, left: bool, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray, edges: bool = False) -> tuple[np.ndarray, ...]:
        """All intervals one word longer, to the left or right: phrase they come from, word, and their starts and sizes.

        ``starts`` are in the forward order, ``others`` in the backward one. The
        interval that is read splits by its symbols; in the other order the parts
        stand one after another as the symbols do. With ``edges``, ends of pieces
        count as word 0; they may then be extended to the other side only.
        """
        (symbols, steps), (own, other) = self.sides[0 if left else 1], (starts, others) if left else (others, starts)
        owner = np.repeat(np.arange(len(own)), sizes)
        rows = np.arange(len(owner)) + np.repeat(own - (np.cumsum(sizes) - sizes), sizes)
        key, first, n = np.unique(owner * self.size + symbols[rows], return_index=True, return_counts=True)
        phrase, word = np.divmod(key, self.size)
        before = np.cumsum(n) - n
        opened = np.concatenate([[True], phrase[1:] != phrase[:-1]])[: len(phrase)]
        inside = before - np.repeat(before[opened], np.diff(np.append(np.flatnonzero(opened), len(phrase))))
        grown, beside = steps[rows[first]], other[phrase] + inside
        keep = (word > 0) | edges
        ends = (grown, beside) if left else (beside, grown)
        return phrase[keep], word[keep], ends[0][keep], ends[1][keep], n[keep]


def _index(raw: pa.BinaryScalar, known: pa.ListScalar) -> tuple[np.ndarray, Index]:
    """The index of a shard over its frequent words, in the order of their global ids, and these ids from code 1."""
    place, gid = (x.to_numpy() for x in known.values.flatten())
    order = np.argsort(gid)
    ids = _unpacked(raw)
    table = np.zeros(max(int(ids.max()), int(place.max()) + 1) + 1, dtype=np.int64)
    table[place[order] + 1] = np.arange(1, len(gid) + 1)
    seq = np.append(table[ids], 0)
    seq = seq[(seq > 0) | np.concatenate([[False], seq[:-1] > 0])]
    return np.append([0], gid[order]), Index(transform(seq), transform(np.append(seq[:-1][::-1], 0)), len(gid))


def _pairs(index: Index) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries of a shard, some words at a time: the word before a pair, the pair, the word behind it (0: none), and their count."""
    words = index.words()
    for lo, hi in slices(words[2], SLICE_WORDS):
        of, second, *ends = index.extend(False, *(x[lo:hi] for x in words))
        first = of + lo + 1
        of, behind, *ends = index.extend(False, *ends, edges=True)
        first, second = first[of], second[of]
        of, before, _, _, n = index.extend(True, *ends, edges=True)
        yield before, first[of], second[of], behind[of], n


def _dealt(entries: list[np.ndarray], weights: list[np.ndarray], share: int, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each entry, and how many words a phrase has at least whose count is whole there.

    ``weights`` are counts of the words, if not below ``share``. A pair of two such
    words may be more than a part holds, so it is spread by the word behind it over
    as many parts as its rarer word fills, and three such words by the one before.
    """
    before, first, second, behind = (e.astype(np.uint64) for e in entries)
    rarer = np.minimum(weights[1], weights[2])
    spread = [(1 + w // share).astype(np.uint64) for w in (rarer, np.minimum(rarer, weights[3]))]
    pair = mix64((first << np.uint64(32)) | second)
    three = mix64(pair + behind)
    size = 2 + (spread[0] > 1) + (spread[1] > 1)
    step = np.choose(size - 2, [np.zeros_like(pair), three % spread[0], mix64(three + before) % spread[1]])
    return ((mix64(np.where(size < 4, pair, three)) % np.uint64(n_parts) + step) % np.uint64(n_parts)).astype(np.int64), size


def _parts(heavy: np.ndarray, share: int, n_parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of shards by part; ``heavy`` are the counts of the words from id 1 on that fill a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, known in zip(batch.column("ids"), batch.column("known"), strict=True):
                gids, index = _index(raw, known)
                weight = np.where(gids <= len(heavy), np.append([np.iinfo(np.int64).max], heavy)[np.minimum(gids, len(heavy))], 0)
                rows = []
                for *codes, n in _pairs(index):
                    entries = [gids[c] for c in codes]
                    rows.append([x.astype(np.uint32) for x in (*_dealt(entries, [weight[c] for c in codes], share, n_parts), *entries, n)])
                part, size, *columns = (np.concatenate(x) for x in zip(*rows, strict=True))
                deal = part.astype(np.int64) * 3 + size - 2
                order = np.argsort(deal, kind="stable")
                deal, at = np.unique(deal[order], return_index=True)
                blocks = list(zip(at, np.append(at[1:], len(order)), strict=True))
                packed = [[_packed(np.diff(x[lo:hi], prepend=np.uint32(0)) if k == 1 else x[lo:hi]) for lo, hi in blocks] for k, x in enumerate(c[order] for c in columns)]
                columns = [pa.array(deal // 3), pa.array(deal % 3 + 2), *(pa.array(x, pa.binary()) for x in packed)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "size", *ENTRY])

    return run


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    fresh = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(np.append([True], fresh)) if len(keys[0]) else np.empty(0, np.int64)


def _counted(least: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The phrases of a part that reach ``least``, and those of which it holds but some counts."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        blocks = {c: [_unpacked(x, np.int64) for x in table.column(c)] for c in ENTRY}
        blocks["first"] = [np.cumsum(x) for x in blocks["first"]]
        before, first, second, behind, n = (np.concatenate(blocks[c]) for c in ENTRY)
        found, pair = [], (first << 32) | second
        order = np.argsort(pair, kind="stable")
        for size in (2, 3, 4):
            if size > 2:
                here = np.flatnonzero(behind[order] > 0 if size == 3 else before[order] > 0)
                order = order[here]
                order = order[np.lexsort((before[order], behind[order], pair[order]) if size == 4 else (behind[order], pair[order]))]
            starts = _runs(*(x[order] for x in (pair, behind, before)[: size - 1]))
            sums = np.add.reduceat(n[order], starts) if len(starts) else np.empty(0, np.int64)
            keep = sums >= (least if key[1].as_py() <= size else 1)
            words = [x[order[starts[keep]]] for x in ((before,) if size == 4 else ()) + (first, second, behind)[: max(2, size - (size == 4))]]
            g = pa.ListArray.from_arrays(pa.array(np.arange(keep.sum() + 1, dtype=np.int32) * size), pa.array(np.stack(words, axis=1).ravel() if words else []))
            found.append(pa.table({"g": g, "n": pa.array(sums[keep])}))
            order = order[np.repeat(keep, np.diff(np.append(starts, len(order))))]
        return pa.concat_tables(found)

    return run


def _sum(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Counts over all shards, of at least ``least``."""
    return rows.groupBy(*keys).agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _numbered(words: DataFrame) -> DataFrame:
    """The words with ids from 1 on without gaps, frequent ones first."""
    sorted_ = materialize(words.orderBy(F.desc("a")).withColumn("id", F.monotonically_increasing_id()))
    slot = F.shiftright("id", 33)
    sizes = {r["slot"]: r["n"] for r in sorted_.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect()}
    first = np.cumsum([1] + [sizes.get(k, 0) for k in range(max(sizes, default=0))]).tolist()
    return sorted_.withColumn("gid", F.get(F.array(*(F.lit(x).cast("long") for x in first)), slot.cast("int")) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("id")


def _subphrases(g: Column) -> Column:
    """The shorter phrases of two words and more inside a phrase of up to four."""
    part = lambda start, size: F.when(F.size(g) >= start + size - 1, F.slice(g, start, size))
    three = F.when(F.size(g) == 4, F.array(F.slice(g, 1, 3), F.slice(g, 2, 3))).otherwise(F.array())
    return F.filter(F.concat(F.array(part(1, 2), part(2, 2), part(3, 2)), three), lambda x: x.isNotNull())


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The best collocations of every language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, null languages `und`; repeated rows count again; texts
    of any length are read whole, in blocks. A language without candidates, and so
    an empty table, gives no rows. Ties of the score go by count, then by phrase
    in the order of its bytes. Columns but lang and text are not looked at. A piece
    is never cut, so memory of a shard follows ``SHARD_WORDS`` or the longest piece.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    shards = materialize(texts.mapInArrow(_shards, "shard long, lang string, ids binary, words array<string>, counts array<long>"))
    totals = shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    found = shards.select("lang", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    words = _numbered(materialize(_sum(found.toDF("lang", "word", "n"), ["lang", "word"], min_count)))
    n_words = words.agg(F.sum("a")).first()[0] or 0
    n_parts = max(partitions(docs.sparkSession), -(-n_words // max(PAIR_ROWS, LEAST_PAIRS)))
    share = max(1, n_words // n_parts)
    heavy = np.array([r["a"] for r in words.where(F.col("a") >= share).orderBy("gid").select("a").collect()], dtype=np.int64)

    placed = shards.select("shard", "lang", F.posexplode("words").alias("place", "word"))
    known = placed.join(words.select("lang", "word", "gid").hint("merge"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("place", "gid")).alias("known"))
    with batches_of(docs.sparkSession, ROW_BYTES):
        inputs = shards.select("shard", "ids").join(known.hint("merge"), "shard")
        entries = inputs.mapInArrow(_parts(heavy, share, n_parts), f"part long, size long, {', '.join(f'{c} binary' for c in ENTRY)}")
        found = entries.groupBy("part", "size").applyInArrow(_counted(min_count), "g array<long>, n long")
        phrases = materialize(_sum(found, ["g"], min_count))

    parts = words.select(F.array("gid").alias("g"), "a").union(phrases.where(F.size("g") < 4))
    cuts = phrases.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    cuts = cuts.select("g", "a", "k", F.expr("slice(g, 1, k)").alias("head"), F.expr("slice(g, k + 1, size(g) - k)").alias("rest"))
    cuts = cuts.join(parts.select(F.col("g").alias("head"), F.col("a").alias("l")).hint("merge"), "head").join(parts.select(F.col("g").alias("rest"), F.col("a").alias("r")).hint("merge"), "rest")
    scored = cuts.withColumn("score", F.expr("(CAST(2000000 AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0))) DIV CAST(l + r AS DECIMAL(19,0))"))
    judged = scored.groupBy("g").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = phrases.where(F.size("g") > 2).select(F.explode(_subphrases(F.col("g"))).alias("g"), "a").groupBy("g").agg(F.max("a").alias("cover"))
    kept = judged.join(inside.hint("merge"), "g", "left").where(F.col("cover").isNull() | (F.col("cover") * 100 < F.col("a") * COVER))
    kept = materialize(kept.select("g", "a", "cut.score", "cut.l", "cut.r"))
    spelt = kept.select("g", F.posexplode("g").alias("at", "gid")).join(words.select("gid", "word", "lang").hint("merge"), "gid")
    spelt = spelt.groupBy("g").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    named = kept.join(spelt.hint("merge"), "g")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = named.withColumn("deal", F.pmod(F.xxhash64("g"), F.lit(RANK_PARTS)))
    for keys in (["lang", "deal"], ["lang"]):
        dealt = dealt.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return dealt.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of every language of ``documents``."""
    return mine(documents(spark, sf_dir))


SQL = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    lists AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
    grams AS ({" UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(w) - {s} + 2), lambda i: w[i : i + {s} - 1])) AS g FROM lists" for s in (1, 2, 3, 4))}),
    f AS MATERIALIZED (SELECT lang, g, array_to_string(g, ' ') AS phrase, count(*) AS a FROM grams GROUP BY lang, g),
    totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang),
    cands AS MATERIALIZED (SELECT * FROM f WHERE len(g) > 1 AND a >= {MIN_COUNT}),
    split AS (SELECT lang, g, phrase, a, unnest(range(1, len(g))) AS k FROM cands),
    cuts AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(g[1:k], ' ') AS head, array_to_string(g[k + 1:], ' ') AS rest FROM split),
    scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score FROM cuts c
        JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    shorter AS (SELECT lang, a, unnest(CASE len(g) WHEN 3 THEN [g[1:2], g[2:3]] WHEN 4 THEN [g[1:2], g[2:3], g[3:4], g[1:3], g[2:4]] END) AS g FROM cands WHERE len(g) > 2),
    inside AS (SELECT lang, array_to_string(g, ' ') AS phrase, max(a) AS cover FROM shorter GROUP BY 1, 2),
    kept AS (SELECT l.* FROM lowest l LEFT JOIN inside USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < {COVER} * l.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= {TOP}"""

QUERIES = {"op11_collocations": op11_collocations}
ORACLE_SQL = {"op11_collocations": SQL}
