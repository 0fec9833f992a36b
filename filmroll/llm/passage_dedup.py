"""Operator 12, removal of repeated 100-byte passages by column-wise suffix sorting.

Every window of 100 bytes has an anchor: its 32 bytes of least hash, the leftmost
of equals. Equal windows have equal anchors at the same place, so windows are
kept in segments, maximal runs with one anchor, and only segments whose anchor
occurs again matter. Of equal segments all but the earliest are repeats at once.
Where an anchor stands in different segments, their bytes meet, lined up at the
anchor, and are sorted by columns: each round puts one symbol in front of every
segment's suffix, and from the symbols in the order of the round before (that
column of the collection's Burrows-Wheeler transform) come the new order, by a
stable partition, and the new common prefixes, by minima over the old ones.
Neighbours that share 100 bytes are equal windows; all but the earliest are
repeats. As segments are lined up, only suffixes of one column need comparing,
so a round's state is one column of order, symbols and common prefixes. What
passes between stages are tables in the shared folder, read in order of anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.llm.common import documents, materialize, mix64

#: Bytes of a passage that counts as repeated, and of the anchors that find it.
WINDOW, ANCHOR = 100, 32
#: Window starts that are hashed at once; positions in a block fill the low bits of a sort key.
BLOCK, LOW = 1 << 17, 18
#: Segments of an anchor beyond which they are dealt into parts that are sorted on their own.
HOT = 20_000
#: Segments sorted at once; an anchor's part is never cut.
SORT_ROWS = 32_768

#: Before an anchor a window reaches at most so far; from it on, at most WINDOW bytes.
REACH = WINDOW - ANCHOR
#: A byte that UTF-8 text never holds.
END = 0xFF

_BASE = 0x9E3779B97F4A7C15
_CACHE: dict[str, tuple[np.ndarray, ...]] = {}
ROW = ("none", "doc_id", "text_id")


def _powers() -> tuple[np.ndarray, ...]:
    """A random word for each byte value, and the powers of an odd base with their inverses."""
    if "powers" not in _CACHE:
        size = BLOCK + 2 * WINDOW
        one = np.ones(1, dtype=np.uint64)
        up, down = (np.cumprod(np.concatenate([one, np.full(size, b, dtype=np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        _CACHE["powers"] = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)), up, down)
    return _CACHE["powers"]


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` consecutive keys, from minima to both sides of block edges."""
    padded = np.concatenate([keys, np.full(-len(keys) % span, np.iinfo(np.uint64).max)]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)[span - 1 : len(keys)]
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)[: len(keys) - span + 1]
    return np.minimum(ahead, behind)


def find_segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of a block: anchor hash, segment hash, anchor, first and last window start.

    ``ends`` holds for each byte where its text ends; a window lies in one text.
    """
    empty = np.empty(0, dtype=np.int64)
    if len(data) < WINDOW:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    values, up, down = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[data] * up[: len(data)], dtype=np.uint64)])
    hashes = (sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(data) - ANCHOR + 1]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    low = np.uint64((1 << LOW) - 1)
    place = (_least(hashes & ~low | np.arange(len(hashes), dtype=np.uint64), REACH + 1) & low).astype(np.int64)
    start = np.arange(len(place))
    inside = start + WINDOW <= ends[: len(place)]
    fresh = np.concatenate([[True], (place[1:] != place[:-1]) | (ends[1 : len(place)] != ends[: len(place) - 1])])
    first = np.flatnonzero(fresh & inside)
    # a run stops before the next one, or where its text has no more whole window
    run = np.append(np.flatnonzero(fresh), len(place))
    last = np.minimum(run[np.searchsorted(run, first, side="right")] - 1, ends[first] - WINDOW)
    anchor = place[first]
    whole = (sums[last + WINDOW] - sums[first]) * down[first] + (last - first).astype(np.uint64)
    return hashes[anchor], mix64(whole), anchor, first, last


def _blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in blocks: bytes, the end of each byte's text, its row, and the position of the block's bytes in their texts.

    Short texts share a block; a long one goes through several, which overlap by a window less a byte.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def block() -> tuple[np.ndarray, ...]:
        sizes = np.array([len(b) for _, _, b in held])
        stops = np.cumsum(sizes)
        repeat = lambda x: np.repeat(np.asarray(x, dtype=np.int64), sizes)
        return np.frombuffer(b"".join(b for _, _, b in held), np.uint8), repeat(stops), repeat([i for i, _, _ in held]), repeat(np.array([at for _, at, _ in held]) - (stops - sizes))

    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - WINDOW + 1, 0), BLOCK):
            piece = text[at : at + BLOCK + WINDOW - 1]
            if held and size + len(piece) > BLOCK + WINDOW:
                yield block()
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield block()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of texts. Of equal ones in a batch all but the earliest are marked as repeats, with a hash of their own in place of the anchor's."""
    names = ["anchor", "segment", *ROW, "place", "before", "size", "again"]
    for batch in batches:
        texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ROW]
        found: list[tuple[np.ndarray, ...]] = []
        for data, ends, row, shift in _blocks(texts):
            hashes, segment, anchor, first, last = find_segments(data, ends)
            found.append((hashes, segment, row[first], anchor + shift[first], anchor - first, last - first + WINDOW))
        if not found:
            continue
        hashes, segment, row, place, before, size = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, keys[2][row], keys[1][row], keys[0][row], segment, hashes))
        ranked = [x[order] for x in (hashes, segment, place, *(k[row] for k in keys))]
        opens = np.flatnonzero(np.concatenate([[True], (ranked[0][1:] != ranked[0][:-1]) | (ranked[1][1:] != ranked[1][:-1])]))
        least = np.repeat(opens, np.diff(np.append(opens, len(order))))
        again = np.zeros(len(order), dtype=bool)
        again[order] = np.any([x != x[least] for x in ranked[2:]], axis=0)  # a row that stands there twice is no repeat of itself
        hashes = np.where(again, mix64(hashes + place.astype(np.uint64) + mix64(row.astype(np.uint64))), hashes)
        columns = [hashes.view(np.int64), segment.view(np.int64), *(k[row] for k in keys), place, before.astype(np.int32), size.astype(np.int32), again]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


RUN = "anchor long, segment long, none boolean, doc_id long, text_id long, place long, before int, size int, again boolean"
PIECE = "anchor long, part int, none boolean, doc_id long, text_id long, place long, before int, bytes binary"
FOUND = "anchor long, window long, none boolean, doc_id long, text_id long, start long, stop long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that are asked for."""
    for batch in batches:
        for i in range(batch.num_rows):
            text, asked = batch.column("text")[i].as_buffer().to_pybytes(), batch.column("asked")[i].values
            anchor, part, place, before, size = (c.to_numpy() for c in asked.flatten())
            cut = [text[a : a + n] for a, n in zip((place - before).tolist(), size.tolist(), strict=True)]
            same = [np.full(len(place), batch.column(c)[i].as_py()) for c in ROW]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor, part, *same, place, before)] + [pa.array(cut, pa.binary())], names=["anchor", "part", *ROW, "place", "before", "bytes"])


def _least_between(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Minima of values[start..stop] (both included), from minima over powers of two."""
    levels, width = [values], 1
    longest = int((stop - start).max(initial=0)) + 1
    while 2 * width <= longest:
        levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
        width *= 2
    level = np.frexp(stop - start + 1)[1] - 1
    out = np.empty(len(start), dtype=values.dtype)
    for k, mins in enumerate(levels):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(mins[start[at]], mins[stop[at] - (1 << k) + 1])
    return out


def sort_columns(pieces: list[bytes], before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Order and common prefixes of the suffixes of lined-up ``pieces``, column by column from the right.

    Yields for each column where a window may start (as a distance from the
    anchor) the order of the pieces and the length that each shares with the one
    before it. ``before`` is each piece's number of bytes before its anchor.
    """
    m = len(pieces)
    grid = np.full((REACH + WINDOW, m), END, dtype=np.uint8)
    sizes = np.array([len(p) for p in pieces])
    owner = np.repeat(np.arange(m), sizes)
    column = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + REACH - before[owner]
    grid[column, owner] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    order, shared = np.arange(m), np.zeros(m, dtype=np.uint8)
    for c in range(REACH + WINDOW - 1, -1, -1):
        symbols = grid[c][order]
        moved = np.argsort(symbols, kind="stable")
        placed = symbols[moved]
        same = np.flatnonzero((placed[1:] == placed[:-1]) & (placed[1:] != END)) + 1
        longer = np.zeros(m, dtype=np.uint8)
        longer[same] = np.minimum(_least_between(shared, moved[same - 1] + 1, moved[same]), END - 1) + 1
        order, shared = order[moved], longer
        if c <= REACH:
            yield c - REACH, order, shared


def _judge(key: list[np.ndarray], place: np.ndarray, before: np.ndarray, pieces: list[bytes], hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last repeated window start of each piece (-1 and -2 if none), and the earliest windows of hot pieces."""
    rank, by = np.empty(len(pieces), dtype=np.int64), np.lexsort((place, *key[::-1]))
    rank[by] = np.cumsum(np.concatenate([[False], np.any([x[by][1:] != x[by][:-1] for x in (place, *key)], axis=0)]))
    low, high = np.full(len(pieces), WINDOW), np.full(len(pieces), -WINDOW)
    left = []
    sizes = np.array([len(p) for p in pieces])
    for c, order, shared in sort_columns(pieces, before):
        runs = np.flatnonzero(shared < WINDOW)
        least = np.repeat(np.minimum.reduceat(rank[order], runs), np.diff(np.append(runs, len(order))))
        again = order[rank[order] != least]
        low[again], high[again] = np.minimum(low[again], c), np.maximum(high[again], c)
        if hot.any():
            first = order[(rank[order] == least)]
            first = first[hot[first] & (c >= -before[first]) & (before[first] + c + WINDOW <= sizes[first])]
            left.append(np.stack([first, np.full(len(first), c)]))
    return low, high, np.concatenate(left, axis=1) if left else np.empty((2, 0), dtype=np.int64)


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated stretches of segments that come in order of anchor and part; windows left over of hot anchors, with their hashes."""
    held: list[pa.RecordBatch] = []

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pieces = [b.as_buffer().to_pybytes() for b in table.column("bytes").combine_chunks()]
        anchor, part, place, before = (table.column(c).to_numpy() for c in ("anchor", "part", "place", "before"))
        key = [table.column(c).to_numpy() for c in ROW]
        low, high, left = _judge(key, place, before, pieces, part > 0)
        at = np.flatnonzero(low <= high)
        yield _rows(anchor[at], np.zeros(len(at), np.int64), [k[at] for k in key], place[at] + low[at], place[at] + high[at] + WINDOW)
        if left.shape[1]:
            one, c = left
            start = before[one] + c
            digest = [hashlib.blake2b(pieces[i][s : s + WINDOW], digest_size=8).digest() for i, s in zip(one.tolist(), start.tolist(), strict=True)]
            yield _rows(anchor[one], np.frombuffer(b"".join(digest), dtype=np.int64), [k[one] for k in key], place[one] + c, np.full(len(one), -1))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) > SORT_ROWS:
            table = pa.Table.from_batches(held)
            anchor, part = table.column("anchor").to_numpy(), table.column("part").to_numpy()
            edges = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            if len(edges):
                yield from judge(table.slice(0, int(edges[-1])))
                held = table.slice(int(edges[-1])).combine_chunks().to_batches()
    if held:
        yield from judge(pa.Table.from_batches(held))


def _rows(anchor: np.ndarray, window: np.ndarray, key: list[np.ndarray], start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    names = [f.split()[0] for f in FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor, window, *key, start.astype(np.int64), stop.astype(np.int64))], names=names)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts of a window and more with the key of their row: whether doc_id is null, doc_id, and a hash of the text."""
    long = docs.where(F.octet_length("text") >= WINDOW)
    return long.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """none, doc_id, text_id and start, stop of stretches of bytes that are covered by windows which also start earlier.

    Earlier is by doc_id (nulls last), a hash of the text where doc_ids repeat,
    and position. Rows of one doc_id and text have the same key; they count as one here.
    """
    keyed = _keyed(docs)
    # the place of a whole anchor in a shuffle of 4 longs; whatever follows sees only what occurs again
    runs = keyed.mapInArrow(_runs, RUN).repartition("anchor", "again")
    alike, group = W.partitionBy("anchor", "again", "segment"), W.partitionBy("anchor", "again")
    ranked = runs.withColumn("nth", F.rank().over(alike.orderBy(*ROW, "place")))
    kinds = [F.min("segment").over(group).alias("least"), F.max("segment").over(group).alias("most"), F.count(F.when(F.col("nth") == 1, 1)).over(group).alias("n")]
    grouped = ranked.select("*", *kinds)
    known = F.col("again") | (F.col("nth") > 1)
    seen = materialize(grouped.where(known | (F.col("least") != F.col("most"))).select("anchor", *ROW, "place", "before", "size", known.alias("known"), "n"))

    whole = seen.where("known").select(*ROW, (F.col("place") - F.col("before")).alias("start"), (F.col("place") - F.col("before") + F.col("size")).alias("stop"))
    part = F.when(F.col("n") > HOT, F.pmod(F.xxhash64(*ROW, "place"), F.ceil(F.col("n") / HOT)) + 1).otherwise(0).cast("int")
    asked = seen.where("NOT known").groupBy(*ROW).agg(F.collect_list(F.struct("anchor", part.alias("part"), "place", "before", "size")).alias("asked"))
    cut = keyed.join(asked.hint("merge"), list(ROW)).mapInArrow(_cut, PIECE)
    sorted_ = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_sorted, FOUND)
    judged = materialize(sorted_)
    met = judged.where("stop < 0").withColumn("nth", F.rank().over(W.partitionBy("anchor", "window").orderBy(*ROW, "start"))).where("nth > 1")
    return whole.union(judged.where("stop >= 0").select(*ROW, "start", "stop")).union(met.select(*ROW, "start", (F.col("start") + WINDOW).alias("stop")))


def _strip(text: bytes | None, starts: np.ndarray, stops: np.ndarray) -> tuple[bytes, int]:
    """A text without the bytes of the stretches, and the number of maximal removed runs."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    opens = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))[: len(starts)]
    closes = np.append(opens[1:], len(starts)) - 1 if len(starts) else opens
    kept, at = [], 0
    for a, b in zip(starts[opens].tolist(), reach[closes].tolist(), strict=True):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, (text or b"")[at:]]), len(opens)


def remove_passages(docs: DataFrame) -> DataFrame:
    """Documents without the bytes of repeated passages: doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    A byte goes if a string of 100 bytes that covers it also starts earlier, in a
    row of smaller doc_id or before in the same text. Null doc_ids come last, and
    rows of equal doc_id in order of a hash of their texts; of repeated rows all
    but one go as a whole. Null and empty texts have no bytes; texts of any length
    are read whole, in blocks; an empty table gives no rows. Columns but doc_id
    and text are not looked at. ``kept`` may start or end inside a character.
    """
    gone = repeated_ranges(docs).groupBy(*ROW).agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    raw = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("text_id"))
    joined = raw.join(gone.hint("merge"), list(ROW), "left")
    nth: Column = F.row_number().over(W.partitionBy(*ROW).orderBy("id"))
    judged = joined.withColumn("whole", (nth > 1) & (F.octet_length("text") >= WINDOW))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone, whole in zip(batch.column("text"), batch.column("gone"), batch.column("whole").to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if whole:
                    starts, stops = np.array([0]), np.array([len(data)])
                else:
                    starts, stops = (c.to_numpy() for c in gone.values.flatten()) if gone.is_valid else (np.empty(0, np.int64),) * 2
                kept, spans = _strip(data, starts, stops)
                out.append((len(data), len(data) - len(kept), spans, kept))
            size, removed, spans, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return judged.select("id", "text", "gone", "whole").mapInArrow(strip, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op12_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's removed bytes and the digest of what is kept."""
    found = remove_passages(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
    w AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, {2 * WINDOW})) AS k FROM (SELECT doc_id, h, unnest(range(0, n_bytes - {WINDOW} + 1)) AS s FROM t)),
    again AS (SELECT doc_id, s, s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) + {WINDOW} AS opens FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS nth FROM w) WHERE nth > 1),
    numbered AS (SELECT doc_id, s, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM again),
    spans AS (SELECT doc_id, min(s) AS a, max(s) + {WINDOW} AS b FROM numbered GROUP BY doc_id, span),
    gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
    kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS parts FROM gaps JOIN t USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(parts, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
    FROM t LEFT JOIN kept USING (doc_id)"""

QUERIES = {"op12_passage_dedup": op12_passage_dedup}
ORACLE_SQL = {"op12_passage_dedup": SQL}
