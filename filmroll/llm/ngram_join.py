"""Operator 5, n-gram Jaccard join over a token-group matrix.

Every text is the set of its distinct 5-word shingles. The join links all pairs
of texts with 100 * intersection >= 80 * union and gives their components.

1. Texts with equal sets form a class; only classes go on.
2. Similar classes are put into groups: classes that share a min-hash band meet
   in buckets, where each is compared with a few leaders, and the verified links
   make groups. A group is connected, so pairs inside it need no further look.
3. The token-group matrix holds, for each group, the union of its members'
   prefix tokens: with the tokens of a set in one order for all (rare first),
   two linked sets must share a token among the first n - ceil(8n/9) + 1 of the
   smaller and the first n - ceil(4n/5) + 1 of the larger. Groups that share no
   such token hold no linked pair.
4. Of the group pairs left, each set queries the other group: its overlap with
   the union of a block of members bounds its overlap with any of them, and only
   blocks that reach the bound are opened. Unions and sets are met as bit maps
   first: every bit that a set has beyond another takes at least one token that
   only the set has, so the bounds hold. What passes is compared set by set.

The order comes from a sketch of token frequencies over the whole corpus, of
fixed size; any order gives the same links, a good one gives few candidates.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from filmroll.llm.common import documents, materialize, mix64, partitions, put_back, set_aside, shingle_hashes, sized_hint
from filmroll.llm.components import connected_components

SHINGLE = 5
SKETCH = 1 << 20
SKETCH_PARTS = 16
BANDS, ROWS = 3, 2
#: Members of a bucket that are compared with one list of leaders, leaders of a list, and those all lists of a bucket share.
BUCKET, LEADERS, SEEDS = 512, 64, 4
#: Bits of a set's bit map.
BITS = 4096
#: Members of a group whose union is kept as one block.
BLOCK = 64

_SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def set_key(tokens: np.ndarray) -> bytes:
    """128-bit digest of a sorted token set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def bands(tokens: np.ndarray) -> np.ndarray:
    """One key per min-hash band."""
    least = np.array([mix64(tokens ^ s).min() for s in _SEEDS]).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key ^ least[:, k])
    return key.view(np.int64)


def _profile(docs: DataFrame) -> DataFrame:
    """A row per document (row_id, doc_id, digest, n, key, bands), and rows of partial frequency sketches (part, counts)."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, id_type = np.zeros(SKETCH, dtype=np.uint32), pa.null()
        names = ["row_id", "doc_id", "digest", "n", "key", "bands", "part", "counts"]
        for batch in batches:
            id_type, sizes, keys, found = batch.schema.field("doc_id").type, [], [], []
            texts = _texts(batch)
            digests = [hashlib.md5(t).digest() if t is not None else None for t in texts]
            for text in texts:
                tokens = shingle_hashes(text, SHINGLE)
                sizes.append(len(tokens))
                keys.append(set_key(tokens) if len(tokens) else None)
                found.append(bands(tokens) if len(tokens) else None)
                np.add.at(counts, (tokens & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if counts.any():
            parts = [zlib.compress(p.astype("<u4").tobytes(), 1) for p in np.split(counts, SKETCH_PARTS)]
            n = SKETCH_PARTS
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_id"))
    return numbered.mapInArrow(profiled, f"row_id long, doc_id {kind}, digest binary, n long, key binary, bands array<long>, part int, counts binary")


def _frequencies(profile: DataFrame) -> np.ndarray:
    """The sketch of the whole corpus: SKETCH counters, whatever the corpus."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, np.uint64(0)) + np.frombuffer(zlib.decompress(raw), dtype="<u4").astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype("<u8").tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])

    rows = profile.where("part IS NOT NULL").select("part", "counts").repartition(SKETCH_PARTS, "part").mapInArrow(total, "part int, counts binary").collect()
    found = np.zeros((SKETCH_PARTS, SKETCH // SKETCH_PARTS), dtype=np.uint64)
    for r in rows:
        found[r["part"]] = np.frombuffer(r["counts"], dtype="<u8")
    return np.minimum(found.reshape(-1), np.uint64(2**32 - 1)).astype(np.uint32)


def prefix_sizes(n: int) -> tuple[int, int]:
    """Tokens that a set of n must be looked up by as the smaller and as the larger of a linked pair."""
    return n - (8 * n + 8) // 9 + 1, n - (4 * n + 4) // 5 + 1


def _prefixes(docs: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """key, n and prefix (tokens in order) of every row with shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            keys, sizes, found = [], [], []
            for text in _texts(batch):
                tokens = shingle_hashes(text, SHINGLE)
                if not len(tokens):
                    continue
                order = np.lexsort((tokens, counts[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]))
                keys.append(set_key(tokens))
                sizes.append(len(tokens))
                found.append(tokens[order[: prefix_sizes(len(tokens))[1]]].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["key", "n", "prefix"])

    return docs.select("text").mapInArrow(cut, "key binary, n long, prefix array<long>")


def bit_map(tokens: np.ndarray) -> bytes:
    """BITS bits, those of the tokens' low digits set."""
    bits = np.zeros(BITS, dtype=bool)
    bits[(tokens & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _read_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """tokens and bits of the classes in ``wanted`` (cid, rep_doc, key and more), read from their first documents, and the other columns of ``wanted``."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t, SHINGLE) for t in _texts(batch)]
            bits = [np.frombuffer(bit_map(t), dtype="<i8") for t in found]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(t) for t in found], pa.binary()), pa.array([t.view(np.int64) for t in found], pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["key", "tokens", "bits"])

    ids = materialize(wanted.select(F.col("rep_doc").alias("_id")).distinct())
    some = docs.select("doc_id", "text").join(sized_hint(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    read = some.select("text").mapInArrow(tokens, "key binary, tokens array<long>, bits array<long>")
    return read.join(sized_hint(materialize(wanted.drop("rep_doc"))), "key").drop("key")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, n, tokens and bits of the classes in ``wanted`` (cid, rep_doc, key), stored."""
    return materialize(_read_sets(docs, wanted.select("cid", "rep_doc", "key")).withColumn("n", F.size("tokens").cast("long")))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _leader_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links (a, b) of classes with leaders of their buckets.

    A bucket is a min-hash band's classes. Large ones are dealt into lists; the
    first SEEDS leaders are the same in all lists of a bucket, more come from
    the members that are not linked to any leader so far, LEADERS at most. What
    is missed here is found by the matrix.
    """
    banded = materialize(classes.select("cid", F.explode("bands").alias("band")))
    seeds = F.array_compact(F.array(*[F.min(F.when(F.pmod(F.xxhash64("cid"), F.lit(SEEDS)) == k, F.col("cid"))) for k in range(SEEDS)]))
    buckets = banded.groupBy("band").agg(F.count("*").alias("size"), seeds.alias("seeds")).where("size > 1")
    buckets = materialize(buckets.withColumn("lists", F.ceil(F.col("size") / BUCKET)))
    members = banded.join(buckets.select("band", "lists").hint("merge"), "band").select("cid", "band", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("lists")).alias("list"), F.lit(False).alias("lead"))
    leaders = buckets.select("band", "seeds", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lists") - 1)).alias("list")).select(F.explode("seeds").alias("cid"), "band", "list", F.lit(True).alias("lead"))
    deals = members.unionByName(leaders).groupBy("cid").agg(F.collect_list(F.struct("band", "list", "lead")).alias("deals"))
    wanted = materialize(classes.select("cid", "rep_doc", "key").join(deals.hint("merge"), "cid"))
    dealt = _read_sets(docs, wanted).select("cid", "tokens", F.inline("deals"))
    lists = dealt.repartition(partitions(docs.sparkSession), "band", "list").sortWithinPartitions("band", "list", F.desc("lead"), "cid")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            values = batch.column("tokens")
            flat, cuts = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))])
            for i, (cid, band, part, lead) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("cid", "band", "list", "lead")), strict=True)):
                if (band, part) != here:
                    here, known = (band, part), []
                tokens = flat[cuts[i] : cuts[i + 1]].view(np.uint64)
                bits, n = int.from_bytes(bit_map(tokens), "little"), len(tokens)
                links = 0
                for other, mine, theirs in known:
                    total = n + len(mine)
                    if other != cid and 9 * (bits ^ theirs).bit_count() <= total and 100 * (same := _common(tokens, mine)) >= 80 * (total - same):
                        out.append((cid, other))
                        links += 1
                if lead or not links and len(known) < LEADERS:
                    known.append((cid, tokens.copy(), bits))
            a, b = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.select("cid", "tokens", "band", "list", "lead").mapInArrow(compare, "a long, b long")


def linked(a: str, b: str, common: str) -> str:
    """SQL for similarity 0.8 of sets of sizes a and b."""
    return f"100 * {common} >= 80 * ({a} + {b} - {common})"


def _differ(a: Column, b: Column) -> Column:
    """Bits in which two bit maps differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked pairs among ``pairs`` (a, b), by their sets."""
    side = lambda c: sets.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("tokens").alias(f"tokens_{c}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")))
    return both.where(linked("n_a", "n_b", "common")).select("a", "b")


def _group_pairs(matrix: DataFrame) -> DataFrame:
    """Pairs of groups (a < b) that share a token by which both must be looked up.

    ``matrix``: token, grp, low and high (sizes of the members), first (whether
    the token is among those of a smaller set). Sorted by token, a token's rows
    stream by together.
    """

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = np.rec.fromarrays([batch.column(n).to_numpy(zero_copy_only=False) for n in ("token", "grp", "low", "high", "first")], names="token,grp,low,high,first")
            table = np.concatenate([rest, table]) if rest is not None else table
            if not len(table):
                continue
            earlier = np.flatnonzero(table["token"] != table["token"][-1])  # the last token may go on in the next batch
            last = int(earlier[-1]) + 1 if len(earlier) else 0
            rest = table[last:]
            yield from _run_pairs(table[:last])
        if rest is not None:
            yield from _run_pairs(rest)

    return matrix.mapInArrow(paired, "a long, b long")


def _run_pairs(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs within each run of equal tokens, in pieces of bounded size."""
    if len(table) < 2:
        return
    token = table["token"]
    starts = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
    lengths = np.diff(np.concatenate([starts, [len(table)]]))
    several = lengths > 1
    found: list[np.ndarray] = []
    held = 0
    for start, length in zip(starts[several], lengths[several], strict=True):
        run = table[start : start + length]
        run = run[np.argsort(run["low"], kind="stable")]
        if (run["grp"] == run["grp"][0]).all():
            continue
        for i in range(length - 1):
            one, others = run[i], run[i + 1 :]
            ok = (4 * others["low"] <= 5 * one["high"]) & (others["grp"] != one["grp"])
            ok &= (one["first"] & (one["low"] <= others["high"])) | (others["first"] & (others["low"] <= one["high"]))
            mates = others["grp"][ok]
            if len(mates):
                found.append(np.stack([np.minimum(mates, one["grp"]), np.maximum(mates, one["grp"])]))
                held += len(mates)
            if held > 100_000:
                yield _pair_batch(found)
                found, held = [], 0
    if found:
        yield _pair_batch(found)


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _open_groups(group_pairs: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Linked pairs of classes (a, b) across ``group_pairs`` (a, b), found block by block.

    The sets of the smaller group query the larger one.
    """
    sized = members.groupBy("grp").agg(F.count("*").alias("n_members"))
    with_sizes = group_pairs.join(sized.select(F.col("grp").alias("a"), F.col("n_members").alias("ma")).hint("merge"), "a").join(sized.select(F.col("grp").alias("b"), F.col("n_members").alias("mb")).hint("merge"), "b")
    sides = with_sizes.select(F.when(F.col("ma") <= F.col("mb"), F.col("a")).otherwise(F.col("b")).alias("query_grp"), F.when(F.col("ma") <= F.col("mb"), F.col("b")).otherwise(F.col("a")).alias("grp"))
    told = materialize(members.select("cid", "grp", "n").join(sets.select("cid", "bits").hint("merge"), "cid"))
    queries = sides.join(told.select(F.col("grp").alias("query_grp"), F.col("cid").alias("query"), F.col("n").alias("nq"), F.col("bits").alias("asked")).hint("merge"), "query_grp").drop("query_grp")
    # members of a group in order of size, in blocks; very large groups are dealt into parts first, so no window spans one
    parts = F.ceil(F.col("n_members") / (16 * BLOCK))
    salted = told.join(sized.hint("merge"), "grp").withColumn("salt", F.pmod(F.xxhash64("cid"), parts))
    ranked = salted.withColumn("block", F.floor((F.row_number().over(W.partitionBy("grp", "salt").orderBy("n", "cid")) - 1) / BLOCK))
    blocks = ranked.groupBy("grp", "salt", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list(F.struct("cid", "n", "bits")).alias("inside"))
    union = F.aggregate("inside", F.array_repeat(F.lit(0).cast("long"), BITS // 64), lambda t, m: F.zip_with(t, m["bits"], lambda x, y: x.bitwiseOR(y)))
    blocks = materialize(blocks.withColumn("union", union))
    reach = queries.join(blocks.hint("merge"), "grp").where("5 * nq >= 4 * low AND 4 * nq <= 5 * high")
    outside = F.aggregate(F.zip_with("asked", "union", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda t, x: t + x)
    opened = reach.where(5 * outside <= F.col("nq"))  # at most a fifth of a set lies outside a set it is linked with
    near = F.filter("inside", lambda m: (5 * F.least(F.col("nq"), m["n"]) >= 4 * F.greatest(F.col("nq"), m["n"])) & (9 * _differ(F.col("asked"), m["bits"]) <= F.col("nq") + m["n"]))
    pairs = opened.select(F.col("query").alias("a"), F.explode(F.transform(near, lambda m: m["cid"])).alias("b"))
    return _verify(materialize(pairs.distinct()), sets)


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, digest of the text, n, key) and of every key the root of its component (key, least_doc, root)."""
    docs = docs.select("doc_id", "text")
    profile = materialize(_profile(docs))
    rows = profile.where("row_id IS NOT NULL").select("row_id", "doc_id", "digest", "n", "key", "bands")
    first = F.min(F.struct("row_id", "doc_id"))
    classes = rows.where("n > 0").groupBy("key").agg(first.alias("rep"), F.min("doc_id").alias("least_doc"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("key", F.col("rep.row_id").alias("cid"), F.col("rep.doc_id").alias("rep_doc"), "least_doc", "n", "bands"))

    links = _leader_links(docs, classes)
    roots = materialize(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    members = classes.join(roots.select(F.col("node").alias("cid"), F.col("root").alias("grp")).hint("merge"), "cid", "left")
    members = materialize(members.withColumn("grp", F.coalesce("grp", "cid")).select("cid", "grp", "n", "key", "rep_doc", "least_doc"))
    large = materialize(roots.select(F.col("root").alias("grp")).distinct())

    prefixes = _prefixes(docs, _frequencies(profile)).groupBy("key").agg(F.first("prefix").alias("prefix"))
    of_member = prefixes.join(members.select("key", "grp", "n").hint("merge"), "key").join(sized_hint(large.withColumn("many", F.lit(True))), "grp", "left")
    n_first = F.col("n") - F.floor((8 * F.col("n") + 8) / 9) + 1
    cells = of_member.select("grp", "n", "many", n_first.alias("n_first"), F.posexplode("prefix").alias("at", "token")).select("token", "grp", "n", "many", (F.col("at") < F.col("n_first")).alias("first"))
    single = cells.where("many IS NULL").select("token", "grp", F.col("n").alias("low"), F.col("n").alias("high"), "first")
    united = cells.where("many").groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("first").alias("first"))
    matrix = single.unionByName(united).repartition(partitions(docs.sparkSession), "token").sortWithinPartitions("token")
    group_pairs = materialize(_group_pairs(matrix).distinct())

    across = members.join(group_pairs.select(F.col("a").alias("grp")).union(group_pairs.select(F.col("b").alias("grp"))).distinct().hint("merge"), "grp")
    more = materialize(_open_groups(group_pairs, across, _sets(docs, across)))
    grp_of = lambda side: members.select(F.col("cid").alias(side), F.col("grp").alias(f"g{side}")).hint("merge")
    joined = connected_components(more.join(grp_of("a"), "a").join(grp_of("b"), "b").select(F.col("ga").alias("u"), F.col("gb").alias("v")))
    final = members.join(joined.select(F.col("node").alias("grp"), "root").hint("merge"), "grp", "left").select("key", "least_doc", F.coalesce("root", "grp").alias("root"))
    return rows, materialize(final)


def similar_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    Words are separated by white space, A-Z taken as a-z. Texts of fewer than
    five words are one shingle; texts without words (and null ones) have none and
    are their own component. Repeated rows each get a row and are linked like
    equal texts; rows with null doc_id take part, and a component made of such
    rows alone has a null id; other columns are ignored; an empty table gives no
    rows. ``docs`` is read four times and must give the same rows each time.
    """
    rows, final = _rooted(docs)
    ids = final.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    by_key = final.join(ids.hint("merge"), "root").select("key", "component_id")
    whole = rows.where("n > 0").join(by_key.hint("merge"), "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return whole.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others), one for each component: its least row.

    A row is known by its doc_id and the digest of its whole text, so rows that
    share a doc_id, or have none, are each judged by their own text. The least
    has the least doc_id (nulls last), then the least digest; of rows equal in
    both one stays. Texts without words, null ones too, are components of their
    own and stay. Very long texts are hashed in blocks, whole. Columns keep any
    names; an empty table gives no rows.
    """
    rows, final = _rooted(docs)
    rows = rows.where("n > 0")
    least = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least"))
    winners = final.join(least.hint("merge"), "key").groupBy("root").agg(F.min("least").alias("w"))
    by_key = materialize(final.join(winners.hint("merge"), "root").select("key", F.col("w.doc_id").alias("_doc"), F.col("w.digest").alias("_won")))
    judged = rows.join(by_key.hint("merge"), "key").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), (F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_won"))).alias("won"))
    found = materialize(judged.groupBy("_id", "_digest", "won").agg(F.count("*").alias("n")))
    aside = set_aside(docs, "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.unhex(F.md5("text")) == F.col("_digest"))
    rest = aside.join(sized_hint(materialize(found.where("NOT won").select("_id", "_digest"))), same, "left_anti")
    repeated = materialize(found.where("won AND n > 1").select("_id", "_digest"))
    if not repeated.isEmpty():
        one = rest.join(sized_hint(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"])
        rest = rest.join(sized_hint(repeated), same, "left_anti").unionByName(one)
    return rest.select(*put_back(rest, docs.columns))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return similar_components(documents(spark, sf_dir))


QUERIES = {"op5_ngram_jaccard_join": op5_ngram_jaccard_join}
ORACLE_SQL: dict[str, str] = {}
