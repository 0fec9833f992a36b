"""Collocations, repeated passages and vector codes against brute force, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmroll.llm import collocations, passage_dedup, vector_codes

TEXTS = "doc_id long, text string, lang string"


def brute_collocations(rows, least, top):
    """rows: (lang, text)."""
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        cands = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
        kept = []
        for g, a in cands.items():
            if any(len(h) > len(g) and 100 * b >= 80 * a and inside(g, h) for h, b in cands.items()):
                continue
            score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, lo, r, n[lang], -s) for i, (s, a, p, lo, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "pairs"), [(1, 2_000_000), (2, 0)])
def test_collocations_equal_brute_force(spark, monkeypatch, seed, pairs):
    """Also with more frequent pairs than are sent to the executors."""
    monkeypatch.setattr(collocations, "PAIR_ROWS", pairs)
    rng = random.Random(seed)
    vocabulary = ["a", "A", "bb", "é", "中", "c\x00d", "e\x1cf", "gg-h", "İx"]
    rows = []
    for i in range(120):
        parts = [rng.choice(vocabulary) + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]) for _ in range(rng.randint(0, 40))]
        rows.append((i, rng.choice([None, "", "".join(parts)] + ["".join(parts)] * 8), rng.choice(["en", "en", "de", None, "und"])))
    frame = spark.createDataFrame(rows, TEXTS).withColumns({c: F.lit(1) for c in ("g", "a", "shard", "word", "rank", "n", "ids")})
    for least, top in ((3, 2000), (8, 7)):
        got = sorted(tuple(r) for r in collocations.mine(frame.repartition(3), least, top).collect())
        assert got == brute_collocations([(r[2], r[1]) for r in rows], least, top) and got


def test_collocations_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], TEXTS)).collect() == []
    assert collocations.mine(spark.createDataFrame([(1, None, None), (2, "", "en"), (3, ".,;", "en")], TEXTS), 1).collect() == []


def test_what_shards_hand_on_grows_no_faster_than_the_words(spark, monkeypatch):
    """Also where most phrases become frequent in the larger table."""
    made, plain = spark.sparkContext.accumulator(0), type(spark.range(1)).mapInArrow

    def counting(frame, func, schema, *more, **named):
        def run(batches):
            for batch in func(batches):
                packed = "first" in batch.schema.names
                made.add(sum(int.from_bytes(x.as_py()[:8], "little") for x in batch.column("first")) if packed else batch.num_rows)
                yield batch

        return plain(frame, run, schema, *more, **named)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", counting)
    rng, totals = random.Random(6), []
    for n in (6_000, 30_000):
        texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(n // 20)), "en") for i in range(20)]
        before = made.value
        assert collocations.mine(spark.createDataFrame(texts, TEXTS).coalesce(1), 30).count()
        totals.append(made.value - before)
    assert totals[0] <= 6_000 and totals[1] <= 5 * totals[0]


def test_a_frequent_pair_is_spread_over_parts():
    """By the word behind it, and by the word before it where that one is frequent as well."""
    rng = np.random.default_rng(7)
    n, parts = 100_000, 50
    one, two = np.full(n, 1), np.full(n, 2)
    for behind in (rng.integers(10, 5_000, n), np.full(n, 3), np.zeros(n, np.int64)):
        entries = [rng.integers(10, 5_000, n), one, two, behind]
        weights = [np.where(e < 10, n, 0) for e in entries]
        part, size = collocations._dealt(entries, weights, n // parts, parts)
        assert np.bincount(part).max() < 3 * n / parts
        whole = collections.defaultdict(set)
        for phrase, k, where in zip(zip(*entries[1:], strict=True), size.tolist(), part.tolist(), strict=True):
            whole[phrase].add((k, where))
        assert all(len(x) == 1 for x in whole.values() if {k for k, _ in x} == {3})


def test_blocks_of_long_texts_keep_words_and_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 16)
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice("ab  \t.,") * rng.choice([1, 1, 30]) for _ in range(rng.randint(0, 60))).encode()
        tokens = [t for b in collocations._blocks(text) for t in collocations._TOKEN.findall(b)]
        assert b"".join(collocations._blocks(text)) == text
        assert [t for t in tokens if t[0] not in b".,"] == re.findall(rb"[^ \t.,]+", text)


def test_index_extends_to_both_sides():
    rng = np.random.default_rng(5)
    seq = np.append(rng.integers(0, 4, 300), 0)
    seq = seq[(seq > 0) | np.concatenate([[False], seq[:-1] > 0])]
    index = collocations.Index(collocations.transform(seq), collocations.transform(np.append(seq[:-1][::-1], 0)), 3)
    text = seq.tolist()
    count = lambda g: sum(text[i : i + len(g)] == list(g) for i in range(len(text)))
    phrases, ends = [(w,) for w in (1, 2, 3)], index.words()
    for left in (False, True, False):
        of, word, *ends = index.extend(left, *ends)
        phrases = [(w, *phrases[o]) if left else (*phrases[o], w) for o, w in zip(of.tolist(), word.tolist(), strict=True)]
        assert dict(zip(phrases, ends[2].tolist(), strict=True)) == {g: count(g) for g in {tuple(text[i : i + len(phrases[0])]) for i in range(len(text) - len(phrases[0]) + 1)} if 0 not in g}


def brute_passages(rows):
    """rows: (doc_id, text) in the order of the operator."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - 99):
            window = data[s : s + 100]
            if window in seen:
                gone[s : s + 100] = True
            seen.add(window)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passage_rows(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(400)) for letters in ("ab", "abcdefghij é", "中文字")]
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 700), (5, "é" * 120)]
    for i in range(6, 40):
        text = ""
        for _ in range(rng.randint(1, 6)):
            b, at = rng.choice(base), rng.randint(0, 300)
            text += b[at : at + rng.randint(20, 260)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 4)))
        rows.append((i, text))
    return rows + [(40, rows[7][1]), (41, rows[30][1]), (42, rows[7][1][5:])]


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 20_000), (3, 2)])
def test_passages_equal_brute_force(spark, monkeypatch, seed, hot):
    """Also with anchors that are dealt into parts, whose left-over windows meet by hash."""
    monkeypatch.setattr(passage_dedup, "HOT", hot)
    rows = passage_rows(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("none", "text_id", "anchor", "place", "gone", "id", "kept", "start")})
    found = passage_dedup.remove_passages(frame.repartition(3)).withColumn("kept", F.sha2("kept", 256))
    assert sorted(tuple(r) for r in found.collect()) == brute_passages(rows)


def test_passages_of_repeated_rows(spark):
    """Of equal rows one stays; null doc_ids come last; rows of one doc_id with other texts are two documents."""
    rng = random.Random(1)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(2))
    rows = [(1, a), (1, a), (1, a), (2, b), (None, b), (None, b), (None, "short"), (None, "short"), (3, a[:150]), (1, b[:120]), (None, None)]
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed) for r in passage_dedup.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[(1, 300, 0)] == 1 and got[(1, 300, 300)] == 2 and got[(None, 300, 300)] == 2 and got[(None, 5, 0)] == 2 and got[(3, 150, 150)] == 1
    # the row (1, b[:120]) stands before (2, b), which loses what they share
    assert got[(1, 120, 0)] == 1 and got[(2, 300, 120)] == 1 and got[(None, 0, 0)] == 1
    assert passage_dedup.remove_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("block", [1, 7, 150])
def test_segments_do_not_depend_on_blocks(monkeypatch, block):
    """However a text is cut into blocks, every window is in one segment, with the same anchor."""
    text = (passage_rows(9)[20][1] or "").encode() * 2
    whole = windows(text)
    monkeypatch.setattr(passage_dedup, "BLOCK", block)
    assert windows(text) == whole and set(whole) == set(range(len(text) - 99))


def windows(text):
    found = {}
    for data, ends, _, shift in passage_dedup._blocks([text]):
        hashes, _, anchor, first, last = passage_dedup.find_segments(data, ends)
        for h, a, s, e in zip(hashes.tolist(), anchor.tolist(), first.tolist(), last.tolist(), strict=True):
            for w in range(s, e + 1):
                assert w + shift[s] not in found
                found[int(w + shift[s])] = (h, int(a + shift[s]))
    return found


def brute_codes(rows):
    """rows: (vec_id, vector, label), kept ones only, all of one length that 16 divides."""
    whole = [[math.floor(int(x) * 256 if abs(x) >= 2**52 else x * 256) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // 16
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:64]
    books = [[part(whole[i], p) for i in first] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(2):
        for p in range(16):
            of = collections.defaultdict(list)
            for v in whole:
                of[near(part(v, p), books[p])[1]].append(part(v, p))
            for e, own in of.items():
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    ends = [[near(part(v, p), books[p]) for p in range(16)] for v in whole]
    errors = [sum(d for d, _ in e) for e in ends]
    sums = collections.Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        sums[label] += e
    return [(i, "".join(f"{c:02x}" for _, c in e), err, sums[label], digest) for (i, _, label), e, err in zip(rows, ends, errors, strict=True)]


@pytest.mark.parametrize(("n", "width", "scale"), [(5, 1, 1.0), (300, 2, 0.2), (90, 3, 300_000.0)])
def test_vector_codes_equal_brute_force(spark, n, width, scale):
    rng = random.Random(n)
    rows = [(i, [round(rng.gauss(0, scale), 3) for _ in range(16 * width)], rng.choice([None, 1, 2])) for i in range(n)]
    rows += [(n, rows[0][1], 7), (n, rows[0][1], 7), (n + 1, rows[1][1], None)]
    odd = [(-1, None, 1), (-2, [None] + [0.0] * (16 * width - 1), 1), (-3, [float("nan")] * 16 * width, 1), (-4, [float("inf")] * 16 * width, 1), (9_999, [1.0], 1), (9_998, [], 1)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("key", "vector", "code", "p", "e", "n", "same")})
    assert sorted(map(tuple, vector_codes.compress(frame.repartition(3)).collect())) == sorted(brute_codes(rows))


def test_vector_codes_of_odd_tables(spark):
    kind = "vec_id long, embedding array<double>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kind)).collect() == []
    few = vector_codes.compress(spark.createDataFrame([(None, [1.0, 2.0, 3.0], 1), (4, [0.0, 0.0, 0.0], None), (5, [1.0], 1)], kind)).collect()
    assert sorted((r.vec_id or -1, r.code, r.error) for r in few) == [(-1, "010101" + "00" * 13, 0), (4, "00" * 16, 0)]  # filled up with zeros
    huge = vector_codes.compress(spark.createDataFrame([(i, [1e300 * (i % 3)] * 16, 1) for i in range(70)], kind)).collect()
    assert len(huge) == 70 and len({r.code for r in huge}) == 3 and all(r.error == 0 for r in huge)


def test_trie_walk_in_small_subtrees(monkeypatch):
    monkeypatch.setattr(vector_codes, "LEAVES", 3)
    rng = np.random.default_rng(3)
    parts = np.unique(rng.integers(-4, 5, (200, 3)), axis=0)
    entries = rng.integers(-5, 6, (7, 3))
    codes, dists = vector_codes.walk_trie(parts, entries)
    all_dists = ((parts[:, None, :] - entries) ** 2).sum(axis=2)
    assert (codes == all_dists.argmin(axis=1)).all() and (dists == all_dists.min(axis=1)).all()
