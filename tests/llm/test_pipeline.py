"""The corpus pipeline: every stage against plain Python on its own input, and the whole on awkward tables."""

from __future__ import annotations

import collections
import re

import corpus_pipeline
import public_tokenizers
from filmroll.llm import language_id
from filmroll.llm.common import materialize
from tests.conftest import DATA
from tests.llm.test_llm import AWKWARD, SCHEMA, WORD, brute_components, check_sequences


def by_hand_line_dedup(rows):
    """doc_id -> text: lines of five sites or more go out of all but whole copies."""
    lines = lambda t: [x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")]
    sites = collections.defaultdict(set)
    for r in rows:
        for x in lines(r.text):
            sites[x].add(r.source or "")
    spread = {x for x, s in sites.items() if len(s) >= 5}
    whole = collections.Counter(tuple(lines(r.text)) for r in rows if lines(r.text) and set(lines(r.text)) <= spread)
    cut = lambda r: set(lines(r.text)) & spread and whole[tuple(lines(r.text))] < 2
    return {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in spread) if cut(r) else r.text for r in rows}


def by_hand_targets(rows):
    """source -> (words, target): weights 5, 2, 1 in order of source, nothing over twice a source."""
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(re.findall(WORD, r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        left = 1.5 * sum(size.values()) - sum(target.values())
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in over} if over else {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        open_ -= over or set(open_)
    return {s: (size[s], target[s]) for s in order}


def test_stages(spark):
    from tokenizers import Tokenizer

    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf))
        assert docs.columns == before.columns
        seen[name] = (before.collect(), docs.collect())
    first, after = seen["language_id"]
    likely = {r.doc_id for r in language_id.predict(spark.createDataFrame(first, before.schema), spark.createDataFrame(first, before.schema).where(~language_id.held_out(language_id.F.col("doc_id")))).where("lang_pred <> 'und' AND score >= 0.5").collect()}
    assert {r.doc_id for r in after} == likely and len(after) == len(likely)
    first, after = seen["line_dedup"]
    assert {r.doc_id: r.text for r in after} == by_hand_line_dedup(first) and len(after) == len(first)
    assert all(r.n_chars == len(r.text) for r in after)
    first, after = seen["ngram_jaccard_join"]
    found = brute_components({r.doc_id: r.text for r in first})
    assert sorted(r.doc_id for r in after) == sorted(i for i, (_, root) in found.items() if root == i)
    first, after = seen["source_mix"]
    copies, words = collections.Counter(r.doc_id for r in after), {r.doc_id: len(re.findall(WORD, r.text)) for r in first}
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in first}
    for source, (_, target) in by_hand_targets(first).items():
        taken = sum(copies[r.doc_id] * words[r.doc_id] for r in first if r.source == source)
        assert abs(taken - target) <= max(words[r.doc_id] for r in first if r.source == source)
    packed, library = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in after}
    got = collections.Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == {i: n * copies[i] for i, n in lengths.items()}
    n_sequences = check_sequences([(r.sequence_id, r.offset, r.length) for r in packed])
    assert n_sequences <= 1.02 * sum(got.values()) / 4096 + 2


def run_on(spark, tmp_path, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def test_run_on_awkward_rows(spark, tmp_path):
    """Nulls, repeats, long words and clashing columns; whatever is left is packed whole."""
    text = "some plain english words that stand here for a document of their own number"
    rows = [(i, t, "en", None if i % 3 else f"s{i}", None) for i, t in enumerate(AWKWARD)]
    rows += [(100 + i, f"{text} {'x' * i}", "en", "s1", 1) for i in range(1, 4)] + [(None, text.upper(), None, None, None)] * 2
    more = [(*r, "a", 2, "b") for r in rows]
    packed = run_on(spark, tmp_path, more, f"{SCHEMA}, _id string, n_removed int, at string")
    assert packed and {r.doc_id for r in packed} <= {r[0] for r in rows}
    check_sequences([(r.sequence_id, r.offset, r.length) for r in packed])


def test_run_on_an_empty_table(spark, tmp_path):
    assert run_on(spark, tmp_path, []) == []
