"""Operator 1, token counts by a compiled finite-state transducer.

A byte-pair vocabulary in which an adjacent pair merges when the joined piece
exists, best score first, has a useful property: a sequence of pieces is the
encoding of its text exactly if every two neighbours are (Berglund and van der
Merwe, "Formalizing BPE tokenization"). So the last piece of the encoding of a
prefix follows from the last pieces of the few shorter prefixes that a longer
piece can still start from. Those make up a state; a character leads from state
to state and every transition carries the number of tokens it emits (which can
be negative, as a longer piece replaces shorter ones). States are determinised
when first met and kept.

Long texts are cut into chunks, which are dealt out over the cluster. A chunk is
a finite map from states before it to the state after it and the tokens emitted
between. A map is first taken at the state that the few characters in front of
the chunk lead to from the start state; where a space follows another character,
or at a line feed, no piece spans the place, so that this is the true state
nearly always. Rounds of joins with the chunk before then add the states that do
arrive but are not mapped yet, until every map is closed. Maps compose
associatively, so a text's are composed in runs, and the runs' maps again, each
level in parallel.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmroll.llm.common import documents, materialize, partitions

MARK = "▁"  # stands for a space inside pieces
START = ((0, -1, 0),)
#: Transitions and pairs of pieces that a worker remembers (some 300 and 200 bytes each).
MOST_STEPS, MOST_FITS = 800_000, 500_000
#: Bytes of counted parts that it remembers, of one beside its text, and characters of the longest.
MOST_PART_BYTES, PART_BYTES, LONG_PART = 100 << 20, 170, 200


class Transducer:
    """Counts the tokens of a scored-merge vocabulary with byte fallback, character by character."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.pieces = sorted(scores)
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, piece in enumerate(self.pieces):
            node = 0
            for ch in piece:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][ch]
            self.ends[node] = i
        if any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("pieces that span white space are not supported")
        self.kept = 0
        self.counts = _Counts(self)
        self.fits: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {START: 0}
        self.states: list[tuple] = [START]
        self.steps: list[dict[str, tuple[int, int]]] = [{}]
        self.n_steps = 0

    @classmethod
    def of_model(cls, path: str) -> Transducer:
        """From a sentencepiece BPE model with byte fallback and no normalisation."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return cls({model.id_to_piece(i): model.get_score(i) for i in plain})

    def merge(self, text: str) -> list[str]:
        """Encode a short text by merging, to learn which pieces can stand side by side."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fit(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: nothing) in an encoding."""
        key = (left, right)
        if key not in self.fits:
            pair = ([self.pieces[left]] if left >= 0 else []) + [self.pieces[right]]
            self.fits[key] = self.merge("".join(pair)) == pair
        return self.fits[key]

    def number(self, state: tuple) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def step(self, number: int, ch: str) -> tuple[int, int]:
        """Determinise one transition: the next state and the tokens that it emits."""
        alive, found = [], None
        for node, last, count in self.states[number]:
            child = self.children[node].get(ch)
            if child is None:
                continue
            if self.children[child]:
                alive.append((child, last, count))
            if found is None and self.ends[child] >= 0 and self.fit(last, self.ends[child]):
                found = (self.ends[child], count + 1)
        if found is None:  # not in the vocabulary: a token for each byte, and nothing merges across
            out = (0, len(ch.encode("utf-8", "surrogatepass")))
        else:
            piece, gained = found
            out = (self.number(((0, piece, 0), *((n, t, c - gained) for n, t, c in alive))), gained)
        self.steps[number][ch] = out
        self.n_steps += 1
        return out

    def run(self, number: int, text: str) -> tuple[int, int]:
        total = 0
        for at in range(0, len(text), 4096):
            if at:
                self.tidy(number)
                number = self.kept
            for ch in text[at : at + 4096]:
                number, n = self.steps[number].get(ch) or self.step(number, ch)
                total += n
        return number, total

    def advance(self, number: int, text: str) -> tuple[int, int]:
        """The state after ``text`` and the tokens it emits, from a state on."""
        self.tidy(number)
        number = self.kept
        text = text.replace(MARK, " ")
        head = re.match(r" *[^ \n]*", text)[0]
        number, total = self.run(number, head.replace(" ", MARK))
        rest = text[len(head) :]
        if not rest:
            return number, total
        if "  " in rest:
            parts = [x if x[0] == "\n" else x[1:] for x in re.findall(r"\n[^ \n]*| +[^ \n]*", rest)]
        else:
            parts = rest.replace("\n", " \n")[1:].split(" ")
        last = parts.pop()
        total += sum(map(self.counts.__getitem__, parts))
        number, n = self.run(0, _marked(last))
        return number, total + n

    def tidy(self, number: int = 0) -> None:
        """Forget all states but one once there are too many; ``kept`` is the new number of that one."""
        if self.n_steps > MOST_STEPS:
            state = self.states[number]
            self._forget()
            number = self.number(state)
        if len(self.fits) > MOST_FITS:
            self.fits.clear()
        self.kept = number

    def name(self, number: int) -> str:
        """A state as text that every worker reads alike."""
        return json.dumps(self.states[number])

    def named(self, name: str) -> int:
        return self.number(tuple(map(tuple, json.loads(name))))


def _marked(part: str) -> str:
    return part if part[:1] == "\n" else MARK + part.replace(" ", MARK)


class _Counts(dict):
    """Tokens from start state to start state, by part; bounded by bytes, long parts are not kept."""

    def __init__(self, owner: Transducer):
        self.owner, self.n_bytes = owner, 0

    def __missing__(self, part: str) -> int:
        n = self.owner.run(0, _marked(part))[1]
        if len(part) < LONG_PART:
            self.n_bytes += PART_BYTES + len(part)
            if self.n_bytes > MOST_PART_BYTES:
                self.clear()
                self.n_bytes = PART_BYTES + len(part)
            self[part] = n
        return n


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One transducer per Python worker and model."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer.of_model(path)
    return _COMPILED[path]


def chunk_map(machine: Transducer, before: str, text: str, sources: list[str]) -> dict[str, tuple[str, int]]:
    """The map of a chunk at the states ``sources`` (names); without any, at the state that the text ``before`` it suggests.

    The first chunk of a text, the only one with nothing before it, begins at the start state and behind a space.
    """
    if not before:
        text = " " + text
    found = {}
    for source in sources or [machine.name(machine.advance(0, before)[0] if before else 0)]:
        number, n = machine.advance(machine.named(source), text)
        found[source] = (machine.name(number), n)
    return found


def compose(a: dict[str, tuple[str, int]], b: dict[str, tuple[str, int]]) -> dict[str, tuple[str, int]]:
    """The map of two neighbouring stretches; associative."""
    return {s: (b[t][0], n + b[t][1]) for s, (t, n) in a.items() if t in b}


def scan(maps: list[dict[str, tuple[str, int]]]) -> dict[str, tuple[str, int]]:
    """Compose neighbours, then neighbours of those, until one map is left."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


ENTRIES = "array<struct<source:string,target:string,n:bigint>>"
_ENTRY = pa.struct([("source", pa.string()), ("target", pa.string()), ("n", pa.int64())])


def _entries(maps: list[dict[str, tuple[str, int]]]) -> pa.Array:
    return pa.array([[{"source": s, "target": t, "n": n} for s, (t, n) in m.items()] for m in maps], pa.list_(_ENTRY))


def _read_map(entries: list[dict]) -> dict[str, tuple[str, int]]:
    return {e["source"]: (e["target"], e["n"]) for e in entries}


def _chunks(long: DataFrame, chunk_chars: int, context: int) -> DataFrame:
    """row_id, doc_id, chunk, before and text of every chunk of long texts, dealt out and stored."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                text, ids = batch.column("text")[i].as_py(), batch.select(["row_id", "doc_id"]).slice(i, 1)
                starts = range(0, len(text), chunk_chars)
                for first in range(0, len(starts), 64):
                    some = starts[first : first + 64]
                    same = pa.array([0] * len(some))
                    columns = [pa.array(range(first, first + len(some)), pa.int64()), pa.array([text[max(0, a - context) : a] for a in some]), pa.array([text[a : a + chunk_chars] for a in some])]
                    yield pa.RecordBatch.from_arrays([*(c.take(same) for c in ids.columns), *columns], names=["row_id", "doc_id", "chunk", "before", "text"])

    kind = long.schema["doc_id"].dataType.simpleString()
    cut_up = long.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text").mapInArrow(cut, f"row_id long, doc_id {kind}, chunk long, before string, text string")
    return materialize(cut_up.repartition(partitions(long.sparkSession), "row_id", "chunk"))


def _map_chunks(chunks: DataFrame, model_path: str) -> DataFrame:
    """row_id, chunk and entries of the maps of ``chunks`` at their ``sources``."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_path)
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("before", "text", "sources")), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("chunk"), _entries([chunk_map(machine, *r) for r in rows])], names=["row_id", "chunk", "entries"])

    return chunks.select("row_id", "chunk", "before", "text", "sources").mapInArrow(mapped, f"row_id long, chunk long, entries {ENTRIES}")


def _closed_maps(chunks: DataFrame, model_path: str, few: int = 8) -> DataFrame:
    """Maps of all chunks that hold every state which the chunk before leads to.

    Each round maps the states that arrive unmapped. Where a text has few of
    them they are mapped at all its chunks at once, since a text that never
    settles is mostly a periodic one, where the same states come again.
    """
    none = F.array().cast("array<string>")
    maps = materialize(_map_chunks(chunks.withColumn("sources", none), model_path))
    while True:
        arriving = maps.select("row_id", (F.col("chunk") + 1).alias("chunk"), F.explode("entries.target").alias("source")).distinct()
        mapped = maps.select("row_id", "chunk", F.explode("entries.source").alias("source")).distinct()
        inner = arriving.join(maps.select("row_id", "chunk").distinct().hint("merge"), ["row_id", "chunk"], "left_semi")
        missing = materialize(inner.join(mapped.hint("merge"), ["row_id", "chunk", "source"], "left_anti"))
        if missing.isEmpty():
            merged = maps.groupBy("row_id", "chunk").agg(F.flatten(F.collect_list("entries")).alias("entries"))
            return materialize(merged)
        in_text = missing.groupBy("row_id").agg(F.slice(F.collect_set("source"), 1, few + 1).alias("s")).where(F.size("s") <= few).select("row_id", F.explode("s").alias("source"))
        everywhere = maps.select("row_id", "chunk").where("chunk > 0").distinct().join(in_text.hint("merge"), "row_id").join(mapped.hint("merge"), ["row_id", "chunk", "source"], "left_anti")
        wanted = missing.select("row_id", "chunk", "source").union(everywhere.select("row_id", "chunk", "source")).groupBy("row_id", "chunk").agg(F.collect_set("source").alias("sources"))
        more = _map_chunks(chunks.join(materialize(wanted).hint("merge"), ["row_id", "chunk"]), model_path)
        maps = materialize(maps.unionByName(more))


def _compose_all(maps: DataFrame, run: int = 64) -> DataFrame:
    """row_id and n_tokens by composing runs of maps, then runs of those."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan([_read_map(m["entries"]) for m in run]) for run in batch.column("maps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("chunk"), _entries(found)], names=["row_id", "chunk", "entries"])

    while (maps.agg(F.max("chunk")).first()[0] or 0) > 0:
        runs = maps.groupBy("row_id", F.floor(F.col("chunk") / run).alias("run")).agg(F.sort_array(F.collect_list(F.struct("chunk", "entries"))).alias("maps"))
        maps = materialize(runs.select("row_id", F.col("run").alias("chunk"), "maps").mapInArrow(joined, f"row_id long, chunk long, entries {ENTRIES}"))
    start = F.filter("entries", lambda e: e["source"] == json.dumps(START))
    return maps.select("row_id", start[0]["n"].alias("n_tokens"))


def count_tokens(docs: DataFrame, model_path: str, chunk_chars: int = 32_768, context: int = 256) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row of ``docs`` (doc_id, text).

    Null and empty texts have 0 tokens. Texts of over ``chunk_chars`` characters
    are counted chunk by chunk, in as many tasks as there are; the last few
    (``context``) characters before a chunk only suggest a state, so they do not
    change results. Repeated rows each get a row; other columns are ignored; an
    empty table gives none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > chunk_chars

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model_path)
        for batch in batches:
            counts = [machine.advance(0, " " + t)[1] if t else 0 for t in batch.column("text").to_pylist()]
            sizes = pc.binary_length(batch.column("text").cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    short = texts.where(~is_long).mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    chunks = _chunks(texts.where(is_long), chunk_chars, context)
    sizes = chunks.groupBy("row_id").agg(F.first("doc_id").alias("doc_id"), F.sum(F.octet_length("text")).alias("n_bytes"))
    long = sizes.join(_compose_all(_closed_maps(chunks, model_path)).hint("merge"), "row_id").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds 4096 tokens."""
    counted = count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLE_SQL: dict[str, str] = {}
