"""Batch scoring with pluggable taggers, embedders and detectors; a model is loaded once per Python worker."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType


class Tagger(Protocol):
    """X1. Gives (tag, score) lists for a batch of contents."""

    def tag(self, contents: list) -> list[list[tuple[str, float]]]: ...


class Embedder(Protocol):
    """X2. Gives a unit vector for each content."""

    def embed(self, contents: list) -> list[list[float]]: ...


class Detector(Protocol):
    """X3. Gives boxes with scores and vectors for each content."""

    def detect(self, contents: list) -> list[list[dict]]: ...


_MODELS: dict[object, object] = {}


def _model(factory: Callable[[], object]) -> object:
    if factory not in _MODELS:
        _MODELS[factory] = factory()
    return _MODELS[factory]


#: Contents that a task scores, tasks at most, and rows of a batch that comes out.
TASK_ROWS, MOST_TASKS, OUT_ROWS = 4_000, 4_000, 2_000


def _dealt(df: DataFrame) -> DataFrame:
    """item_id and content, dealt evenly over tasks by their number: a small file of short contents, one task to Spark, is much work to score."""
    contents = df.select("item_id", "content")
    n_tasks = 1 if df.isStreaming else min(MOST_TASKS, math.ceil(df.select("item_id").count() / TASK_ROWS))
    return contents.repartition(n_tasks) if n_tasks > 1 else contents


def _scored(df: DataFrame, factory: Callable[[], object], method: str, batch: int, rows_of: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows that ``rows_of`` makes of the item, the result and the error of every content; the model is handed ``batch`` contents at once."""
    types = to_arrow_schema(DataType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, rows = getattr(_model(factory), method), []

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)

        for part in batches:
            items, contents = part.column("item_id").to_pylist(), part.column("content").to_pylist()
            for at in range(0, len(items), batch):
                for item, (found, error) in zip(items[at : at + batch], _guarded(score, contents[at : at + batch]), strict=True):
                    rows += rows_of(item, found, error)
                if len(rows) >= OUT_ROWS:
                    yield out()
                    rows = []
        yield out()

    return _dealt(df).mapInArrow(run, schema)


def _guarded(run: Callable[[list], list], contents: list) -> list[tuple[object, str | None]]:
    """Results of a batch; if it fails, of each content alone, so that one bad file costs only itself."""
    try:
        return [(r, None) for r in run(contents)]
    except Exception:
        out = []
        for c in contents:
            try:
                out.append((run([c])[0], None))
            except Exception as e:
                out.append((None, f"{type(e).__name__}: {e}"[:200]))
        return out


def score_tags(df: DataFrame, factory: Callable[[], Tagger], model_name: str, threshold: float = 0.0, batch: int = 64) -> DataFrame:
    """X1, X4. item_id, tag, score, model_name and error of every content (item_id, content), by score from ``threshold``."""

    def rows(item: int, tags: list | None, error: str | None) -> list[tuple]:
        if error:
            return [(item, None, None, model_name, error)]
        return [(item, t, float(s), model_name, None) for t, s in sorted(tags or [], key=lambda x: (-x[1], x[0])) if s >= threshold]

    return _scored(df, factory, "tag", batch, rows, "item_id long, tag string, score double, model_name string, error string")


def embed(df: DataFrame, factory: Callable[[], Embedder], model_name: str, batch: int = 64) -> DataFrame:
    """X2. item_id, model_name, vector and error of every content."""

    def rows(item: int, vector: list | None, error: str | None) -> list[tuple]:
        return [(item, model_name, None if vector is None else [float(x) for x in vector], error)]

    return _scored(df, factory, "embed", batch, rows, "item_id long, model_name string, vector array<float>, error string")


def detect(df: DataFrame, factory: Callable[[], Detector], model_name: str, batch: int = 16) -> DataFrame:
    """X3. A row per region found in every content."""

    def rows(item: int, found: list | None, error: str | None) -> list[tuple]:
        if error:
            return [(item, None, None, None, None, None, None, model_name, error)]
        return [(item, *map(int, r["box"]), float(r["score"]), [float(x) for x in r["vector"]], model_name, None) for r in found or []]

    return _scored(df, factory, "detect", batch, rows, "item_id long, x int, y int, w int, h int, det_score double, vector array<float>, model_name string, error string")


REGION = "x int, y int, w int, h int, det_score double, vector array<float>, error string"


def detector_table(factory: Callable[[], Detector]) -> object:
    """X3. The detector as a table function of one content, for lateral joins: rows come out as regions are found.

    A content that cannot be read gives one row with the error; the others of its batch are not touched.
    """

    class Detect:
        def eval(self, content):  # noqa: ANN001, ANN202
            try:
                for r in _model(factory).detect([content])[0]:
                    yield (*map(int, r["box"]), float(r["score"]), [float(v) for v in r["vector"]], None)
            except Exception as e:
                yield (None,) * 6 + (f"{type(e).__name__}: {e}"[:200],)

    return F.udtf(Detect, returnType=REGION)


def detect_lateral(df: DataFrame, factory: Callable[[], Detector]) -> DataFrame:
    """X3. item_id and the regions found in every content (item_id, content), by a lateral join with the detector."""
    return _dealt(df).lateralJoin(detector_table(factory)(F.col("content").outer())).drop("content")


def unscored(items: DataFrame, existing: DataFrame, model_name: str, force: bool = False) -> DataFrame:
    """X5. Items that a model has not scored yet."""
    return items if force else items.join(existing.where(F.col("model_name") == model_name).select("item_id").distinct(), "item_id", "left_anti")


#: The vocabulary of the fake tagger.
FAKE_TAGS = ("cat", "dog", "tree", "beach", "car", "smile", "night")


def fake_tags(content: Column, n: int = 3) -> Column:
    """X6. A deterministic array of (tag, score) per content, for tests; runs inside the JVM."""
    at = lambda i: F.conv(F.substring(F.sha2(content, 256), 1 + 4 * i, 4), 16, 10).cast("int")
    vocabulary = F.array(*map(F.lit, FAKE_TAGS))
    return F.array(*[F.struct(F.element_at(vocabulary, F.pmod(at(0) + i * (1 + at(1) % 3), F.lit(len(FAKE_TAGS))) + 1).alias("tag"), (0.5 + at(2 + i) % 500 / 1000).alias("score")) for i in range(n)])


class FakeEmbedder:
    """X6. Deterministic unit vectors from a hash of the content."""

    def __init__(self, dim: int = 8):
        self.dim = dim

    def embed(self, contents: list) -> list[list[float]]:
        out = []
        for c in contents:
            raw = [b - 127.5 for b in hashlib.sha256(c if isinstance(c, bytes) else str(c).encode()).digest()[: self.dim]]
            length = sum(x * x for x in raw) ** 0.5
            out.append([x / length for x in raw])
        return out


class FakeTagger:
    """X6. Deterministic tags; contents that start with "bad" fail, as broken files do."""

    def tag(self, contents: list) -> list[list[tuple[str, float]]]:
        if any(str(c).startswith("bad") for c in contents):
            raise ValueError("unreadable")
        return [[(FAKE_TAGS[b % 7], 0.5 + b / 512) for b in hashlib.sha256(str(c).encode()).digest()[:3]] for c in contents]


class FakeDetector:
    """X6. None to three deterministic regions per content; contents that start with "bad" fail."""

    def detect(self, contents: list) -> list[list[dict]]:
        if any(str(c).startswith("bad") for c in contents):
            raise ValueError("unreadable")
        out = []
        for c in contents:
            raw = hashlib.sha256(str(c).encode()).digest()
            out.append([{"box": (raw[i], raw[i + 1], 20 + i, 30 + i), "score": raw[i + 2] / 256, "vector": [raw[i] / 256, raw[i + 1] / 256]} for i in range(1, 1 + raw[0] % 4)])
        return out
