"""The retrieval pipeline as one object over DataFrames: configuration, registry of components, events and hooks, ingest and query."""

from __future__ import annotations

import contextlib
import functools
import importlib
import importlib.metadata
import importlib.util
import json
import logging
import threading
import time
import uuid
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, chunking, dense, embedding, generation, ranking, store

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class PipelineConfig:
    """method of chunk: fixed, recursive, sentence, semantic. method of retrieve: vector, bm25, hybrid (alpha weighs the dense list)."""

    chunk_method: str = "recursive"
    chunk_size: int = 512
    chunk_overlap: int = 64
    dimensions: int = 384
    metric: str = "cosine"
    retrieve_method: str = "vector"
    top_k: int = 5
    score_threshold: float = 0.0
    alpha: float = 0.7
    context_chars: int = 8000
    template: str = "Answer the question from the context.\n\nContext:\n{context}\n\nQuestion: {question}"
    namespace: str = ""

    def problems(self) -> list[str]:
        out = []
        if self.chunk_method not in CHUNKERS:
            out.append(f"no such chunker: {self.chunk_method}")
        if self.retrieve_method not in ("vector", "bm25", "hybrid"):
            out.append(f"no such retriever: {self.retrieve_method}")
        if self.chunk_size <= 0 or not 0 <= self.chunk_overlap < self.chunk_size:
            out.append("chunk_size must be positive and chunk_overlap smaller")
        if self.top_k <= 0:
            out.append("top_k must be positive")
        if not 0 <= self.alpha <= 1:
            out.append("alpha must be in 0..1")
        return out + [f"the template has no value for {x}" for x in generation.undeclared(self.template, {"context", "question"})]

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))


PRESETS = {"rag": PipelineConfig(), "qa": PipelineConfig(chunk_size=256, chunk_overlap=32, top_k=3), "summarise": PipelineConfig(chunk_size=1024, chunk_overlap=128, top_k=10)}
CHUNKERS: dict[str, Callable[..., DataFrame]] = {
    "fixed": chunking.fixed_chunks,
    "recursive": chunking.recursive_chunks,
    "sentence": chunking.sentence_chunks,
    "semantic": lambda docs, size, overlap: chunking.semantic_chunks(docs, size),
}


def config_from(data: dict[str, Any]) -> PipelineConfig:
    unknown = sorted(set(data) - set(PipelineConfig.__dataclass_fields__))
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return PipelineConfig(**data)


def load_config(path: str | Path) -> PipelineConfig:
    """JSON, or YAML where a parser is installed."""
    raw = Path(path).read_text()
    try:
        if str(path).endswith((".yml", ".yaml")):
            import yaml

            return config_from(yaml.safe_load(raw))
        return config_from(json.loads(raw))
    except (ValueError, TypeError) as e:
        raise ValueError(f"{path} cannot be read: {e}") from e


class Registry:
    """(kind, alias) to a factory."""

    KINDS = ("loader", "chunker", "embedder", "store", "retriever", "llm")

    def __init__(self) -> None:
        self._of: dict[tuple[str, str], Callable] = {}

    def register(self, kind: str, alias: str, factory: Callable, overwrite: bool = False) -> None:
        if kind not in self.KINDS:
            raise ValueError(f"no such kind: {kind}")
        if (kind, alias) in self._of and not overwrite:
            raise ValueError(f"{kind} {alias} is registered")
        self._of[kind, alias] = factory

    def build(self, kind: str, alias: str, **kw: Any) -> Any:
        if (kind, alias) not in self._of:
            raise KeyError(f"no {kind} named {alias}")
        return self._of[kind, alias](**kw)

    def all(self) -> dict[str, list[str]]:
        return {k: sorted(a for kind, a in self._of if kind == k) for k in self.KINDS}

    def discover(self, group: str = "lodestream.plugins") -> int:
        """Entry points of installed packages: each is called with the registry."""
        points = list(importlib.metadata.entry_points(group=group))
        for p in points:
            p.load()(self)
        return len(points)


class Events:
    """Synchronous callbacks by event name; a failing callback is logged, or raised where asked for."""

    def __init__(self, strict: bool = False) -> None:
        self.strict = strict
        self._subscribers: list[tuple[Callable, frozenset[str]]] = []

    def subscribe(self, handler: Callable[[str, dict], None], *names: str) -> None:
        self._subscribers.append((handler, frozenset(names)))

    def unsubscribe(self, handler: Callable) -> int:
        before = len(self._subscribers)
        self._subscribers = [x for x in self._subscribers if x[0] is not handler]
        return before - len(self._subscribers)

    def emit(self, name: str, **data: Any) -> None:
        for handler, names in list(self._subscribers):
            if not names or name in names:
                try:
                    handler(name, data)
                except Exception:
                    if self.strict:
                        raise
                    log.exception("a handler of %s failed", name)


class Tracer:
    """Spans of driver-side work in a ring of the last `keep`; a child's trace is its parent's."""

    def __init__(self, keep: int = 10_000) -> None:
        self.spans: deque[dict] = deque(maxlen=keep)

    @contextlib.contextmanager
    def span(self, name: str, parent: dict | None = None, **attributes: Any) -> Iterator[dict]:
        s = {"id": uuid.uuid4().hex, "trace": parent["trace"] if parent else uuid.uuid4().hex, "parent": parent and parent["id"], "name": name, "attributes": attributes, "status": "ok", "start": time.time(), "end": None}
        try:
            yield s
        except Exception as e:
            s["status"], s["error"] = "error", repr(e)
            raise
        finally:
            s["end"] = time.time()
            s["duration_ms"] = (s["end"] - s["start"]) * 1000
            self.spans.append(s)


class TokenBucket:
    """At most `rate` a second with bursts of `burst`: take() waits, or returns False where waiting is not wanted."""

    def __init__(self, rate: float, burst: int = 1, wait: bool = True) -> None:
        self.rate, self.burst, self.wait = rate, burst, wait
        self._left, self._at, self._lock = float(burst), time.monotonic(), threading.Lock()

    def take(self) -> bool:
        with self._lock:
            now = time.monotonic()
            self._left, self._at = min(self.burst, self._left + (now - self._at) * self.rate), now
            short = 1 - self._left
            if short > 0 and not self.wait:
                return False
            self._left -= 1
        if short > 0:
            time.sleep(short / self.rate)
        return True


class Hooks:
    """Plugins: objects with any of the methods before_ingest, after_ingest, before_query, after_query, on_error. Errors are logged."""

    def __init__(self) -> None:
        self.plugins: dict[str, Any] = {}
        self.tags: dict[str, set[str]] = defaultdict(set)

    def register(self, name: str, plugin: Any, *tags: str) -> None:
        if name in self.plugins:
            raise ValueError(f"plugin {name} is registered")
        self.plugins[name] = plugin
        for t in tags:
            self.tags[t].add(name)

    def load(self, module: str) -> list[str]:
        """Registers what the module's `plugins()` returns: a dict by name."""
        found = importlib.import_module(module).plugins()
        for name, p in found.items():
            self.register(name, p)
        return sorted(found)

    def load_directory(self, path: str | Path) -> list[str]:
        """Registers what `plugins()` of every module file in a folder returns."""
        out = []
        for file in sorted(Path(path).glob("[!_]*.py")):
            spec = importlib.util.spec_from_file_location(f"lodestream_plugin_{file.stem}", file)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            for name, p in module.plugins().items():
                self.register(name, p)
                out.append(name)
        return sorted(out)

    def describe(self) -> list[dict[str, Any]]:
        """Name, class, hooks and tags of every plugin."""
        hooks = ("before_ingest", "after_ingest", "before_query", "after_query", "on_error")
        return [{"name": n, "kind": type(p).__name__, "hooks": [h for h in hooks if hasattr(p, h)], "tags": sorted(t for t, names in self.tags.items() if n in names)} for n, p in sorted(self.plugins.items())]

    def by_tag(self, tag: str) -> list[str]:
        return sorted(self.tags.get(tag, ()))

    def call(self, hook: str, **context: Any) -> None:
        for name, p in self.plugins.items():
            f = getattr(p, hook, None)
            if f is not None:
                try:
                    f(**context)
                except Exception:
                    log.exception("plugin %s failed in %s", name, hook)


class CountingPlugin:
    """Counts the calls of every hook."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = defaultdict(int)

    def __getattr__(self, hook: str) -> Callable:
        if not hook.startswith(("before_", "after_", "on_")):
            raise AttributeError(hook)
        return lambda **context: self.counts.__setitem__(hook, self.counts[hook] + 1)


class LoggingPlugin:
    """Logs errors of the pipeline."""

    def on_error(self, error: Exception, stage: str, **context: Any) -> None:
        log.error("%s failed: %s", stage, error)


class Metrics:
    """Counters and timings of driver-side work; snapshot() is what they are now."""

    def __init__(self) -> None:
        self._lock, self._counts, self._times = threading.Lock(), defaultdict(float), defaultdict(list)

    def count(self, name: str, by: float = 1) -> None:
        with self._lock:
            self._counts[name] += by

    def instrument(self, name: str) -> Callable:
        """Decorator: calls, failures and milliseconds of a function that runs an action."""

        def wrap(f: Callable) -> Callable:
            @functools.wraps(f)
            def run(*a: Any, **kw: Any) -> Any:
                start = time.perf_counter()
                try:
                    return f(*a, **kw)
                except Exception:
                    self.count(f"{name}.failed")
                    raise
                finally:
                    self.count(f"{name}.calls")
                    with self._lock:
                        self._times[name].append((time.perf_counter() - start) * 1000)

            return run

        return wrap

    def snapshot(self) -> dict[str, Any]:
        with self._lock:
            return {"counts": dict(self._counts), "mean_ms": {k: sum(v) / len(v) for k, v in self._times.items()}}


@dataclass
class Pipeline:
    """documents (doc_id, text) in, answers out. The index is a table of chunks with vectors; `index` may be replaced by a stored one."""

    config: PipelineConfig = field(default_factory=PipelineConfig)
    chunker: Callable[..., DataFrame] | None = None
    embedder: Callable[[DataFrame], DataFrame] | None = None
    answer: Callable[[DataFrame], DataFrame] | None = None
    events: Events = field(default_factory=Events)
    hooks: Hooks = field(default_factory=Hooks)
    tracer: Tracer = field(default_factory=Tracer)
    index: DataFrame | None = None

    def __post_init__(self) -> None:
        if problems := self.config.problems():
            raise ValueError("; ".join(problems))

    def embedded(self, df: DataFrame, column: str = "content") -> DataFrame:
        return self.embedder(df) if self.embedder else embedding.embed(df, self.config.dimensions, content=column)

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Chunks with vectors, added to the index (replacing chunks of the same id). Nothing runs until the index is written or asked."""
        c = self.config
        self.hooks.call("before_ingest", docs=docs)
        with self.tracer.span("ingest"):
            chunks = (self.chunker or CHUNKERS[c.chunk_method])(docs, c.chunk_size, c.chunk_overlap)
            new = store.with_namespace(self.embedded(chunks), c.namespace)
            self.index = new if self.index is None else store.upsert(self.index, new)
        self.hooks.call("after_ingest", index=self.index)
        self.events.emit("ingested")
        return new

    def delete_document(self, doc_id: Any) -> None:
        self.index = self.index.where(F.col("document_id") != doc_id)

    def retrieve(self, queries: DataFrame, k: int | None = None, filters: tuple[dense.MetadataFilter, ...] = ()) -> DataFrame:
        """queries (query_id, query) to (query_id, chunk_id, score, rank, document_id, content)."""
        if self.index is None:
            raise ValueError("nothing is ingested")
        c, k = self.config, k or self.config.top_k
        index = dense.filtered(self.index.where(F.col("namespace") == c.namespace), filters)
        sparse = lambda n: bm25.bm25_top_k(index, queries, n)
        by_vector = lambda n: dense.dense_top_k(index, self.embedded(queries.withColumn("content", F.col("query"))).withColumnRenamed("embedding", "vector"), n, metric=c.metric)
        if c.retrieve_method == "bm25":
            got = sparse(k)
        elif c.retrieve_method == "vector":
            got = by_vector(k)
        else:
            got = ranking.top_k(ranking.linear_fusion([sparse(3 * k), by_vector(3 * k)], [1 - c.alpha, c.alpha]).drop("lists"), k)
        if c.score_threshold > 0:
            got = got.where(F.col("score") >= c.score_threshold)
        return got.join(index.select("chunk_id", "document_id", "content"), "chunk_id")

    def query(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """queries with context, prompt, answer, usage and sources."""
        c = self.config
        self.hooks.call("before_query", queries=queries)
        with self.tracer.span("query"), self._reporting("query"):
            hits = self.retrieve(queries, k)
            context = generation.context_block(hits, c.context_chars)
            sources = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score"))), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["score"].alias("score"))).alias("sources"))
            q = queries.join(context, "query_id", "left").join(sources, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
            q = q.withColumn("prompt", generation.rendered(c.template, {"context": F.col("context"), "question": F.col("query")}))
            q = self.answer(q) if self.answer else q.withColumn("answer", generation.mock_answer(F.col("prompt")))
            out = q.withColumn("usage", generation.usage(F.col("prompt"), F.col("answer")))
        self.hooks.call("after_query", answers=out)
        self.events.emit("answered")
        return out

    @contextlib.contextmanager
    def _reporting(self, stage: str) -> Iterator[None]:
        try:
            yield
        except Exception as e:
            self.hooks.call("on_error", error=e, stage=stage)
            raise

    def stats(self) -> dict[str, int]:
        r = self.index.agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents")).collect()[0] if self.index is not None else None
        return {"chunks": r["chunks"], "documents": r["documents"]} if r else {"chunks": 0, "documents": 0}


class PipelineBuilder:
    """Stage by stage; build() raises on what is wrong."""

    def __init__(self, config: PipelineConfig | None = None) -> None:
        self._config, self._parts = config or PipelineConfig(), {}

    def _with(self, **kw: Any) -> PipelineBuilder:
        self._config = replace(self._config, **kw)
        return self

    def chunk(self, method: str = "recursive", size: int = 512, overlap: int = 64, chunker: Callable | None = None) -> PipelineBuilder:
        self._parts["chunker"] = chunker
        return self._with(chunk_method=method, chunk_size=size, chunk_overlap=overlap)

    def embed(self, dimensions: int = 384, embedder: Callable | None = None) -> PipelineBuilder:
        self._parts["embedder"] = embedder
        return self._with(dimensions=dimensions)

    def store(self, namespace: str = "") -> PipelineBuilder:
        return self._with(namespace=namespace)

    def retrieve(self, method: str = "vector", top_k: int = 5, score_threshold: float = 0.0, alpha: float = 0.7) -> PipelineBuilder:
        return self._with(retrieve_method=method, top_k=top_k, score_threshold=score_threshold, alpha=alpha)

    def generate(self, template: str | None = None, answer: Callable | None = None) -> PipelineBuilder:
        self._parts["answer"] = answer
        return self._with(template=template) if template else self

    def with_events(self, events: Events) -> PipelineBuilder:
        self._parts["events"] = events
        return self

    def validate(self) -> list[str]:
        return self._config.problems()

    def build(self) -> Pipeline:
        return Pipeline(self._config, **{k: v for k, v in self._parts.items() if v is not None})


def with_retry(f: Callable[[], Any], attempts: int = 3, delay: float = 0.1) -> Any:
    """Calls f until it succeeds, at most so often."""
    for i in range(attempts):
        try:
            return f()
        except Exception:
            if i == attempts - 1:
                raise
            time.sleep(delay * 2**i)


def session(app: str = "lodestream", **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
