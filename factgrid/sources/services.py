"""Providers that ask services over HTTP. Addresses and keys are parameters; nothing is asked twice, since runs cut what a provider returns."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgrid.functions.text import BINARY_SUFFIXES, BLOCKED_DOMAINS
from factgrid.operators.pages import DEADLINE_MS, MAX_HTML
from factgrid.operators.retry import call_with_retries
from factgrid.plans.ship import ship_package

from . import replies
from .options import Options
from .providers import SearchProvider

#: Results of a query, seconds that a search may take, the pause between unkeyed searches, pages fetched at once by a task.
RESULTS, SEARCH_SECONDS, PAUSE_S, IN_FLIGHT = 5, 10, 0.4, 16
BODIES = "run_id string, query_ord long, body string"


def _ask(url: str, body: dict | None = None, headers: dict | None = None, seconds: float = 30) -> tuple[str, str]:
    """(text, content type) of an answer; raises what goes wrong, with the number of an HTTP error in it."""
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"User-Agent": "Mozilla/5.0", "Content-Type": "application/json"} | (headers or {}))
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace"), answer.headers.get("Content-Type", "")
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}: {e.read(500).decode('utf-8', 'replace')}") from e


def _bodies(queries: DataFrame, ask: Callable[[str], str], pause: float = 0.0) -> DataFrame:
    """One reply for each query; any error is an empty one."""
    ship_package(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for query in batch.column("query").to_pylist():
                try:
                    found.append(ask(query))
                except (OSError, RuntimeError, ValueError):
                    found.append("")
                time.sleep(pause)
            yield pa.RecordBatch.from_arrays([batch.column("run_id"), batch.column("query_ord"), pa.array(found, pa.string())], names=["run_id", "query_ord", "body"])

    return queries.select("run_id", F.col("query_ord").cast("long").alias("query_ord"), "query").mapInArrow(run, BODIES)


class KeyedSearch:
    """A search service that takes a key and answers in JSON (`organic`: link, title, snippet)."""

    def __init__(self, url: str, key: str, results: int = RESULTS):
        self.url, self.key, self.results = url, key, results

    def search(self, queries: DataFrame) -> DataFrame:
        url, key, n = self.url, self.key, self.results
        spread = queries.repartition("run_id", "query_ord")  # a query is a wait; each task has its share
        return replies.json_results(_bodies(spread, lambda q: _ask(url, {"q": q, "num": n}, {"X-API-KEY": key}, SEARCH_SECONDS)[0]))


class PacedSearch:
    """A search service without a key that answers in HTML and wants a pause between queries: one task asks them in order."""

    def __init__(self, url: str, pause: float = PAUSE_S):
        self.url, self.pause = url, pause

    def search(self, queries: DataFrame) -> DataFrame:
        from urllib.parse import quote_plus

        url = self.url
        in_order = queries.coalesce(1).sortWithinPartitions("run_id", "query_ord")
        return replies.html_results(_bodies(in_order, lambda q: _ask(url + quote_plus(q), seconds=SEARCH_SECONDS)[0], self.pause))


def choose_search(options: Options, keyed: Callable[[str], SearchProvider], unkeyed: SearchProvider) -> SearchProvider:
    """The keyed search where there is a key, else the other."""
    return keyed(options.search_key) if options.search_key else unkeyed


class HttpFetch:
    """Fetches pages, IN_FLIGHT at once in each task, each within the deadline; blocked and binary addresses are not asked for."""

    def __init__(self, seconds: float = DEADLINE_MS / 1000):
        self.seconds = seconds

    def fetch(self, hits: DataFrame) -> DataFrame:
        ship_package(hits.sparkSession)
        seconds = self.seconds
        types = [("status", pa.int32()), ("content_type", pa.string()), ("html", pa.string()), ("fetch_error", pa.string()), ("elapsed_ms", pa.int64())]

        def one(url: str) -> tuple:
            start = time.monotonic()

            def spent() -> int:
                return int((time.monotonic() - start) * 1000)

            host = url.split("/")[2].replace("www.", "") if url.count("/") >= 2 else ""
            if host.endswith(tuple(BLOCKED_DOMAINS)) or url.lower().endswith(tuple(BINARY_SUFFIXES)):
                return None, None, None, None, 0
            try:
                text, kind = _ask(url, seconds=seconds)
                return 200, kind, text[:MAX_HTML], None, spent()
            except RuntimeError as e:
                return int(str(e)[5:8]), "", None, None, spent()
            except TimeoutError:
                return None, None, None, "timeout", spent()
            except (OSError, ValueError) as e:
                return None, None, None, "timeout" if "timed out" in str(e) else str(e)[:200] or type(e).__name__, spent()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(IN_FLIGHT) as pool:
                for batch in batches:
                    got = list(pool.map(one, batch.column("url").to_pylist()))
                    columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*got, strict=True), types, strict=True)] if got else [pa.array([], kind) for _, kind in types]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(n for n, _ in types)])

        asked = hits.select("run_id", "page_ord", "url", "title", "snippet").repartition("url")
        return asked.mapInArrow(run, "run_id string, page_ord long, url string, title string, snippet string, status int, content_type string, html string, fetch_error string, elapsed_ms long")


class Chat:
    """A language model behind a chat service, asked with retries."""

    def __init__(self, url: str, key: str, model: str, json_mode: bool = True, seconds: float = 30, max_tokens: int = 2000):
        self.url, self.key, self.model, self.json_mode, self.seconds, self.max_tokens = url, key, model, json_mode, seconds, max_tokens

    def ask(self, prompt: str) -> tuple[str | None, bool, int]:
        """(body, failed, milliseconds)."""
        start = time.monotonic()

        def call(json_mode: bool) -> str:
            body = {"model": self.model, "max_tokens": self.max_tokens, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}
            if json_mode:
                body["response_format"] = {"type": "json_object"}
            text = _ask(self.url, body, {"Authorization": f"Bearer {self.key}"}, self.seconds)[0]
            return json.loads(text)["choices"][0]["message"]["content"] or ""

        body, failed = call_with_retries(call, self.json_mode)
        return body, failed, int((time.monotonic() - start) * 1000)

    def replies(self, prompts: DataFrame, keys: str) -> DataFrame:
        """prompts (the columns of the DDL `keys`, and prompt) to those columns with body, failed, elapsed_ms."""
        ship_package(prompts.sparkSession)
        chat, names = self, [k.strip().split(" ")[0] for k in keys.split(",")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                with ThreadPoolExecutor(IN_FLIGHT) as pool:
                    got = list(pool.map(chat.ask, batch.column("prompt").to_pylist()))
                columns = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], names=[*names, "body", "failed", "elapsed_ms"])

        typed = [F.col(n).cast(k.strip().split(" ")[1]).alias(n) for n, k in zip(names, keys.split(","), strict=True)]
        return prompts.select(*typed, "prompt").mapInArrow(run, f"{keys}, body string, failed boolean, elapsed_ms long")


class ChatPlan:
    def __init__(self, chat: Chat, template: str):
        self.chat, self.template = chat, template

    def plan(self, requests: DataFrame) -> DataFrame:
        return self.chat.replies(requests.select("run_id", F.replace(F.lit(self.template), F.lit("{query}"), F.col("query")).alias("prompt")), "run_id string")


class ChatExtract:
    def __init__(self, chat: Chat, template: str):
        self.chat, self.template = chat, template

    def extract(self, prompts: DataFrame) -> DataFrame:
        return self.chat.replies(prompts.withColumn("prompt", F.replace(F.lit(self.template), F.lit("{pages}"), F.col("prompt"))), "run_id string, batch long")


class ChatFill:
    def __init__(self, chat: Chat, template: str):
        self.chat, self.template = chat, template

    def fill(self, prompts: DataFrame) -> DataFrame:
        prompt = F.replace(F.replace(F.lit(self.template), F.lit("{holes}"), F.col("holes_text")), F.lit("{pages}"), F.col("context"))
        return self.chat.replies(prompts.withColumn("prompt", prompt), "run_id string, worker long")


class ModelEmbed:
    """Vectors by an encoder that load() brings, once for each worker process: a function of a list of texts to a list of vectors."""

    def __init__(self, name: str, load: Callable[[], Callable[[list[str]], list[list[float]]]]):
        self.name, self.load = name, load

    def embed(self, texts: DataFrame) -> DataFrame:
        ship_package(texts.sparkSession)
        name, load = self.name, self.load

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from factgrid.sources import services

            for batch in batches:
                if name not in services._ENCODERS:
                    services._ENCODERS[name] = load()
                vectors = services._ENCODERS[name]([t or "" for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(vectors, pa.list_(pa.float32()))], names=["id", "embedding"])

        return texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, embedding array<float>")


_ENCODERS: dict[str, Callable[[list[str]], list[list[float]]]] = {}
