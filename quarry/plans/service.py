"""Search and answers over a stored index, in batches; a single question is a batch of one. And the same over HTTP."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import QuarryError, RetrievalError
from quarry.operators import context, incremental, retrieve
from quarry.plans import models
from quarry.sources import datasets
from quarry.sources.cache import QueryCache
from quarry.sources.store import LOADED, IndexRegistry, IndexStore

@contextlib.contextmanager
def kept(table: DataFrame):
    """The table, held in memory for the time of a request."""
    table = table.persist()
    try:
        yield table
    finally:
        table.unpersist()


MODES = ("bm25", "semantic", "hybrid")


class SearchService:
    """retriever: a function of (questions, k) that gives (qid, rank, chunk_id[, score]) in place of the mode's own.
    Loaded indexes are shared by all services of the process, unless a registry is given."""

    def __init__(
        self, spark: SparkSession, folder: str, mode: str = "bm25", embedder: Callable[[], models.Embedder] = models.HashingEmbedder, registry: IndexRegistry | None = None,
        cache: QueryCache | None = None, retriever: models.Retriever | None = None,
    ):
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        self.spark, self.mode, self.embedder, self.cache = spark, mode, embedder, cache
        self.store = IndexStore(spark, folder)
        self.retriever = retriever or self._ranked
        self.chunks, self.lexical = (LOADED if registry is None else registry).get(self.store)
        self._embeddings: DataFrame | None = None

    def embeddings(self) -> DataFrame:
        """The stored embeddings, checked against the chunks; they are made and stored where there are none."""
        if self._embeddings is None:
            held = self.store.embeddings()
            if held is None:
                self.store.save_embeddings(models.embed(self.chunks, "id", "text", self.embedder))
                held = self.store.embeddings()
            bad = incremental.integrity(self.chunks, held).where("failures > 0").collect()
            if bad:
                raise RetrievalError("embeddings don't fit the index: " + ", ".join(f"{r['check']} {r['failures']}" for r in bad))
            self._embeddings = held.join(self.chunks.select(F.col("id").alias("chunk_id"), "ordinal"), "chunk_id").persist()
        return self._embeddings

    def _ranked(self, questions: DataFrame, k: int) -> DataFrame:
        if self.mode == "bm25":
            return retrieve.bm25(questions, self.lexical, k)
        queries = models.embed(questions, "qid", "question", self.embedder).withColumnRenamed("chunk_id", "qid")
        if self.mode == "semantic":
            return retrieve.dense(queries, self.embeddings(), k)
        return retrieve.hybrid(questions, queries, self.lexical, self.embeddings(), k)

    def search(self, questions: DataFrame, k: int = retrieve.DEFAULT_K) -> DataFrame:
        """(qid, rank, chunk_id, file_path, text, start, end, kind) for questions (qid, question); a blank one is an error."""
        retrieve.checked_k(k)
        questions = retrieve.asked(questions)
        ranked = self.cache.get_or_compute(questions, k, lambda q: self.retriever(q, k)) if self.cache else self.retriever(questions, k).select("qid", "rank", "chunk_id")
        return retrieve.materialised(ranked, self.chunks)

    def search_one(self, question: str, k: int = retrieve.DEFAULT_K) -> list[dict]:
        retrieve.checked_question(question)
        asked = self.spark.createDataFrame([("q", question)], "qid string, question string")
        return [r.asDict() for r in self.search(asked, k).orderBy("rank").collect()]

    def search_dataset(self, path: str, folder: str, k: int = retrieve.DEFAULT_K) -> str:
        with kept(datasets.load_dataset(self.spark, path).select("qid", "question")) as questions:
            return datasets.save_results(datasets.nested_results(questions, self.search(questions, k)), k, path, folder)


class AnswerService:
    def __init__(self, search: SearchService, generator: Callable[[], models.Generator] = models.QuotingGenerator):
        self.search, self.generator = search, generator

    def answers(self, questions: DataFrame, ranked: DataFrame) -> DataFrame:
        """(qid, answer) from ranked chunks with text; a blank question is an error."""
        questions = retrieve.asked(questions)
        planned = context.answer_messages(questions, context.build_context(ranked))
        made = models.generate(planned.where("status = 'prompt'"), self.generator)
        return planned.where("status = 'fixed'").select("qid", "answer").unionByName(made)

    def answer(self, question: str, k: int = retrieve.DEFAULT_K) -> dict:
        retrieve.checked_question(question)
        spark = self.search.spark
        asked = spark.createDataFrame([("q", question)], "qid string, question string")
        with kept(self.search.search(asked, k)) as ranked:
            text = self.answers(asked, ranked).first()["answer"]
            spans = ranked.orderBy("rank").select("file_path", F.col("start").alias("first_character_index"), F.col("end").alias("last_character_index"))
            return {"question": question, "answer": text, "sources": [r.asDict() for r in spans.collect()]}

    def answer_dataset(self, results_path: str, folder: str) -> str:
        """Answers saved search results: their spans are resolved to chunks first."""
        spark = self.search.spark
        with kept(datasets.load_search_results(spark, results_path)) as rows:
            questions = retrieve.asked(rows.select("qid", "question").distinct())
            ranked = context.resolve(rows.where("rank is not null"), self.search.chunks)
            nested = datasets.nested_results(questions, ranked).join(self.answers(questions, ranked).withColumnRenamed("qid", "question_id"), "question_id")
            return datasets.save_results(nested, rows.first()["k"], results_path, folder)


def serve(answers: AnswerService, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server for GET /, GET /health and POST /query with {question, k}; the caller runs serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: dict, **headers: str) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            for name, value in {"Content-Type": "application/json", "Content-Length": str(len(raw)), **headers}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if self.path == "/":
                self.reply(307, {}, Location="/health")
            elif self.path == "/health":
                self.reply(200, {"status": "ok"})
            else:
                self.reply(404, {"detail": "not found"})

        def do_POST(self) -> None:
            if self.path != "/query":
                return self.reply(404, {"detail": "not found"})
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                question, k = asked["question"], asked.get("k", retrieve.DEFAULT_K)
                if not isinstance(question, str) or not question or not isinstance(k, int) or k <= 0:
                    return self.reply(422, {"detail": "question must be text and k a positive number"})
            except (ValueError, KeyError, TypeError):
                return self.reply(422, {"detail": "not a query"})
            try:
                self.reply(200, answers.answer(question, k))
            except ValueError as e:
                self.reply(400, {"detail": str(e)})
            except QuarryError as e:
                self.reply(500, {"detail": str(e)})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
