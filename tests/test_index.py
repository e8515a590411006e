import json
import threading
import urllib.error
import urllib.request

import pytest

from pyspark.sql import functions as F

from quarry import cli, schemas
from quarry.errors import DatasetError, IndexingError
from quarry.operators import incremental
from quarry.plans import indexing, models, service
from quarry.sources import datasets, files
from quarry.sources.cache import QueryCache
from quarry.sources.store import IndexRegistry, IndexStore
from quarry.streaming import watch


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, content in {"guide.md": "# Cache\nThe cache keeps pages.\n", "src/tool.py": "def load_model(name):\n    return name\n", "build/skip.md": "skipped", "data.bin": "skipped", "empty.txt": " \n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return root


def snapshot(store):
    return sorted((r.id, r.text) for r in store.chunks().collect()), sorted((r.term, r.chunk_id, r.tf) for r in store.lexical().postings.collect())


def test_tree(spark, tree):
    (tree / "bad.txt").write_bytes(b"a\r\nb\xff")
    rows = {r.path: r.content for r in files.read_tree(spark, str(tree)).collect()}
    assert set(rows) == {"guide.md", "src/tool.py", "empty.txt", "bad.txt"} and rows["bad.txt"] == "a\nb�"
    with pytest.raises(IndexingError):
        files.read_tree(spark, str(tree / "nowhere"))


def test_incremental_pass_equals_full_pass(spark, tree, tmp_path):
    folder = str(tmp_path / "index")
    first = indexing.index(spark, str(tree), folder, 500, models.HashingEmbedder)
    assert (first["files_indexed"], first["new_files"], first["total_chunks"]) == (2, 3, 2)
    again = indexing.index(spark, str(tree), folder, 500, models.HashingEmbedder)
    assert (again["unchanged_files"], again["new_files"], again["files_indexed"]) == (3, 0, 3)
    (tree / "guide.md").write_text("# Cache\nNew text.\n")
    (tree / "new.md").write_text("Fresh words.")
    (tree / "src/tool.py").unlink()
    third = indexing.index(spark, str(tree), folder, 500, models.HashingEmbedder)
    assert [third[f"{s}_files"] for s in ("unchanged", "modified", "new", "deleted")] == [1, 1, 1, 1]
    indexing.index(spark, str(tree), str(tmp_path / "full"), 500)
    assert snapshot(IndexStore(spark, folder)) == snapshot(IndexStore(spark, str(tmp_path / "full")))
    assert IndexStore(spark, folder).embeddings().count() == 2
    assert indexing.index(spark, str(tree), folder, 400)["modified_files"] == 3  # another chunk size
    assert IndexStore(spark, folder).embeddings() is None
    (tmp_path / "index" / IndexStore(spark, folder).version() / "chunks").rename(tmp_path / "lost")
    assert indexing.index(spark, str(tree), folder, 400)["new_files"] == 3  # an index that can't be read is built anew


def test_plan_and_integrity(spark):
    chunks = spark.createDataFrame([("a_0_1", "a"), ("b_0_1", "b"), ("c_0_1", "c")], "id string, file_path string")
    old = spark.createDataFrame([("a_0_1", [1.0]), ("b_0_1", [1.0]), ("d_0_1", [1.0])], "chunk_id string, embedding array<float>")
    manifest = spark.createDataFrame([("a", ["a_0_1"]), ("b", ["b_0_1"]), ("d", ["d_0_1"])], "path string, chunk_ids array<string>")
    changed = spark.createDataFrame([("a", "unchanged"), ("b", "modified"), ("c", "new"), ("d", "deleted")], "path string, status string")
    plan = {r.chunk_id: r.action for r in incremental.embedding_plan(old, chunks, manifest, changed).collect()}
    assert plan == {"a_0_1": "reuse", "b_0_1": "compute", "c_0_1": "compute", "d_0_1": "remove"}
    found = {r.check: r.failures for r in incremental.integrity(chunks, old).collect()}
    assert found == {"repeated_ids": 0, "null_ids": 0, "empty_vectors": 0, "other_sizes": 0, "unknown_ids": 1, "missing_ids": 1}


def test_store_errors(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    with pytest.raises(IndexingError):
        store.chunks()
    assert store.manifest().count() == 0 and store.embeddings() is None
    twice = spark.createDataFrame([("a", [1.0]), ("a", [1.0])], "chunk_id string, embedding array<float>")
    with pytest.raises(IndexingError, match="repeat"):
        store.save_embeddings(twice)
    store.add("chunks", spark.range(1))
    with pytest.raises(IndexingError, match="lacks"):
        store.chunks()


def test_a_crash_leaves_the_index_as_it_was(spark, tmp_path):
    chunks = lambda *texts: spark.createDataFrame([(f"c{i}", "f.md", t, 0, len(t), "markdown", i) for i, t in enumerate(texts)], schemas.CHUNKS)
    store = IndexStore(spark, str(tmp_path))
    store.save(chunks("one word"))
    first = store.version()
    broken = chunks("two").withColumn("text", F.raise_error(F.lit("crash")).cast("string"))
    with pytest.raises(Exception, match="crash"):
        store.save(broken)
    assert store.version() == first and [r.text for r in store.chunks().collect()] == ["one word"]
    registry = IndexRegistry()
    assert registry.get(store)[0].first().text == "one word"
    for text in ("second", "third", "fourth"):
        store.save(chunks(text))
    assert registry.get(store)[0].first().text == "fourth" and len(store.generations()) == 2
    assert {(r.term, r.tf) for r in store.lexical().postings.collect()} == {("fourth", 1)}


def test_files_that_cannot_be_read_are_counted(spark, tree, monkeypatch):
    whole = files.read_tree(spark, str(tree))
    assert files.skipped(spark, str(tree), whole) == 0
    with pytest.warns(UserWarning, match="guide.md"):
        assert files.skipped(spark, str(tree), whole.where("path <> 'guide.md'")) == 1


def test_own_retriever_and_blank_questions(spark, tree, tmp_path):
    folder = str(tmp_path / "index")
    assert indexing.index(spark, str(tree), folder)["files_skipped"] == 0
    asked = lambda *texts: spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "qid string, question string")
    fixed = service.SearchService(spark, folder, retriever=lambda q, k: q.select("qid", F.lit(1).alias("rank"), F.lit("guide.md_0_31").alias("chunk_id")))
    assert [r.file_path for r in fixed.search(asked("zzz")).collect()] == ["guide.md"]
    assert service.SearchService(spark, folder).chunks is fixed.chunks  # the process loads an index once
    for blank in (" ", "\u2003\n", None):
        with pytest.raises(Exception, match="the question is blank"):
            fixed.search(asked("cache", blank)).collect()


def test_cache(spark, tmp_path):
    cache = QueryCache(spark, str(tmp_path), "bm25", "1")
    asked = spark.createDataFrame([("a", "What is it"), ("b", "none")], "qid string, question string")
    calls = []

    def compute(missing):
        calls.append(sorted(r.qid for r in missing.collect()))
        return spark.createDataFrame([("a", 1, "c1"), ("a", 2, "c2")], "qid string, rank int, chunk_id string")

    assert cache.get_or_compute(asked, 5, compute).count() == 2
    other = spark.createDataFrame([("x", "  what IS  it")], "qid string, question string")
    assert sorted((r.rank, r.chunk_id) for r in cache.get_or_compute(other, 5, compute).collect()) == [(1, "c1"), (2, "c2")]
    assert calls == [["a", "b"]] and cache.contains(asked, 5).count() == 2 and cache.contains(asked, 6).count() == 0
    assert QueryCache(spark, str(tmp_path), "bm25", "2").contains(asked, 5).count() == 0
    (tmp_path / "query_cache" / "bad.parquet").write_bytes(b"PAR1 no table")
    assert cache.get_or_compute(asked, 5, compute).count() in (0, 2) and len(calls) == 2  # what can't be read is worked out anew
    cache.clear()
    assert cache.contains(asked, 5).count() == 0


def test_datasets(spark, tmp_path):
    source = {"file_path": "f", "first_character_index": 0, "last_character_index": 4}
    good = tmp_path / "set.json"
    good.write_text(json.dumps({"rag_questions": [{"question_id": "1", "question": "q", "sources": [source], "answer": "a"}, {"question": "no id"}]}))
    rows = datasets.load_dataset(spark, str(good))
    assert rows.count() == 2 and rows.where("qid is null").count() == 0
    assert [tuple(r) for r in datasets.expected_spans(rows).collect()] == [("1", 0, "f", 0, 4)]
    for name, content in {"broken.json": "{", "shape.json": "{}", "text.json": '{"rag_questions": [{"question_id": "1"}]}'}.items():
        (tmp_path / name).write_text(content)
        with pytest.raises(DatasetError):
            datasets.load_dataset(spark, str(tmp_path / name))
    with pytest.raises(DatasetError):
        datasets.load_dataset(spark, str(tmp_path / "missing.json"))


def test_commands_and_services(spark, tree, tmp_path, capsys):
    folder = str(tmp_path / "index")
    assert cli.main(["index", str(tree), "--folder", folder, "--semantic"]) == 0
    for mode in service.MODES:
        assert cli.main(["search", "cache pages", "--folder", folder, "--mode", mode]) == 0
    assert "guide.md" in capsys.readouterr().out
    assert cli.main(["search", " ", "--folder", folder]) == 1
    assert cli.main(["search", "x", "--folder", folder, "--k", "0"]) == 1
    dataset = tmp_path / "set.json"
    source = {"file_path": "guide.md", "first_character_index": 0, "last_character_index": 31}
    dataset.write_text(json.dumps({"rag_questions": [{"question_id": "1", "question": "what does the cache keep", "sources": [source], "answer": "pages"}]}))
    assert cli.main(["search-dataset", str(dataset), str(tmp_path / "out"), "--folder", folder]) == 0
    results = str(tmp_path / "out" / "set.json")
    capsys.readouterr()
    assert cli.main(["evaluate", results, str(dataset)]) == 0
    assert json.loads(capsys.readouterr().out)["recall@1"] == 1.0
    assert cli.main(["answer-dataset", results, str(tmp_path / "answers"), "--folder", folder]) == 0
    assert json.loads((tmp_path / "answers" / "set.json").read_text())["search_results"][0]["answer"]
    assert cli.main(["cached", "cache", "--folder", folder]) == 0

    registry = IndexRegistry()
    search = service.SearchService(spark, folder, registry=registry)
    assert folder in registry and registry.get(search.store)[0] is search.chunks
    server = service.serve(service.AnswerService(search), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    post = lambda body: urllib.request.urlopen(urllib.request.Request(f"{base}/query", json.dumps(body).encode()))
    assert json.load(urllib.request.urlopen(f"{base}/health")) == {"status": "ok"}
    assert urllib.request.urlopen(f"{base}/").url.endswith("/health")
    assert json.load(post({"question": "cache", "k": 1}))["sources"][0]["file_path"] == "guide.md"
    for body, status in (({"question": "   "}, 400), ({"question": ""}, 422), ({"question": "x", "k": 0}, 422), ({}, 422)):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(body)
        assert e.value.code == status
    server.shutdown()
    registry.clear()
    assert folder not in registry


def test_stream(spark, tree, tmp_path):
    folder = str(tmp_path / "stream")
    watch.watch(spark, str(tree), folder).awaitTermination()
    (tree / "late.md").write_text("late words")
    (tree / "new").mkdir()
    (tree / "guide.md").unlink()
    (tree / "new" / "guide.md").write_text("# Cache\nanother text\n")
    watch.watch(spark, str(tree), folder).awaitTermination()
    chunks, postings = watch.latest(spark, folder)
    assert [r.file_path for r in chunks.orderBy("ordinal").collect()] == ["guide.md", "late.md", "new/guide.md", "src/tool.py"]
    assert chunks.select("ordinal").distinct().count() == 4 and postings.where("term = 'late'").count() == 1
