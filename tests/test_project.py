from loomdex.config import Embedding, Project, expand
from loomdex.operators.chunking import ChunkConfig
from loomdex.operators.search import Ranking


def test_a_folder_of_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("PROJECT_ROOT", "/srv/x")
    files = {
        "sources.team.yaml": "sources:\n  - {name: a, root: $PROJECT_ROOT/a, type: module, metadata: {area: core}}\n", "sources.yaml": "sources: []\n",
        "chunking.yaml": "markdown: {max_chars: 700}\nphp: {max_chars: 900, phpdoc: {max_chars: 10}}\n", "ranking.yaml": "search: {default_mode: dense}\nhybrid: {dense_candidates: 7, rrf_k: 10}\n",
        "limits.yaml": "indexing: {max_file_bytes: '12', max_chunks_per_file: 3, stop_on_error: 'yes'}\n", "embeddings.yaml": "dense: {provider: hashing, model: hashing-32, batch_size: 4, query_prefix: '', device_ids: '0,1', cuda: on}\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    p = Project.load(tmp_path, "team")
    assert p.sources[0]["root"] == "/srv/x/a" and Project.load(tmp_path, "other").sources == []
    assert p.chunking["markdown"] == ChunkConfig(700, 200) and p.chunking["php"].chunk == ChunkConfig(900, 300) and p.chunking["php"].docs.max_chars == 10 and "text" not in p.chunking
    assert p.ranking == Ranking(7, 50, 10) and p.mode == "dense" and (p.limits.max_file_bytes, p.limits.max_chunks_per_file, p.limits.stop_on_error) == (12, 3, True)
    assert p.embedding == Embedding("hashing", "hashing-32", 4, "", "passage: ", True, None, True, (0, 1), None)
    assert Project.load(tmp_path / "none") == Project()


def test_variables_are_replaced_within(monkeypatch):
    monkeypatch.setenv("HERE", "x")
    assert expand({"$HERE": ["a $HERE", {"b": "$NOWHERE"}, 3]}) == {"$HERE": ["a x", {"b": "$NOWHERE"}, 3]}


def test_embedders_by_provider():
    import pytest

    from loomdex.operators import dense

    assert dense.embedder("hashing", "hashing-32", 2)(["a", "b", "c"]).shape == (3, 32)
    with pytest.raises(ValueError):
        dense.embedder("none", "x")


def test_options_of_an_experiment(tmp_path):
    import yaml

    from loomdex.cli import main

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "embeddings.yaml").write_text("dense: {model: old, batch_size: 3, providers: [cpu]}\n")
    (tmp_path / "c" / "store.yaml").write_text("collection: old\n")
    main(["--config-dir", str(tmp_path / "c"), "derive", "one", "--to", str(tmp_path / "e"), "--model", "new", "--cuda", "--device-id", "0", "--device-id", "1", "--collection", "x", "--no-preload-cuda-dependencies"])
    read = lambda name: yaml.safe_load((tmp_path / "e" / "one" / name).read_text())
    assert read("embeddings.yaml") == {"dense": {"model": "new", "batch_size": 3, "cuda": True, "device_ids": [0, 1], "preload_cuda_dependencies": False}} and read("store.yaml") == {"collection": "x"}
    assert yaml.safe_load((tmp_path / "c" / "embeddings.yaml").read_text())["dense"]["model"] == "old"


def test_the_memory_guard():
    import pytest

    from loomdex.functions.memory import guard, held_mb

    guard(None, "nothing")
    guard(int(held_mb()) + 10_000, "little")
    with pytest.raises(MemoryError):
        guard(1, "much")
