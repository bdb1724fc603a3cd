"""The stages, each on what its predecessor kept."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    prose = ["river stone under moving light while birds cross slowly over the northern hills %d and nobody counts the hours left before winter returns with snow" % i for i in range(30)]
    texts = [*prose, prose[0], prose[0], "short", None, prose[1] + " mail me at x.y@example.org please", "a " * 100]
    out = tmp_path_factory.mktemp("sf")
    data = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return str(out), texts


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs)
    quality, once, private, mixed = (d.collect() for d in seen)
    assert {r.doc_id for r in quality} == {i for i, t in enumerate(texts) if t and t not in ("short", "a " * 100)}
    assert len({r.text for r in once}) == len(once) and {30, 31}.isdisjoint(r.doc_id for r in once)
    assert not any("x.y@example.org" in r.text for r in private) and len(private) == len(once)
    words = sum(len(WORD.findall(r.text)) for r in private)
    assert abs(sum(len(WORD.findall(r.text)) for r in mixed) - 1.5 * words) <= 3
    final = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in final)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0


def test_run_over_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_with_clashing_columns_nulls_and_a_long_text(spark, tmp_path):
    import random

    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    prose = " ".join(f"v{rng.randrange(10**6)}" for _ in range(60))
    rows = [(1, long, "en", "a", len(long), 1, 2, "x", True), (2, prose, None, None, None, None, None, None, None), (2, prose, None, None, None, None, None, None, None), (None, prose + " more words here", "en", "a", 1, 1, 1, "y", False), (3, None, None, "a", None, 0, 0, "z", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h long, fp long, entities string, kept boolean").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and all(r.round_trip for r in got) and {r.doc_id for r in got} <= {1, 2, None} and 1 in {r.doc_id for r in got}
