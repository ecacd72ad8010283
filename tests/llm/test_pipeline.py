"""The pipeline's stages, each against a plain version of its rule on its own input."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from .conftest import SF  # noqa: E402
from .test_edges import WORD, normal, plain_classes  # noqa: E402


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "sentencepiece" or docs.columns == names
    rows = {n: [tuple(r) for r in d.select("doc_id", "text", "lang", "source").collect()] for n, d in inputs.items()}
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r[0] for r in rows["toxicity"]} - {r[0] for r in rows["exact_dedup"]}
    assert len(gone - toxic) < 0.1 * len(rows["toxicity"]) and gone & toxic
    assert Counter(normal(r[1]) for r in rows["minhash_near_dedup"]) == Counter({normal(r[1]) for r in rows["exact_dedup"]})
    classes = plain_classes(rows["minhash_near_dedup"], 5)
    assert sorted(r[0] for r in rows["mix_sources"]) == sorted({k[2][1] if k[1][1] else k[0][1] for k in classes})
    size = lambda t: len(WORD.findall(t or ""))
    taken = Counter(r[0] for r in rows["sentencepiece"])
    assert max(taken.values()) <= 3 and {r[0] for r in rows["sentencepiece"]} <= {r[0] for r in rows["mix_sources"]}
    total = sum(size(r[1]) for r in rows["mix_sources"])
    assert abs(sum(size(r[1]) for r in rows["sentencepiece"]) - total) < 0.35 * total
    assert docs.count() == len(rows["sentencepiece"])


def test_run_is_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mix_sources", "sentencepiece"]
    one, two = corpus_pipeline.run(spark, SF), corpus_pipeline.run(spark, SF)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


@pytest.mark.parametrize("which", ["edge", "nothing"])
def test_stages_on_edges(spark, request, labels, tmp_path, which):
    """Nulls, repeated rows and ids, very long texts, clashing columns, and an empty table, through each stage in turn."""
    docs = request.getfixturevalue(which)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        n = docs.count()
        assert n <= before if name not in ("mix_sources", "sentencepiece") else n <= 3 * before
        if name != "sentencepiece":
            assert docs.columns == names
        before = n
    assert (before == 0) == (which == "nothing") and {"doc_id", "pieces"} <= set(docs.columns)
