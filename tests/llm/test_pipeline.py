import os
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
import plain  # noqa: E402
from parcelweave.llm import language  # noqa: E402

ROWS = [r for r in plain.AWKWARD if r[0] not in (6,)] + [(100 + i, f"clean text number {i} " + f"word{i} " * 9, "en", "a") for i in range(30)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again as the next one's input."""
    root = tmp_path_factory.mktemp("pipeline")
    docs = plain.documents(spark, ROWS)
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(root / f"stage-{i}")
        stage(spark, out[-1], str(root)).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_return_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(stages[-1].columns)


def test_each_stage_on_its_own_input(stages):
    raw, spoken, single, cut, mixed, packed = stages
    letters = Counter((r[0], r[1]) for r in ROWS if any(c.isalpha() for c in r[1] or ""))
    assert Counter((r["doc_id"], r["text"]) for r in spoken.collect()) == letters
    texts = [(r["doc_id"], r["text"]) for r in spoken.collect()]
    groups = plain.linked([plain.simhash(t) for _, t in texts])
    kept = single.collect()
    assert len(kept) == len(set(groups))
    least = {g: min((i for (i, _), h in zip(texts, groups, strict=True) if h == g and i is not None), default=None) for g in groups}
    assert Counter(r["doc_id"] for r in kept) == Counter(least.values())
    left = Counter()
    for r, (n, gone, text) in zip(kept, plain.without_repeats([r["text"] for r in kept]), strict=True):
        if not gone or gone < n:
            left[r["doc_id"], text if gone else r["text"]] += 1
    assert Counter((r["doc_id"], r["text"]) for r in cut.collect()) == left
    assert all(r["n_chars"] == len(r["text"]) for r in [*cut.collect(), *mixed.collect()])
    size = Counter()
    for r in cut.collect():
        size[r["doc_id"]] += len(plain.words(r["text"]))
    taken = Counter()
    for r in mixed.collect():
        taken[r["doc_id"]] += len(plain.words(r["text"]))
    assert all(taken[i] <= 2 * size[i] for i in taken)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.1 * sum(size.values())
    pieces = Counter(r["doc_id"] for r in packed.collect())
    assert pieces.keys() == taken.keys()


def test_run_over_a_folder(spark, tmp_path):
    plain.documents(spark, ROWS, clashing=False).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language ID", "SimHash near-dedup", "substring dedup", "mixing", "packing"]


def test_texts_with_letters_stay_without_a_profile(spark, tmp_path):
    letters = Counter((r[0], r[1]) for r in ROWS if any(c.isalpha() for c in r[1] or ""))
    bare = plain.documents(spark, [(*r[:2], None, r[3]) for r in ROWS], clashing=False)
    labelled = plain.documents(spark, [(*r[:2], "und", r[3]) for r in ROWS], clashing=False)
    only_held = bare.withColumn("lang", F.when(language.held_out(), F.lit("en")))
    for docs in (bare, labelled, only_held):
        kept = corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()
        assert Counter((r["doc_id"], r["text"]) for r in kept) == letters
        assert {r["lang"] for r in kept} <= {"und", "en"}
    bare.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_an_empty_corpus(spark, tmp_path):
    docs = plain.documents(spark, [])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() == 0
