"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from docspan.llm import decontaminate, mixing, quality
from docspan.llm.common import stored, table
from tests.llm.fixtures import odd_documents
from tests.llm.test_jaccard import brute
from tests.llm.test_sharding_mixing import nearest_mix
from tests.llm.test_text_operators import edit_distance_inside

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """Rows after each stage, by name, as the pipeline hands them on."""
    docs, out = table(spark, SF, "documents"), {}
    out["start"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        out[name] = docs.collect()
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stages_are_the_ones_agreed(kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram jaccard join", "benchmark decontamination", "mixing", "sharding"]
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert [list(r.asDict()) for r in kept[name][:1]] == [COLUMNS]
    assert list(kept["sharding"][0].asDict()) == [*COLUMNS, "shard", "slot"]


def test_rejected_documents_go(spark, kept):
    good = quality.classify(table(spark, SF, "documents")).filter("keep").collect()
    assert ids(kept["quality classifier"]) == ids(good)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    stay = set(ids(kept["quality classifier"]))
    clean = [d for d, q in labels.items() if q == 1]
    junk = [d for d, q in labels.items() if q == 0]
    assert sum(d in stay for d in clean) >= 0.97 * len(clean)
    assert sum(d in stay for d in junk) <= 0.35 * len(junk)


def test_one_of_each_group_stays(kept):
    rows = [(r.doc_id, r.text) for r in kept["quality classifier"]]
    comp = {d: c for d, _, c in brute(rows, 5, 80)}
    assert ids(kept["n-gram jaccard join"]) == sorted(d for d, c in comp.items() if d == c)


def test_leaks_go(spark, kept):
    items = [decontaminate.normal(r.text) for r in table(spark, SF, "benchmark").collect()]
    stay = set(ids(kept["benchmark decontamination"]))
    for r in kept["n-gram jaccard join"]:
        said = decontaminate.normal(r.text)
        exact = any(p in said for p in items)
        if exact:
            assert r.doc_id not in stay
        elif r.doc_id not in stay:
            assert any(edit_distance_inside(p, said) <= len(p) // 10 for p in items)


def test_mix_and_shards(kept):
    before, after = kept["benchmark decontamination"], kept["mixing"]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    words, taken, times = Counter(), Counter(), Counter(r.doc_id for r in after)
    for r in before:
        words[r.source] += size(r)
        taken[r.source] += size(r) * times[r.doc_id]
    assert set(times) <= set(ids(before)) and max(times.values()) <= 2
    names = sorted(words, key=str.encode)
    targets = mixing.water_fill([words[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(words.values()), 2)
    for s, t in zip(names, targets, strict=True):
        sizes = [size(r) for r in before if r.source == s and size(r)]
        if abs(taken[s] - t) > min(sizes) / 2 + 0.001 * t + 1:  # few documents: only where no choice comes nearer
            assert abs(taken[s] - t) <= nearest_mix(sizes, t) + 1, (sizes, t)
    last = kept["sharding"]
    assert ids(last) == ids(after)
    for s in range(8):
        slots = sorted(r.slot for r in last if r.shard == s)
        assert slots == list(range(len(slots)))


def test_run_is_the_stages_in_turn(spark, kept):
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.shard) for r in got) == sorted((r.doc_id, r.shard) for r in kept["sharding"])


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, blanks, long texts, repeated rows, clashing names and an empty table, stage by stage."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, "no such passage anywhere at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["quality", "keep", "size", "rate", "target", "copies", "source_size", "__n", "uid", "a.b"]
    whole = odd_documents(spark, clashing=True).withColumns({n: F.lit("mine") for n in names})
    for docs in (whole, whole.limit(0)):
        given = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            if name == "quality classifier":  # so few odd rows teach it nothing, so the next stages get all of them
                kept = stage(spark, docs, str(tmp_path))
                assert kept.columns == docs.columns and kept.count() <= given
                continue
            kept = stored(stage(spark, docs, str(tmp_path)), "odd")
            own = [c for c in kept.columns if c not in ("shard", "slot")]
            assert own == [c for c in docs.columns if c not in ("shard", "slot")], name
            assert all(r[n] == "mine" for r in kept.collect() for n in names)
            if name == "n-gram jaccard join" and given:
                gone = Counter(r.doc_id for r in docs.collect()) - Counter(r.doc_id for r in kept.collect())
                assert gone[2] == 1 and gone[3] == 2 and gone[None] == 1 and gone[4] == gone[5] == gone[6] == 0
            if not given:
                assert kept.count() == 0
