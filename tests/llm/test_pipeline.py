"""The pipeline, stage by stage, on the small tables."""

from collections import Counter

import corpus_pipeline as pipeline
import pytest
from test_corpus_operators import jaccard_groups

from bellwether.llm import quality, sharding
from bellwether.llm.common import stored, table
from bellwether.llm.queries import SHARDS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The table before the first stage and after each."""
    out = [table(spark, SF, "documents")]
    for name, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "test-stage"))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == [*stages[0].columns, "slot", "shard"]


def test_quality_stage_drops_what_the_model_rejects(spark, stages):
    model = quality.train(stages[0], table(spark, SF, "labels"))
    rows = stages[0].collect()
    import numpy as np

    scores = model.scores(np.array([quality.features((r.text or "").encode()) for r in rows]))
    want = {r.doc_id for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_one_of_each_group_stays(stages):
    groups = jaccard_groups({r.doc_id: r.text for r in stages[1].collect()})
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(set(groups.values()))


def test_all_pairs_of_high_jaccard_meet(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    words = [f"w{i}" for i in range(300)]
    made = [(10**7 + i, " ".join(f"x{i}" if k == 3 * i else w for k, w in enumerate(words))) for i in range(20)]
    made.append((10**7 + 99, " ".join(words[:-40] + [f"y{k}" for k in range(40)])))
    made.append((10**7 + 100, " ".join(words[:-90] + [f"z{k}" for k in range(90)])))
    rows = docs.unionByName(spark.createDataFrame(made, "doc_id bigint, text string"))
    groups = jaccard_groups({r.doc_id: r.text for r in rows.collect()})
    assert sorted(r.doc_id for r in pipeline.keep_one_of_each_group(spark, rows, SF).collect()) == sorted(set(groups.values()))


def test_contaminated_documents_go(spark, stages):
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[2:4])
    holding = {i for i, t in before.items() if any(x in (t or "") for x in items)}
    assert holding.isdisjoint(after) and set(after) <= set(before)
    assert len(before) - len(after) <= len(holding) + 2


def test_mixing_keeps_all_and_repeats_at_most_twice(stages):
    before, after = ([r.doc_id for r in s.collect()] for s in stages[3:5])
    counts = Counter(after)
    assert set(counts) == set(before) and max(counts.values()) == 2


def test_sharding_places_every_row(stages):
    full = sharding.fill_table(SHARDS)
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r.shard == full[r.slot] for r in rows)


def test_run_gives_the_last_stage(spark, stages):
    columns = ["doc_id", "slot", "shard"]
    got, want = (Counter(map(tuple, s.select(columns).collect())) for s in (pipeline.run(spark, SF), stages[-1]))
    assert got == want
