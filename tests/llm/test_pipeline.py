import random

import corpus_pipeline
from factgrid.llm.line_dedup import line_dedup
from factgrid.llm.quality_rules import quality_rules
from factgrid.llm.simhash import similar_components
from factgrid.llm.toxicity import toxicity
from factgrid.plans import materialize

from tests.llm.helpers import ODD, docs as documents

SF = "/root/testdata/sf0.001"


def test_each_stage_does_what_its_operator_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "toxicity", "line dedup", "near-duplicates", "packing"]
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, SF).cache()
    assert kept.columns == docs.columns and ids(kept) == ids(quality_rules(docs).filter("kept"))
    clean = stages["toxicity"](spark, kept, SF).cache()
    assert clean.columns == docs.columns and ids(clean) == ids(toxicity(kept, labels).filter("predicted = 0"))
    lines = stages["line dedup"](spark, clean, SF).cache()
    assert lines.columns == docs.columns and ids(lines) == ids(clean)
    assert {(r.doc_id, r.text) for r in lines.collect()} == {(r.doc_id, r.text) for r in line_dedup(clean).collect()}
    assert lines.filter("n_chars <> length(text)").count() == 0
    one = stages["near-duplicates"](spark, lines, SF).cache()
    groups = similar_components(lines)
    assert one.columns == docs.columns and ids(one) == ids(groups.select("component_id").distinct().withColumnRenamed("component_id", "doc_id"))
    packed = stages["packing"](spark, one, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(ids(one))
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed.collect())


def test_odd_rows_empty_tables_and_other_columns_go_through_every_stage(spark, tmp_path):
    rng = random.Random(1)
    stop = ["the", "of", "and", "to", "in", "a", "is", "that"]
    prose = [" ".join(rng.choice(stop) if rng.random() < 0.4 else "".join(rng.choices("abcdefghij", k=6)) for _ in range(120)) for _ in range(12)]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(prose)), (100, prose[0]), (200, prose[1]), (None, prose[2]), (300, prose[3] + "\n" + prose[4])]
    odd = documents(spark, rows).selectExpr("*", "1 AS fp", "2 AS rep", "3 AS __n", "'x' AS kept", "5 AS i", "6 AS id")
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(12)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for name, d, l in (("odd", odd, labels), ("empty", odd.limit(0), labels.limit(0))):
        folder = str(tmp_path / name)
        d.write.parquet(f"{folder}/documents.parquet")
        l.write.parquet(f"{folder}/labels.parquet")
        at = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:-1]:
            path = f"{folder}/{stage.replace(' ', '_')}"
            function(spark, at, folder).write.parquet(path)
            at = spark.read.parquet(path)
            assert at.columns == d.columns
        rows_left = at.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, at, folder).collect()
        assert len({(r.doc_id, r.start) for r in packed}) <= len(packed) and {r.doc_id for r in packed} == {r.doc_id for r in rows_left}
        if name == "empty":
            assert not packed
        else:  # 200 is a copy of 101; line dedup empties it first, as it does the repeated lines of 300
            kept = {r.doc_id for r in rows_left}
            assert {101, 102} <= kept and not {1, 2, 3, 4, 7, 8} & kept


def test_cuts_free_what_finished_jobs_left_on_the_driver(spark, monkeypatch, tmp_path):
    collectors = list(spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    monkeypatch.setattr(materialize, "shared_dir", lambda s: str(tmp_path))
    cleared = []
    clear = materialize.clear_driver
    monkeypatch.setattr(materialize, "clear_driver", lambda s: cleared.append(clear(s)))

    def whole_collections(share):
        monkeypatch.setattr(materialize, "HEAP_SHARE", share)
        before = sum(c.getCollectionCount() for c in collectors if "Old" in c.getName())
        for n in range(materialize.LOOK_EVERY):
            assert materialize.cut(spark.range(n)).count() == n
        return sum(c.getCollectionCount() for c in collectors if "Old" in c.getName()) - before

    whole_collections(2)
    assert not cleared  # a heap with room is left alone
    assert whole_collections(0) >= 1 and len(cleared) == 1
