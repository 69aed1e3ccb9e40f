"""The pipeline on a small corpus, stage by stage, against brute force."""

import random

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from anomalypool.llm import bpe
from tests.llm.test_dedup import _removed, near_groups_by_force, normal


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    shared = " ".join(word() for _ in range(40))
    rows = []
    for i in range(240):
        words = [word() for _ in range(rng.randint(30, 90))]
        text = " ".join(words)
        if i % 3 == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        elif i % 10 == 1 and i > 20:
            text = rows[i - 12][1]
        elif i % 10 == 2:
            text = f"{text} {shared} {word()}"
        elif i % 10 == 4 and i > 20:
            text = rows[i - 12][1] + " " + word()
        rows.append((i, text, "en", "s", len(text)))
    sf = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    at, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        if name != "best-fit packing":
            assert at.columns == docs.columns
        at.write.parquet(f"{sf}/stage-{len(seen)}")
        at = spark.read.parquet(f"{sf}/stage-{len(seen)}")
        seen.append(at.toPandas())
    good, exact, near, cut, packed = seen
    assert sorted(good.doc_id) == [i for i in range(240) if i % 3]
    first = good.assign(t=good.text.map(normal)).groupby("t").doc_id.min()
    assert sorted(exact.doc_id) == sorted(first)
    groups, links = near_groups_by_force(list(zip(exact.doc_id, exact.text)))
    assert links and sorted(near.doc_id) == sorted(set(groups.values()))
    want = _removed(list(zip(near.doc_id, near.text.str.encode("utf-8"))))
    assert dict(zip(cut.doc_id, cut.text)) == {i: k.decode("utf-8", "ignore") for i, (k, _, _) in want.items()}
    assert (cut.n_chars == cut.text.str.len()).all()
    encoder = bpe.Encoder(bpe.load_merges(bpe.vocabulary_path()))
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: len(encoder.ids(t)) + 1 for i, t in zip(cut.doc_id, cut.text)}
    whole = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(zip(whole.doc_id, whole.piece, whole.ids_crc32)) == sorted(zip(packed.doc_id, packed.piece, packed.ids_crc32))


def test_stages_of_odd_and_empty_tables(spark, tmp_path):
    """Null and repeated ids, null and empty texts, one very long: nothing crashes, and columns stay."""
    said = " ".join(f"w{i}" for i in range(40))
    rows = [(1, said, "en", "a", 1), (1, said, "en", "a", 1), (None, said, "en", "a", 1), (None, None, None, None, None), (2, None, None, None, None), (3, "", None, None, 0), (5, " ".join(map(str, range(100_000))), "en", "b", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        found = stage(spark, docs, str(tmp_path))
        if name != "best-fit packing":
            assert empty.columns == found.columns == docs.columns
        ids = [r["doc_id"] for r in found.collect()]
        assert 5 in ids and 1 in ids
        if name == "quality rules":
            assert sorted(ids, key=str) == [1, 1, 5, None]  # the empty ones fail the base rules
        if name == "suffix-array dedup":
            assert len(ids) == len(rows)
