"""The pipeline as a whole, and its near-duplicate stage on repeated rows and rows without id."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from dendrospark.llm import packing

STAGES = dict(corpus_pipeline.STAGES)


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text + " more"), (None, text + " other"), (3, "alone " * 3), (None, "lost " + " ".join(f"a{i}" for i in range(20))),
            (None, "lost " + " ".join(f"a{i}" for i in range(20))), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "leads": F.lit(1)})
    got = Counter(r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, "nowhere").collect())
    assert got == {1: 1, 3: 1, None: 1, 4: 2}


def test_two_pipelines_and_lazy_stages_keep_their_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = STAGES["quality_rules"](spark, docs, "one")
    other = STAGES["near_duplicates"](spark, docs, "two")
    lazy = STAGES["near_duplicates"](spark, one, "one")  # reads what the first stage wrote
    assert other.count() > 0 and one.count() >= lazy.count() > 0


def test_run_against_its_stages(spark, tmp_path):
    """Repeated rows and null ids go through all stages; every token of what is left comes once and in order."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = docs.orderBy("doc_id").limit(20)
    docs = docs.unionByName(extra).unionByName(extra.withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("quality_rules", "near_duplicates", "secret_scan"):
        left = spark.createDataFrame(STAGES[name](spark, left, "by-hand").collect(), left.schema)
    coder = packing.Encoder(packing.tokenizer_path())
    want = Counter((r["doc_id"], len(coder.tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in left.collect())
    assert None not in {i for i, _ in want} and max(Counter(i for i, _ in want).values()) == 1
    total = Counter()
    for p in pieces:
        total[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert {k: v // k[1] for k, v in total.items()} == dict(want) and all(v % k[1] == 0 for k, v in total.items())


def test_packing_follows_the_places_of_the_mix(spark, monkeypatch):
    """The mixing stage hands on its places, and other places give other sequences."""
    monkeypatch.setattr(corpus_pipeline, "STRETCH", 8)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(64)
    mixed = STAGES["mix_sources"](spark, docs, "places")
    mixed = spark.createDataFrame(mixed.collect(), mixed.schema)
    places = {r["doc_id"]: r[corpus_pipeline.PLACE] for r in mixed.collect()}
    assert sorted(places.values()) == list(range(64)) and set(mixed.columns) == {*docs.columns, corpus_pipeline.PLACE}

    def order(place):
        pieces = STAGES["packing"](spark, mixed.withColumn(corpus_pipeline.PLACE, place), "places").filter("start = 0").collect()
        return [p["doc_id"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))]

    place = F.col(corpus_pipeline.PLACE)
    ahead, back = order(place), order(F.lit(63) - place)
    assert [places[i] // 8 for i in ahead] == sorted(places[i] // 8 for i in ahead)
    assert [places[i] // 8 for i in back] == sorted((places[i] // 8 for i in back), reverse=True) and ahead != back
