import corpus_pipeline
from pyspark.sql import functions as F

from pageloom.llm import token_store
from pageloom.llm.queries import op2_toxicity, op6_decontamination
from tests.conftest import DATA
from tests.llm.test_near_duplicates import plain_groups


def test_each_stage_on_its_input(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        seen.append(stage(spark, seen[-1], d))
        assert seen[-1].columns == docs.columns
        seen[-1] = seen[-1].cache()
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in seen]
    assert sorted(ids[1]) == sorted(r.doc_id for r in op2_toxicity(spark, d).where("predicted = 0").collect())
    groups = plain_groups([(r.doc_id, r.text) for r in seen[1].collect()])
    assert sorted(ids[2]) == sorted({c for _, _, c in groups})
    leaked = {r.doc_id for r in op6_decontamination(spark, d).where("contaminated").collect()}
    assert sorted(ids[3]) == sorted(set(ids[2]) - leaked)
    words = [sum(len((r.text or "").split()) for r in s.collect()) for s in (seen[3], seen[4])]
    assert 0.98 * words[0] <= words[1] <= words[0] and set(ids[4]) <= set(ids[3])


def test_run(spark):
    rows = corpus_pipeline.run(spark, f"{DATA}/sf0.001").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and rows


def odd_tables(spark, folder, empty=False):
    """documents with null and repeated ids, null, empty and long texts, a null source, and clashing columns; benchmark and labels as they are."""
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({"label": F.lit(1), "overlaps": F.lit("x"), "key": F.lit(2.0), "size": F.lit(None).cast("int"), "__n": F.lit(1)})
    texts = {"no id": "lonely words of a text without any id at all", "none": None, "empty": "", "long": "very long text " * 20_000, "again": "some other text whose id is there twice"}
    add = lambda i, t, source="s": docs.limit(1).withColumns({"doc_id": F.lit(i).cast(docs.schema["doc_id"].dataType), "text": F.lit(texts[t]), "source": F.lit(source)})
    for row in (add(None, "no id"), add(None, "none"), add(None, "none", None), add(900_001, "empty", None), add(900_002, "long"), add(900_003, "again"), add(900_003, "again"), add(900_003, "no id")):
        docs = docs.unionByName(row)
    (docs.limit(0) if empty else docs).write.parquet(f"file://{folder}/documents.parquet")
    for name in ("benchmark", "labels"):
        t = spark.read.parquet(f"{d}/{name}.parquet")
        (t.limit(0) if empty else t).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}"


def test_odd_documents_pass_all_stages(spark, tmp_path):
    d = odd_tables(spark, tmp_path / "odd")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = out.cache()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "near copies":
            assert ids.count(900_003) == 1 and ids.count(None) == 3 and ids.count(900_002) == 1
        if name == "benchmark leaks":
            assert docs.where("doc_id = 900002").first().text == "very long text " * 20_000
    index = corpus_pipeline.STAGES[4][1](spark, docs, d).collect()
    assert sorted(r.slot for r in index) == list(range(len(index))) and {i for r in index for i in r.doc_ids} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_empty_documents_give_an_empty_index(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "empty", True)).collect() == []


def test_shards_of_the_run_hold_what_the_stages_kept(spark):
    """Tokens of the last stage against a plain version: texts of the mix one after another, cut and dealt by the permutation."""
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, d)
    texts = [r.text for r in docs.select("text").collect()]
    index = corpus_pipeline.STAGES[4][1](spark, docs, d).collect()
    plain = token_store.encoders(token_store.VOCABULARY)[0]
    assert sum(r.n_tokens for r in index) == sum(len(plain.encode_ordinary(t or "")) + 1 for t in texts)
