"""The pipeline's stages: columns, decisions, and the same result as the operators one by one."""

import corpus_pipeline
from quillworks.llm import common, mixing, quality_classifier, quality_rules, simhash
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents").withColumn("score", common.F.lit(1))
    columns = docs.columns
    labels = common.table(spark, SF, "labels")
    model = quality_classifier.fit(docs, quality_classifier.graded(labels))
    want = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        out = common.materialize(stage(spark, docs, SF), "stage")
        assert out.columns == columns
        got = sorted(r.doc_id for r in out.select("doc_id").collect())
        if k == 0:
            want = {r.doc_id for r in quality_classifier.score_documents(docs, model).where("selected").collect()}
        elif k == 1:
            want = {r.doc_id for r in quality_rules.score_documents(docs, labels).where("kept").collect()}
        elif k == 2:
            want = {r.component_id for r in simhash.link_documents(docs).collect()}
        if k < 3:
            assert got == sorted(want), name
        else:
            copies = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in mixing.mix_documents(docs).collect()}
            assert got == sorted(i for i in ids for _ in range(copies[i]))
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.select("text").collect())
    assert sum(p.length for p in pieces) == total
    assert sum(p.length for p in corpus_pipeline.run(spark, SF).collect()) == total


def test_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows and ids, clashing columns: each stage keeps whole rows or drops them."""
    given = common.table(spark, SF, "documents").where("doc_id < 80")
    odd = [(None, None, None, None, None), (None, "", None, None, 0), (900, "", "en", None, 0), (900, "", "en", None, 0), (901, None, None, "src1", None), (5, "another text under a known id", "en", "src1", 29)]
    docs = given.union(given.where("doc_id < 9")).union(spark.createDataFrame(odd, given.schema))
    for name in ("score", "size", "fp", "position", "copies", "near_row", "near_hash", "kept", "doc", "tail"):
        docs = docs.withColumn(name, common.F.lit(name))
    docs = common.materialize(docs, "odd")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {str(r) for r in docs.collect()}
        out = common.materialize(stage(spark, docs, SF), "stage")
        rows = sorted(map(str, out.collect()))
        assert out.columns == columns and rows and set(rows) <= before, name
        if k < 3:
            assert rows == sorted(map(str, stage(spark, docs.repartition(3), SF).collect())), name
        if k == 2:
            assert len(rows) == len(set(rows))
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len({p.doc_id for p in pieces}) == docs.select("doc_id").distinct().count()


def test_empty_table(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        if name != "packing":
            assert out.columns == docs.columns
