import corpus_pipeline
from tallyforge.llm import language_id, mixing, quality
from tests.llm.test_text_operators import first_of_each_group


def test_stages_and_their_decisions(spark, sf, tmp_path):
    docs, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        columns = columns or docs.columns
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "language_id":
            model = language_id.learned(before)
            kept = {r.doc_id for r in language_id.identify(before, model).where("lang_pred <> 'und' AND score >= 0.5").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "quality":
            kept = {r.doc_id for r in quality.classify(before, quality.trusted_ids(spark.read.parquet(f"{sf}/labels.parquet"))).where("keep").collect()}
            assert {r.doc_id for r in docs.collect()} == kept and len(kept) < before.count()
        if name == "near_dedup":
            first, kept = first_of_each_group([(r.doc_id, r.text) for r in before.collect()]), {r.doc_id for r in docs.collect()}
            assert set(first) <= kept and len(kept) <= len(first) + 0.05 * (before.count() - len(first))
        if name == "mixing":
            taken = {r.doc_id: r.whole + (r.part > 0 and 2 * r.part >= r.size) for r in mixing.mix(before).collect()}
            for doc, n in docs.groupBy("doc_id").count().collect():
                assert taken[doc] == n
            assert docs.count() == sum(taken.values())
    assert counts[0] > counts[1] >= counts[2] and counts[3] == counts[4]
    assert corpus_pipeline.run(spark, sf).count() == counts[-1]


def test_edge_documents_pass_through(spark, edge_documents, tmp_path):
    spark.createDataFrame([(1, 1), (4, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    given = {(r.doc_id, r.text) for r in edge_documents.collect()}
    for docs in (edge_documents, edge_documents.where("false")):
        empty, before = docs.limit(1).count() == 0, docs.count()
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(str(tmp_path / f"{empty}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{empty}{name}"))
            kept = [(r.doc_id, r.text) for r in docs.collect()] if i < 4 else None
            if empty:
                assert docs.count() == 0, name
            elif name == "language_id":
                # texts that are null, empty or without a letter go, and rows without an id stay
                assert {d for d, _ in kept} <= {1, 4, 5, 9, None} and {1, 4, 5} <= {d for d, _ in kept} and len(kept) <= before
            elif name == "near_dedup":
                # the same text under two ids, and twice under one, is one row, of the least id
                assert len({t for _, t in kept}) == len(kept) and 5 not in {d for d, _ in kept}
            elif name == "mixing":
                assert set(kept) <= given
            elif name == "bpe":
                assert docs.where("n_tokens > 0 AND decoded_sha256 = sha2('The quick brown fox jumps over the lazy dog.', 256)").count() == docs.where("doc_id = 1").count()
