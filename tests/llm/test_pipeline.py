import random

import corpus_pipeline
import public_tokenizers
from llm_helpers import awkward_texts, syllables

from shelfwise.llm import lsi_decontamination, quality_lm, secret_scan, sentencepiece_bpe, simhash_dedup


def tables(spark, folder, rows, labels, bench):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    rng = random.Random(11)
    bench = [syllables(rng, 30) for _ in range(4)]
    texts = [syllables(rng, rng.randint(40, 120)) for _ in range(120)]
    texts += [texts[0], texts[1], texts[1] + "", "".join(chr(rng.randint(33, 120)) for _ in range(400)), texts[5] + " " + bench[0] + " " + texts[6],
              "password=abcdef123456 " + syllables(rng, 1500), None, "", None]
    ids = [*range(len(texts) - 2), None, None]
    rows = [(i, t, ("en", "de", None)[k % 3], "s", len(t) if t is not None else None, "clash") for k, (i, t) in enumerate(zip(ids, texts))]
    labels = [(k, 1, 0) for k in range(0, 110)]
    return rows, labels, list(enumerate(bench))


def test_stages_against_their_operators_and_brute_force(spark, tmp_dir):
    rows, labels, bench = corpus()
    tables(spark, tmp_dir, rows, labels, bench)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    at, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, tmp_dir).write.parquet(f"{tmp_dir}/stage{k}")
        after = spark.read.parquet(f"{tmp_dir}/stage{k}")
        if k < 4:
            assert after.columns == docs.columns
        seen[k] = {"in": at.collect(), "out": after.collect()}
        at = after

    def texts(part, k):
        return sorted((str(r.doc_id), str(r.text)) for r in seen[k][part])

    # 1: noise goes, nothing else but what the model rejects
    verdict = {(r.doc_id, r.lang): r.kept for r in quality_lm.classify(docs, spark.read.parquet(f"{tmp_dir}/labels.parquet")).collect() if r.doc_id is not None}
    assert {r.doc_id for r in seen[0]["out"]} - {None} == {d for (d, _), kept in verdict.items() if kept}
    assert 123 not in {r.doc_id for r in seen[0]["out"]} and len(seen[0]["out"]) >= len(rows) - 8
    # 2: one of each group, the least id, as brute force has it
    from test_simhash import plainly, reached

    ids = [r for r in seen[1]["in"] if r.doc_id is not None]
    least = {}
    for r in ids:
        f = plainly(r.text)
        least[f] = min(r.doc_id, least.get(f, r.doc_id))
    root = reached({d: f for f, d in least.items()}, 4)
    assert {r.doc_id for r in seen[1]["out"]} - {None} == set(root.values())
    assert len(seen[1]["out"]) == len(set((r.doc_id, r.text) for r in seen[1]["out"]))
    # 3: the planted item's document goes
    assert {r.doc_id for r in seen[2]["in"]} - {r.doc_id for r in seen[2]["out"]} == {124}
    # 4: secrets are marked
    assert len(seen[3]["in"]) == len(seen[3]["out"])
    marked = {r.doc_id: r for r in seen[3]["out"]}[125]
    assert marked.text.startswith("[secret] ") and marked.n_chars == len(marked.text)
    assert all(secret_scan.base_spans(r.text or "") == [] for r in seen[3]["out"])
    # 5: the library's tokens
    lib = sentencepiece_bpe.encoder(public_tokenizers.path("piece_bpe_32k.model")).library
    want = sorted((str(r.doc_id), lib.encode(r.text or "")) for r in seen[3]["out"])
    assert sorted((str(r.doc_id), r.ids) for r in seen[4]["out"]) == want and all(r.n_tokens == len(r.ids) and r.decodes for r in seen[4]["out"])
    # run() is the same
    assert sorted((str(r.doc_id), r.ids) for r in corpus_pipeline.run(spark, tmp_dir).collect()) == want


def test_empty_tables_go_through(spark, tmp_dir):
    tables(spark, tmp_dir, [], [], [])
    assert corpus_pipeline.run(spark, tmp_dir).count() == 0


def test_rows_of_one_id_and_text_and_clashing_columns(spark, tmp_dir):
    """Of rows that differ in other columns only the least stays, however they are dealt; columns named like the stages' own come back."""
    rng = random.Random(2)
    text = syllables(rng, 60)
    rows = [(1, text, lang, source, 7, f"own {lang}", "mine", {"a": lang}) for lang, source in (("en", "z"), ("de", "b"), ("de", "a"), (None, "q"))]
    rows += [(5, syllables(rng, 50), "en", "s", 7, "x", "y", {"b": "c"}), (None, syllables(rng, 40), "en", "s", 7, "x", "y", None)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    spark.createDataFrame([(1, syllables(rng, 30))], "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __key string, __lang string, more map<string,string>")
    for parts in (1, 5):
        out = corpus_pipeline.near_duplicates(spark, docs.repartition(parts), tmp_dir)
        assert out.columns == docs.columns
        got = {r.doc_id: r for r in out.collect()}
        assert set(got) == {1, 5, None} and (got[1].lang, got[1].source, got[1]["__key"], got[1].more) == (None, "q", "own None", {"a": None})
    for stage in (corpus_pipeline.quality, corpus_pipeline.decontamination, corpus_pipeline.secrets):
        out = stage(spark, docs, tmp_dir)
        assert out.columns == docs.columns and {r["__key"] for r in out.collect()} <= {r[5] for r in rows}
    assert corpus_pipeline.secrets(spark, docs.drop("n_chars"), tmp_dir).count() == 6
