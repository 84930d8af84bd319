import corpus_pipeline


def test_stages_on_a_small_corpus(spark, tmp_path):
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    clean = ["\n".join(" ".join(word() for _ in range(20)) for _ in range(4)) for _ in range(60)]
    junk = [" ".join(w + "***" for w in t.split()) for t in clean[:20]]
    item = " ".join(word() for _ in range(30))
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)] + [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(junk)]
    docs += [(200, clean[3], "en", "s", 1), (201, clean[5] + "\n" + item, "en", "s", 1), (202, "start " + item + " end of it", "en", "s", 1), (203, None, "en", "s", None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, columns).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontaminate", "mixing"]
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {x["doc_id"] for x in out.collect()}
    assert set(range(60)) - {3, 5} <= ids and not ids & {*range(100, 120), 202}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "rate"]
