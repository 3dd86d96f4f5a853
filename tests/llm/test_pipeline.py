import corpus_pipeline as C
from netlytics.llm import quality
from test_dedup import brute_components, brute_lines
from test_web_and_chat import brute_contamination


def test_stages_against_brute_force(spark, tmp_path, texts):
    """Each stage on all that the stage before it kept, with the classifier's verdicts from the same trained model."""
    prose = "plain words of an ordinary text that says something about the weather and the river in the valley"
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(1000 + i, f"{prose} {i} " * (1 + i % 3), "en", "s", 0) for i in range(60)] + [(2000 + i, "BUY$$$ NOW### |||| " * (3 + i % 5), "en", "s", 0) for i in range(60)]
    labels = [(i, 1, 0) for i in range(1000, 1060)] + [(i, 0, 0) for i in range(2000, 2060)]
    items = [(1, " ".join(f"bench{i}" for i in range(20)))]
    rows.append((3000, "Intro words. " + items[0][1] + " and the end.", "en", "s", 0))
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), max_labelled=3000)
    state = sorted((r.doc_id, r.text) for r in docs.collect() if model.scores([(r.text or "").encode()])[0] >= 0.5)
    found = []
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, folder), "test")
        found.append(name)
        if name == "line dedup":
            kept = brute_lines([t for _, t in state], 20, 3)  # positions order documents as ids do
            state = [(d, kept[i][2] if kept[i][1] else t) for i, (d, t) in enumerate(state)]
        elif name == "near copies":
            label = brute_components([t for _, t in state], 5, 80, 100)
            state = [x for i, x in enumerate(state) if label[i][1] == i]
        elif name == "decontamination":
            verdict = brute_contamination(state, items, 13)
            state = [x for x in state if not verdict[x[0]][3]]
        if name != "packing":
            assert docs.columns == names
            assert sorted((r.doc_id, r.text or "") for r in docs.collect()) == [(d, t or "") for d, t in state], name
        else:
            assert {r.doc_id for r in docs.collect()} == {d for d, _ in state}
    assert found == ["quality", "line dedup", "near copies", "decontamination", "packing"]
    assert 3000 not in {d for d, _ in state}
