"""The pipeline stage by stage, and the registration of its queries."""

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from runwatch.llm import queries, shared, toxicity

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.QUERIES) | {"pipeline"} <= names


def test_stages_keep_columns_and_their_decisions_hold(spark):
    docs = shared.documents(spark, SF)
    names, inputs, outputs = docs.columns, [], []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        inputs.append(docs)
        docs = shared.stored(stage(spark, docs, SF))
        outputs.append(docs)
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == names
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in (inputs[0], *outputs)]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    scores = toxicity.toxicity(inputs[0], shared.labels(spark, SF)).toPandas()
    assert ids[1] == set(scores[scores["predicted"] == 0]["doc_id"])
    assert ids[2] == {r.doc_id for r in outputs[0].collect() if r.text and any(c.isalpha() for c in r.text)}
    pieces = outputs[-1].toPandas()
    assert (pieces.groupby("sequence_id")["length"].sum() <= 2048).all()
    whole = pipeline.run(spark, SF).toPandas()
    assert len(whole) == len(pieces) and set(whole["doc_id"]) == set(pieces["doc_id"])


def test_copies_at_the_limit_of_the_stage_go(spark):
    words = [f"w{k}" for k in range(400)]
    near, far = list(words), list(words)
    for k in range(8):  # each takes five of the 396 shingles
        near[25 + 43 * k] = f"n{k}"
    for k in range(16):
        far[12 + 25 * k] = f"f{k}"
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (words, near, far)]
    alike = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert 0.8 < alike[0] < 0.85 and alike[1] < 0.75
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((words, near, far))],
                                 "doc_id long, text string")
    assert {r.doc_id for r in pipeline.without_copies(spark, docs, SF).collect()} == {0, 2}


def test_empty_documents_pass_every_stage(spark):
    docs = shared.documents(spark, SF).limit(0)
    for _, stage in pipeline.STAGES:
        docs = shared.stored(stage(spark, docs, SF))
    assert docs.count() == 0
