"""Steps that have to stay cheap at size: what is computed once, what never passes through the driver."""

import random

import numpy as np
from pyspark.sql import functions as F

from meterline import lineage
from meterline.functions import labels
from meterline.operators import groups, knn, repeats, students, synthetic
from tests.test_datasets import dataset, log


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_label_words_are_cut_once(spark):
    frame = spark.range(1).select(F.col("id").cast("string").alias("s"))
    named = frame.select(labels.normalize_label_canonical(F.col("s"), ["top-up", "lost card", "wait"]).alias("label"))
    assert optimized(named).count("regexp_extract_all(") == 1
    assert optimized(named).count("<think>") == 1


def test_synthetic_texts_are_squeezed_once(spark):
    data = dataset.build_dataset(log(spark, dict(prompt_redacted="a  b"))).withColumn("split", F.lit("train"))
    made = synthetic.synthetic_rows(data, "now")
    assert optimized(made).count("regexp_replace(input") == 1
    assert sorted(r["input"] for r in made.collect()) == [
        "Demande reformulee sans changer l'intention:\na b", "Message utilisateur:\na b"]


def test_linked_rows_broadcast_nothing(spark):
    rng = random.Random(5)
    rows = [(f"r{i}", f"c{rng.randrange(40)}") for i in range(60)]
    split = groups.leak_free_split(spark.createDataFrame(rows, "id string, c string"), "id", [F.col("c")])
    assert "Broadcast" not in split._jdf.queryExecution().executedPlan().toString()
    least = {c: min(r for r, d in rows if d == c) for _, c in rows}
    assert {r.id: r.component for r in split.collect()} == {r: least[c] for r, c in rows}


def test_near_repeats_write_no_texts(spark):
    words = [f"w{i}" for i in range(40)]
    texts = {"a": " ".join(words), "b": " ".join([*words, "more"]), "c": "some other text that is not alike"}
    rows = [(t, h, x) for t in ("t", "u") for h, x in texts.items() if (t, h) != ("u", "b")]
    before = len(lineage.folders())
    found = repeats.near_repetitive_tasks(spark.createDataFrame(rows, "task_id string, input_hash string, prompt_redacted string"))
    assert {r.task_id: r.near_inputs for r in found.collect()} == {"t": 2, "u": 0}
    made = [f.rpartition("/")[2].partition("-")[0] for f in lineage.folders()[before:]]
    assert "shingles" in made and "inputs" not in made


def test_best_of_rows_is_a_stable_sort():
    rng = np.random.default_rng(1)
    for n, m, k in ((50, 7, 3), (40, 200, 6), (20, 4096, 6), (20, 96, 6), (9, 1, 1)):
        scores = np.round(rng.normal(size=(n, m)), 1)
        row, column = knn._best_of_rows(scores, k)
        assert (column.reshape(n, k) == np.argsort(-scores, axis=1, kind="stable")[:, :k]).all()
        assert (row == np.repeat(np.arange(n), k)).all()


def test_vocabulary_breaks_ties_by_name(spark):
    frame = spark.createDataFrame([(["b", "a", "d"],), (["c", "a", "d"],), (["c", "b", "e", "e"],)], "_grams array<string>")
    assert students._vocabulary(frame, students.StudentSpec(vocab_size=3)).vocabulary == ["a", "b", "c"]
    both = students._vocabulary(frame, students.StudentSpec("tfidf_mlp"))
    assert both.vocabulary == ["a", "b", "c", "d"]  # "e" is in one text only
