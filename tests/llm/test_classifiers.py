import zlib

import numpy as np
import pytest

from lintlake.llm import quality, toxicity
from lintlake.llm.learning import labelled

SF = "/root/testdata/sf0.1"
CASES = [(toxicity, "toxic", 3, 1, 0.7), (quality, "quality", 5, 0, 0.3)]


def model_of(spark, module, column, modulus, held, docs=None, labels=None):
    docs = docs if docs is not None else spark.read.parquet(f"{SF}/documents.parquet")
    labels = labels if labels is not None else spark.read.parquet(f"{SF}/labels.parquet")
    return module.train(labelled(docs, labels, column, modulus, held))


@pytest.mark.parametrize("module,column,modulus,held,threshold", CASES)
def test_held_out_accuracy_and_odd_rows(spark, module, column, modulus, held, threshold):
    model = model_of(spark, module, column, modulus, held)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in module.score(docs, model).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == held) and r["predicted"] == int(r["score"] >= threshold) and 0 <= r["score"] <= 1
               for i, r in rows.items())
    truth = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    test = [(rows[i]["score"], rows[i]["predicted"], y) for i, y in truth.items() if rows[i]["held_out"]]
    right = np.mean([p == y for _, p, y in test])
    ones, zeros = [s for s, _, y in test if y], [s for s, _, y in test if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones[:400] for b in zeros[:400]])
    clean = np.mean([p == 0 for _, p, y in test if not y])
    print(column, "accuracy", right, "auc", auc, "zeros kept", clean, "ones found", np.mean([p for _, p, y in test if y]))
    assert right > 0.93 and auc > 0.93
    odd = spark.createDataFrame([(1, None, 5, "x"), (2, "", 5, "x"), (None, "some words", 5, "x"), (3, "y " * 100_000, 5, "x"), (3, "y " * 100_000, 5, "x")],
                                "doc_id long, text string, score int, y string")
    got = module.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("module,column,modulus,held,threshold", CASES)
def test_labels_of_held_out_rows_are_not_seen(spark, module, column, modulus, held, threshold):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(300)] + [(None, 1, 1), (4, 1, 1), (8, None, None)], "doc_id long, toxic int, quality int")
    docs = spark.createDataFrame([(i, f"word{i} " * 3) for i in range(300)], "doc_id long, text string")
    ids = {r["doc_id"] for r in labelled(docs, labels, column, modulus, held).collect()}
    assert ids == {i for i in range(300) if zlib.crc32(str(i).encode()) % modulus != held and i != 4}
    assert labelled(docs, labels, column, modulus, held, 10).count() == 10


def test_a_repeated_id_brings_one_row(spark):
    docs = spark.createDataFrame([(2, f"text {i % 50}") for i in range(4000)] + [(i, "x") for i in range(3, 60)] + [(61, None)] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(2, 0)] * 5, "doc_id long, toxic int")
    got = [tuple(r) for r in labelled(docs, labels, "toxic", 3, 1, 40).collect()]
    assert len(got) == len({r[0] for r in got}) <= 40
    every = [tuple(r) for r in labelled(docs, labels, "toxic", 3, 1).collect()]
    assert len(every) == len({r[0] for r in every}) and sorted(every) == sorted(tuple(r) for r in labelled(docs.repartition(5), labels, "toxic", 3, 1).collect())


@pytest.mark.parametrize("module,column,modulus,held,threshold", CASES)
def test_no_labels_no_rows(spark, module, column, modulus, held, threshold):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    model = model_of(spark, module, column, modulus, held, docs, labels)
    assert module.score(docs, model).count() == 2 and module.score(docs.limit(0), model).count() == 0


def test_label_model_discounts_copies_and_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.8, 0.05), (0.6, 0.02), (0.3, 0.3))], axis=1)
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], axis=1)
    noisy = np.where(rng.random(4000) < 0.02, ~y, y).astype(int)
    model, q = toxicity.fit_label_model(votes, noisy, trust=0.98)
    assert model.share[0] < 0.4 and model.share[1] > 1.5 * model.share[0] and model.fired[0] > 2 and abs(model.fired[2]) < 0.3
    assert np.mean((q > 0.5) == y) > 0.97


def test_dual_descent_is_optimal():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 8, replace=False)) for _ in range(60)]
    y = np.array([1 if 3 in r or 5 in r else 0 for r in rows])
    r = rng.normal(size=40)
    w = quality.dual_descent(rows, r, y, 1.0, 2000)
    x = np.zeros((60, 40))
    for i, at in enumerate(rows):
        x[i, at] = r[at] / np.linalg.norm(r[at])
    s = np.where(y == 1, 1, -1)
    cost = 0.5 / np.where(y == 1, y.mean(), 1 - y.mean())

    def loss(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - s * (x @ v))).sum()

    assert all(loss(w) <= loss(w + rng.normal(size=40) * e) + 1e-2 for e in (1e-3, 1e-2, 0.1) for _ in range(200))
