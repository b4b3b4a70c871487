import numpy as np
from conftest_llm import rows_of
from pyspark.sql import functions as F

from oscilla.llm import ranker

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = ranker.query(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels.filter("quality is not null"), "doc_id").filter("held_out").collect()
    assert len(rows) > 60 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_special_rows(spark, docs):
    good, bad = "The quick brown fox jumped over a lazy dog. It was late.", "*** $$$ *** $$$ *** ### ### ###"
    rows = [(k, good + f" word{k}") if k % 2 else (k, bad + "$" * (k % 7)) for k in range(60)] + [(None, good), (101, None), (102, ""), (103, bad * 20_000), (1, good + " word1")]
    marks = labelled(spark, [(k, k % 2, 0) for k in range(60)] + [(None, 1, 0), (101, None, 1), (999, 1, 0)])
    df = docs(rows)
    got = ranker.op10(df, marks).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[None].predicted == 1 and by[None].held_out is False and by[101].score == by[102].score and by[103].predicted == 0
    assert all(by[k].predicted == k % 2 for k in range(60))
    left = ranker.accepted(df, marks)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} >= {k for k in range(1, 60, 2)}
    assert ranker.op10(df.filter("false"), marks).count() == 0


def test_nothing_to_learn_from_keeps_all(spark, docs):
    df = docs([(1, "a"), (2, "*** $$$")])
    for marks in (labelled(spark, [(1, 1, 0)]), labelled(spark, [(1, 1, 0)]).filter("false")):
        assert all(v[1:] == (1.0, 1) for v in rows_of(ranker.op10(df, marks)).values())


def test_labels_that_are_held_out_teach_nothing(spark, docs):
    import zlib

    rows = [(k, "good text here." if k % 3 else "*** ***") for k in range(80)]
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    true = [(k, int(k % 3 > 0), 0) for k, _ in rows]
    turned = [(k, 1 - q if k in held else q, t) for k, q, t in true]
    assert held and rows_of(ranker.op10(docs(rows), labelled(spark, true))) == rows_of(ranker.op10(docs(rows), labelled(spark, turned)))


def test_pairs_order_the_classes():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 0] + 0.1 * rng.random(400) > 0.6).astype(int)
    score = ranker.fit(x, y).score(x)
    assert (score[y == 1][:, None] > score[y == 0][None]).mean() > 0.98


def test_same_weights_as_plain_descent():
    """Newton's steps end where gradient descent on the same loss does: the mean logistic loss of the pairs' differences plus the ridge."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.8 * rng.normal(size=120) > 0).astype(int)
    made = ranker.fit(x, y, pairs=500, seed=5, ridge=0.05)
    z = ranker.expanded(x, made.edges, made.mean, made.scale)
    assert made.edges.shape == (2, ranker.BINS - 1) and np.allclose(made.edges[0], [np.quantile(x[:, 0], k / 8) for k in range(1, 8)])
    draw = np.random.default_rng(5)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[draw.choice(good, 500)] - z[draw.choice(bad, 500)]
    loss = lambda w: np.log1p(np.exp(-(d @ w))).mean() + 0.025 * w @ w
    w = np.zeros(z.shape[1])
    for _ in range(20_000):
        w -= 0.2 * (-(d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(0) + 0.05 * w)
    np.testing.assert_allclose(made.weights, w, atol=1e-4)
    assert loss(made.weights) <= min(loss(w + 0.01 * draw.normal(size=len(w))) for _ in range(20))
    # the threshold is the raw scores' quantile at the share of label 0
    assert made.threshold == np.quantile(z @ made.weights, (y == 0).mean())


def test_scores_of_a_query_by_hand(spark):
    """Every score of the table, from features computed again text by text."""
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150"), spark.read.parquet(f"{SF}/labels.parquet")
    model = ranker.learn(docs, marks)
    got = rows_of(ranker.op10(docs, marks))
    for r in docs.collect():
        x = np.clip(np.array(ranker.features(r.text)), model.low, model.high)
        raw = ((x - model.mean) / model.scale) @ model.weights[: len(x)]
        raw += sum(model.weights[len(x) + k * (ranker.BINS - 1) + j] for k in range(len(x)) for j in range(ranker.BINS - 1) if x[k] > model.edges[k][j])
        z = np.clip((raw - model.threshold) / model.spread + np.log(0.7 / 0.3), -30, 30)
        assert abs(got[r.doc_id][1] - 1 / (1 + np.exp(-z))) < 1e-9


def test_all_rows_and_all_pairs_teach(spark):
    """The weights are those of plain descent on the loss of every pair of every row."""
    rng = np.random.default_rng(4)
    x = np.zeros((90, len(ranker.FEATURES)))
    x[:, :3] = rng.normal(size=(90, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.8 * rng.normal(size=90) > 0).astype(int)
    rows = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x, strict=True)], "y int, x array<double>").repartition(3).localCheckpoint()
    made = ranker.fit_all(rows, ridge=0.05)
    assert np.allclose(made.edges[:3], [np.quantile(x[:, f], [k / 8 for k in range(1, 8)]) for f in range(3)])
    z = ranker.expanded(x, made.edges, x.mean(0), np.where(x.std(0) == 0, 1, x.std(0)))
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    assert len(d) == (y == 1).sum() * (y == 0).sum()
    w = np.zeros(z.shape[1])
    for _ in range(4000):
        w -= 0.2 * (-(d * (1 / (1 + np.exp(d @ w)))[:, None]).mean(0) + 0.05 * w)
    np.testing.assert_allclose(made.weights, w, atol=1e-4)
    raw = z @ made.weights
    assert abs(made.threshold - np.quantile(raw, (y == 0).mean())) < 1e-9 and abs(made.spread - raw.std() / 4) < 1e-9
    assert (made.low == x.min(0)).all() and (made.high == x.max(0)).all()


def test_no_labelled_row_is_left_out(spark, docs):
    """More labels than the 20,000 that a fit used to take; each label and document is a row."""
    known = spark.range(30_000).select(F.col("id").alias("doc_id"), F.array(*[F.lit(0.0)] * len(ranker.FEATURES)).alias("x"))
    marks = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    rows = ranker.labelled_features(known, marks)
    assert rows.count() == marks.filter(ranker.remainder(F.col("doc_id"), 4) != 2).count() > 20_000
