import numpy as np

from tallymast.llm import common, quality

from .conftest import FOLDER


def test_flat_trees_walk_like_plain_ones():
    draw = np.random.RandomState(1)
    x = draw.normal(size=(500, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.3) ^ (x[:, 7] > 0)).astype(float)
    model = quality.fit_trees(x, y, trees=20)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95

    def one(row):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (row[feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x[:50]), [one(r) for r in x[:50]])


def test_held_out_documents(spark):
    folder = FOLDER.replace("0.001", "0.1")
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    model = quality.fit(docs, labels)
    rows = docs.where(common.held_out()).select("doc_id", quality.score("text", model).alias("s")).join(labels, "doc_id").toPandas()
    assert ((rows["s"] >= 0.3) == (rows["quality"] == 1)).mean() > 0.98


def test_odd_rows_and_no_rows(spark, odd, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    for docs, lab in ((odd, labels), (odd, labels.limit(0)), (no_docs, labels)):
        kept = quality.keep_good(docs, lab, least=0.0)
        assert kept.columns == docs.columns and kept.count() == docs.count()
        scores = [r[0] for r in docs.select(quality.score("text", quality.fit(docs, lab))).collect()]
        assert all(0 <= s <= 1 for s in scores)
