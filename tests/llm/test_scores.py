import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudgrain.llm import quality, toxicity
from cloudgrain.llm.text import FOLDED, Words

BIG = "/root/testdata/sf0.1"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize("query, label, least", [(quality.op9_quality, "quality", 0.98), (toxicity.op7_toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, query, label, least):
    got = query(spark, BIG)
    assert got.count() == spark.read.parquet(f"{BIG}/documents.parquet").count()
    rows = got.join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(rows[label].to_numpy(), rows.score.to_numpy()) > least
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    # Both predictions are made: the threshold means something.
    assert rows.predicted.nunique() == 2


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_rows(spark, module, edge, empty):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(11)] + [(3, 1, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(edge, labels, F.lit(True))
    rows = module.score(edge, model).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert module.score(empty, model).count() == 0
    nothing = module.fit(empty, labels.where("false"), F.lit(True))
    assert [r.score for r in module.score(edge, nothing).collect()] == [0.5] * edge.count()


def test_labels_of_held_out_rows_do_not_matter(spark, sf):
    """Scores stay the same when labels of held-out rows are turned round."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    one, two = (dict(map(tuple, toxicity.score(docs, toxicity.fit(docs, x, ~held)).collect())) for x in (labels, turned))
    assert max(abs(one[k] - two[k]) for k in one) < 1e-9


def test_what_the_counts_of_toxicity_hold(spark):
    """The shared backoff counts every document; class counts leave out only the rows that the curve uses."""
    docs = spark.createDataFrame([(i, f"common word{i % 5}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    for most, least, top in ((100, 1840, 1960), (20_000, 1650, 1850)):
        c = toxicity.fit(docs, labels, F.lit(True), most).load().counts
        root = toxicity._bucket(toxicity._ROOT)
        assert c["below_every"][root] == 8000 and least < (c["below_toxic"][root] + c["below_ordinary"][root]) / 2 < top


def test_the_driver_holds_count_tables_packed(spark):
    docs = spark.createDataFrame([(i, f"common word{i % 5}") for i in range(100)], "doc_id long, text string")
    counts = toxicity.fit_counts(docs, spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, label int"))
    # Unpacked, each of the tables has 8 MB.
    assert len(counts) == 8 and all(sum(len(packed) for _, packed in parts) < 1 << 17 for parts in counts.values())
    tables = toxicity.Model(spark, counts).load().counts
    root = toxicity._bucket(toxicity._ROOT)
    assert all(t.shape == (1 << toxicity.NODE_BITS,) for t in tables.values()) and tables["below_every"][root] == 200 and tables["below_toxic"][root] == 100


def test_probabilities_of_steps_sum_to_one():
    """The steps after a prefix share all of its probability, up to the shared backoff's smoothing."""
    texts = [b"idiot idiots idiotic idea ideas ideal"] * 9 + [b"plain words of other kinds idea"] * 9
    w = Words(texts, FOLDED)
    word, parent, node = toxicity._steps(w)
    assert len(set(node.tolist())) == len({*(w.word(i) for i in range(len(w)))}) + len({w.word(i)[:n] for i in range(len(w)) for n in toxicity.PREFIXES if len(w.word(i)) > n})
    # A word's steps are counted once each, the first after the empty prefix.
    assert (parent == toxicity._ROOT).sum() == len(w)


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(9)
    model = quality.Ftrl(8)
    for _ in range(3000):
        place = rng.integers(1, 200, 12)
        model.learn(np.append(0, np.unique(place)), np.ones(len(np.unique(place)) + 1), int((place < 20).any()))
    w = model.weights()
    assert w[1:20].mean() > 0.5 > abs(w[20:200].mean()) and (w == 0).sum() > 50


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_conflicting_labels(spark, sf, module, label):
    """A doc_id with several labels has the greatest, so the order of the rows does not matter."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", label)
    twice = labels.unionByName(labels.where("doc_id % 3 = 0").withColumn(label, F.lit(1)))
    most = labels.withColumn(label, F.when(F.col("doc_id") % 3 == 0, 1).otherwise(F.col(label)))
    tables = (twice.orderBy("doc_id").repartition(2), twice.orderBy(F.desc("doc_id")).repartition(7), most)
    scores = [dict(map(tuple, module.score(docs, module.fit(docs, t, F.lit(True))).collect())) for t in tables]
    assert all(max(abs(scores[0][k] - s[k]) for k in s) < 1e-6 for s in scores[1:])


def brute_quality(texts, labelled, xxhash):
    """Scores by FTRL over dictionaries, one coordinate after another; ``labelled``: {doc_id: label}."""
    features = {}
    for i, t in texts.items():
        owner, place, value = quality.features([(t or "").encode()])
        features[i] = list(zip(place.tolist(), value.tolist()))
    order = {i: xxhash[i] for i in labelled}
    shard = {i: (order[i] >> 20) % (8 * quality.SHARDS) for i in labelled}
    apart = [i for i in labelled if shard[i] < quality.SHARDS]
    weights, total = {}, 0
    for s in range(quality.SHARDS):
        own = sorted((i for i in labelled if shard[i] >= quality.SHARDS and shard[i] % quality.SHARDS == s), key=lambda i: order[i])
        z, n = {}, {}

        def w(p):
            if abs(z.get(p, 0.0)) <= quality.L1:
                return 0.0
            return -(z[p] - np.sign(z[p]) * quality.L1) / ((quality.BETA + n[p] ** 0.5) / quality.ALPHA + quality.L2)

        for _ in range(quality.EPOCHS):
            for i in own:
                now = {p: w(p) for p, _ in features[i]}
                error = 1 / (1 + np.exp(-sum(now[p] * v for p, v in features[i]))) - labelled[i]
                for p, v in features[i]:
                    g = error * v
                    sigma = ((n.get(p, 0.0) + g * g) ** 0.5 - n.get(p, 0.0) ** 0.5) / quality.ALPHA
                    z[p] = z.get(p, 0.0) + g - sigma * now[p]
                    n[p] = n.get(p, 0.0) + g * g
        for p in z:
            weights[p] = weights.get(p, 0.0) + w(p) * len(own)
        total += len(own)
    margin = {i: sum(weights.get(p, 0.0) / total * v for p, v in features[i]) for i in texts}
    if len({labelled[i] for i in apart}) < 2:
        return {i: 1 / (1 + np.exp(-m)) for i, m in margin.items()}
    bias, scale = quality.curve(np.array([[1.0, margin[i]] for i in apart]), np.array([float(labelled[i]) for i in apart]))
    return {i: 1 / (1 + np.exp(-(bias + scale * m))) for i, m in margin.items()}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_ftrl_scores_by_hand(spark, folder):
    """Every score, without the calibration (one class left for it) and with it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = dict(map(tuple, quality.score(docs, quality.fit(docs, labels, F.lit(True))).collect()))
    labelled = {r.doc_id: r.quality for r in labels.collect()}
    hashed = dict(map(tuple, docs.select("doc_id", F.xxhash64(F.lit("quality"), F.col("doc_id"))).collect()))
    want = brute_quality({r.doc_id: r.text for r in docs.collect()}, {i: y for i, y in labelled.items() if i in hashed}, hashed)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-4
