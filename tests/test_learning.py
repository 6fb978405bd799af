import numpy as np
import pytest
from pyspark.sql import functions as F

from otindex.operators.gradients import batch_gradient
from otindex.plans import dictionary as dl
from otindex.plans import index as ix
from otindex.sources.corpus import read_corpus, write_corpus
from otindex.sources.model_store import load_model, save_model
from otindex.spec import DictionarySpec, EmbeddingSpec, IndexSpec

DOCS = [[0.2, 0.2, 0.6], [0.2, 0.1, 0.7], [0.6, 0.2, 0.2]]
COST = [[0.1, 0.3, 0.2], [0.5, 0.1, 0.5], [0.4, 0.2, 0.1]]
SPEC = DictionarySpec(num_topics=2, batch_size=2, epochs=3, lr=0.1, max_iter=30)


@pytest.fixture(scope="module")
def tables(make):
    return make.histograms(DOCS, "doc_id", "word_id"), make.cost(COST)


@pytest.fixture(scope="module")
def model(tables):
    return dl.fit(*tables, SPEC)


@pytest.mark.parametrize("loss", ["squared", "linear", "regularized"])
def test_batch_gradient_by_finite_differences(spark, tables, loss):
    docs, cost = tables
    spec = DictionarySpec(num_topics=2, loss=loss, max_iter=12, tol=0.0)
    rng = np.random.default_rng(0)
    alpha, logits, h = rng.normal(size=(3, 2)), rng.normal(size=(3, 2)), 1e-5

    def run(alpha, logits):
        topics = spark.createDataFrame(
            [(k, w, float(alpha[w, k])) for k in range(2) for w in range(3)],
            "topic int, word_id int, logit double",
        )
        weights = spark.createDataFrame(
            [(d, [float(x) for x in logits[d]]) for d in range(3)], "doc_id bigint, logits array<double>"
        )
        return batch_gradient(docs, topics, weights, cost, spec)

    def losses(alpha, logits):
        return {r.doc_id: r.loss for r in run(alpha, logits)[1].collect()}

    by_topic, by_doc = run(alpha, logits)
    topic = {(r.topic, r.word_id): r.grad for r in by_topic.collect()}
    doc = {r.doc_id: r.grad for r in by_doc.collect()}
    for word, k in ((0, 0), (2, 1)):
        step = np.zeros_like(alpha)
        step[word, k] = h
        up, down = losses(alpha + step, logits), losses(alpha - step, logits)
        numeric = np.mean([(up[d] - down[d]) / (2 * h) for d in range(3)])
        assert topic[k, word] == pytest.approx(numeric, abs=1e-7)
    step = np.zeros_like(logits)
    step[:, 1] = h
    up, down = losses(alpha, logits + step), losses(alpha, logits - step)
    for d in range(3):
        assert doc[d][1] == pytest.approx((up[d] - down[d]) / (2 * h), abs=1e-7)


def test_fit_gives_distributions_and_less_loss(model):
    sums = [r.s for r in model.topics.groupBy("topic").agg(F.sum("p").alias("s")).collect()]
    assert sums == pytest.approx([1.0, 1.0])
    weights = {r.doc_id: r.weights for r in model.weights.collect()}
    assert len(weights) == 3
    assert all(sum(w) == pytest.approx(1.0) for w in weights.values())
    per_epoch = model.history.groupBy("epoch").agg(F.avg("loss").alias("l")).orderBy("epoch").collect()
    assert per_epoch[-1].l < per_epoch[0].l
    assert model.history.count() == 6


@pytest.mark.parametrize("optimizer", ["sgd", "adam", "adamw"])
def test_shared_weight_gradient_moves_all_documents_alike(tables, optimizer):
    spec = DictionarySpec(
        num_topics=2, batch_size=2, epochs=1, max_iter=10, loss="squared", weight_grad="shared",
        optimizer=optimizer, decay=0.0,
    )
    found = {r.doc_id: np.log(r.weights) for r in dl.fit(*tables, spec).weights.collect()}
    start = tables[0].select("doc_id").distinct().withColumn("l", dl.initial_logits(spec)).collect()
    shifts = [found[r.doc_id] - np.array(r.l) for r in start]
    contrasts = [s[1] - s[0] for s in shifts]
    assert contrasts == pytest.approx([contrasts[0]] * 3) and abs(contrasts[0]) > 0


def test_reconstruction_and_its_loss(model, tables):
    docs, cost = tables
    fitted = dl.reconstruct(model, cost)
    sums = [r.s for r in fitted.groupBy("doc_id").agg(F.sum("p").alias("s")).collect()]
    assert len(sums) == 3 and sums == pytest.approx([1.0] * 3, abs=0.05)
    got = {r.doc_id: r.loss for r in dl.reconstruction_loss(fitted, docs).collect()}
    p = {(r.doc_id, r.word_id): r.p for r in fitted.collect()}
    for d, column in enumerate(DOCS):
        assert got[d] == pytest.approx(sum((p[d, w] - x) ** 2 for w, x in enumerate(column)))


def test_predict_improves_the_fit(model, tables):
    docs, cost = tables
    few = dl.predict(model, docs, cost, steps=1)
    many = dl.predict(model, docs, cost, steps=60)

    def loss(weights):
        fitted = dl.reconstruct(dl.DictionaryModel(model.topics, weights, model.history, SPEC), cost)
        return dl.reconstruction_loss(fitted, docs).agg(F.sum("loss")).first()[0]

    assert loss(many) <= loss(few) + 1e-9


def test_scores(model, tables):
    topics = dl.document_scores(model)
    scores = {r.topic: r.score for r in dl.topic_scores(model.topics).collect()}
    weights = {r.doc_id: r.weights for r in model.weights.collect()}
    for r in topics.collect():
        assert r.score == pytest.approx(sum(w * scores[k] for k, w in enumerate(weights[r.doc_id])))
    assert dl.document_scores(model, tables[1], "docs").count() == 3
    with pytest.raises(ValueError):
        dl.document_scores(model, tables[1], "other")


def test_save_and_load(spark, model, tables, tmp_path):
    path = str(tmp_path / "model")
    save_model(model, path, dl.reconstruct(model, tables[1]))
    loaded = load_model(spark, path)
    assert loaded.spec == model.spec
    assert loaded.topics.exceptAll(model.topics).count() == 0
    assert loaded.weights.count() == 3
    assert spark.read.parquet(f"{path}/docs_pred").count() == 9


def test_fit_is_reproducible(model, tables):
    again = dl.fit(*tables, SPEC)
    one = {(r.topic, r.word_id): r.p for r in model.topics.collect()}
    two = {(r.topic, r.word_id): r.p for r in again.topics.collect()}
    assert one == pytest.approx(two, abs=1e-10)


def test_a_training_that_was_broken_off_goes_on(spark, model, tables, tmp_path, monkeypatch):
    """Killed in the middle of a step, and again after the last step of an epoch: the same topics."""
    folder = str(tmp_path / "training")
    whole = dl._Training.step

    def killed(self, docs, epoch, batch):
        if self.steps == 2 and (epoch, batch) == (1, 0):
            dl.gradient_rows(docs, self.dense, dl.topic_matrix(self.topics, self.dense, "value"), self.spec).count()
            raise KeyboardInterrupt
        return whole(self, docs, epoch, batch)

    monkeypatch.setattr(dl._Training, "step", killed)
    with pytest.raises(KeyboardInterrupt):
        dl.fit(*tables, SPEC, folder=folder)
    steps = []

    def counted(self, docs, epoch, batch):
        steps.append((epoch, batch))
        return whole(self, docs, epoch, batch)

    monkeypatch.setattr(dl._Training, "step", counted)
    monkeypatch.setattr(dl._Training, "close", lambda self, *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        dl.fit(*tables, SPEC, folder=folder)
    monkeypatch.undo()
    monkeypatch.setattr(dl._Training, "step", counted)
    again = dl.fit(*tables, SPEC, folder=folder)
    assert steps == [(1, 0), (1, 1), (2, 0), (2, 1)]
    one, two = ({(r.topic, r.word_id): r.p for r in m.topics.collect()} for m in (model, again))
    assert one == pytest.approx(two, abs=1e-10)
    told, expected = ([x for r in m.history.orderBy("step").collect() for x in r] for m in (again, model))
    assert told == pytest.approx(expected, abs=1e-9)
    weights = [{r.doc_id: r.weights for r in m.weights.collect()} for m in (model, again)]
    assert all(weights[0][d] == pytest.approx(weights[1][d], abs=1e-10) for d in weights[0])


@pytest.mark.parametrize("loss", ["squared", "linear", "regularized"])
@pytest.mark.parametrize("debias", [False, True])
def test_log_gradients_equal_those_of_the_kernel(spark, tables, loss, debias):
    docs, cost = tables
    rng = np.random.default_rng(3)
    topics = spark.createDataFrame(
        [(k, w, float(rng.normal())) for k in range(2) for w in range(3)], "topic int, word_id int, logit double"
    )
    weights = spark.createDataFrame(
        [(d, [float(x) for x in rng.normal(size=2)]) for d in range(3)], "doc_id bigint, logits array<double>"
    )
    found = []
    for domain in ("exp", "log"):
        spec = DictionarySpec(num_topics=2, loss=loss, debias=debias, max_iter=23, tol=0.0, reg=0.3, domain=domain)
        by_topic, by_doc = batch_gradient(docs, topics, weights, cost, spec)
        found.append(({(r.topic, r.word_id): r.grad for r in by_topic.collect()}, {r.doc_id: r for r in by_doc.collect()}))
    assert found[0][0] == pytest.approx(found[1][0], abs=1e-10)
    for d, r in found[0][1].items():
        other = found[1][1][d]
        assert r.loss == pytest.approx(other.loss, abs=1e-10) and r.grad == pytest.approx(other.grad, abs=1e-10)
        assert r.status == other.status


def test_log_gradient_on_a_steep_cost_by_finite_differences(spark, make):
    """At reg 0.001 the kernel underflows: only the log domain has a gradient."""
    cost = make.cost([[0.1, 0.8, 1.4], [0.6, 0.3, 0.9], [1.2, 0.7, 0.2]])
    docs = make.histograms([[0.4, 0.3, 0.3], [0.1, 0.8, 0.1]], "doc_id", "word_id")
    spec = DictionarySpec(num_topics=2, reg=0.001, max_iter=30, tol=0.0)
    rng, h = np.random.default_rng(4), 1e-6
    alpha, logits = rng.normal(size=(3, 2)), rng.normal(size=(2, 2))

    def run(alpha, logits):
        topics = [(k, w, float(alpha[w, k])) for k in range(2) for w in range(3)]
        weights = [(d, [float(x) for x in logits[d]]) for d in range(2)]
        return batch_gradient(
            docs, spark.createDataFrame(topics, "topic int, word_id int, logit double"),
            spark.createDataFrame(weights, "doc_id bigint, logits array<double>"), cost, spec,
        )

    def losses(alpha, logits):
        return {r.doc_id: r.loss for r in run(alpha, logits)[1].collect()}

    by_topic, by_doc = run(alpha, logits)
    assert {r.status for r in by_doc.collect()} == {"max_iter"}
    topic, doc = {(r.topic, r.word_id): r.grad for r in by_topic.collect()}, {r.doc_id: r.grad for r in by_doc.collect()}
    step = np.zeros_like(alpha)
    step[1, 0] = h
    up, down = losses(alpha + step, logits), losses(alpha - step, logits)
    assert topic[0, 1] == pytest.approx(np.mean([(up[d] - down[d]) / (2 * h) for d in range(2)]), abs=1e-5)
    step = np.zeros_like(logits)
    step[:, 1] = h
    up, down = losses(alpha, logits + step), losses(alpha, logits - step)
    for d in range(2):
        assert doc[d][1] == pytest.approx((up[d] - down[d]) / (2 * h), abs=1e-5)
    trained = dl.fit(docs, cost, DictionarySpec(num_topics=2, batch_size=2, epochs=2, reg=0.001, max_iter=30))
    assert {r.nonfinite for r in trained.history.collect()} == {0}


@pytest.mark.parametrize("fmt", ["tsv", "csv", "parquet"])
def test_corpus_round_trip(spark, tmp_path, fmt):
    texts = ['tab\there "quoted", so', "two\nlines", " blanks ", "", None, "\\N?", "a\\", '"', "#x", "é\r\nz"]
    rows = [(n, f"2020-01-{n + 1:02d} 01:02:03.456789", text) for n, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, ts string, text string").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    path = str(tmp_path / fmt)
    write_corpus(df, path, fmt)
    back = {r.doc_id: (r.ts, r.text) for r in read_corpus(spark, path, fmt).collect()}
    assert back == {r.doc_id: (r.ts, r.text) for r in df.collect()}


def test_whole_index_and_extension(spark):
    words = "bank rate market crop rain harvest the of".split()
    rng = np.random.default_rng(1)
    rows = [
        (d, f"2020-{1 + d % 4:02d}-{1 + d:02d} 00:00:00", " ".join(rng.choice(words, 12)))
        for d in range(12)
    ]
    corpus = spark.createDataFrame(rows, "doc_id bigint, ts string, text string").withColumn("ts", F.col("ts").cast("timestamp"))
    spec = IndexSpec(
        dictionary=DictionarySpec(num_topics=2, batch_size=6, epochs=1, max_iter=10),
        embedding=EmbeddingSpec(dim=3, iterations=1, min_count=1, partitions=1),
    )
    result = ix.fit_index(corpus, spec)
    series = result.index.collect()
    assert len(series) == 4
    assert np.mean([r["index"] for r in series]) == pytest.approx(100)
    assert np.std([r["index"] for r in series], ddof=1) == pytest.approx(1)
    assert {r.word for r in result.vocabulary.collect()} == set(words) - {"the", "of"}
    more = ix.extend_index(result, corpus.where("doc_id < 3"), spec, steps=3)
    assert more.count() == 3 and more.where("score is null").count() == 0


def test_bad_settings_are_refused():
    for wrong in ({"loss": "other"}, {"optimizer": "other"}, {"weight_grad": "other"}, {"epochs": 0}):
        with pytest.raises(ValueError):
            DictionarySpec(**wrong)
    with pytest.raises(ValueError):
        IndexSpec(svd_method="other")


def test_training_says_what_is_not_finite(spark, make):
    # word 2 is out of reach of the topic: its barycenter underflows, and nothing may look like a fit
    cost = make.cost([[0.0, 1.0, 900.0], [1.0, 0.0, 900.0], [900.0, 900.0, 0.0]])
    docs = make.histograms([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]], "doc_id", "word_id")
    topics = spark.createDataFrame(
        [(0, 0, 0.0), (0, 1, 0.0), (0, 2, -800.0)], "topic int, word_id int, logit double"
    )
    weights = spark.createDataFrame([(0, [0.0]), (1, [0.0])], "doc_id bigint, logits array<double>")
    spec = DictionarySpec(num_topics=1, reg=0.5, max_iter=50, debias=False, domain="exp")
    by_topic, by_doc = batch_gradient(docs, topics, weights, cost, spec)
    rows = {r.doc_id: r for r in by_doc.collect()}
    assert {r.status for r in rows.values()} == {"nonfinite"}
    assert all(r.loss is None and r.grad == [0.0] for r in rows.values())
    assert all(r.grad is None for r in by_topic.collect())


def test_a_batch_without_a_finite_document_is_an_error(spark, make):
    cost = make.cost([[0.0, 9e4], [9e4, 0.0]])
    docs = make.histograms([[0.5, 0.5], [0.2, 0.8]], "doc_id", "word_id")
    spec = DictionarySpec(num_topics=1, batch_size=2, epochs=1, reg=0.1, max_iter=20)
    try:
        model = dl.fit(docs, cost, spec)
    except RuntimeError as error:
        assert "finite" in str(error)
    else:  # whatever was solved is counted
        assert {(r.converged or 0) + r.max_iter + r.nonfinite for r in model.history.collect()} == {2}


@pytest.mark.parametrize(("optimizer", "weight_grad"), [("adamw", "per_doc"), ("sgd", "shared"), ("adam", "shared")])
def test_small_batches_are_walked_through_in_runs(tables, monkeypatch, tmp_path, optimizer, weight_grad):
    """Runs give what single steps give, and no step is a job of its own."""
    spec = DictionarySpec(**{**SPEC.__dict__, "optimizer": optimizer, "weight_grad": weight_grad, "batch_size": 1})
    single = dl.fit(*tables, spec, folder=str(tmp_path / "single"))
    monkeypatch.setattr(dl, "RUN_STEPS", 2)
    monkeypatch.setattr(dl._Training, "step", None)
    runs = dl.fit(*tables, spec)
    for name in ("topics", "weights", "history"):
        one, two = (sorted(tuple(r) for r in getattr(m, name).collect()) for m in (single, runs))
        flat = [[x for r in t for c in r for x in (c if isinstance(c, list) else [c])] for t in (one, two)]
        assert len(one) > 0 and flat[0] == pytest.approx(flat[1], abs=1e-9)


def test_the_query_trains_for_the_epochs_and_rounds_of_the_reference(spark, tmp_path, monkeypatch):
    from workloads import learning

    rows = [(s, float(q)) for s in range(70) for q in range(1, 6) for _ in range(1 + (s * q) % 4)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    fit, models = dl.fit, []
    monkeypatch.setattr(dl, "fit", lambda *a, **b: models.append(fit(*a, **b)) or models[-1])
    topics = learning.wdl_fit(spark, str(tmp_path))
    (model,) = models
    assert (model.spec.max_iter, model.spec.tol) == (1000, 1e-8)
    told = model.history.orderBy("step").collect()
    assert [(r.epoch, r.batch) for r in told] == [(e, b) for e in range(5) for b in range(2)]
    assert [r.converged + r.max_iter + r.nonfinite for r in told] == [64, 6] * 5
    by_topic = topics.groupBy("topic").agg(F.sum("p").alias("p"), F.count("*").alias("n")).collect()
    assert len(by_topic) == 3 and all(r.n == 5 and r.p == pytest.approx(1) for r in by_topic)
