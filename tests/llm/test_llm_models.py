"""The learned classifiers, and the pipeline as a whole."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import line_crf, toxicity_chain
from quillmill.llm import stages as corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


def labelled(spark, n=300):
    """Clean lines against shouted and marked ones; some rude words."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    docs, marks = [], []
    for k in range(n):
        bad, rude = k % 4 == 0, k % 5 == 0
        lines = []
        for _ in range(r.randint(1, 8)):
            words = [word() for _ in range(12)]
            if rude:
                words[r.randrange(12)] = r.choice(["zounds", "drat", "fie"])
            line = " ".join(words)
            lines.append(line.upper().replace(" ", "!! ") if bad else line.capitalize() + ".")
        docs.append((k, "\n".join(lines)))
        marks.append((k, 0 if bad else 1, int(rude)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "Some words."), (4, "line of words\n" * 20_000), (5, "Twice."), (5, "Twice.")]
    return spark.createDataFrame([(*row, 9.0, "x") for row in rows], "doc_id long, text string, score double, p_toxic string")


def brute_marginals(field, features):
    """Sum over all labellings of a short document."""
    scores = np.clip((features - field.mean) / field.spread, -8, 8) @ field.emit
    n = len(scores)
    weights = np.zeros((n, 2))
    for labelling in range(1 << n):
        y = [(labelling >> i) & 1 for i in range(n)]
        s = field.begin[y[0]] + sum((scores[i] if y[i] else -scores[i]) / 2 for i in range(n)) + sum(field.move[y[i], y[i + 1]] for i in range(n - 1))
        for i in range(n):
            weights[i, y[i]] += np.exp(s)
    return weights / weights.sum(1, keepdims=True)


def test_forward_backward_equals_brute_force():
    r = np.random.default_rng(1)
    width = 5
    field = line_crf.Field(np.zeros(width), np.ones(width), r.standard_normal(width), r.standard_normal((2, 2)), r.standard_normal(2))
    counts = np.array([3, 1, 6, 2])
    features = r.standard_normal((counts.sum(), width))
    p, _, _ = field.marginals(features, counts)
    at = 0
    for n in counts:
        assert np.allclose(p[at : at + n], brute_marginals(field, features[at : at + n]))
        at += n


def test_line_classifier(spark):
    docs, labels = labelled(spark)
    field = line_crf.fit(docs, labels.where("doc_id % 3 <> 1"))
    scored = line_crf.score(docs, field).join(labels, "doc_id").where("doc_id % 3 = 1").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in scored]) > 0.97
    edges = edge_rows(spark)
    rows = line_crf.score(edges, field).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 5}) == 1
    assert rows[0]["p_toxic"] == "x"
    assert line_crf.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in line_crf.score(edges, None).collect()} == {0.5}
    assert line_crf.score(edges.limit(0), field).count() == 0


def test_document_scores_equal_brute_force(spark):
    docs, labels = labelled(spark)
    field = line_crf.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 40").collect()} | {900: "", 901: "\n\n", 902: "One.\n\nTWO!! " + "long " * 50}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for row in line_crf.score(table, field).collect():
        features, lengths, counts = line_crf.text_features([texts[row["doc_id"]]])
        good = brute_marginals(field, features)[:, 1]
        share = min(max(sum(g * n for g, n in zip(good, lengths, strict=True)) / sum(lengths), 1e-6), 1 - 1e-6)
        assert counts.tolist() == [len(features)]
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-(field.slope * math.log(share / (1 - share)) + field.level))), abs=1e-6)


def plain_probability(model, row):
    z = model["level"] + sum(model["weights"].get(name, 0.0) * value for name, value in row.items())
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def plain_linear(rows, marks):
    """Penalised logistic regression by Adam, a number at a time; rows are dictionaries."""
    names = sorted({name for row in rows for name in row})
    share = sum(marks) / len(marks)
    model = {"weights": dict.fromkeys(names, 0.0), "level": math.log(share / (1 - share))}
    slow, fast = dict.fromkeys([*names, None], 0.0), dict.fromkeys([*names, None], 0.0)
    for step in range(1, 151):
        slope = {name: -2e-4 * model["weights"][name] for name in names} | {None: 0.0}
        for row, mark in zip(rows, marks, strict=True):
            error = (mark - plain_probability(model, row)) / len(rows)
            slope[None] += error
            for name, value in row.items():
                slope[name] += error * value
        for name, g in slope.items():
            slow[name] += 0.1 * (g - slow[name])
            fast[name] += 0.01 * (g * g - fast[name])
            move = 0.05 * (slow[name] / (1 - 0.9**step)) / (math.sqrt(fast[name] / (1 - 0.99**step)) + 1e-9)
            if name is None:
                model["level"] += move
            else:
                model["weights"][name] += move
    return model


def test_chain_equals_one_written_plainly(spark):
    """Vocabulary, out-of-fold inputs, both models of the chain and its probabilities."""
    r = random.Random(3)
    common = ["alpha", "beta", "gamma", "delta", "zounds", "drat"]
    texts, marks = {}, {}
    for k in range(60):
        words = [r.choice(common) for _ in range(r.randint(1, 5))]
        texts[k] = " ".join(words) + "!" * r.randint(0, 2)
        shouted = int(r.random() < (0.8 if "alpha" in words else 0.2))
        marks[k] = (shouted, int(r.random() < (0.9 if "zounds" in words or shouted else 0.1)))
    texts[58], texts[59] = "", "ALPHA rare"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, *m) for k, m in marks.items()], "doc_id long, shouted int, toxic int")
    chain = toxicity_chain.fit(docs, labels, ["shouted", "toxic"])

    held = {w: sum(w in re.findall("[a-z]+", t.lower()) for t in texts.values()) for t in texts.values() for w in re.findall("[a-z]+", t.lower())}
    known = {w for w, n in held.items() if n >= toxicity_chain.MIN_DOCS}
    assert set(chain.vocabulary) == known

    def row_of(text):
        n = max(1, len(text))
        numbers = {"#length": math.log1p(len(text)) / 10, "#upper": sum(c.isupper() for c in text) / n, "#marks": 10 * text.count("!") / n}
        return dict.fromkeys(known & set(re.findall("[a-z]+", text.lower())), 1.0) | numbers

    rows = {k: row_of(t) for k, t in texts.items()}
    fitted = {k: dict(row) for k, row in rows.items()}
    fold = {k: ((k * 0x9E3779B97F4A7C15 % 2**64) >> 33) % toxicity_chain.FOLDS for k in rows}
    models = []
    for at in (0, 1):
        guesses = {}
        for f in range(toxicity_chain.FOLDS):
            inside = [k for k in rows if fold[k] != f]
            model = plain_linear([fitted[k] for k in inside], [marks[k][at] for k in inside])
            guesses |= {k: plain_probability(model, fitted[k]) for k in rows if fold[k] == f}
        models.append(plain_linear(list(fitted.values()), [marks[k][at] for k in rows]))
        for k in rows:
            fitted[k][f"#{at}"] = guesses[k]
    got = {s["doc_id"]: (s["p_shouted"], s["p_toxic"]) for s in toxicity_chain.score(docs, chain).collect()}
    for k, row in rows.items():
        first = plain_probability(models[0], row)
        second = plain_probability(models[1], row | {"#0": first})
        assert got[k] == pytest.approx((first, second), abs=2e-3)


def test_toxicity_chain(spark):
    docs, labels = labelled(spark, 600)
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("shouted"), "toxic")
    chain = toxicity_chain.fit(docs, marks.where("doc_id % 3 <> 1"), ["shouted", "toxic"])
    assert len(chain.models[1].weights) == len(chain.models[0].weights) + 1
    rows = toxicity_chain.score(docs, chain).join(marks, "doc_id").where("doc_id % 3 = 1").collect()
    for k, name in enumerate(["shouted", "toxic"]):
        assert np.mean([(r[f"p_{name}"] >= chain.limits[k]) == (r[name] == 1) for r in rows]) > 0.95
    edges = toxicity_chain.score(edge_rows(spark), chain)
    assert edges.count() == 7 and edges.where("p_toxic is null or p_toxic < 0 or p_toxic > 1").count() == 0
    assert toxicity_chain.score(edge_rows(spark).limit(0), chain).count() == 0
    single = toxicity_chain.fit(docs, marks.withColumn("toxic", F.lit(0)), ["toxic"])
    assert all(r["p_toxic"] < 0.05 for r in toxicity_chain.score(docs, single).collect())


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], SF_DIR), name))
    return out


def test_stages_keep_columns_and_clean_documents(spark, stages):
    for table in stages[1:-1]:
        assert table.columns == stages[0].columns
    counts = [t.count() for t in stages[:-1]]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 0
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").where("quality = 1")
    good = stages[0].join(labels, "doc_id", "left_semi")
    lost = good.join(stages[1], "doc_id", "left_anti").count()
    assert lost <= 0.03 * good.count()


def test_each_stage_decides_on_its_own_input(spark, stages):
    from quillmill.llm import decision_lists, minhash_dedup, suffix_dedup

    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    judged = decision_lists.statistics(stages[2].select("doc_id", "text")).where(decision_lists.base_failed())
    assert judged.count() == 0
    found = minhash_dedup.near_duplicates(stages[2])
    assert ids(stages[3]) == ids(found.where("kept"))
    again = suffix_dedup.repeats(stages[3]).select("doc_id", "kept_text").collect()
    changed = {r["doc_id"]: r["kept_text"] for r in again if r["kept_text"] is not None}
    assert changed
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    assert {r["doc_id"]: r["text"] for r in stages[4].collect()} == before | changed
    assert ids(stages[5]) == ids(stages[4])


def test_pipeline_on_edge_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "word " * 60), (3, "a b " * 40), (4, None), (4, None)]
    extra = ["row", "text_hash", "group", "_text", "_nth", "h", "w", "found"]
    clean = " ".join(f"word{k}" for k in range(200))
    rows += [(k, clean) for k in range(10, 14)] + [(20, clean + " and one more"), (21, "x " + "y" * 200_000)]
    table = spark.createDataFrame([(i, t, "en", "src0", 1, "kept", 0.5, *extra) for i, t in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long, score string, rule double, "
                                  + ", ".join(f"{name} string" for name in extra))
    for part in (table, table.limit(0)):
        folder = str(tmp_path / f"in{part.count()}")
        part.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{SF_DIR}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
            assert docs.columns == table.columns
            assert docs.select("score", "rule", *extra).distinct().collect() in ([], [("kept", 0.5, *extra)])
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == corpus_pipeline.run(spark, folder).count()
