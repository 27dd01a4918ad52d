"""Every stage against its own operator's brute-force facts, on a small corpus with clashing columns."""

import importlib

import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, f in pipeline.STAGES:
        out.append((name, f(spark, out[-1][1], SF).cache()))
    return dict(out)


def test_stages_keep_the_columns(stages):
    names = list(stages)
    assert names == ["documents", "toxicity", "simhash_dedup", "secrets", "mixing", "sentencepiece"]
    assert all(stages[n].columns == stages["documents"].columns for n in names[:-1])


def first_of_each_group(rows):
    """Ids that stay: five-word shingle sets, similarity 0.8 or more, by brute force over all pairs."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c < "\x80" else c for c in text or "").split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = {i: i for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and (sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) > 0):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root[i]] = min(least.get(root[i], doc_id), doc_id)
    return sorted(least.values())


def test_each_decision_takes_effect(spark, stages):
    from ledgerbeam.llm import mixing, secrets, toxicity

    ids = {n: [r["doc_id"] for r in df.select("doc_id").collect()] for n, df in stages.items()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(stages["documents"], labels)
    assert set(ids["toxicity"]) == {r["doc_id"] for r in toxicity.score(stages["documents"], model).collect() if r["score"] < 0.5}
    assert sorted(ids["simhash_dedup"]) == first_of_each_group([(r["doc_id"], r["text"]) for r in stages["toxicity"].collect()])
    assert sorted(ids["secrets"]) == sorted(ids["simhash_dedup"])
    assert not any(secrets.base_spans(r["text"]) for r in stages["secrets"].collect())
    drawn = mixing.draws(mixing.sized_rows(stages["secrets"])).collect()
    assert sorted(ids["mixing"]) == sorted(r["doc_id"] for r in drawn for _ in r["copies"])
    assert sorted(ids["sentencepiece"]) == sorted(ids["mixing"])


def test_tokens_decode_to_the_texts(spark, stages):
    from pyspark.sql import functions as F

    want = stages["mixing"].select("doc_id", F.sha2("text", 256).alias("s")).distinct()
    got = stages["sentencepiece"].select("doc_id", F.col("decoded_sha256").alias("s")).distinct()
    assert want.exceptAll(got).count() == got.exceptAll(want).count() == 0


def test_nulls_empty_texts_repeated_rows_and_clashing_columns(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    big = 2**53 + 1
    rows = [(i, f"plain words number {i} " + " ".join(f"w{i}x{j}" for j in range(30)), "en", "ab"[i % 2], 5, i, "x") for i in range(40)]
    rows += [(None, None, None, None, None, None, None), (None, "", "en", "a", 0, 1, "x"), (big, "one of its kind " * 8000, "en", None, 1, big, "x"), (7, rows[7][1], "en", "b", 5, 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, mix_shard string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for given in (docs, docs.where("false")):
        out = given
        for name, f in pipeline.STAGES:
            before, out = out, f(spark, out, str(tmp_path))
            if name != "sentencepiece":
                assert out.dtypes == docs.dtypes
            found = out.collect()
            assert bool(found) == bool(before.count())
            if name == "simhash_dedup" and found:
                kept = [r["doc_id"] for r in found]
                assert kept.count(None) == 2 and big in kept and kept.count(7) == 2
                assert [r["score"] for r in found if r["doc_id"] == big] == [big]
        assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def rows_of_a_batch(spark):
    """Sets the rows of an Arrow batch, and sets them back after the test."""
    given = spark.conf.get(ROWS)
    yield lambda n: spark.conf.set(ROWS, str(n))
    spark.conf.set(ROWS, given)


def largest_batch(spark):
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    return max(r["n"] for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect())


@pytest.mark.parametrize("stage", ["drop_toxic", "drop_near_copies", "mask_secrets", "encode"])
def test_stages_hand_python_small_batches(spark, rows_of_a_batch, stage):
    """10,000 whole texts at a time fill an executor beside its workers."""
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for given, most in ((10_000, 2048), (0, 2048), (300, 300)):
        rows_of_a_batch(given)
        getattr(pipeline, stage)(spark, docs, SF)
        assert largest_batch(spark) == most


def test_batches_of_any_size_give_the_same(spark, stages, rows_of_a_batch):
    pipeline = importlib.import_module("corpus_pipeline")
    rows_of_a_batch(7)
    before = stages["documents"]
    for name, f in pipeline.STAGES:
        got = f(spark, before, SF)
        assert sorted(map(str, got.collect())) == sorted(map(str, stages[name].collect())), name
        before = stages[name]
