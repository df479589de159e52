"""Every operator and stage, with fitted models, on null, empty, very long, tied and repeated rows, null and repeated ids, clashing names and empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontamination, embeddings, language_id, packing, quality, secrets, simhash, substring_dedup, token_counts, toxicity
from tidemark.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
LONG_WORD, MANY = "aB3" * 100_000, "the long and winding road of words goes on " * 15_000
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, LONG_WORD), (5, MANY), (6, "one two three"), (6, "one two three"), (6, "four five six seven"), (7, "one two three"), (None, "an orphan row of text"), (None, None), (8, "é́ 中文　x"), (9, "<|endoftext|> 12 34")]
KIND = "doc_id long, text string, lang string, source string, n_chars long, label int, score string, id string, node long, _id string, found string, `a.b` double"


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y", 5, "z", "w", 0.5) for i, t in rows], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def operators(spark, docs):
    """name -> (function of a documents frame, columns of its result)."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("text", F.lit("clash")).withColumn("score", F.lit(1))
    labels = labels.unionByName(labels).unionByName(labels.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    language = language_id.fit(docs, vocabulary("piece_bpe_32k.model"), per_language=40)
    toxic, good, field = toxicity.fit(docs, labels), quality.fit(docs, labels), secrets.fit(docs, made=600, rounds=30)
    bench = spark.createDataFrame([(1, "one two three", 1.0, "k"), (1, "one two three", 1.0, "k"), (None, "four five six seven", 1.0, "k"), (2, None, 1.0, "k"), (3, "", 1.0, "k"), (4, "the long and winding road of words goes on", 1.0, "k")], "item_id long, text string, doc_id double, key string")
    return {
        "language": lambda d: language_id.identify(d, language), "packing": lambda d: packing.best_fit(d, vocabulary("word_bpe_49k.json")), "toxicity": lambda d: toxicity.score(d, toxic), "decontamination": lambda d: decontamination.overlaps(d, bench),
        "simhash": simhash.near_duplicates, "similar": simhash.similar, "counts": lambda d: token_counts.token_counts(d, vocabulary("byte_bpe_50k.json")), "secrets": lambda d: secrets.scan(d, field), "quality": lambda d: quality.score(d, good), "substring": substring_dedup.substring_dedup,
    }


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_models_are_fitted_from_repeated_labels(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    once, twice = quality.fit(docs, labels), quality.fit(docs.unionByName(docs), labels.unionByName(labels))
    assert (once.weights == twice.weights).all()
    torn = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")))
    assert quality.fit(docs, torn) is None  # every id has both labels


@pytest.mark.parametrize("name", ["language", "packing", "toxicity", "simhash", "similar", "counts", "secrets", "quality", "substring"])
def test_every_row_gives_a_row_and_equal_texts_fare_alike(spark, operators, name):
    got = operators[name](frame(spark))
    pieces = got.collect()
    if name == "packing":
        pieces = [r for r in pieces if r["piece"] == 0]
    assert sorted(str(r["doc_id"]) for r in pieces) == sorted(str(i) for i, _ in TEXTS)
    own = [c for c in got.columns if c not in ("doc_id", "sequence_id", "offset", "component_id", "n_removed", "kept_sha256")]
    twins = {}
    for r in pieces:
        twins.setdefault(r["doc_id"], []).append(tuple(str(r[c]) for c in own))
    assert len(set(twins[6])) <= 2 and set(twins[7]) <= set(twins[6]) and twins[2] == twins[3] or name in ("counts",)


@pytest.mark.parametrize("name", ["language", "packing", "toxicity", "decontamination", "simhash", "similar", "counts", "secrets", "quality", "substring"])
def test_empty_documents(spark, operators, name):
    assert operators[name](frame(spark, [])).count() == 0


def test_defined_results(spark, operators):
    d = frame(spark)
    language = {r["doc_id"]: r for r in operators["language"](d).collect()}
    assert all(language[k]["lang_pred"] == "und" and language[k]["score"] == 0 for k in (1, 2, 3)) and language[4]["lang_pred"] != "und"
    assert all(r["score"] == pytest.approx(sum(x["score"] for x in operators["quality"](frame(spark, [(1, "")])).collect())) for r in operators["quality"](frame(spark, [(1, None), (2, " ")])).collect())
    assert rows_of(operators["toxicity"](frame(spark, [(1, None), (2, "")])), "evidence", "passages") == [(0.0, []), (0.0, [])]
    assert rows_of(operators["secrets"](frame(spark, [(1, None), (2, "")])), "doc_id", "found") == [(1, []), (2, [])]
    assert rows_of(operators["decontamination"](d), "doc_id", "item_id", "n_words") == [(5, 4, 9), (6, 1, 3), (7, 1, 3)]
    alike = {r["doc_id"]: r["component_id"] for r in operators["simhash"](frame(spark, [(1, None), (2, ""), (3, " "), (None, "x y"), (5, "p q"), (6, "P  q")])).collect()}
    assert alike == {1: 1, 2: 1, 3: 1, None: None, 5: 5, 6: 5}


def test_rows_of_one_id_with_different_texts_are_different_documents(spark, operators):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(900)]
    a, b = " ".join(rng.choices(words, k=300)), " ".join(rng.choices(words, k=40))
    rows = [(5, a), (5, b), (5, a), (6, f"{b} tail"), (7, a)]
    got = rows_of(operators["substring"](frame(spark, rows)), "doc_id", "n_words", "n_removed")
    assert got == [(5, 300, 0), (5, 300, 0), (5, 40, 0), (6, 41, 40), (7, 300, 300)]
    split = rows_of(operators["substring"](frame(spark, [(1, b), (1, f"{b} {b}"), (2, None)])), "doc_id", "n_words", "n_removed")
    assert sorted(n for _, n, _ in split) == [0, 40, 80] and sum(r for *_, r in split) == 80  # one of three copies stays


def test_ties_at_thresholds(spark):
    d = frame(spark, [(1, "some words here")])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for module, model in ((quality, quality.fit(d, labels)), (toxicity, toxicity.fit(d, labels))):
        own = module.score(d, model).first()["score"]
        assert [module.score(d, model, threshold=t).first()["predicted"] for t in (own, own + 1e-9)] == [1, 0]


def test_empty_reference_tables(spark, docs):
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert quality.fit(docs, labels.where("false")) is None and toxicity.fit(docs.where("false"), labels) is None
    assert decontamination.overlaps(docs, bench.where("false")).count() == 0
    empty = language_id.fit(docs.where("false"), vocabulary("piece_bpe_32k.model"))
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}
    nothing = secrets.fit(docs.where("false"))
    assert all(s["kind"] != "crf" for r in secrets.scan(docs, nothing).collect() for s in r["found"])
    assert embeddings.near_duplicates(spark.read.parquet(f"{SF}/embeddings.parquet").where("false")).count() == 0


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edge_rows_and_empty_documents(spark, stage, tmp_path):
    name, f = stage
    for rows in ([], TEXTS):
        path = str(tmp_path / f"{len(rows)}")
        frame(spark, rows).write.parquet(path)
        out = f(spark, spark.read.parquet(path), SF)
        if name == "best-fit packing":
            assert out.where("piece = 0").count() == len(rows)
            continue
        assert out.columns == frame(spark).columns
        kept = sorted(str(r["doc_id"]) for r in out.collect())
        if name == "SimHash near-dedup":
            assert kept == (sorted(map(str, [1, 4, 5, 6, 6, 8, 9, None])) if rows else [])
        elif name != "quality classifier":
            assert kept == sorted(str(i) for i, _ in rows)
        if name == "secret scans" and rows:
            assert sorted(str(r["n_chars"]) for r in out.collect()) == sorted(str(len(r["text"])) if r["text"] is not None else "None" for r in out.collect())


def test_decontamination_stage_examines_rows_without_an_id(spark):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    d = frame(spark, [(None, f"x {passage} y"), (None, "clean"), (3, passage), (3, "clean too")])
    assert sorted(r["text"] for r in corpus_pipeline.decontaminate(spark, d, SF).collect()) == ["clean", "clean too"]


def test_folder_is_required_on_a_cluster(spark):
    from types import SimpleNamespace

    from tidemark.llm.common import shared_dir

    conf = SimpleNamespace(get=lambda _: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://somewhere:7077")))
    assert hashlib.sha256(shared_dir(spark).encode()).hexdigest()
