import pytest

import corpus_pipeline
from readloom.llm import bpe_tree
from readloom.llm.common import table

from test_minhash import brute_groups

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        made.write.parquet(f"{folder}/{len(out)}")
        before, docs = docs, spark.read.parquet(f"{folder}/{len(out)}")
        out[name] = before, docs
    return out


def test_columns(stages):
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns
    assert after.count() > 0


def test_filters_keep_whole_rows(stages):
    for name in ("quality classifier", "language ID", "near-dedup"):
        before, after = stages[name]
        assert set(rows_of(after)) <= set(rows_of(before)) and after.count() > 0.5 * before.count()


def test_one_of_each_group_stays(spark, stages):
    before, after = stages["near-dedup"]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    firsts = {rows[i][0] for i in brute_groups([t for _, t in rows])}  # by the similarity of all pairs
    assert sorted(r.doc_id for r in after.collect()) == sorted(firsts)


def test_repeated_rows_are_near_copies(spark, tmp_path):
    docs = table(spark, SF, "documents").limit(20)
    docs.unionByName(docs).unionByName(docs.selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/d")
    kept = corpus_pipeline.without_near_copies(spark, spark.read.parquet(f"{tmp_path}/d"), SF)
    assert kept.count() == kept.select("text").distinct().count() == docs.select("text").distinct().count()


def test_mix_repeats_rows(stages):
    before, after = stages["mix"]
    assert set(rows_of(after)) <= set(rows_of(before))
    counts = after.groupBy("doc_id").count().toPandas()["count"]
    assert counts.max() == 2 and after.count() != before.count()


def test_last_stage_and_run(spark, stages):
    before, after = stages["BPE"]
    assert sorted(r.doc_id for r in before.collect()) == sorted(r.doc_id for r in after.collect())
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect()))


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.fixture
def repacked(spark, tmp_path, monkeypatch):
    """A folder of many files, and a way to make later scans pack them otherwise."""
    key = "spark.sql.files.minPartitionNum"
    text = lambda i: " ".join(f"{i}Wort{k}" for k in range(6000 if i % 5 == 0 else 20 + i % 7))
    rows = [(i, text(i), "de", "ab"[i % 2], i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(12).write.parquet(f"{tmp_path}/d")
    spark.conf.set(key, "1")
    yield spark.read.parquet(f"{tmp_path}/d"), lambda: spark.conf.set(key, "12")
    spark.conf.unset(key)


def test_mix_joins_rows_by_written_numbers(spark, repacked, monkeypatch):
    docs, repack = repacked
    mix, taken = corpus_pipeline.mixing.mix, {}

    def then_repack(*args, **named):
        made = mix(*args, **named).persist()
        taken.update({r.doc_id: r.copies for r in made.collect() if r.copies})
        repack()
        return made

    monkeypatch.setattr(corpus_pipeline.mixing, "mix", then_repack)
    got = corpus_pipeline.mixed_sources(spark, docs, SF).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == taken


def test_near_dedup_joins_rows_by_written_numbers(spark, repacked, monkeypatch):
    docs, repack = repacked
    module = getattr(corpus_pipeline, "minhash", None) or corpus_pipeline.simhash
    near_copies, firsts = module.near_copies, set()

    def then_repack(*args):
        made = near_copies(*args).persist()
        firsts.update(r.component_id.doc_id for r in made.collect())
        repack()
        return made

    monkeypatch.setattr(module, "near_copies", then_repack)
    kept = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == firsts


def test_long_texts_join_by_written_keys(repacked):
    docs, repack = repacked
    made = bpe_tree.encode_decode(docs, corpus_pipeline.vocabulary("word_bpe_49k.json"), 1 << 15)
    repack()
    assert sorted(r.doc_id for r in made.collect()) == list(range(60))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "monotonically_increasing_id" not in plan


def test_near_dedup_groups_by_fingerprints_first(spark, tmp_path, monkeypatch):
    """The stage runs op5's operator on every row, and what its groups propose is linked before any key is looked at."""
    docs, seen = table(spark, SF, "documents").limit(40), []
    near_copies, compared = corpus_pipeline.simhash.near_copies, corpus_pipeline.minhash._compared
    docs.unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "concat(text, ' ', text) as text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/d")

    def noted(texts):
        made = near_copies(texts)
        seen.append(made.count())
        return made

    def pairs_noted(pairs, sets):
        seen.append(pairs.count())
        return compared(pairs, sets)

    monkeypatch.setattr(corpus_pipeline.simhash, "near_copies", noted)
    monkeypatch.setattr(corpus_pipeline.minhash, "_compared", pairs_noted)
    kept = corpus_pipeline.without_near_copies(spark, spark.read.parquet(f"{tmp_path}/d"), SF)
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/d").collect())
    assert seen[0] == 80 and seen[1] > 0
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[i][0] for i in brute_groups([t for _, t in rows])})
