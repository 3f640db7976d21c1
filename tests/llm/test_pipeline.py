"""The pipeline against a plain version of each stage, on the rows that the stage before it kept."""

from collections import Counter

import corpus_pipeline as P
from test_ngram_join import brute
from turnstone.llm import decontam, mixing, sharding, toxicity


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    now = docs
    for name, stage in P.STAGES:
        stage(spark, now, sf_dir).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = now.collect()
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    assert all(kept[n] == [] or list(kept[n][0].asDict()) == columns for n in names[:-1])

    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    distances = toxicity.Distances(model.toxic, model.ordinary)
    clean = [r for r in docs.collect() if model.score(distances.of(r.text)[None, :])[0] < toxicity.THRESHOLD]
    assert Counter(clean) == Counter(kept["toxicity"])

    classes, _, _ = brute([(r.doc_id, r.text) for r in clean])
    single = [r for r, c in zip(clean, classes) if c == r.doc_id]
    assert Counter(single) == Counter(kept["ngram_join"])

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    import pyarrow as pa

    hit = {row for row, *_ in decontam.Matcher(items).hits(pa.array([r.text for r in single], pa.string()))}
    unleaked = [r for i, r in enumerate(single) if i not in hit]
    assert Counter(unleaked) == Counter(kept["decontamination"])

    slim, decisions, _ = mixing.mix(spark.createDataFrame(unleaked, docs.schema))
    copies = {r.id: r.copies for r in mixing.copies_of(slim, decisions).collect()}
    assert Counter(kept["mixing"]) == Counter({r: copies[r.doc_id] for r in unleaked if copies[r.doc_id]})

    assert len(kept["sharding"]) == len(kept["mixing"]) and {r["shard"] for r in kept["sharding"]} <= set(range(sharding.SHARDS))
    assert Counter(P.run(spark, sf_dir).collect()) == Counter(kept["sharding"])


def test_stages_take_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string, score double, v double, id long"
    rows = [(None, None, None, None, None, "x", 1.0, 1.0, 1), (1, "", "en", "s", 0, "x", 1.0, 1.0, 1), (2, "word " * 50_000, "en", "s", 1, "x", 1.0, 1.0, 1), (3, "a b c d e f", "en", "t", 1, "x", 1.0, 1.0, 1), (3, "a b c d e f", "en", "t", 1, "x", 1.0, 1.0, 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in P.STAGES:
            out = stage(spark, table, sf_dir)
            assert set(table.columns) <= set(out.columns) and out.count() <= 3 * table.count(), name
