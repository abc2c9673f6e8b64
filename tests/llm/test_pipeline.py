import corpus_pipeline
from murmur.llm import language, latent, packing, secrets, stages


def test_stages_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = language.fit(docs)
    guess = {i: language.judged(model, [t]) for i, t in texts.items()}
    left = {i: t for i, t in texts.items() if guess[i][0][0] != "und" and guess[i][1][0] >= language.SURE}
    after = stages.language(spark, docs, sf)
    assert {r.doc_id: r.text for r in after.collect()} == left and after.columns == docs.columns

    sets = {}
    for i, t in left.items():
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    near = [(i, j) for i in left for j in left if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    low = {i: i for i in left}
    while moved := [(i, j) for i, j in near if low[i] != low[j]]:
        for i, j in moved:
            low[i] = low[j] = min(low[i], low[j])
    left = {i: t for i, t in left.items() if low[i] == i}
    after = stages.near_duplicates(spark, after, sf)
    assert {r.doc_id: r.text for r in after.collect()} == left and after.columns == docs.columns

    items = [b" " + b" ".join(latent.words_of(r.text)) + b" " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(x in b" " + b" ".join(latent.words_of(t)) + b" " for x in items)}
    after = stages.decontamination(spark, after, sf)
    assert {r.doc_id: r.text for r in after.collect()} == left and after.columns == docs.columns

    known = secrets.Known(secrets.learn(secrets.credentials(after)))
    left = {i: secrets.masked(t, secrets.spans(t, known)[1]) for i, t in left.items()}
    after = stages.secrets(spark, after, sf)
    rows = after.collect()
    assert {r.doc_id: r.text for r in rows} == left and all(r.n_chars == len(r.text) for r in rows)

    pieces = stages.packing(spark, after, sf).collect()
    encode = packing.encoder()
    total = {i: len(encode(t)) + 1 for i, t in left.items()}
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == total


def test_run_applies_the_stages_and_survives_odd_rows(spark, tmp_path):
    rows = [(i, f"some plain words about number {i} and what follows it there", "en", "s", 9) for i in range(30)]
    rows += [(50, None, "en", "s", 1), (51, "", None, None, None), (None, "words without a number of their own", None, "s", 3), (3, rows[3][1], "en", "s", 9)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "words without a number of their own")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert found <= set(range(30)) and len(found) > 20
    assert len(corpus_pipeline.STAGES) == 5


def test_run_over_nothing(spark, sf, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
