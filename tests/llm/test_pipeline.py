import random

import pytest

import corpus_pipeline
from quire.llm import catalog

VOCABULARY = [a + b for a in "ba de fi go hu ka le mi no pu ra se ti vo xu za".split() for b in "l m n r s t k b".split()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(VOCABULARY) for _ in range(n))
    rows = {i: text(rng.randint(40, 120)) for i in range(300)}
    labels = []
    for i in range(0, 300, 2):
        toxic = i % 8 == 0
        if toxic:
            rows[i] += " grub vermin " + text(5) + " vermin grub"
        labels.append((i, 1, int(toxic)))
    item = text(30)
    passage = text(60)
    rows[301], rows[303] = text(30) + " " + item, item[:-1]
    rows[305], rows[307] = text(50) + " " + passage, text(55) + " " + passage
    rows[309], rows[311] = rows[1], rows[1] + " zak"
    rows[313], rows[315], rows[317] = None, "", passage
    path = tmp_path_factory.mktemp("pipeline")
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows.items()], kind).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, passage


def test_each_stage_takes_effect(spark, folder, tmp_path):
    path, rows, passage = folder
    docs, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "best_fit_packing":
            assert docs.columns == columns
    toxic = {i for i in range(0, 300, 8)}
    assert len(toxic & set(kept["toxicity"])) <= 3
    assert len(set(range(300)) - toxic - set(kept["toxicity"])) <= 6
    a, b, c, d, e = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert {1, 305, 307, 317} <= set(b) and 309 not in b
    assert len({313, 315} & set(b)) == 1  # equal fingerprints of texts without words
    assert c[305]["text"] == rows[305] and passage not in c[307]["text"] and 317 not in c
    assert c[307]["n_chars"] == len(c[307]["text"]) and len(c[307]["text"].split()) == 55
    assert c[303]["text"] == rows[303].split()[-1]  # the rest of 303 starts earlier, in 301
    assert 301 in c and set(d) == set(c) - {301} and set(e) == set(d)


def test_run_returns_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 200


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES) == list(range(1, 11))
