"""The pipeline's stages on a small corpus, against what brute force keeps."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    words = {"en": "the and of with this house water".split(), "fr": "le la une avec cette maison ete".split()}
    rows = []
    for k in range(60):
        lang = ["en", "fr"][k % 2]
        rows.append((k, " ".join(words[lang][(k * 5 + j * j + j * k) % 7] + (str(k) if j % 5 == 0 else "") for j in range(60)), lang, f"s{k % 3}", 1))
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[1][1].replace("maison", "maison", 1) + " fin", "fr", "s1", 1), (102, "12 34", None, None, 1), (103, None, None, None, None), (104, "the water and password=abcdef99 of this house " * 3, "en", "s0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) == {r[0] for r in rows} - {102, 103}
    assert set(kept[1]) == set(kept[0]) - {0}  # of equal texts the largest id stays
    assert 1 in kept[2] and 101 not in kept[2]  # a near copy goes

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in kept[1].items()}
    alone = {i for i in sets if not any(j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)}
    assert alone <= set(kept[2])
    assert set(kept[3]) == set(kept[2]) and "abcdef99" not in kept[3][104]
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert {r.doc_id for r in pieces.collect()} == set(kept[3]) and pieces.where("n <> all").count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() > 0
