"""The pipeline's stages, each against a plain version on its own input."""

import re

import pytest

import corpus_pipeline as pipeline
from citespan.llm import packing, quality, secrets
from citespan.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("SF", [SF, "/root/testdata/sf0.01"])
def test_stages(spark, tmp_path, SF):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = " ".join(reversed(docs.filter("doc_id = 1").first().text.split()))
    docs = docs.unionByName(spark.createDataFrame([(99999, text + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "x", 1)], docs.schema))
    columns, read = docs.columns, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        read[name], docs = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "packing":
            assert docs.columns == columns
    out = {n: {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/{n}").collect()} for n in ("quality", "near duplicates", "decontamination", "secrets")}

    labels = table(spark, SF, "labels", "doc_id", "quality")
    good = {r.doc_id for r in quality.classify(read["quality"], labels).collect() if r.score >= quality.REJECT}
    assert set(out["quality"]) == good

    def sets(t):
        w = re.findall(r"\w+", t.lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    made = {d: sets(t) for d, t in out["quality"].items()}
    root = {d: d for d in made}
    find = lambda d: d if root[d] == d else find(root[d])
    for a in made:
        for b in made:
            if a < b and (made[a] == made[b] or 5 * len(made[a] & made[b]) >= 4 * len(made[a] | made[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(out["near duplicates"]) == {find(d) for d in made}

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, t in out["near duplicates"].items() if any(i in t for i in items)}
    gone = set(out["near duplicates"]) - set(out["decontamination"])
    words = lambda t: re.findall(r"[^\W\d_]+|\d+", t.lower())
    windows = {tuple(w[i : i + 8]) for w in map(words, items) for i in range(len(w) - 7)}
    near = {d for d, t in out["near duplicates"].items() if any(tuple(w[i : i + 8]) in windows for w in [words(t)] for i in range(len(w) - 7))}
    assert dirty and dirty <= gone <= near

    assert set(out["secrets"]) == set(out["decontamination"])
    assert out["secrets"][99999].endswith(" [SECRET]\"") and not any(secrets.base_spans(t) for t in out["secrets"].values())
    assert all(t == out["secrets"][d] for d, t in out["decontamination"].items() if "[SECRET]" not in out["secrets"][d])

    pieces = docs.toPandas()
    assert set(pieces.doc_id) == set(out["secrets"]) and pieces.groupby("sequence_id").length.sum().max() <= packing.WINDOW
    assert pipeline.run(spark, SF).count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, spans array<int>, node int, KEPT_ID int, `score` double, part int, hash binary"


def test_stages_on_odd_rows(spark):
    words = "toran milile senou parer " * 30
    rows = [(1, words, "en", "s", 5, [1], 1, 1, 0.5, 1, b"x"), (1, words, "en", "s", 5, [1], 1, 1, 0.5, 1, b"x"), (2, None, None, None, None, None, None, None, None, None, None), (None, words, "en", "s", 5, None, 1, None, None, None, None), (3, "", "en", "s", 0, [], 1, 1, 0.0, 1, b""), (4, "w " * 200000, "en", "s", 1, [], 1, 1, 0.0, 1, b"")]
    for docs in (spark.createDataFrame(rows, ODD).repartition(4), spark.createDataFrame([], ODD)):
        empty = not docs.take(1)
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, SF)
            got = out.collect()
            if name == "packing":
                assert (not got) == empty
            else:
                assert out.columns == docs.columns and {r.doc_id for r in got} <= {1, 2, 3, 4, None}
                if name == "near duplicates" and not empty:
                    assert sorted((r.doc_id for r in got), key=str) == [1, 2, 4, None]
                if name == "secrets":
                    assert len(got) == (0 if empty else len(rows)) and all(r.n_chars is None for r in got if r.text is None)
