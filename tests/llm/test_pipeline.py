import public_tokenizers
import pytest

import corpus_pipeline
from tallyloom.llm import common, quality, rules, simhash
from tests.llm.test_quality import ngrams
from tests.llm.test_simhash import fingerprint


def representatives(rows):
    """One row of each component, by comparing all pairs of fingerprints."""
    prints = [fingerprint(r.text) for r in rows]
    label = {p: p for p in prints}
    moved = True
    while moved:
        moved = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    moved = True
    best = {}
    for r, p in zip(rows, prints):
        key = (r.doc_id is None, r.doc_id or 0, p - (p >> 63 << 64))
        if label[p] not in best or key < best[label[p]][0]:
            best[label[p]] = (key, r)
    return [r for _, r in best.values()]


def test_stages(spark, awkward, empty, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for frame in (docs, awkward, empty):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, sf)
            assert out.columns == now.columns
            rows, kept = [tuple(r) for r in now.select("doc_id", "text").collect()], sorted(map(str, out.collect()))
            if name == "quality classifier":
                verdicts = {(r.doc_id, r.n_ngrams, r.log_weight): r.kept for r in quality.resample(now, labels).collect()}
                want = [r for r in now.collect() if any(k and i == r.doc_id and n == len(ngrams(r.text)) for (i, n, _), k in verdicts.items())]
            elif name == "quality rules":
                list_ = rules.learn_rules(docs, labels)
                good = {(r.doc_id, r.n_words) for r in rules.statistics(now).withColumn("bad", rules.base_failed()).withColumn("rule", rules.verdict(list_)).where("NOT bad AND rule IS NULL").collect()}
                want = [r for r in now.collect() if (r.doc_id, len((r.text or "").split())) in good]
            else:
                want = representatives(now.collect())
            assert kept == sorted(map(str, want)), name
            now = spark.createDataFrame(out.collect(), out.schema)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.where("length > 0").select("doc_id").distinct().count() > 50
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 4
    assert public_tokenizers.path("word_bpe_49k.json")


def test_rows_of_one_id(spark):
    """Unlike texts of one id are judged apart; helper names may be taken."""
    copy, other = "same text here it is", "something else entirely now and here"
    names = "doc_id long, text string, fp string, row int, digest string, rows__ int, id__ int, row__ int, gone__ int"

    def kept(*rows):
        df = spark.createDataFrame([(*r, "x", 1, "y", 2, 3, 4, 5) for r in rows], names)
        out = simhash.keep_representatives(df)
        assert out.columns == df.columns
        return sorted((str(r.doc_id), r.text) for r in out.collect())

    assert kept((1, copy), (1, copy), (2, copy), (None, copy), (3, other)) == [("1", copy), ("3", other)]
    assert kept((3, copy), (3, other)) == [("3", copy), ("3", other)]
    assert kept((1, copy), (3, copy), (3, other)) == [("1", copy), ("3", other)]
    assert kept((None, copy), (None, copy), (None, other)) == [("None", copy), ("None", other)]
    assert kept((None, None), (None, ""), (7, " ")) == [("7", " ")]


def test_rows_without_an_id_are_weighed_one_by_one(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    marked = docs.join(labels, "doc_id")
    some = marked.where("quality = 1").orderBy("doc_id").limit(5).unionByName(marked.where("quality = 0").orderBy("doc_id").limit(5)).selectExpr("CAST(NULL AS long) AS doc_id", "text", "lang", "source", "n_chars")
    both = docs.unionByName(some)
    want = quality.resample(both, labels).where("kept AND doc_id IS NULL").count()
    assert 0 < want < 10 and quality.keep_documents(both, labels).where("doc_id IS NULL").count() == want


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

            class _jsc:
                class sc:
                    class getCheckpointDir:
                        isDefined = staticmethod(lambda: False)

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(Session)
