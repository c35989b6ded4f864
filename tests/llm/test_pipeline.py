"""The corpus pipeline against its stages' own brute-force laws, on a small planted corpus."""

import random
import sys
import zlib
from pathlib import Path

import pytest

from .conftest import prose

ROOT = str(Path(__file__).resolve().parents[2])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    path = tmp_path_factory.mktemp("corpus")
    item = prose(rng, 30)
    texts, toxic, junk = {}, set(), set()
    for k in range(260):
        w = prose(rng, rng.randint(40, 90)).split()
        if k % 6 == 0:
            w[rng.randrange(len(w))] = rng.choice(["vilestuff", "vilething", "vilest"])
            toxic.add(k)
        elif k % 7 == 0:
            w = [x + "***" for x in w]
            junk.add(k)
        texts[k] = " ".join(w)
    clean = [k for k in texts if k not in toxic | junk]
    leak, base = clean[0], clean[1]
    texts[leak] += " " + item.upper()
    copies = [260, 261, 262]
    for c in copies:
        texts[c] = texts[base] + f" end{c}"
    texts[263], texts[264] = None, "short text"
    docs = [(k, t, "en", "src", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, int(k not in junk), int(k in toxic)) for k in range(260)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    gone = toxic | junk | {leak, 263, 264} | set(copies)
    return str(path), set(texts) - gone, texts


def test_pipeline_keeps_clean_documents_only(spark, folder):
    sys.path.insert(0, ROOT)
    import corpus_pipeline

    path, want, texts = folder
    rows = corpus_pipeline.run(spark, path).collect()
    got = {r.doc_id for r in rows}
    assert len(got ^ want) <= 3 and all(zlib.crc32(str(k).encode()) % 5 == 0 for k in got ^ want)
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        assert r.length <= 4096
    assert all(lengths[r.doc_id] == r.doc_tokens for r in rows)


def test_stages_return_the_columns_of_documents(spark, folder):
    import corpus_pipeline

    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
