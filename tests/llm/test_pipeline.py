import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from graywether.llm.queries import word_vocabulary

from .fixtures import empty, odd
from .test_mixing_simhash import brute_alike, check_mix
from .test_privacy import brute as brute_spans
from .test_sharding_quality import measures


def stages(spark, docs, tmp_path):
    """Every stage's rows, each written and read again."""
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        f(spark, out[-1], "").write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    return out


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_stages_against_brute_force(spark, sf_dir, tmp_path, which):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if which == "documents" else odd(spark)
    made = stages(spark, docs, tmp_path)
    assert all(df.columns == docs.columns for df in made[:-1])
    rows = [df.collect() for df in made]
    good = [r for r in rows[0] if not measures(r.text)[5]]
    if which == "documents":
        assert Counter(map(str, rows[1])) == Counter(map(str, good))  # no host is rejected here
    else:
        assert not Counter(map(str, rows[1])) - Counter(map(str, good))
    groups = brute_alike(rows[1])
    stay = [min((rows[1][i].doc_id for i in g if rows[1][i].doc_id is not None), default=None) for g in groups]
    assert Counter(r.doc_id for r in rows[2]) == Counter(stay)
    clean = {r.doc_id: r.text for r in rows[3]}
    assert len(rows[3]) == len(rows[2])
    for r in rows[2]:
        assert (clean[r.doc_id] == r.text) == (not brute_spans(r.text))
        assert not brute_spans(clean[r.doc_id])
    copies, sizes = Counter(r.doc_id for r in rows[4]), {r.doc_id: r for r in rows[3]}
    assert set(copies) <= set(sizes) and max(copies.values(), default=0) <= 3
    library = Tokenizer.from_file(word_vocabulary())
    assert Counter(r.doc_id for r in rows[5]) == copies
    for r in rows[5]:
        ids = library.encode(clean[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_mixing_stage_takes_what_the_mix_says(spark, sf_dir):
    from graywether.llm import mixing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mix(docs).collect()
    check_mix(mixed)
    got = defaultdict(int)
    for r in corpus_pipeline.mix_sources(spark, docs, sf_dir).collect():
        got[r.doc_id] += 1
    assert got == {r.doc_id: r.copies for r in mixed if r.copies}


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty(spark), sf_dir).count() == 0
