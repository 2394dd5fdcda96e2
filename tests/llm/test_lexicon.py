import numpy as np
import pytest
from tokenizers import Tokenizer

from graywether.llm import lexicon
from graywether.llm.queries import QUERIES, word_vocabulary

from .fixtures import ROWS, clashing, empty, odd

STRANGE = [
    "ΟΔΟΣ Σ İstanbul ǅ ﬁ ① x² ٣٤    é Å ẞ",
    "<|startoftext|>Hello<|endoftext|> <|nothing|> it's WE'LL 123 !!! \x1c\x85 \x00",
    "漢字かな混じり 😀😀 नमस्ते",
    "naïve “quotes” – dash… €5",
    "a" * 3000 + "!" * 200,
    "xͅy ÀÉ ẞ ŉ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_vocabulary())


def test_merges_equal_the_library(library, spark, sf_dir):
    model = lexicon.bpe(word_vocabulary())
    texts = STRANGE + [r[1] or "" for r in ROWS]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for text in texts:
        ids = [i for w in model.words(text) for i in model.merge(w)]
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text[:80]
        assert model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_automaton_knows_its_words_only(tmp_path):
    words = sorted({"a", "ab", "abc", "bc", "c", "nation", "station", "stations", "é", "été", *(f"w{i}ing" for i in range(300))}, key=str.encode)
    ids = [[i, i + 1] for i in range(len(words))]
    lexicon.compile_words(words, ids, str(tmp_path / "a"))
    t = lexicon.Transducer(str(tmp_path / "a"))
    assert t.look_up(words) == [np.array(x, dtype="<u4").tobytes() for x in ids]
    assert t.look_up(["", "b", "abcd", "statio", "w300ing", "\xff"]) == [None] * 6
    assert len(t.t["end"]) < sum(map(len, words)) / 2


def test_query_equals_the_library(spark, sf_dir, library, monkeypatch):
    import hashlib

    monkeypatch.setattr(lexicon, "LEXICON_WORDS", 500)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op3_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, library):
    rows = lexicon.encode_and_decode(clashing(spark, "ids", "decoded"), word_vocabulary(), 20).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
    assert lexicon.encode_and_decode(empty(spark), word_vocabulary()).count() == 0
    assert odd(spark).count() == len(rows)
