"""Piece encoding against the library."""

import random
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece

from quernstone.llm import piece_encoding as pe

TEXTS = [
    "", " ", "   a  b ", "Hello  wörld ﬁ ½ \n x　y é", "▁▁x ▁", "<s> </s> <0x0A> <unk>", "\x00\x01\t\r\n", "日本語のテキスト 😀👩‍👩‍👧 مرحبا", "a" * 3000, "1234567890 " * 50,
    "éé ½ﬁ Å", " wide space　", "é" * 500 + "\n\n" + "ü", "word," * 400,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    letters = "abcdeé ▁ß語😀 \n\t,.-tionThe   "
    return TEXTS + ["".join(rng.choices(letters, k=rng.randrange(400))) for _ in range(300)]


def test_ids_and_spans_equal_the_library(texts):
    ours = pe.Encoder(pe.default_model())
    for text in texts:
        ids, starts, stops = ours(text)
        assert ids.tolist() == ours.library.encode(text, add_bos=True, add_eos=True)
        found = ours.library.encode(text, return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in found] == list(zip(ids.tolist(), starts, stops, strict=True))[1:-1]
        assert starts[0] == 0 and stops[-1] == len(text.encode()) or not text


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
def test_normalising_equals_the_library(texts, rule, prefix, squeeze):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    blob = sentencepiece.sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec.precompiled_charsmap
    assert bool(blob) == (rule != "identity")
    ours = pe.Normaliser(blob, prefix, squeeze, True)
    for text in texts:
        normal, origin = ours(text)
        assert normal == library.normalize(text)
        assert len(origin) == len(normal) + 1 and (np.diff(origin) >= 0).all()
        want, places = library.normalize(text, with_offsets=True)
        at = np.cumsum([0, *(len(c.encode()) for c in text)])
        assert want == normal and [at[p] for p in places] == origin.tolist()


def test_tables(spark, texts):
    rows = [(i, None if i == 3 else t, "x", 1) for i, t in enumerate(texts[:40])] + [(None, "no id", "x", 1), (1, "again", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, starts int")
    library = sentencepiece.SentencePieceProcessor(model_file=pe.default_model())
    made = pe.encode(docs)
    for r in made.join(docs.select("doc_id", "text"), "doc_id").where("doc_id <> 1").collect():
        data = (r["text"] or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r["starts"], r["ends"], strict=True)) == data
    want = {(i, library.decode(library.encode(t or "", add_bos=True, add_eos=True))) for i, t, _, _ in rows}
    assert {tuple(r) for r in pe.decode(made).collect()} == want
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pe.round_trip(docs).collect())
    exact = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        exact.append((str(i), len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(exact)
    assert pe.round_trip(docs.limit(0)).count() == 0 and pe.encode(docs.limit(0)).count() == 0
