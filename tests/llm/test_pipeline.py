"""The pipeline, stage by stage, against plain re-statements on its own rows."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from spreadlake.llm import secrets, toxicity
from spreadlake.llm.common import held_out, read, table

from .conftest import rows
from .test_corpus import WORD, near_components


def kept_texts(docs):
    first, out = {}, {}
    words = {i: WORD.findall(t or "") for i, t in docs.items()}
    for i in sorted(docs):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else docs[i]
    return out


def test_stages(spark, place):
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    of = lambda df: {r["doc_id"]: r["text"] for r in rows(df)}
    docs = read(spark, place, "documents")
    before, frames = of(docs), []
    for name, stage in cp.STAGES:
        docs = table(spark, stage(spark, docs, place), "test")
        frames.append(docs)
        if stage is not cp.pack:
            assert docs.columns == cp.COLUMNS, name
    start = read(spark, place, "documents").filter(~held_out(F.col("doc_id")))
    model = toxicity.train(start, read(spark, place, "labels").filter(~held_out(F.col("doc_id"))))
    score = lambda t: 1 / (1 + np.exp(-(model[0][toxicity.features(t)].sum(dtype=float) + model[1])))
    after = of(frames[0])
    assert after == {i: t for i, t in before.items() if score(t) < 0.3}
    expected = {i: after[i] for i, _, c in near_components(after) if i == c}
    assert of(frames[1]) == expected
    expected = kept_texts(expected)
    assert of(frames[2]) == expected
    expected = {i: secrets.mask(t, [{"start": a, "end": b} for _, a, b in secrets.find(t)]) if t else t for i, t in expected.items()}
    assert of(frames[3]) == expected
    assert all((r["n_chars"] is None and r["text"] is None) or r["n_chars"] == len(r["text"]) for r in rows(frames[3]))
    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = sorted((i, k, zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for i, t in expected.items() for ids in [tok.encode(t or "", add_special_tokens=False).ids + [0]] for k, a in enumerate(range(0, len(ids), 2048)))
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows(frames[4])) == want


def test_empty(spark, empty):
    assert cp.run(spark, empty).count() == 0


def test_mask():
    spans = [{"start": 2, "end": 5}, {"start": 4, "end": 6}, {"start": 8, "end": 9}]
    assert secrets.mask("0123456789", spans) == "01[SECRET]67[SECRET]9" and secrets.mask(None, spans) is None


def test_secrets_of_null_and_repeated_ids_are_masked(spark, tmp_path):
    dirty, other, clean = 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "deadbeefdeadbeef0 first, PASSWORD:abcdefghijklmn", "nothing to hide in here, however long it goes on and on"
    ids_texts = [(None, dirty), (None, clean), (None, None), (1, dirty), (1, clean), (2, dirty), (2, other), (3, other), (3, other), (4, clean), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in ids_texts], "doc_id long, text string, lang string, source string, n_chars long")
    want = [(i, secrets.mask(t, [{"start": a, "end": b} for _, a, b in secrets.find(t)]) if t else t) for i, t in ids_texts]
    got = [(r["doc_id"], r["text"]) for r in rows(cp.mask_secrets(spark, docs, str(tmp_path)))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert not any(secrets.find(t) for _, t in got if t)


def test_masked_column(spark):
    rng = np.random.default_rng(4)
    alphabet = list("abc \U0001f600\u00e9\n")
    data = []
    for _ in range(60):
        text = "".join(rng.choice(alphabet, int(rng.integers(0, 30))))
        spans = sorted((int(a), int(rng.integers(a, len(text) + 1))) for a in rng.integers(0, len(text) + 1, int(rng.integers(0, 4))))
        data.append((text, [("x", a, b) for a, b in spans if a < b]))
    data += [(None, []), ("", []), ("plain", None)]
    df = spark.createDataFrame(data, f"text string, spans {secrets.SPANS}")
    got = [r[0] for r in df.coalesce(1).select(secrets.masked(df["text"], df["spans"])).collect()]
    assert got == [secrets.mask(t, [{"start": a, "end": b} for _, a, b in v or []]) for t, v in data]


ODD = [(None, "nobody"), (None, None), (1, "first text of one"), (1, "other text of one"), (1, "other text of one"), (2, None), (2, ""), (3, "x " * 40), (3, "x " * 40)]


def test_toxic_rows_go_whatever_their_id(spark, small):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    labels = read(spark, small, "labels")
    model = toxicity.train(docs.filter("doc_id is not null"), labels.filter("doc_id is not null"))
    score = lambda t: 1 / (1 + np.exp(-(model[0][toxicity.features(t)].sum(dtype=float) + model[1])))
    assert sorted(((r["doc_id"], r["text"]) for r in rows(cp.drop_toxic(spark, docs, small))), key=repr) == sorted(((i, t) for i, t in ODD if score(t) < 0.3), key=repr)


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES[1:4]])
def test_stages_keep_rows_of_null_and_repeated_ids(spark, small, stage):
    """Nothing here links with another id, so every row comes out once; a repeat of an id's own words stays."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in rows(stage(spark, docs, small))), key=repr)
    if stage is cp.drop_repeats:
        assert sorted((i for i, _ in got), key=repr) == sorted((i for i, _ in ODD), key=repr)
    else:
        assert got == sorted(ODD, key=repr)


def test_pack_takes_null_and_repeated_ids(spark, small):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = rows(cp.pack(spark, docs, small))
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted((i for i, _ in ODD), key=repr) and len({(r["sequence_id"], r["offset"]) for r in got}) == len(ODD)
