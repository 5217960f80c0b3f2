"""Labels of positions drive the segments; a trained network is stored."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from merloom.llm import gru, language


@pytest.fixture(scope="module")
def net(spark, data):
    rows = sorted((r.lang, r.text) for r in spark.read.parquet(f"{data}/lang_samples.parquet").collect())
    return language.train(rows, epochs=25)


def test_steps_of_all_texts(net):
    texts = [b"the house of commons", b"x", b"der ausschuss ber\xc3\xa4t heute " * 9, b"abcdefgh"]
    logit, steps = net.block_logits(texts, batch=3)
    assert steps.tolist() == [3, 1, 31, 1] and len(logit) == 36
    at = 0
    for t, n in zip(texts, steps):
        alone = net.position_logits(t)
        assert np.allclose(np.repeat(logit[at : at + n], gru.BLOCK, axis=0)[: len(t)], alone, atol=1e-3)
        assert np.allclose(logit[at : at + n].mean(0), net.logits([t])[0], atol=1e-3)
        at += n


def test_a_segment_may_begin_inside_a_sentence(net):
    de = "der ausschuss hat gestern lange über den bericht der regierung beraten und"
    fr = "nous devons maintenant examiner avec attention toutes les propositions de la commission"
    (langs, seg), = language.label_texts(net, [f"{de} {fr}."])
    assert [s["lang"] for s in seg] == ["de", "fr"] and len(langs) == 1
    assert abs(seg[0]["end"] - len(de)) <= 3 * gru.BLOCK and seg[0]["end"] == seg[1]["start"]
    assert seg[0]["start"] == 0 and seg[1]["end"] == len(de) + len(fr) + 2


def test_offsets_count_characters(net):
    de = "die öffentlichkeit müßte über die größe der brücken aufgeklärt werden und für"
    en = "the members of this house should like to know what the government will do about it"
    (_, seg), = language.label_texts(net, [f"{de} {en}."])
    assert [s["lang"] for s in seg] == ["de", "en"] and abs(seg[1]["start"] - len(de)) <= 3 * gru.BLOCK


def test_held_rule():
    n = np.array([5.0, 9.0, 1.0])
    assert language.held([0, 0, 0, 1, 1, 1, 1], n) == [0, 1]
    assert language.held([0, 0, 1, 0, 0], n) == [1]
    assert language.held([2, 2, 2, 0, 0], n) == [2]


def test_a_text_without_letters_is_in_no_language(net):
    assert language.label_texts(net, ["12 345 678 901 ... 23 %!", "1234. 5678."]) == [None, None]


def test_long_training_sentences_are_read_whole(monkeypatch):
    seen = []
    monkeypatch.setattr(language, "to_blocks", lambda texts: seen.extend(texts) or gru.to_blocks(texts))
    long = " ".join(f"wort{i}" for i in range(400))
    language.train([("de", long), ("en", "a short sentence here.")], epochs=12)
    assert any(b"wort399" in t for t in seen) and max(map(len, seen)) <= language.MAX_BYTES + 3 * gru.BLOCK


def test_a_network_is_trained_once(spark, data, monkeypatch):
    s = spark.read.parquet(f"{data}/lang_samples.parquet")
    a = language.fit(s, epochs=1, hidden=8)
    monkeypatch.setattr(language, "train", lambda *x: pytest.fail("trained again"))
    b = language.fit(s, epochs=1, hidden=8)
    assert a.labels == b.labels and all(np.array_equal(a.p[k], b.p[k]) for k in a.p) and np.array_equal(a.pair_id, b.pair_id)
    with pytest.raises(BaseException):
        language.fit(s.where(F.col("sample_id") > 3), epochs=1, hidden=8)
