import random
import zlib

import numpy as np

from lineweave.llm import langid

SYLLABLES = {"en": "th er ing the and of tion re st on", "de": "sch ung ein ver der ich ü ö keit zu", "fr": "ou eau é è tion que les ai une eux"}


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))]
        out.append((i, " ".join(words), lang))
    return out


def test_learns_and_holds_out(spark):
    extra = [(9000, None, "en"), (9001, "", None), (9002, "12 !! 34", "de"), (9003, "the " * 50_000, None), (None, "ein schung", "de"), (7, "the and", "en")]
    data = rows(500) + extra
    docs = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, lang string, score string")
    got = langid.identified(docs).collect()
    assert len(got) == len(data)
    truth = {d: lang for d, _, lang in rows(500)}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "und"}
    judged = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in judged]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[9000].lang_pred == by[9001].lang_pred == by[9002].lang_pred == "und" and by[9003].lang_pred == "en"


def test_never_learns_from_held_out(spark):
    data = rows(200)
    wrong = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 4 == 2 else lang) for d, t, lang in data]
    docs = [spark.createDataFrame(x, "doc_id long, text string, lang string") for x in (data, wrong)]
    a, b = (sorted(map(tuple, langid.identified(x).collect())) for x in docs)
    assert a == b and not any(r[2] == "zz" for r in b)


def test_empty_and_unlabelled(spark):
    docs = spark.createDataFrame([(1, "the and", None)], "doc_id long, text string, lang string")
    assert langid.identified(docs).first().lang_pred == "und"
    assert langid.identified(docs.limit(0)).count() == 0


def test_weights_are_sparse():
    sample = [(lang, *langid.features(t)) for _, t, lang in rows(300)]
    model = langid.train(sample, np.ones(langid.FEATURES))
    assert (model.weights == 0).mean() > 0.5
