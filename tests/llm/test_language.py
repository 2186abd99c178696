"""Every letter and every language counts."""

import random

from loomlake.llm import language


def test_letters_beyond_the_first_twenty(spark):
    """Runs without blanks differ only after 25 shared letters, and in their ends."""
    rng = random.Random(5)
    stems = {"aa": ["mo", "ra", "ti", "lu"], "bb": ["xen", "qor", "zik", "wuv"]}
    rows = [(i, "kep" * 8 + "k" + "".join(rng.choice(stems[lang]) for _ in range(rng.randint(10, 400))), lang) for i in range(120) for lang in ["aa" if i % 2 else "bb"]]
    found = {r.doc_id: r.lang_pred for r in language.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(found[i] == lang for i, _, lang in rows)
    ends = language.features(["a" * 30 + "xyz", "a" * 30 + "xyq"], {})
    assert (ends[0] != ends[1]).any()


def test_all_ngrams_of_a_long_word_are_features():
    word = "".join(chr(97 + i % 26) if i < 26 else chr(0x4E00 + i) for i in range(500))
    once = language.features([word], {})[0].tolist() + language.further(["ab", word])[1].tolist()
    assert set(language.further(["ab", word])[0].tolist()) == {1}
    for n in (2, 3):
        for at in range(len(word) - n + 1):
            assert language._hashed([language._codes([c], 1)[:, 0] for c in word[at : at + n]], 30 + n)[0] in once


def test_every_language_is_learned(spark, monkeypatch):
    """Fitting 70 languages takes minutes, so only what it is given is looked at."""
    rows = [(i, f"word{chr(97 + k % 26)} other", f"l{k:02d}") for k in range(70) for i in range(k * 8, k * 8 + 8)]
    monkeypatch.setattr(language, "fit", lambda segments, langs: (segments, langs))
    segments, langs = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == [f"l{k:02d}" for k in range(70)] and {k for k, _ in segments} == set(range(70))
