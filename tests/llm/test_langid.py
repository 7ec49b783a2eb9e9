from collections import Counter

import pytest

from quern.llm import langid

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then the other thing that was there",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann das andere ding",
    "fr": "le rapide renard brun saute par-dessus le chien paresseux et puis l'autre chose était là",
}


def grams(text):
    """Brute force: n-grams of words padded by one shared blank."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        for n, s in ((1, w), (2, f" {w} "), (3, f" {w} ")):
            out.update(s[i : i + n] for i in range(len(s) - n + 1))
    return out


def train(spark):
    rows = [(i, g, t) for i, (g, t) in enumerate(TEXTS.items())] * 3 + [(9, None, "x"), (10, "en", None), (11, "en", "")]
    return langid.learn(spark.createDataFrame(rows, "doc_id bigint, lang string, text string").selectExpr("*", "1 as key", "2 as n"), size=50)


def test_counts_match_brute_force(spark):
    profiles = train(spark)
    names = {i + 2: chr(c) for i, c in enumerate(profiles.alphabet.tolist())} | {0: " "}
    for text in [*TEXTS.values(), "É é\n\n a--b 12 ßß", "x"]:
        alphabet = langid.np.unique(langid.np.concatenate([profiles.alphabet, [ord(c) for c in text.lower() if c.isalpha()]]))
        names = {i + 2: chr(c) for i, c in enumerate(alphabet.tolist())} | {0: " "}
        keys, n = langid._counted(text, alphabet)
        got = {}
        for k, c in zip(keys.tolist(), n.tolist(), strict=True):
            size, rest = k >> 36, k & ((1 << 36) - 1)
            got["".join(names[(rest >> 12 * (size - i)) & 4095] for i in range(size + 1))] = c
        assert got == grams(text)


def test_predictions(spark):
    profiles = train(spark)
    rows = [(1, "the dog and the fox"), (2, "der hund und das"), (3, "le chien et la chose"), (4, None), (5, "123 !"), (6, ""), (None, "the the"), (7, "über" * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'q' as lang_pred", "1 as id")
    got = {r.id: (r.lang_pred, r.score) for r in langid.predict(df, profiles).collect()}
    assert [got[i][0] for i in (1, 2, 3, None)] == ["en", "de", "fr", "en"]
    assert got[4] == got[5] == got[6] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(df.where("false"), profiles).count() == 0


def test_no_training_rows(spark):
    profiles = langid.learn(spark.createDataFrame([], "lang string, text string"))
    assert profiles.predict("hello") == ("und", 0.0)


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    from pyspark.sql import functions as F

    d = f"/root/testdata/{sf}"
    got = langid.op10_language_id(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").where("lang is not null"), "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_every_letter_of_the_training_texts_is_numbered(spark):
    # two languages that differ in rarer letters only, beyond 200 a language and 4,093 in all
    common = "".join(chr(0x4E00 + i) for i in range(250))
    rare = {"aa": "".join(chr(0x5000 + i) for i in range(2600)), "bb": "".join(chr(0xAC00 + i) for i in range(2600))}
    rows = [(lang, common * 3 + letters) for lang, letters in rare.items()]
    profiles = langid.learn(spark.createDataFrame(rows, "lang string, text string"), size=20000)
    assert {ord(c) for c in common + rare["aa"] + rare["bb"]} == set(profiles.alphabet.tolist())
    for lang, letters in rare.items():
        assert profiles.predict(letters[2000:2100])[0] == lang


def test_distance_and_score_match_brute_force(spark):
    """Profiles ranked by count, out-of-place distances and the score, from dictionaries."""
    import math
    import random

    profiles = train(spark)

    def numbered(text):
        keys, n = langid._counted(text, profiles.alphabet)
        return dict(zip(keys.tolist(), n.tolist(), strict=True))

    ranked = {}
    for g, t in TEXTS.items():
        counts = numbered(t)
        ranked[g] = {k: i for i, k in enumerate(sorted(counts, key=lambda k: (-counts[k], k))[:50])}
    rng = random.Random(2)
    words = [w for t in TEXTS.values() for w in t.split()] + ["zzz", "qqx"]
    for _ in range(40):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))
        counts = numbered(text)
        mine = sorted(counts, key=lambda k: (-counts[k], k))[:50]
        far = {g: sum(min(50, abs(r[k] - i)) if k in r else 50 for i, k in enumerate(mine)) / (50 * len(mine)) for g, r in ranked.items()}
        best, second = sorted(far.items(), key=lambda x: (x[1], x[0]))[:2]
        lang, score = profiles.predict(text)
        assert lang == best[0] and abs(score - 1 / (1 + math.exp(-20 * (second[1] - best[1])))) < 1e-9
