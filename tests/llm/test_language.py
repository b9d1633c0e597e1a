import random
from collections import Counter
from math import exp, log

from linkwright.llm.language import Model, grams, identify, split, train

WORDS = {"aa": "ko ruko miko tako soko rimo kari sato".split(), "bb": "the thing then that thorn thick moth path".split()}


def made(counts, known=3):
    """A model from words alone."""
    by = Counter()
    for lang, w, n in counts:
        by.update({(lang, g): n * k for g, k in Counter(grams(w, 4)).items()})
    return Model(counts, [(lang, g, n) for (lang, g), n in by.items()])


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) + (rng.choice(WORDS[lang]) if rng.random() < 0.3 else "") for _ in range(rng.randrange(1, 30)))
        out.append((i, text, lang, "x"))
    return out


def test_held_out(spark):
    kind = "doc_id long, text string, lang string, score string"
    model = train(spark.createDataFrame(rows(300, 1) + [(900, None, "aa", ""), (901, "zz", None, "")], kind))
    fresh = rows(200, 2)
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(fresh, kind), model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in fresh) >= 196
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_texts(spark):
    model = made([(lang, w, 5) for lang in WORDS for w in WORDS[lang]])
    texts = [None, "", "123 ... 456", "ko " * 40000, "日本", "½ ² Ⅷ ①", "ko½ko"]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] == got[6] == "aa" and got[4] in WORDS and got[5] == "und"
    assert split("a½b ²c") == ["a", "b", "c"]


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = train(empty)
    assert model.predict("some words") == ("und", 0.0) and identify(empty, model).count() == 0


def test_backoff_takes_the_longest_known():
    model = made([("aa", "koko", 5), ("bb", "thth", 5)])
    assert "koko" in model.words and model.predict("kokoko")[0] == "aa" and split("Ab1c é_d") == ["ab", "c", "é", "d"]


def by_hand(train_rows, text, known=3):
    """The score of each language straight from the sentences."""
    words, pieces = Counter(), Counter()
    for _, t, lang, _ in train_rows:
        for w in t.lower().split():
            words[lang, w] += 1
            for size in range(1, 5):
                for k in range(len(w) + 3 - size):
                    pieces[lang, f" {w} "[k : k + size]] += 1
    langs = sorted({lang for lang, _ in words})
    often = {w for _, w in words if sum(words[x, w] for x in langs) >= known}
    have = {g for _, g in pieces if sum(pieces[x, g] for x in langs) >= known}
    total = dict.fromkeys(langs, 0.0)
    logs = lambda table, among, key, more: {x: log((table[x, key] + more) / sum(table[x, y] + more for y in among)) for x in langs}
    for w in text.lower().split():
        parts = []
        if w in often:
            parts.append(logs(words, often, w, 0.5))
        else:
            padded = f" {w} "
            for end in range(2, len(padded) + 1):
                g = next((padded[end - s : end] for s in range(min(4, end), 0, -1) if padded[end - s : end] in have), None)
                if g is not None:
                    parts.append(logs(pieces, [y for y in have if len(y) == len(g)], g, 0.1))
        for p in parts:
            for x in langs:
                total[x] += p[x] - max(p.values())
    best = max(langs, key=total.get)
    return best, exp(total[best]) / sum(exp(total[x]) for x in langs)


def test_scores_equal_a_plain_computation(spark):
    kind = "doc_id long, text string, lang string, score string"
    seen = rows(60, 5)
    model = train(spark.createDataFrame(seen + seen[:9], kind))  # repeated rows count once
    for text in ("ko rukothing soko", "moththorn zzz", "then", "kariko sax"):
        lang, score = model.predict(text)
        want = by_hand(seen, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-4


def test_a_rare_language_is_learned(spark):
    kind = "doc_id long, text string, lang string, score string"
    many = [(i, t, "bb", s) for i, t, lang, s in rows(3000, 7) if lang == "bb"]
    few = [(9000 + i, "zul bazul wazu", "cc", "") for i in range(5)]
    model = train(spark.createDataFrame(many + few, kind), most_docs=100)
    assert model.languages == ["bb", "cc"] and model.predict("zul wazu")[0] == "cc" and model.predict("thing moth")[0] == "bb"
