import random
import re
from math import exp, log1p

from hypothesis import given, settings
from hypothesis import strategies as st

from linkwright.llm.toxicity import ADDRESS, QUOTES, REPORTS, Automaton, Model, score, train

TERMS = ["stupid", "idiot", "scum", "vequ*", "moron", "morons"]
AUTOMATON = Automaton(TERMS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(word):
    hits = []
    for k, t in enumerate(TERMS):
        if t.endswith("*"):
            if word.startswith(t[:-1]):
                hits.append((0, k))
        elif (d := distance(word, t)) <= (1 if len(t) >= 5 else 0):
            hits.append((d, k))
    return min(hits, default=None)


@settings(max_examples=1000, deadline=None)
@given(st.one_of(st.text(alphabet="stupidmorncveq", max_size=9), st.sampled_from(TERMS).flatmap(lambda t: st.tuples(st.just(t), st.integers(0, 6), st.sampled_from("xsto"), st.integers(0, 2)).map(lambda x: x[0][: x[1]] + x[2] * x[3] + x[0][x[1] + x[3] % 2 :]))))
def test_automaton(word):
    assert AUTOMATON.match(word) == plain(word)


def corpus(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zworthless", "zstupid", "zmoronic", "zq" + rng.choice(clean)]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic), 1))
    return docs, labels


def test_learned(spark):
    docs, labels = corpus(400, 7)
    d = spark.createDataFrame(docs + [(1000, None, ""), (1001, "", "")], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(1000, 1, 0), (1002, None, 0)], "doc_id long, toxic int, kind int")
    model = train(d, lab.where("doc_id % 4 <> 0"))
    got = {r["doc_id"]: r["score"] for r in score(d, model).collect()}
    held = [(i, y) for i, y, _ in labels if i % 4 == 0]
    assert sum((got[i] >= 0.5) == bool(y) for i, y in held) >= 0.95 * len(held)
    assert got[1000] < 0.5 and got[1001] < 0.5
    assert model.score("such a zstupidd ztupid thing") >= 0.5 or model.features("such a zstupidd thing")[1] > 0


def test_terms_of_a_minority(spark):
    """A stem of seven letters in a few toxic texts, and in one clean text; its first six letters begin clean words too."""
    docs, labels = corpus(600, 9)
    rng = random.Random(4)
    for i in range(1000, 1120):
        ending = "".join(rng.choice("abcdefghij") for _ in range(4))
        words = [rng.choice("klmnop") * 3 + str(rng.randrange(60)) for _ in range(30)]
        toxic = i % 10 == 0
        words[7:7] = ["boment" + ("e" if toxic or i == 1001 else rng.choice("klmnop")) + ending]
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic), 1))
    model = train(spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, kind int"))
    assert "bomente*" in model.terms and "boment*" not in model.terms
    fresh = "kkk1 lll2 mmm3 bomentezzzz nnn4 ooo5"
    assert model.features(fresh)[0] > 0 and model.features(fresh.replace("bomente", "bomentk"))[0] == 0


def test_rare_class_is_sampled_apart(spark):
    """Of 8,000 labelled rows 80 are toxic, the sample has 80."""
    rng = random.Random(6)
    docs = []
    for i in range(8000):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(90)}" for _ in range(25)]
        docs.append((i, " ".join(words + ["zstupid", "zmoronic"] * (i % 100 == 0)), int(i % 100 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = train(d.drop("toxic"), d.drop("text"), most_docs=80)
    assert {"zstupid", "zmoronic"} <= set(model.terms)
    assert model.score("a1 b2 zstupid zmoronic c3 d4") >= 0.5 and model.score("a1 b2 c3 d4") < 0.01


def score_by_hand(model, text):
    """Word by word, each compared with each term."""
    words = re.findall(r"\w+", text.lower())
    at = [m.start() for m in re.finditer(r"\w+", text.lower())]
    plain_, loose, quoted, seen = 0.0, 0.0, 0.0, set()
    for k, w in enumerate(words):
        hits = []
        for n, term in enumerate(model.terms):
            if term.endswith("*"):
                hits += [(0, n)] * w.startswith(term[:-1])
            elif (d := distance(w, term)) <= (1 if len(term) >= 5 else 0):
                hits.append((d, n))
        hit = min(hits, default=None)
        if hit is None or hit[0] and w in model.clean:
            continue
        seen.add(hit[1])
        low, near = text.lower(), [words[j] for j in range(max(0, k - 6), min(len(words), k + 7)) if j != k]
        first, last = at[max(0, k - 6)], min(len(words) - 1, k + 6)
        marks = any(c in QUOTES for c in low[first : at[k]]) and any(c in QUOTES for c in low[at[k] + len(w) : at[last] + len(words[last]) + 2])
        context = 1.5 * marks + len(set(near) & REPORTS) - 0.75 * len(set(near) & ADDRESS) - 1
        odds = model.odds[hit[1]]
        if context > 0:
            quoted += odds
        elif hit[0]:
            loose += odds
        else:
            plain_ += odds
    x = [log1p(v) for v in (plain_, loose, quoted, len(seen), 1000 * (plain_ + loose) / max(1, len(words)))] if seen else [0.0] * 5
    return 1 / (1 + exp(-(model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x)))))


def test_scores_equal_a_plain_computation():
    rng = random.Random(12)
    model = Model(dict(zip(TERMS, (3.0, 2.5, 4.0, 1.5, 2.0, 2.2))), clean={"idiom"}, weights=[-3.0, 1.2, 0.7, -0.4, 0.3, 0.2])
    words = ["stupid", "stupidd", "idiom", "idiot", "vequalor", "moronn", "scun", "scum", "said", "you", "word", '"', "the", "a", "green", "»", "«", "thing"]
    for _ in range(400):
        text = " ".join(rng.choices(words, k=rng.randrange(30)))
        assert abs(model.score(text) - score_by_hand(model, text)) < 1e-12


def test_quotation_counts_apart():
    model = Model({"stupid": 5.0})
    plainly, quoted = model.features("you are so stupid and you know it"), model.features('they said the word "stupid" is a term')
    assert plainly[0] > 0 and plainly[2] == 0 and quoted[2] > 0 and quoted[0] == 0


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= model.score(None) <= 1 and score(empty, model).count() == 0
