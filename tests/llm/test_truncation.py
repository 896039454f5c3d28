import random

import numpy as np
import pytest

from tripleloom.llm import truncation as T

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, path string, mark string, odds string"
WORDS = "alpha beta gamma delta index value token result cursor window buffer marker".split()


def whole(r):
    kind = r.choice(["python", "javascript", "markdown"])
    name = lambda: "_".join(r.choices(WORDS, k=2))
    if kind == "python":
        text = "".join(f"def {name()}({name()}):\n    {name()} = {name()}({name()}, \"{name()}\")\n    return {name()}\n\n\n" for _ in range(r.randint(4, 14)))[:-2]
    elif kind == "javascript":
        text = "".join(f"function {name()}() {{\n  const {name()} = {name()}[{name()}];\n  return {name()};\n}}\n\n" for _ in range(r.randint(4, 14)))[:-1]
    else:
        text = "".join(f"## {name()}\n\n{' '.join(r.choices(WORDS, k=12)).capitalize()}.\n\n" for _ in range(r.randint(4, 14)))[:-1]
    return kind, text


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    rows, cut = [], set()
    for i in range(1500):
        lang, text = whole(r)
        source = r.choice(["limited", "mirror", "clean", None])
        if source == "limited" and len(text) > 700:
            text = text[:700]
            cut.add(i)
        elif source == "mirror" and r.random() < 0.2:
            text = text[: r.randint(60, len(text) - 20)]
            cut.add(i)
        elif r.random() < 0.15:
            text = text[:-1]
        rows.append((i, text, lang if r.random() < 0.95 else None, source, len(text), "a.x", "x", "x"))
    for k, i in enumerate(sorted(cut)[:20]):  # copies elsewhere
        rows.append((5000 + k, rows[i][1], None, "clean", 0, None, "x", "x"))
        cut.add(5000 + k)
    rows += [(9000, "", "python", "clean", 0, "a", "x", "x"), (9001, None, None, None, None, None, None, None), (9002, " ", "c", "mirror", 1, "b", "x", "x"), (9003, "0", "c", "limited", 1, "b", "x", "x")]
    return rows, cut


def test_found(spark, corpus):
    rows, cut = corpus
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id for r in T.truncated(docs, 400).collect()}
    assert len(found & cut) >= 0.9 * len(cut)
    assert len(found & cut) >= 0.93 * len(found)
    assert not found & {9000, 9001, 9002, 9003}
    rates = {r.source: (r.documents, r.truncated) for r in T.rates(docs, 400).collect()}
    assert rates["clean"][1] <= 30 and rates["limited"][1] > 100 and None in rates


def test_limits(spark, corpus):
    docs = spark.createDataFrame([r for r in corpus[0] if r[0] < 5000], SCHEMA)
    assert {(r.source, r.unit, r["size"]) for r in T.limits(docs).collect()} == {("limited", "chars", 700), ("limited", "bytes", 700)}
    copies = docs.where("doc_id = 3").crossJoin(spark.range(50)).drop("id")
    assert T.limits(copies).count() == 0  # one text fetched often is no limit


def test_held_out_accuracy(spark, corpus):
    """On cuts the classifier has not seen."""
    docs = spark.createDataFrame(corpus[0], SCHEMA)
    marked = T.with_limits(docs, T.limits(docs))
    model = T.train(marked, 300)
    r = random.Random(99)
    wrong = 0
    for _ in range(400):
        lang, text = whole(r)
        cut = r.random() < 0.5
        shown = text[: r.randint(60, len(text) - 20)] if cut else text[:-1] if r.random() < 0.2 else text
        odds = model.weights[T._hash(T.describe(shown, lang, "a.x", False, model.known))].sum() - np.log(T.CUT_SHARE / (1 - T.CUT_SHARE))
        wrong += (odds > 0) != cut
    assert wrong < 40


def test_small_and_empty_corpora(spark, corpus):
    docs = spark.createDataFrame(corpus[0], SCHEMA)
    assert T.truncated(docs.where("doc_id < 0")).count() == 0
    assert T.rates(docs.where("doc_id < 0")).count() == 0
    few = spark.createDataFrame([(1, "int main() {\n  return f(", "c", "s", 0, None, None, None), (2, "int x;\n", "c", "s", 0, None, None, None)], SCHEMA)
    assert [r.doc_id for r in T.truncated(few).collect()] == [1]


def test_very_long_text():
    text = "function f() {\n  return 1;\n}\n" * 40_000
    assert T.describe(text, "javascript", None, False, frozenset())
    assert T.describe("x" * 1_000_000, None, None, False, frozenset())


def test_known_pieces_are_those_of_all_intact_texts(spark):
    """Pieces outside the sample and beyond 20,000 are known, and end texts as known ones."""
    name = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i:05d}")
    many = " ".join(name(i) for i in range(25_000)) + "\n"
    rows = [(i, f"{many if i < 3 else 'zeta omega word '}rare\n" + "x" * i + "\n", None, "s", 0, None, None, None) for i in range(60)]
    marked = T.with_limits(docs := spark.createDataFrame(rows, SCHEMA), T.limits(docs))
    pieces = {r.piece for r in T.known_pieces(marked).collect()}
    assert {name(i) for i in range(25_000)} | {"zeta", "rare"} <= pieces
    made = T.train(marked, 10_000)
    assert made is not None and made.known <= pieces
    ends = [f"a {name(24_999)}", "a nowhere", "a fooRare", "a ", "RARE\n"]
    model = T.Model(np.arange(T.FEATURES, dtype=float), frozenset())  # other features, other odds
    ended = spark.createDataFrame([(i, t, "c", "s", 0, None, None, None) for i, t in enumerate(ends)], SCHEMA)
    odds = {r.doc_id: r.odds for r in T.score(T.with_limits(ended, T.limits(ended)), model, T.known_pieces(marked)).collect()}
    for i, text in enumerate(ends):
        assert odds[i] == model.weights[T._hash(T.describe(text, "c", None, False, frozenset(pieces)))].sum()


def cut_at(r, size, mark="", n=120):
    """Texts of one source that cuts at ``size`` characters and ends them with ``mark``; the shorter ones are whole."""
    made = [whole(r) for _ in range(n)]
    return [(lang, text if len(text) <= size else text[: size - len(mark)] + mark, len(text) > size) for lang, text in made]


def test_a_mark_that_the_code_has_never_seen(spark, corpus):
    r = random.Random(11)
    made = cut_at(r, 600, "~~>go on")
    rows = corpus[0][:600] + [(20_000 + i, text, lang, "feed", 0, "a.x", "x", "x") for i, (lang, text, _) in enumerate(made)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marked = T.with_limits(docs, T.limits(docs))
    marks = T.marks_found(marked, T.intact_sample(marked, 300))
    assert list(marks) == ["~~>go on"] and 0.3 < marks["~~>go on"] < 1
    found = {x.doc_id for x in T.truncated(docs, 300).collect()}
    want = {20_000 + i for i, (_, _, cut) in enumerate(made) if cut}
    assert want <= found and len([i for i in found if i >= 20_000]) <= len(want) + 2


def test_short_limits_and_short_whole_texts(spark, corpus):
    """A source that cuts at 15 characters is found; whole texts as short as that in other sources are not."""
    r = random.Random(12)
    names = lambda: "_".join(r.choices(WORDS, k=3))
    tiny = [(30_000 + i, f"{names()} = {i}"[:15], "python", "sms", 0, "a.x", "x", "x") for i in range(60)]
    odd = [(31_000 + i, x, "c", "mirror", 0, "a.x", "x", "x") for i, x in enumerate(["0", " ", "\t", "1.2.3", "v1", "<|end|>"] * 4)]
    docs = spark.createDataFrame(corpus[0][:900] + tiny + odd, SCHEMA)
    found = {x.doc_id for x in T.truncated(docs, 400).collect()}
    assert sum(30_000 <= i < 30_060 for i in found) >= 50
    assert not [i for i in found if i >= 31_000]


def test_small_corpus_is_judged_by_the_same_model(spark):
    r = random.Random(13)
    rows = [(i, text, lang, "a", 0, "a.x", "x", "x") for i, (lang, text) in enumerate(whole(r) for _ in range(26))]
    rows += [(100 + i, whole(r)[1][:400], "python", "b", 0, "a.x", "x", "x") for i in range(4)]  # a limit that four texts have
    found = {x.doc_id for x in T.truncated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {100, 101, 102, 103} <= found and len(found) <= 6


def test_without_intact_texts_the_prior_reports_nothing(spark):
    rows = [(i, "abc" * (i + 1), "c", "s", 0, None, None, None) for i in range(3)]
    assert T.truncated(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_features_see_the_whole_text():
    closed, open_ = ("x = 1;\n" * 5 + f'call({q}{"a b, " * 2000}end' for q in ("", '"'))
    assert "quote code False -" in T.describe(closed, "c", None, False, frozenset()) and "quote code True -" in T.describe(open_, "c", None, False, frozenset())
    line = "y" * 3000 + " - tail"
    assert any(f.startswith("first c yyy") or f == "first c  -" for f in T.describe("z\n" + line, "c", None, False, frozenset()))
