import random

import pytest

from rookery.llm import splitting as sp

MARKS = set(".!?;:,。！？、，")


def natural(text, limit):
    run = longest = 0
    for c in text:
        run = 0 if c.isspace() or c in MARKS else run + 1
        longest = max(longest, run)
    return longest <= limit


def check(text, limit, overlap):
    pieces = sp.split_text(text, limit, overlap)
    if not text:
        assert pieces == []
        return pieces
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and pieces[-1][2] == "end"
    for (a, b, kind), (c, d, _) in zip(pieces, pieces[1:]):
        assert 0 <= b - c <= overlap and c >= a and d > b
        if kind != "forced":
            assert text[b - 1].isspace() or text[b - 1] in MARKS or text[b].isspace() or text[b] in MARKS
    assert all(0 < b - a <= limit for a, b, _ in pieces)
    assert any(k == "forced" for *_, k in pieces) == (not natural(text, limit))
    return pieces


def test_random_texts():
    rng = random.Random(5)
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append("".join(rng.choice("abcdé日") for _ in range(rng.choice([1, 4, 9, 60, 150, 210]))) + rng.choice([" ", ". ", "\n", "\n\n", "。", "", ", "]))
        check("".join(parts), 200, rng.choice([0, 30, 60]))


def test_runs_at_the_limit():
    for n in (1399, 1400, 1401):
        for text in ("x" * n + " " + "word " * 400, "word " * 400 + "x" * n, "a. " * 300 + "x" * n + "." + "b, " * 300):
            check(text, 1400, 240)
    check("x" * 20_000, 1400, 240)
    check("word " * 40_000, 1400, 240)


def test_overlap_is_about_as_asked():
    pieces = check("Some words make a sentence here. " * 300, 1400, 240)
    assert all(120 <= b - c <= 240 for (_, b, _), (c, _, _) in zip(pieces, pieces[1:]))
    assert all(k == "sentence" for *_, k in pieces[:-1])


def test_word_only_texts_overlap():
    for n in (*range(2561, 2801, 20), 3800, 5000, 20_000):
        for text in (("word " * n)[:n], ('{"id":4711} ' * n)[:n], ("pallet " * n)[: n - 400] + "One sentence. " * 29):
            pieces = check(text, 1400, 240)
            assert all(120 <= b - c <= 240 for (_, b, _), (c, _, _) in zip(pieces, pieces[1:])), n


def test_runs_keep_the_overlap_that_fits():
    for run in (1150, 1200, 1300, 1390, 1400):
        pieces = check("word " * 300 + "x" * run + " word" * 300, 1400, 240)
        at = next(i for i, (a, b, _) in enumerate(pieces) if a <= 1500 and b >= 1500 + run)
        assert min(240, 1400 - run) - 5 <= pieces[at - 1][1] - pieces[at][0]
        assert all(120 <= b - c for i, ((_, b, _), (c, _, _)) in enumerate(zip(pieces, pieces[1:])) if i != at - 1)


def test_paragraphs_win():
    text = ("alpha beta gamma. " * 17 + "\n\n") * 12
    assert {k for *_, k in check(text, 1400, 240)[:-1]} == {"paragraph"}


def test_bad_overlap():
    with pytest.raises(ValueError):
        sp.split_text("x", 100, 50)


def test_operator(spark):
    rows = [(1, "short", 0, "t"), (2, None, 0, "t"), (3, "", 0, "t"), (4, "w " * 1000, 0, "t"), (4, "w " * 1000, 0, "t")]
    df = spark.createDataFrame(rows, "key int, text string, piece int, kind string")
    got = sp.split_oversized(df, "key", "text").collect()
    assert {r.key for r in got} == {1, 4}
    assert [(r.start, r.end, r.kind) for r in got if r.key == 1] == [(0, 5, "end")]
    assert all(r.text == ("w " * 1000)[r.start : r.end] for r in got if r.key == 4)
    assert sp.split_oversized(df.limit(0), "key", "text").count() == 0
