import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from momentlake.llm import leakage, residue
from momentlake.llm.text import rendered, words

VOCABULARY = "gate lamp red blue crate visitor camera walks stops turns kneels near the old north south bench".split()


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 5), min_size=1, max_size=120), st.lists(st.lists(st.integers(1, 7), min_size=3, max_size=3), min_size=1, max_size=8))
def test_fm_index(text, phrases):
    index = leakage.FMIndex(np.array(text))
    lo, hi = index.search(np.array(phrases))
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(text) - 2) if text[i : i + 3] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(0)
    t = np.append(rng.integers(1, 4, 200), 0)
    assert leakage.suffix_array(t).tolist() == sorted(range(201), key=lambda i: t[i:].tolist())
    s = rng.integers(0, 11, 300)
    m = leakage.WaveletMatrix(s, 11)
    for c in range(11):
        at = np.arange(301)
        assert m.rank(np.full(301, c), at).tolist() == [int((s[:i] == c).sum()) for i in at]
    assert m.symbol(np.arange(300)).tolist() == s.tolist()


def leak_rule(docs, tests, width):
    grams = {}
    for q, *fields in tests:
        for f in fields:
            w = words(f) if f else []
            for k in range(len(w) - width + 1):
                grams.setdefault(tuple(w[k : k + width]), set()).add(q)
    out = set()
    for d, t in docs:
        w = words(t) if t and d is not None else []
        for k in range(len(w) - width + 1):
            out |= {(d, q) for q in grams.get(tuple(w[k : k + width]), ())}
    return out


def test_leaks_equal_the_rule(spark):
    rng = random.Random(7)
    tests = [(f"q{i}", " ".join(rng.choices(VOCABULARY, k=rng.randrange(3, 20))), " ".join(rng.choices(VOCABULARY, k=15)) if i % 3 else None) for i in range(12)] + [("e", "", None)]
    docs = []
    for i in range(200):
        w = rng.choices(VOCABULARY + ["zebra", "moon"], k=rng.randrange(0, 40))
        if i % 4 == 0:
            q = rng.choice(tests[:12])[1].split()
            a = rng.randrange(len(q))
            w += [x.upper() if rng.random() < 0.3 else x for x in q[a:]] + rng.choices(VOCABULARY, k=3)
        t = rng.choice([" ", "-", " &amp;nbsp; ", " <b>", ", "]).join(w)
        docs.append((i, t))
    docs += [(500, None), (501, ""), (None, tests[0][1]), (502, " ".join([tests[1][1]] * 500))] + docs[:5]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item string")
    t = spark.createDataFrame(tests, "id string, a string, b string")
    for options in ({}, {"shard_chars": 500, "block_phrases": 20}):
        spans = leakage.leaked_spans(d, "doc_id", "text", t, "id", ["a", "b"], width=6, **options)
        got = {tuple(r) for r in leakage.leaked_documents(spans).collect()}
        assert got == leak_rule(docs, tests, 6) and len(got) > 20
    for r in leakage.leaked_spans(d, "doc_id", "text", t, "id", ["a", "b"], width=6).where("doc_id = 502").collect():
        assert 0 <= r.word_start < r.word_end
    assert leakage.leaked_spans(d.where("false"), "doc_id", "text", t, "id", ["a"]).count() == 0
    assert leakage.leaked_spans(d, "doc_id", "text", t.where("false"), "id", ["a"]).count() == 0


def test_rendering():
    assert words("W<b>he</b>n&nbsp;th&#101; &amp;lt; <br>b­e​ll") == ["when", "the", "bell"]
    assert words("Ｗｈｉｃｈ ﬁve") == ["which", "five"]
    assert words("a_b-c 1,5") == ["a", "b", "c", "1", "5"]
    assert "<hora>" in rendered("x &lt;hora&gt; y", all_tags=False) and "<site>" in rendered("<site>", all_tags=False)
    assert words("one<br>two</p>three") == ["one", "two", "three"]


def notes(rng, n):
    who, what = ["A visitor", "A courier", "The guard", "Someone"], ["leaves a red crate near the gate", "stops by the lamp before dawn", "walks past the bench twice", "turns back at the north door"]
    return [" ".join(f"{rng.choice(who)} {rng.choice(what)} at {rng.randrange(60)}:{rng.randrange(60):02}." for _ in range(rng.randrange(1, 6))) for _ in range(n)]


def test_odd_long_texts(spark):
    odd = ["a." * 60_000, "[" * 20_000, "{{" * 20_000, "<a " + "x " * 60_000, "<" * 20_000, "&amp;" * 20_000, "word " * 60_000, "- \n" * 5000, "\u200b" * 1000, "$" * 5000]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert residue.residue_documents(df, "doc_id", "text").count() <= len(odd)
    tests = spark.createDataFrame([("q", " ".join(["word"] * 12))], "id string, a string")
    assert {r.doc_id for r in leakage.leaked_spans(df, "doc_id", "text", tests, "id", ["a"]).collect()} == {6}


def test_placeholders_of_any_length():
    for size in (2, 45, 400, 9000):
        name = "long name " * (size // 10) + "ab"
        for text in ("{{%s}}", "${%s}", "[[%s]]", "<<%s>>", "{%% %s %%}", "@@%s@@", "{{{%s}}}", "%%(%s)s", "[insert %s]", "(your %s here)"):
            found = residue.passages(f"Somebody leaves by the door at {text % name} before noon today.")
            assert len(found) == 1 and found[0][1] and "name" not in found[0][0], text
        word = "ab" * (size // 2 + 1)
        for text in ("%%%s%%", "$%s$", "__%s__", "#%s#", "{%s}", "<%s>"):
            assert residue.passages(f"Somebody leaves by the door at {text % word} before noon today.")[0][1], text


def test_passages_and_features():
    text = "Clip gate_1\nA dog barks. It runs (fast!) off - then stops: quiet\n" + "=" * 12 + "\n12"
    assert [p for p, *_ in residue.passages(text)] == ["Clip gate_1", "A dog barks.", "It runs (fast!)", "off", "then stops", "quiet", "⟦_rule⟧", "12"]
    tokens = [["a", "b", "a"], [], ["b", "7"], ["a", "b", "a"], ["b", "19"]]
    f, sizes = residue.features(tokens, [["double"], [], [], ["double"], []])
    parts = np.split(f, np.cumsum(sizes)[:-1])
    # ^a ab ba a$ with two words and a style; ^$; ^b b# #$ with two words
    assert sizes.tolist() == [7, 1, 5, 7, 5] and np.array_equal(parts[0], parts[3]) and np.array_equal(parts[2], parts[4])


def test_residue_on_held_out_records(spark):
    rng = random.Random(9)
    plain = notes(rng, 600)
    slots = ["{{ name }}", "${site}", "[TBD]", "__TIME__", "%USER%", "<<when>>", "undefined", "{0}", "<ort>"]
    explains = [f"In the form the field {{{{site}}}} stands for the place, here door {i}." for i in range(25)]
    quotes = [f'The guard wrote "access denied" in the log because door {i} stayed shut.' for i in range(25)]
    hurt = []
    for i in range(120):
        w = rng.choice(plain).split()
        for _ in range(1 + i % 3):
            w[rng.randrange(len(w))] = rng.choice(slots)
        hurt.append(" ".join(w))
    errors = [rng.choice(["404 Not Found", "Access denied. Please sign in again.", "Please enable JavaScript to view this page.", "Lorem ipsum dolor sit amet lorem ipsum dolor.", "Something went wrong. Please try again later."]) for _ in range(60)]
    heads = [f"Clip gate_{i}\n{rng.choice(errors)}" for i in range(20)]
    data = [(t, False) for t in plain + explains + quotes] + [(t, True) for t in hurt + errors + heads] + [(None, False), ("", False), (" \n", False), (plain[0] * 300, False)]
    rng.shuffle(data)
    df = spark.createDataFrame([(i, t, 3) for i, (t, _) in enumerate(data)] + [(None, errors[0], 3)], "doc_id long, text string, n_passages int")
    found = {r.doc_id for r in residue.residue_documents(df, "doc_id", "text").collect()}
    want = {i for i, (_, bad) in enumerate(data) if bad}
    assert len(found & want) >= 0.93 * len(want) and len(found - want) <= 0.03 * len(want)
    assert residue.residue_documents(df.where("false"), "doc_id", "text").count() == 0
    only = spark.createDataFrame([(1, "A visitor walks past.")], "doc_id long, text string")
    assert residue.residue_documents(only, "doc_id", "text").count() == 0
