import random

import pytest

from quillspark.llm import licenses

SHORT = ("mit-notice", "cc-by-nc-4-notice", "apache-2-notice")


@pytest.mark.parametrize("name", SHORT)
def test_every_one_of_adjacent_notices_is_found(name):
    line = licenses.TEMPLATES[name]
    text = "\n".join([line] * 9)
    got = licenses.Index.build(licenses.TEMPLATES).scan(text)
    assert [(g[0], text[g[4] : g[5]]) for g in got] == [(name, line.rstrip("."))] * 9


def test_a_worse_copy_beside_a_better_one_is_found():
    text = "Released under the MIT License. Released under the MIT Licence. Released under the MIT License."
    got = licenses.Index.build(licenses.TEMPLATES).scan(text)
    assert [(g[0], g[1]) for g in got] == [("mit-notice", 5), ("mit-notice", 4), ("mit-notice", 5)]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_changed_words_at_the_least_coverage_are_found(name):
    words = licenses.tokenize(licenses.TEMPLATES[name])[0]
    changes = int(0.2 * len(words) + 1e-9)
    rng = random.Random(name)
    spread = [round((i + 1) * len(words) / (changes + 1)) for i in range(changes)]
    cases = [spread] + [rng.sample(range(1, len(words) - 1), changes) for _ in range(30)]
    for changed in cases if changes else []:
        text = "before it " + " ".join("zzz" if i in changed else w for i, w in enumerate(words)) + " and after"
        got = licenses.Index.build({name: licenses.TEMPLATES[name]}).scan(text)
        assert [(g[0], g[1]) for g in got] == [(name, len(words) - changes)], changed


@pytest.mark.parametrize("name", (*SHORT, "gpl-3-notice", "apache-2-grant"))
def test_k_adjacent_notices_give_k_spans(name):
    line, index = licenses.TEMPLATES[name], licenses.Index.build(licenses.TEMPLATES)
    for k in range(1, 51):
        got = index.scan("before. " + " ".join([line] * k) + " after")
        assert [g[0] for g in got] == [name] * k and all(g[3] == 1.0 for g in got), k


def test_notices_of_two_kinds_by_turns():
    index = licenses.Index.build(licenses.TEMPLATES)
    got = index.scan(" ".join(licenses.TEMPLATES[n] for _ in range(20) for n in ("cc-by-nc-4-notice", "apache-2-notice")))
    assert [g[0] for g in got] == ["cc-by-nc-4-notice", "apache-2-notice"] * 20


def longest_common(template, words):
    """By table: the longest common subsequence, and the last and, among those, latest first word of one in the text."""
    table = [[0] * (len(words) + 1) for _ in range(len(template) + 1)]
    for i, t in enumerate(template):
        for j, w in enumerate(words):
            table[i + 1][j + 1] = table[i][j] + 1 if t == w else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("name", ("mit-text", "bsd-3-text", "isc-text", "apache-2-grant", "gpl-notice"))
def test_alignment_against_the_whole_table(name):
    """Matched words, coverage, start and end of templates with words changed, dropped and added, in text that shares no word with them."""
    rng, index = random.Random(name), licenses.Index.build({name: licenses.TEMPLATES[name]})
    template = licenses.tokenize(licenses.TEMPLATES[name])[0]
    found = 0
    for trial in range(25):
        words, at = [], 0
        for i, w in enumerate(template):
            p = rng.random()
            inner = 2 < i < len(template) - 3
            if inner and p < 0.02 * (trial % 4):
                words.append(f"q{rng.randrange(99)}")
            elif inner and p < 0.03 * (trial % 4) and at > -4:
                at -= 1
            elif inner and p < 0.04 * (trial % 4) and at < 4:
                at += 1
                words += [w, f"q{rng.randrange(99)}"]
            else:
                words.append(w)
        text = " ".join([*["xx"] * rng.randrange(30), *words, *["yy"] * rng.randrange(30)])
        matched = longest_common(template, licenses.tokenize(text)[0])
        if matched < 0.8 * len(template):
            continue
        got = index.scan(text)
        found += len(got) == 1
        if got:
            assert got[0][1] == matched and got[0][2] == len(template) and got[0][3] == matched / len(template)
            assert text[got[0][4] : got[0][5]] == " ".join(words)
    assert found >= 23


def test_recall_of_edited_texts():
    """Each full text with a tenth of its words changed, dropped or doubled at random, in plain prose: found in nine of ten cases or more."""
    rng, index = random.Random(17), licenses.Index.build(licenses.TEMPLATES)
    names = [n for n in licenses.TEMPLATES if n.endswith("-text")]
    hits = total = 0
    for _ in range(20):
        for name in names:
            words = licenses.TEMPLATES[name].split()
            for i in rng.sample(range(len(words)), len(words) // 10):
                words[i] = rng.choice(("other", "", words[i] + " " + words[i]))
            text = "some prose before it " + " ".join(words) + " and some after"
            total += 1
            hits += name in {g[0] for g in index.scan(text)}
    assert hits >= 0.9 * total


def test_thousands_of_notices_in_one_text_take_little_time():
    import time

    index, line = licenses.Index.build(licenses.TEMPLATES), licenses.TEMPLATES["mit-notice"]
    began = time.time()
    assert len(index.scan("\n".join([line] * 8000))) == 8000
    assert time.time() - began < 60


@pytest.mark.parametrize("added", (9, 12, 20, 30))
def test_texts_with_added_words_are_found(added):
    """Words added at random places of each long template, in prose: found in nine of ten cases or more."""
    rng, index = random.Random(added), licenses.Index.build(licenses.TEMPLATES)
    names = [n for n, t in licenses.TEMPLATES.items() if len(licenses.tokenize(t)[0]) >= 60]
    hits = total = 0
    for _ in range(8):
        for name in names:
            words = licenses.TEMPLATES[name].split()
            for _ in range(added):
                words.insert(rng.randrange(1, len(words)), f"extra{rng.randrange(999)}")
            got = index.scan("some prose before it " + " ".join(words) + " and some after")
            total += 1
            hits += name in {g[0] for g in got}
    assert hits >= 0.9 * total


def test_a_block_of_added_words_widens_the_span():
    words = licenses.TEMPLATES["mit-grant"].split()
    text = " ".join([*words[:30], *["extra"] * 25, *words[30:]])
    got = licenses.Index.build({"mit-grant": licenses.TEMPLATES["mit-grant"]}).scan("before " + text + " after")
    assert [(g[0], g[3], g[4], g[5]) for g in got] == [("mit-grant", 1.0, 7, 7 + len(text.rstrip(":")))]


def test_fewer_than_the_shared_words_bound_never_align():
    """The bound that spares alignments is never under what an alignment in the same band matches."""
    rng, index = random.Random(3), licenses.Index.build(licenses.TEMPLATES)
    import numpy as np

    pool = sorted(index.vocabulary)[:60] + ["other"]
    for _ in range(200):
        t = rng.randrange(len(index.names))
        words = [rng.choice(pool if rng.random() < 0.5 else index.words[t]) for _ in range(rng.randrange(1, 120))]
        ids = np.array([index.vocabulary.get(w, len(index.vocabulary)) for w in words])
        diagonal, reach = rng.randrange(-40, len(words) + 5), rng.choice((0, 0, 7, 30))
        low, high = sorted(rng.choices(range(len(words) + 1), k=2))
        assert licenses.align(index.words[t], words, diagonal, low=low, high=high, reach=reach)[0] <= index._possible(t, ids, diagonal, low, high, reach)


def test_a_long_text_of_shared_words_without_a_match_takes_little_time():
    import time

    index = licenses.Index.build(licenses.TEMPLATES)
    began = time.time()
    assert index.scan("without restriction including " * 20_000) == []
    assert time.time() - began < 30
