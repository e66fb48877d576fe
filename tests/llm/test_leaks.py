import random

import numpy as np
import pytest

from trackloom.llm.leaks import KINDS, LeakRules, _candidates, build_index, cgk, edit_distance, edited, leaked_items, search, words_of
from trackloom.llm.words import cut

VOCABULARY = [a + b for a in "ka lo mi ne pu ra".split() for b in "sta tem lin dor".split()]


def passage(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def brute(docs, items, k=12):
    grams = lambda text: {tuple(w[i : i + k]) for w in [words_of(text or "")] for i in range(len(w) - k + 1)}
    held = {i: grams(p) for i, p in items if i is not None}
    return sorted((d, i) for d, t in docs for g in [grams(t)] for i, h in held.items() if g & h)


def run(spark, docs, items, rules=LeakRules()):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id string, passage string, text string")
    return sorted((r.doc_id, r.item_id) for r in leaked_items(d, i, rules).where("edits = 0").collect())


def test_equals_brute_force(spark):
    rng = random.Random(3)
    items = [(f"I{k}", passage(rng, rng.choice([5, 12, 30, 60]))) for k in range(40)] + [(None, passage(rng, 20)), ("null", None), ("empty", "")]
    docs = [(-1, None), (-2, ""), (-3, " \n")]
    for k in range(250):
        text = passage(rng, rng.randint(0, 80))
        if k % 2:
            words = rng.choice(items[:40])[1].split()
            n = rng.choice([11, 12, 13, len(words)])
            at = rng.randint(0, max(0, len(words) - n))
            text = f"{text} odd {' '.join(words[at : at + n])} strange {text[:50]}"
        docs.append((k, text))
    docs += [(7000, docs[8][1]), (7001, items[3][1]), (7001, items[3][1])]
    want = brute(docs, items)
    assert len(want) > 60
    assert run(spark, docs, items) == sorted(set(want))
    assert run(spark, docs, items, LeakRules(block_chars=1500)) == sorted(set(want))  # several passes
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_not_letter_for_letter(spark):
    text = "At frame 26 the beige dolly emerges by the arcade while nobody watches it"
    forms = [text.upper(), text.replace(" ", ",\n  "), text.replace("beige", "be­ige").replace("arcade", "ar​cade"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text), text.replace("beige", "grey")]
    assert run(spark, list(enumerate(forms)), [("A", text)]) == [(0, "A"), (1, "A"), (2, "A"), (3, "A")]


def test_embedding_keeps_small_distances():
    rng = np.random.default_rng(1)
    walk = rng.integers(0, 2, (36, 60))
    rows = rng.integers(1, 50, (400, 12))
    other = rows.copy()
    other[:, 5] = rng.integers(1, 50, 400)
    apart = rng.integers(1, 50, (400, 12))
    hamming = lambda a, b: (cgk(a, walk) != cgk(b, walk)).sum(axis=1).mean()
    assert hamming(rows, rows) == 0 and hamming(rows, other) < 0.4 * hamming(rows, apart)


def test_edit_distance():
    a = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4], [1, 1, 1, 1]])
    b = np.array([[1, 2, 3, 4], [2, 3, 4, 5], [1, 9, 3, 8], [2, 2, 2, 2]])
    assert edit_distance(a, b).tolist() == [0, 2, 2, 4]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_banded_distance(most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(0, 3, (500, 7)), rng.integers(0, 3, (500, 7))
    assert (edit_distance(a, b, most) == np.minimum(edit_distance(a, b), most + 1)).all()


def near_pairs(texts, items, most, k=12):
    """(text, item) -> fewest edits between any two windows, by looking at all of them."""
    code = {}
    number = lambda p: [code.setdefault(w, len(code)) for w in words_of(p or "")]
    windows = lambda ws: np.array([ws[i : i + k] for i in range(len(ws) - k + 1)], np.int64).reshape(-1, k)
    held, out = [(name, windows(number(p))) for name, p in items], {}
    for t, text in enumerate(texts):
        own = windows(number(text))
        for name, its in held:
            if len(own) and len(its):
                d = edit_distance(np.repeat(own, len(its), axis=0), np.tile(its, (len(own), 1))).min()
                if d <= most:
                    out[t, name] = int(d)
    return out


def varied(rng, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, rng.choice(vocabulary))
    return words


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_passages_by_brute_force(edits):
    rng = random.Random(edits)
    vocabulary = [a + b for a in VOCABULARY for b in "0123456789"]
    items = [(f"I{k:02}", " ".join(rng.choice(vocabulary) for _ in range(rng.choice([12, 14, 25])))) for k in range(40)] + [("short", "a b c")]
    texts = [None, "", "a b c"]
    for _ in range(150):
        words = varied(rng, rng.choice(items[:40])[1].split(), vocabulary, rng.randint(0, 3))
        texts.append(" ".join([*(rng.choice(vocabulary) for _ in range(5)), *words, *(rng.choice(vocabulary) for _ in range(5))]))
    texts += texts[-3:]
    index = build_index(items, LeakRules(max_edits=edits, sampled=4 if edits > 2 else 5))
    assert min(index.measured.values()) >= 0.995
    wanted = near_pairs(texts, items, edits)
    found = {(int(t), index.items[i]): int(e) for t, i, e in zip(*search(texts, index))}
    assert len(set(wanted.values())) == edits + 1
    assert set(found) <= set(wanted) and len(found) >= 0.98 * len(wanted)
    assert all(found[key] == e for key, e in wanted.items() if e == 0)
    assert sum(found[key] != wanted[key] for key in found) <= 0.02 * len(found)


def test_recall_of_every_kind_of_edit():
    rng = np.random.default_rng(9)
    items = [(f"I{k}", " ".join(f"w{w}" for w in rng.integers(0, 800, 40))) for k in range(150)]
    rules = LeakRules(max_edits=2)
    index = build_index(items, rules)
    names = {n: i for i, n in enumerate(index.items)}
    for kind in KINDS:
        texts, wanted = [], []
        for k in range(600):
            name, passage = items[int(rng.integers(len(items)))]
            words = passage.split()
            at = int(rng.integers(0, len(words) - 15))
            row = edited(np.array([range(at, at + 12)]), np.array([[at + 12, at + 13]]), kind, rules, 2000, rng)[0]
            texts.append("before " * 12 + " ".join(words[c] if c < 40 else f"x{c}" for c in row) + " after" * 12)
            wanted.append((k, names[name]))
        text, item, _ = search(texts, index)
        assert len(set(wanted) & set(zip(text.tolist(), item.tolist()))) >= 0.985 * len(wanted), kind


def test_windows_left_out_before_the_walk_cannot_match():
    rng = random.Random(12)
    for edits in (0, 1, 2, 3):
        items = [("A", " ".join(rng.choice(VOCABULARY) for _ in range(60)))]
        index = build_index(items, LeakRules(max_edits=edits, sampled=4))
        its = index.windows
        words = varied(rng, items[0][1].split(), VOCABULARY + ["strange"], 8)
        c = cut([" ".join(words)], plain=True)
        codes = np.maximum(index.vocabulary.find(c.hashes), 0).astype(np.int64)
        kept = set(_candidates(codes, c.owner, index).tolist())
        for i in range(len(codes) - 11):
            row = np.where(codes[i : i + 12] == 0, -1, codes[i : i + 12])
            if edit_distance(np.tile(row, (len(its), 1)), its).min() <= edits:
                assert i in kept


def test_no_silent_loss_of_tables():
    items = [("A", " ".join(f"w{k}" for k in range(40)))]
    with pytest.raises(ValueError, match="recall"):
        build_index(items, LeakRules(max_edits=4, sampled=10, most_tables=3))


def test_long_passages_and_repeated_items(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(6000))
    words = long.split()
    items = [("A", long), ("A", "other words of the same item that are twelve words long in all"), ("B", " ".join(words[3990:4010])), (None, long)]
    docs = [(1, " ".join(words[1995:2008])), (2, " ".join(words[3994:4008])), (3, "of the same item that are twelve words long in all"), (3, "x"), (4, "other words of the same item that are twelve words long in all")]
    assert run(spark, docs, items) == [(1, "A"), (2, "A"), (2, "B"), (4, "A")]
    assert run(spark, docs, items, LeakRules(block_chars=9000)) == [(1, "A"), (2, "A"), (2, "B"), (4, "A")]
