import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm.quality import STATISTICS, CommonWords, document_statistics, fit_tails, in_tails, language_sketches, merged_sketches, prose_scores, sketch_quantiles, text_statistics, word_counts
from trackloom.llm.words import CHUNK, chunks, cut

EN = ["We saw that the count was not right because it had been cut too early.", "Nobody could say how the ladder got in front of the door, but it was there for an hour.", "If they come back before noon, we will look at it again with the whole team."]
DE = ["Wir haben die Liste noch einmal angesehen, weil sie nicht ganz stimmte.", "Am Ende war es ruhig, aber niemand weiß, ob das auch so bleibt."]
MS = ["Kami melihat lawatan itu dan tiada apa yang berubah selepas hari itu.", "Terdapat kotak di pintu kerana rak telah dialihkan, jadi kita perlu menunggu."]
ZH = ["我们又看了一遍到访表，不过还要再等一周。", "没有人知道这是不是从入口来的，所以我们会去看。"]


SPOKEN = {"en": EN, "de": DE, "ms": MS, "zh": ZH}


def prose(rng, language=None):
    return " ".join(rng.choice(SPOKEN[language or rng.choice(list(SPOKEN))]) for _ in range(rng.randint(2, 9)))


def other(rng):
    kind = rng.randrange(5)
    n = rng.randint(6, 40)
    if kind == 0:
        return "a,b,c\n" + "\n".join(f"{rng.randint(0, 99)},{rng.random():.3f},zone_{rng.randint(0, 9)}" for _ in range(n))
    if kind == 1:
        return "\n".join(f"* the {rng.choice(['door', 'shelf', 'heat map'])}" for _ in range(n))
    if kind == 2:
        return "\n".join(f"2025-05-0{rng.randint(1, 9)} INFO track.born gid={rng.randint(0, 99)}" for _ in range(n))
    if kind == 3:
        return " ".join("".join(rng.choice("bcdfghjk") for _ in range(rng.randint(2, 9))) for _ in range(n))
    return rng.choice(EN) + "\n\n" + "".join(rng.choice("#$%&*<>|") for _ in range(20 * n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    docs, tags = [], []
    for i in range(900):
        language = rng.choice(["en", "en", "en", "de", "ms", "zh"])
        docs.append((i, *((prose(rng, language), "prose") if rng.random() < 0.7 else (other(rng), "not_prose"))))
        tags.append(rng.choice([language] * 6 + [language.upper() + " ", "de", None, "xx"]))
    frame = spark.createDataFrame([(i, t, tag, 0.5) for (i, t, _), tag in zip(docs, tags)], "doc_id bigint, text string, lang string, n_words double")
    return docs, frame


def test_held_out_accuracy(spark, corpus):
    docs, frame = corpus
    labels = spark.createDataFrame([(i, k, "x") for i, _, k in docs if i < 300], "doc_id bigint, label string, text string")
    bad = {r.doc_id for r in prose_scores(frame, labels).where("not_prose_score > 0").collect()}
    held = [(i, k) for i, _, k in docs if i >= 300]
    assert sum((i in bad) == (k == "not_prose") for i, k in held) / len(held) > 0.97


def test_without_labels(spark, corpus):
    docs, frame = corpus
    bad = {r.doc_id for r in prose_scores(frame, spark.createDataFrame([], "doc_id bigint, label string")).where("not_prose_score > 0").collect()}
    assert sum((i in bad) == (k == "not_prose") for i, _, k in docs) / len(docs) > 0.9


def words_of(*languages):
    return CommonWords({w: k for k, text in enumerate(languages) for w in {w for s in text for w in tokens(s)}})


def tokens(text):
    c = cut([text])
    return [c.text[a:b] for a, b in zip(c.starts, c.stops)]


def test_statistics_of_one_text():
    common = CommonWords({"the": 0, "no": 0})
    _, values = text_statistics(["The cat sat.\nNo end here\n\n12 + 3"], common)
    s = dict(zip(STATISTICS, values[0]))
    assert s["n_words"] == 8 and s["mean_word_length"] == pytest.approx(21 / 8)
    assert s["symbol_share"] == pytest.approx(2 / 23) and s["digit_share"] == pytest.approx(3 / 23)
    assert s["punctuated_lines"] == pytest.approx(1 / 3) and s["common_words"] == pytest.approx(2 / 8)
    assert s["distinct_words"] == 1 and s["top_word_share"] == pytest.approx(1 / 8) and s["words_per_line"] == pytest.approx(8 / 3)
    seen, _ = text_statistics([" ".join(DE), " ".join(MS), "".join(ZH), "qqq zzz"], words_of(EN, DE, MS, ZH))
    assert seen.tolist() == [1, 2, 3, -1]
    assert text_statistics(["\u200b ..."], common)[1][0][0] == 0


def test_words_are_cut_as_plainly_written():
    rng = random.Random(5)
    han = "㐀-䶿一-鿿豈-﫿"
    plain = re.compile(rf"[{han}]|[^\W_{han}]+(?:['’\-_][^\W_{han}]+)*")
    texts = ["".join(rng.choice("ab'-_ \n.9é中文ＡＢﬁ\u00ad’") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", "a", "-", "中"]
    c = cut(texts)
    for i, text in enumerate(texts):
        wanted = plain.findall(unicodedata.normalize("NFKC", text).casefold())
        assert [c.text[a:b] for a, b, o in zip(c.starts, c.stops, c.owner) if o == i] == wanted, text
    spelt = [c.text[a:b] for a, b in zip(c.starts, c.stops)]
    assert len(set(zip(spelt, c.hashes.tolist()))) == len(set(spelt)) == len(set(c.hashes.tolist()))


def test_chunks_do_not_matter():
    rng = random.Random(6)
    texts = [prose(rng) if k % 2 else other(rng) for k in range(60)] + ["", " ", "x" * (CHUNK + 5), "!"]
    common = words_of(EN, DE, MS, ZH)
    together = [text_statistics(texts[a:b], common) for a, b in chunks(texts)]
    assert len(together) > 1
    alone = [text_statistics([t], common) for t in texts]
    assert [x for part, _ in together for x in part.tolist()] == [x for part, _ in alone for x in part.tolist()]
    assert [v for _, part in together for v in part.round(9).tolist()] == [v for _, part in alone for v in part.round(9).tolist()]


def test_letter_case_and_wrapping_do_not_matter():
    text, common = " ".join(EN), words_of(EN)
    at = STATISTICS.index("running_words")
    for form in (text, text.upper(), text.replace(" ", "\n"), text.replace(",", "").replace(".", "")):
        assert text_statistics([form], common)[1][0][at] > 0.95


def test_running_text_by_brute_force():
    """The share of running words equals that of a plain scan over all windows."""
    rng = random.Random(8)
    common = CommonWords({"um": 0})
    for _ in range(60):
        words = [rng.choice(["um", "xa", "xb", "xc"]) for _ in range(rng.randint(1, 60))]
        n = len(words)
        need = max(1, round(4 * min(1, n / 13)))
        runs = [False] * n
        at = [i for i, w in enumerate(words) if w == "um"]
        for i in range(len(at) - need + 1):
            if at[i + need - 1] - at[i] < 13:
                runs[at[i] : at[i + need - 1] + 1] = [True] * (at[i + need - 1] - at[i] + 1)
        assert text_statistics([" ".join(words)], common)[1][0][STATISTICS.index("running_words")] == pytest.approx(sum(runs) / n)


def test_word_counts_by_brute_force(spark, corpus):
    docs, frame = corpus
    scales = {"other": (np.zeros(3), np.full(3, 1e9))}  # every text is body
    got = {r.word: r.n for r in word_counts(frame.select("text", F.lit("aa").alias("language")), scales).collect()}
    wanted = Counter(w for _, t, _ in docs for w in {w for w in tokens(t) if not any(c.isdigit() or c in "'’-_" for c in w) and len(w) <= 40})
    assert got.pop(None) == len(docs) and got == dict(wanted)


def test_common_words_are_learnt(spark, corpus):
    from trackloom.llm.quality import common_words

    _, frame = corpus
    counts = [("aa", "body", None, 100), ("aa", "tail", None, 50)] + [("aa", side, w, n) for w, body, tail in [("of", 90, 1), ("is", 60, 1), ("door", 60, 25), ("rare", 2, 0)] for side, n in [("body", body), ("tail", tail)] if n]
    counts += [("bb", "body", None, 10), ("bb", "tail", None, 10), ("bb", "body", "of", 1), ("bb", "body", "und", 9)]  # a wrong tag
    assert common_words(spark.createDataFrame(counts, "language string, side string, word string, n bigint")) == {"of": "aa", "is": "aa", "und": "bb"}
    assert common_words(spark.createDataFrame([], "language string, side string, word string, n bigint")) == {}


def test_tails_alone_decide():
    rng = np.random.default_rng(4)
    bad = (np.arange(400) % 4 == 0).astype(float)
    z = rng.normal(0, 0.4, (400, 3))
    z[:, 1] -= 6 * bad
    cuts, weights = fit_tails(z, bad)
    assert (weights[:-1] >= 0).all() and weights[-1] < 0 and all(abs(c) >= 0.5 for _, c in cuts)
    assert ((in_tails(z, cuts) @ weights[:-1] + weights[-1] > 0) == bad).mean() > 0.99
    assert not (in_tails(np.zeros((1, 3)), cuts) @ weights[:-1] + weights[-1] > 0).any()


def test_nulls_blanks_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, EN[0]), (4, EN[0]), (5, "x" * 60_000), (6, "!!!")]
    frame = spark.createDataFrame([(*r, None) for r in rows], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in document_statistics(frame).collect()) == [4, 4, 5, 6]
    scored = prose_scores(frame, spark.createDataFrame([(4, None), (5, "other")], "doc_id bigint, label string")).collect()
    assert sorted(r.doc_id for r in scored) == [4, 4, 5, 6] and all(r.not_prose_score is not None for r in scored)
    assert prose_scores(frame.limit(0), spark.createDataFrame([], "doc_id bigint, label string")).collect() == []


def test_sketches_of_parts_merge_exactly(spark, corpus):
    _, frame = corpus
    statistics = document_statistics(frame)
    whole = language_sketches(statistics)
    parts = merged_sketches(*[language_sketches(statistics.where(F.pmod("doc_id", F.lit(3)) == k)) for k in range(3)])
    rows = lambda df: sorted(tuple(r) for r in df.select("language", "statistic", F.coalesce("bucket", F.lit(-(1 << 30))), "n").collect())
    assert rows(whole) == rows(parts)


def test_sketch_quantiles_are_near(spark, corpus):
    _, frame = corpus
    statistics = document_statistics(frame)
    got = {(r.language, r.statistic): (r.a, r.b) for r in sketch_quantiles(language_sketches(statistics), a=0.5, b=0.9).collect()}
    values = {}
    for r in statistics.collect():
        for s in STATISTICS:
            values.setdefault((r.language, s), []).append(r[s])
    for key, v in values.items():
        v.sort()
        for q, near in zip((0.5, 0.9), got[key]):
            assert near == pytest.approx(v[max(0, math.ceil(q * len(v)) - 1)], rel=0.006), key
