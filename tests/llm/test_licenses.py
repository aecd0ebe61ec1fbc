import random
import re

import numpy as np

from chronofold.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NOTICE = licenses.NOTICES[0].text


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words = WORD.findall(lower(text))
    found = []
    for t in licenses.PHRASES:
        p = t.text.split()
        found += [(i, t.label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found})))


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, label string, row int").repartition(3)
    return {r["doc_id"]: r for r in licenses.scan_documents(df).collect()}


def test_base_against_plain_python(spark):
    rng = random.Random(2)
    vocabulary = ["gnu", "general", "public", "license", "Apache", "LICENSE", "cc", "by", "mit", "the", "é", "cc-by", "license.", "\n"]
    texts = [None, "", "mit", "MIT License", "a mit license b mit license", "cc\nby 4.0", "gnu general public license" * 2, "x " * 5000 + "Apache  License", "mitlicense mit licenseé"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    got = scan(spark, texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_notices_with_changed_words(spark):
    words = NOTICE.split()
    texts = [NOTICE, "before it " + NOTICE.upper() + " and after", " ".join(words[:10] + ["oddly"] + words[10:]), " ".join(words[:12] + words[13:]), " ".join(words[:6]), " ".join(reversed(words))]
    labels = [("mit-notice" in scan(spark, texts)[i]["labels"].split(",")) for i in range(len(texts))]
    assert labels == [True, True, True, True, False, False]


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "mit license"), (1, "cc by"), (None, "apache license"), (1, "mit license")], "doc_id long, text string")
    rows = sorted((r["doc_id"] is None, r["labels"]) for r in licenses.scan_documents(df).collect())
    assert rows == [(False, "cc-by"), (False, "mit"), (False, "mit"), (True, "apache")]
    assert licenses.scan_documents(df.limit(0)).count() == 0


def test_repeating_one_line_of_a_notice_is_no_copy(spark):
    line = " ".join(NOTICE.split()[:4])
    texts = [f"{line}, " * 8, f"{line} and more. " * 40, " ".join(NOTICE.split()[:15] * 6), (NOTICE + " ") * 3]
    got = scan(spark, texts)
    assert ["mit-notice" in got[i]["labels"].split(",") for i in range(4)] == [False, False, False, True]
    assert got[0]["score"] == 0.0 and got[3]["score"] == 1.0


def pairs_cover(pairs, k, at):
    return any(j <= at < j + k for _, j in pairs)


def spans_by_hand(text):
    """Labels of the notices and the best cover, by a plain search over diagonals."""
    words, labels, best = WORD.findall(lower(text)), set(), 0.0
    for t in licenses.PHRASES + licenses.NOTICES:
        p, k = WORD.findall(lower(t.text)), 2 if t.phrase else 4
        hits = {}
        for i in range(len(words) - k + 1):
            for j in range(len(p) - k + 1):
                if words[i : i + k] == p[j : j + k]:
                    hits.setdefault(i - j, []).append((i, j))
        spans, before = [], None
        for d in sorted(hits):
            if before is None or d - before > (0 if t.phrase or t.whole else licenses.NEAR):
                spans.append([])
            spans[-1] += hits[d]
            before = d
        for pairs in spans:
            pairs = sorted(set(pairs))
            ends = []  # (matched - inserted, matched) of the best chain that ends at each hit
            for x, (i, j) in enumerate(pairs):
                found = [(k, k)]
                for y in range(x):
                    di, dj = i - pairs[y][0], j - pairs[y][1]
                    if di > 0 and dj > 0:
                        new = min(di, dj, k)
                        found.append((ends[y][0] + new - (di - new), ends[y][1] + new))
                ends.append(max(found))
            value, matched = max(ends)
            cover = matched / (len(p) + matched - value)
            if cover < (1 if t.phrase or t.whole else licenses.COVER):
                continue
            if any(all(not pairs_cover(pairs, k, at) for at in range(len(p)) if p[at] == w) for w in t.need.split()):
                continue
            first, last = min(i for i, _ in pairs), max(i for i, _ in pairs) + k
            if set(t.never.split()) & set(words[first:last]):
                continue
            labels.add(t.label)
            best = max(best, cover)
    return ",".join(sorted(labels)), best


def test_labels_and_score_against_plain_python(spark):
    rng = random.Random(9)
    notices = [t.text.split() for t in licenses.NOTICES]
    texts = [None, "", "of the"]
    for _ in range(120):
        words = []
        for _ in range(rng.randint(1, 3)):
            own = list(rng.choice(notices))
            for _ in range(rng.randint(0, len(own) // 2)):
                at = rng.randrange(len(own))
                rng.choice([lambda: own.insert(at, "and"), lambda: own.pop(at) if len(own) > 1 else None, lambda: own.__setitem__(at, "oddly")])()
            words += own[: rng.randint(1, len(own))] + ["mit", "license"] * rng.randint(0, 1) + ["filler"] * rng.randint(0, 9)
        texts.append(" ".join(words))
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        labels, best = spans_by_hand(t)
        assert got[i]["labels"] == labels and abs(got[i]["score"] - best) < 1e-12, t
        assert (got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"]) == base(t), t


def test_words_are_compared_by_their_bytes():
    v = licenses.Vocabulary(licenses.PHRASES)
    data, start, end, _, tokens = licenses._words_of("the mit license of gnu")
    assert [v.words[i].decode() if i >= 0 else None for i in v.numbers(data, start, end, tokens)] == [None, "mit", "license", None, "gnu"]
    forged = np.full(len(tokens), v.tokens[v.words.index(b"mit")])  # equal hashes of other words
    assert [i >= 0 for i in v.numbers(data, start, end, forged)] == [False, True, False, False, False]


def test_words_that_tell_licenses_apart(spark):
    wrong = {
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "cc-by-mention",
        "Creative Commons Zero dedication": "cc-by-mention",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-mention",
        "released under the MIT Press imprint": "mit-mention",
        "This work is licensed under the GNU Affero General Public License, version 3.": "gpl-mention",
        "Licensed under the Apache License, Version 1.1.": "apache-mention",
        licenses.NOTICES[3].text.replace("GNU General", "GNU Lesser General"): "gpl-notice",
        licenses.NOTICES[3].text.replace("the GNU General Public License", "the Common Development License"): "gpl-notice",
        licenses.NOTICES[9].text.replace("Mozilla", "Eclipse"): "mpl-notice",
        licenses.NOTICES[7].text.replace("are permitted", "are not permitted"): "bsd-notice",
        NOTICE.replace(" ", " very much indeed and so on "): "mit-notice",
        " ".join(w + " and or else" * (i % 4 == 3) for i, w in enumerate(NOTICE.split())): "mit-notice",
    }
    right = [t.text for t in licenses.NOTICES] + ["Some words. " + t.text + " And others, not lesser ones." for t in licenses.NOTICES]
    got = scan(spark, [*wrong, *right])
    for i, (text, label) in enumerate(wrong.items()):
        assert label not in got[i]["labels"].split(","), text
    for i, t in enumerate(licenses.NOTICES * 2):
        assert t.label in got[len(wrong) + i]["labels"].split(",") and got[len(wrong) + i]["score"] == 1.0, t.text
