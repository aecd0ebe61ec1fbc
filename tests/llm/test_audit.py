import re
from itertools import permutations

from chronofold.llm import audit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def flags(docs):
    out = []
    for i, text, _ in docs:
        t = text or ""
        w = WORD.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        out.append([len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copy])
    return out


def brute(docs, labels):
    of = lambda i, at: i is not None and any(r[0] == i and r[at] == 1 for r in labels)
    rows = [((lang or ""), f, of(i, 1), of(i, 2)) for (i, _, lang), f in zip(docs, flags(docs), strict=True)]
    out = []
    for part in {r[0] for r in rows}:
        own, total = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            alive = own
            for step, letter in enumerate(order):
                at = "ABCDE".index(letter)
                gone, fail = [r for r in alive if r[1][at]], [r for r in own if r[1][at]]
                alive = [r for r in alive if not r[1][at]]
                total[letter] += len(gone)
                steps.append((letter, [part, "".join(order), step + 1, len(alive), len(gone), len(fail) - len(gone), sum(sum(r[1]) == 1 for r in fail), sum(r[2] for r in gone), sum(r[3] for r in gone)]))
        out += [(*s, total[letter]) for letter, s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def run(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, lang string, part int, A string").repartition(3)
    y = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    df = audit.interactions(d, y)
    assert sorted(df.columns) == sorted(COLUMNS)
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def long_text(n, distinct=10**6, start=0, more=""):
    return " ".join(f"w{(start + i) % distinct}" for i in range(n)) + more


def test_against_applying_every_order(spark):
    texts = [long_text(n, k, 0, more) for n in (0, 1, 199, 200, 400) for k in (10**6, 100, 99) for more in ("", "\tA", " $", " " + "AB" * 200, "\n|")]
    docs = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in enumerate(texts)] + [(1000 + i, t, "en") for i, t in enumerate(texts[::3])]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 1100, 2)]
    labels = [(i, q, int(t)) for i, q, t in labels]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_odd_rows(spark):
    docs = [(None, "x", "en"), (3, "x", "en"), (3, "x", "en"), (2, "x", None), (None, None, ""), (5, None, "de"), (4, "", "de"), (7, "ÄÖÜ" * 90, "de"), (8, "x y", "en"), (9, "A B\x0bc\x0cd\r\n", "en"), (9, "other", "en")]
    labels = [(3, 1, None), (3, 0, 1), (2, None, None), (None, 1, 1), (9, 1, 1), (77, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert run(spark, [], [(1, 1, 1)]) == []
    assert run(spark, [(1, "x", "en")], []) == brute([(1, "x", "en")], [])
    assert len(run(spark, [(1, "x", "en")], [])) == 600


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(tuple(r) for r in queries.op13_filter_audit(spark, "/root/testdata/sf0.001").select(COLUMNS).collect()) == brute(docs, labels)
