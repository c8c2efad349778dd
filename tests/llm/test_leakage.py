import random

from memloom.llm import leakage

W = leakage.WORD


def brute(docs, items, n=12):
    grams = {}
    for i, t in items:
        w = W.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = W.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def world(seed):
    rng = random.Random(seed)
    words = ["the", "a", "of", "b", "c", "d", "e", "f"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 12, 30])))) for i in range(30)]
    items += [(100, items[2][1] + " " + items[3][1]), (101, items[2][1]), (102, None), (103, "")]
    docs = []
    for d in range(80):
        ws = rng.choices([*words, "zz"], k=rng.randrange(60))
        if rng.random() < 0.5:
            part = (rng.choice(items)[1] or "").split()
            a = rng.randrange(len(part) + 1)
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = part[a : a + rng.choice([11, 12, 13, 40])]
        docs.append((d, rng.choice([" ", "\n> ", "--"]).join(w.upper() if rng.random() < 0.3 else w for w in ws)))
    docs += [(900, None), (901, ""), (902, "\n+".join(items[5][1].split()) * 3), (None, items[2][1])]
    return docs, items


def test_found_equals_brute_force(spark):
    for seed in (1, 2, 3):
        docs, items = world(seed)
        d = spark.createDataFrame([(a, b, 1) for a, b in docs + docs[:5]], "doc_id BIGINT, text STRING, item_id INT")
        i = spark.createDataFrame(items + items[:3], "item_id BIGINT, text STRING")
        got = [tuple(r) for r in leakage.found(d, i).collect()]
        assert len(got) == len(set(got))
        assert set(got) == {p for p in brute(docs, items) if p[0] is not None}


def test_cut(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"before {item}; after"), (2, "nothing"), (3, None)], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    got = {r.doc_id: (r.text, r.n_cut) for r in leakage.cut_leaks(docs, items).collect()}
    assert got == {1: ("before ; after", 20), 2: ("nothing", 0), 3: (None, 0)}
    report = leakage.leaks(docs, items).first()
    assert (report.longest, report.covered, report.item_share) == (20, 20, 1.0)


def test_empty_and_long(spark):
    docs = spark.createDataFrame([(1, "x " * 300_000 + " ".join(f"w{k}" for k in range(12)))], "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(12)))], "item_id BIGINT, text STRING")
    assert leakage.found(docs, items).count() == 1
    assert leakage.found(docs.limit(0), items).collect() == []
    assert leakage.found(docs, items.limit(0)).collect() == []
