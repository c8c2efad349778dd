import pytest

from memloom.llm import spam

HEAD = "commit 0123456789abcdef0123456789abcdef01234567\nAuthor: A <a@b.example>\nDate:   2031-01-01 00:00:00 +0000\n\n    {}\n\ndiff --git a/{p} b/{p}\nindex 0000000..1111111 100644\n--- a/{p}\n+++ b/{p}\n@@ -0,0 +1,3 @@\n"


def page(subject, path, lines, sign="+"):
    return HEAD.format(subject, p=path) + "\n".join(sign + x for x in lines) + "\n"


TAGS = ["#price #onlineMattress #official #buy", "#cheap #saleShoes #best #deal"] * 4
LINKS = [f'<li><a href="http://keto-x{i}.example/best-keto">buy cheap keto</a></li>' for i in range(9)]
WORDS = [f"★ TENT rabatt preis online tent {i}" for i in range(9)] + ["✔ t.e.n.t billig angebot tent"]
PROSE = ["We now mask the quota before the pump starts, so the old price of an order stays visible until it is paid."] * 6


@pytest.mark.parametrize("lines", [TAGS, LINKS, WORDS])
def test_promotional_share(lines):
    assert spam.read_page(page("docs", "README.md", lines))[1] > 0.5
    assert spam.read_page(page("docs", "README.md", lines, "-"))[1] == 0  # removed lines promote nothing
    for path in ("package-lock.json", "CHANGELOG.md", "locale/de.po", "tests/shop_cases.py"):
        assert spam.read_page(page("docs", path, lines))[1] == 0


def test_prose_and_odd_texts():
    assert spam.read_page(page("Fix pump", "docs/a.md", PROSE))[1] == 0
    assert spam.read_page("") == ([0.0] * len(spam.FEATURES), 0.0, 0)
    assert spam.read_page("word")[2] == 1
    assert spam.read_page("buy " * 200_000)[2] == 200_000


@pytest.mark.parametrize("labelled", [True, False])
def test_found(spark, labelled):
    docs = [(i, page(f"Fix pump {i}", "docs/a.md", [f"The {w} of part {i} was moved to {w}{i} because it failed {i % 7} times." for w in ("valve", "queue", "menu")[: 1 + i % 3]]), ("en", "EN ", "de", None)[i % 4], "c") for i in range(400)]
    docs += [(1000 + i, page("docs", "README.md", [TAGS, LINKS, WORDS][i % 3]), "en", "c") for i in range(20)]
    docs += [(2000, None, "en", "c"), (2001, "", "en", "c"), (None, "x", "en", "c"), (1000, docs[400][1], "en", "c")]
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, lang STRING, share STRING")
    labels = [(i, "r", "ok") for i in range(60)] + [(1000 + i, "r", "spam") for i in range(18)] + [(1000, "s", "unsure"), (1001, "s", "ok"), (None, "r", "spam"), (5, None, None)] if labelled else []
    lab = spark.createDataFrame(labels, "doc_id BIGINT, reviewer STRING, label STRING")
    got = [r.doc_id for r in spam.found(d, lab).collect()]
    assert sorted(got) == list(range(1000, 1020))
    assert spam.found(d.limit(0), lab).collect() == []
