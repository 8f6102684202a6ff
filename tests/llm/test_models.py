import binascii
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchlab.llm import edit_match, html_text, language, personal_data, quality
from tests.llm.cases import ROWS, edge_documents, no_documents


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, letter in enumerate(item, 1):
        last, row[0] = row[:], i
        for j, other in enumerate(text, 1):
            row[j] = min(last[j - 1] + (letter != other), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edit_matches_equal_brute_force(spark):
    items = [(1, "The quick brown fox jumps over the lazy dog near the river"), (2, None), (3, "!!!"),
             (4, "completely different benchmark question about nothing at all")]
    item = edit_match.plain(items[0][1])
    near = item.replace("quick", "quack").replace("lazy ", "")
    texts = [(1, f"noise before {items[0][1].upper()}, noise"), (2, f"more {near} more"), (3, item[:40]), (4, None),
             (None, item), (5, ""), (6, item.replace("brown fox jumps over", "red cat sleeps under"))]
    got = edit_match.benchmark_matches(
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    expected = set()
    for doc, text in texts:
        for key, other in items:
            other = edit_match.plain(other or "")
            if other and text:
                distance = least_distance(other, edit_match.plain(text))
                if distance <= int(edit_match.RATE * len(other)):
                    expected.add((doc, key, distance))
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == expected
    assert {d for d, _, _ in expected} == {1, 2, None} or len(expected) >= 2


def test_contaminated_rows_go_and_others_stay_unchanged(spark):
    docs = edge_documents(spark)
    items = spark.createDataFrame([(1, "nobody's text"), (2, None)], "item_id long, text string")
    kept = edit_match.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    none = items.filter("item_id > 5")
    assert edit_match.drop_contaminated(docs, none).count() == len(ROWS)
    assert edit_match.benchmark_matches(docs, none).count() == 0
    assert edit_match.benchmark_matches(no_documents(spark), items).count() == 0


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def held_out(doc_id):
    return binascii.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_on_held_out_rows(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_scores(documents, labels).collect()
    assert all(r.held_out == held_out(r.doc_id) for r in rows) and len(rows) == documents.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    hits = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(hits) >= 0.95


def test_rare_label_is_learnt(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality in (0, 1)")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    bad = sorted(d for d, q in truth.items() if q == 0 and not held_out(d))
    for n in (1, 8):
        known = labels.filter(labels.quality.eqNullSafe(1) | labels.doc_id.isin(bad[:n]))
        rows = quality.quality_scores(documents, known).filter("held_out").collect()
        rows = [r for r in rows if r.doc_id in truth]
        good = np.array([r.score for r in rows if truth[r.doc_id] == 1])
        poor = np.array([r.score for r in rows if truth[r.doc_id] == 0])
        assert np.mean(poor < quality.THRESHOLD) >= (0.6 if n == 8 else 0.1)
        assert np.mean(good >= quality.THRESHOLD) >= 0.95


def test_quality_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, None), (99, 0)], "doc_id long, quality int")
    rows = quality.quality_scores(edge_documents(spark), labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out for r in rows if r.doc_id is None)
    assert quality.keep_good(edge_documents(spark), labels).columns == edge_documents(spark).columns
    assert quality.quality_scores(no_documents(spark), labels.filter("doc_id < 0")).count() == 0


def test_language_on_held_out_rows(spark, documents):
    network = language.train_network(documents)
    rows = language.predict_languages(documents, network).collect()
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) >= 0.95
    edge = language.predict_languages(edge_documents(spark), network).collect()
    unknown = {r.doc_id for r in edge if r.lang_pred == "und"}
    assert unknown == {2, 3, 8, None} and all(0 <= r.score <= 1 for r in edge) and len(edge) == len(ROWS)
    assert language.train_network(no_documents(spark)) is None
    assert language.predict_languages(edge_documents(spark), None).filter("lang_pred != 'und'").count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def is_valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if is_valid(k, m[0])]


def check_base(rows, texts):
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        named = [f"{k}:{s}:{e}" for k, s, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest(), r
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in BASE]
        assert set(named) <= set(r.spans.split(","))


def test_personal_data_equals_brute_force(spark):
    random = np.random.default_rng(4)
    parts = ["a", "b@c.d", ".", "@", "_", "%", "1", "22", "+1", "+", " ", "-", "(", "255", ".1", "é", "😀",
             "4111111111111111", "5500 0000 0000 0004", "192.168.1.1", "999.1.1.1", "a@b.c_x@y.z", "00012.1.1.01",
             "\n", "me [at] home [dot] org", "call 555-123-4567 ", 'token = "abcdef0123456789abcdef0123"']
    texts = {i: "".join(random.choice(parts, random.integers(0, 20))) for i in range(600)}
    texts |= {700: "a" * 50_000, 701: "1" * 30_000, 702: "1." * 20_000, 703: "+1 " * 20_000, 704: None, 705: "a@b.c " * 300}
    got = personal_data.find_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    check_base([r for r in got if r.doc_id != 700], texts)
    assert [r.spans for r in got if r.doc_id in (700, 704)] == ["", ""]
    assert sum(r.n_added for r in got) > 0


def test_personal_data_positions_beyond_one_part(spark):
    """Spans, context and the character behind, where matches fill several parts."""
    rng = np.random.default_rng(5)
    fill = ["", " ", "é ü", "mail ", "x" * 40, "12-"]
    texts = ["", "7", "12"] + [
        "".join(f"{rng.integers(10, 10**6)}{fill[i]}," for i in rng.integers(0, 6, n)) for n in (1, 127, 128, 129, 700)
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows.select("doc_id", personal_data.matches("card", F.col("text")).alias("spans")).collect()
    for row in found:
        text = texts[row["doc_id"]]
        want = [
            (m.start(), m.end(), m[0], text[max(0, m.start() - 32) : m.start()], text[m.end() : m.end() + 1])
            for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text)
        ]
        assert [tuple(s) for s in row["spans"]] == want
    assert max(len(r["spans"]) for r in found) > 5 * personal_data.PART


def test_added_spans_do_not_overlap_base_ones(spark):
    """Thousands of base spans, added candidates inside, across and between them."""
    piece = "call 555 123 4567, +1 555 123 4567, mail a@b.de or c [at] d.org; "
    text = piece * 300
    row = personal_data.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    base = [(b["start"], b["stop"]) for b in row["base"]]
    assert len(base) == 600 and len(row["more"]) == 600
    assert not any(s < m["stop"] and m["start"] < e for m in row["more"] for s, e in base)


def test_personal_data_edge_rows(spark, documents):
    rows = personal_data.find_personal_data(edge_documents(spark)).collect()
    assert len(rows) == len(ROWS)
    check_base([r for r in rows if r.doc_id is not None], dict(ROWS))
    assert personal_data.find_personal_data(no_documents(spark)).count() == 0
    plan = personal_data.candidates(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_labelers_that_agree_with_the_truth_become_reliable(spark):
    rows = [(0, "11111", 80), (0, "11011", 20), (0, "10001", 5), (0, "10000", 95)]
    got = personal_data.reliabilities(spark.createDataFrame(rows, "kind int, votes string, n long")).collect()
    posterior = {r.votes: r.posterior for r in got}
    assert posterior["11111"] > 0.95 and posterior["10000"] < 0.05
    assert got[0].yes_true[1] > 0.9 and got[0].yes_false[1] < 0.1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li>Menu</li></ul></nav><!-- <p>no</p> --><div class="ad">Buy now</div><article><h1>Head &amp; line</h1>
<p><b>First  block<br>goes&nbsp;on.<p>Second &eacute; &#233; &lt;x&gt;</p><aside>Beside</aside><p>S.</p>
<div id="comments"><div>He said</div>so</div></article><form><p>Sign</p></form><footer>&copy; F</footer></body></html>"""


def test_page_text_of_templates():
    assert html_text.main_text(PAGE) == "Head & line\nFirst block goes on.\nSecond é é <x>\nS."
    bare = "<html><body><div class=menu><a>a</a></div><p>" + "words " * 30 + "</p><p>" + "text " * 30 + "</p></body>"
    assert html_text.main_text(bare) == ("words " * 30).strip() + "\n" + ("text " * 30).strip()
    assert html_text.main_text("") == "" and html_text.main_text("<nav>only</nav>") == ""
    assert html_text.main_text("<p>a</p>" * 5000).count("\n") == 4999


def test_missing_end_tags():
    main = "<p>The real text of the page.</p><p>It goes on.</p>"
    text = "The real text of the page.\nIt goes on."
    for page, want in [
        ("<body><p class=promo>buy" + main + "</body>", text),
        ("<ul><li class=share>x<li>one item<li>two</ul>" + main, "one item\ntwo\n" + text),
        ("<ul><li class=share>x<ul><li>y<li>z</ul>w<li>one</ul>" + main, "one\n" + text),
        ("<table><tr><td class=ad>x<td>cell<tr><td>more</table>" + main, "cell\nmore\n" + text),
        ("<article><div><div class=ad>x<p>y</div></div>" + main + "</article>", text),
        ("<article>" + main + "<section><div class=ad>x<p>y</section><p>End.</article>", text + "\nEnd."),
        ("<article>" + main + "<div class=ad>x</p>y</div><p>End.</article>", text + "\nEnd."),
        ("<p class=ad>x<hr>" + main, text),
    ]:
        assert html_text.main_text(page) == want


def test_attribute_values_and_wrappers_are_no_side_parts():
    long = "<p>" + "words " * 30 + "</p>"
    text = ("words " * 30).strip()
    for page, want in [
        ('<article><div style="overflow:hidden"><p>One.</p></div><p title="A hidden gem">Two.</p></article>', "One.\nTwo."),
        ('<article><p>See <a href="/p?id=menu">this</a> and <a href=/p?id=menu>that</a>.</p></article>', "See this and that."),
        ("<article><p data-x='class=\"ad\"'>One.</p><p hidden>x</p><p CLASS=ad>x</p></article>", "One."),
        ('<div class="layout has-sidebar"><article><p>One.</p></article><div class=sidebar>x</div></div>', "One."),
        ('<div class="sidebar-layout"><article><p>One.</p></article><div class=sidebar>x</div></div><p>out</p>', "One."),
        ('<main><div class="sidebar-right"><article><p>One two.</p></article></div></main>', "One two."),
        ('<div class="nav-page">' + long + "<ul class=menu><li>x</ul></div>", text),
        ('<form id=page><div class="widget">' + long + "<button>x</button></div></form>", text),
        ('<article><div class="article-header"><h1>Title</h1></div><p>One.</p></article>', "Title\nOne."),
        ('<div class="article-header">Title</div>' + long + '<div class="site-header">x</div>', "Title\n" + text),
        ('<article><p>One long text.</p></article><div class=related><article>x</article><article>y</article></div>',
         "One long text."),
        ("<p>The text.</p><div id=comments>" + long + "</div>", "The text."),
    ]:
        assert html_text.main_text(page) == want


def unmarked(lengths):
    texts = ["x" * n for n in lengths]
    return texts, [f"<p>{t}</p>" for t in texts]


def test_long_paragraph_does_not_cut_the_others():
    box = "<div class=related><p>a</p><p>b</p><p>c</p><p>d</p></div>"
    for lengths in ([20, 150, 150, 150, 150, 8000], [8000, 150, 150, 20], [20, 30, 8000, 30, 20, 10], [5, 6, 7, 90_000]):
        texts, blocks = unmarked(lengths)
        assert html_text.main_text("".join(blocks)) == "\n".join(texts)
        for at in range(len(blocks) + 1):
            page = "".join([*blocks[:at], box, *blocks[at:]])
            assert html_text.main_text(page) == "\n".join(texts), (lengths, at)


def test_menu_of_links_before_the_text_goes():
    texts, blocks = unmarked([20, 150, 8000, 150, 30])
    menu = "<ul>" + "<li><a href=/x>Page</a>" * 6 + "</ul>"
    source = "<p><a href=/y>Source</a></p>"
    page = "<body>" + menu + "<hr><p>By me</p>" + "".join(blocks) + source + "<p>End.</p></body>"
    got = html_text.main_text(page).split("\n")
    assert [x for x in got if x != "Page"] == ["By me", *texts, "Source", "End."] and got.count("Page") <= 2
    assert html_text.main_text(menu).count("Page") == 6


def test_pages_edge_rows(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, None), (None, "v", "plain words", "x"), (1, "u", PAGE, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract_pages(pages).collect()}
    assert got[(2, None)] == ("", 0) and got[(None, "v")] == ("plain words", 11)
    assert got[(1, "u")][1] == len(got[(1, "u")][0]) > 0
    assert html_text.extract_pages(pages.filter("page_id > 9")).count() == 0


def test_stretches_follow_surge_and_dive():
    lengths = np.array([0, 0, 0, 0, 50, 60, 0, 40, 0, 0, 0, 0, 2])
    assert html_text.stretches(lengths, 30) == [(2, 8)]


def test_items_may_have_ids_of_any_type(spark):
    from searchlab.llm import edit_match

    text = "the quick brown fox jumps over the lazy dog near the river bank today"
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing")], "doc_id int, text string")
    for kind, value in (("int", 7), ("string", "i7"), ("bigint", 7), ("smallint", 7)):
        items = spark.createDataFrame([(value, text)], f"item_id {kind}, text string")
        got = edit_match.benchmark_matches(docs, items).collect()
        assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(1, value, 0)]


def test_language_sample_draws_from_all_windows_and_keeps_large_languages(spark):
    assert language.hash_limit(6000, 10**13) > 0 and language.hash_limit(5, 3) == language.HASHES - 1
    rows = [(i, "wort " * 3000 if i % 2 else "word " * 20, "de" if i % 2 else "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    windows, labels = language.training_windows(docs, "doc_id", "text", "lang", 500)
    assert 400 < labels.count("de") < 600 and labels.count("en") > 60
    assert len(windows) == len(labels)


@pytest.mark.parametrize("page, text", [
    ('<article><p class="a"">two</p></article>', "two"),
    ("<article><p title=it's>three</p><p>four</p></article>", "three\nfour"),
    ('<article><p title="a > b">five</p></article>', "five"),
    ('<article><section class="related-work"><h2>Related work</h2><p>Body.</p></section></article>', "Related work\nBody."),
    ("<article><p>one</p><object data=x><p>two</p></article>", "one\ntwo"),
    ('<article><p>Long enough to stay as it is.</p><div class="related">more</div></article>', "Long enough to stay as it is."),
])
def test_start_tags_and_boxes_as_browsers_read_them(page, text):
    from searchlab.llm.html_text import main_text

    assert main_text(page) == text
