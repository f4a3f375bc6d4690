"""Unmarked templates on a small share of a large host, and inside main."""

from labelloom.llm import pages


def texts(spark, bodies):
    rows = [(i, f"http://large.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()}


def test_block_on_a_twentieth_of_a_large_host(spark):
    notice = "<div><p>The office is closed on Friday</p></div>"
    bodies = [(notice if i % 20 == 0 else "") + f"<div><p>story {i} is told</p></div>" for i in range(2000)]
    assert texts(spark, bodies) == {i: f"story {i} is told" for i in range(2000)}


def test_needed_pages_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(pages.templates, "__defaults__", (5, 0.02, 8, 0.2))
    bodies = [("<div>rare notice</div>" if i % 100 == 0 else "") + f"<p>story {i}</p>" for i in range(1000)]
    assert texts(spark, bodies) == {i: f"story {i}" for i in range(1000)}


def test_block_inside_main(spark):
    block = "<div><ul><li>One link</li><li>Other link</li></ul></div>"
    bodies = [f"<main><h1>Head</h1><p>story {i} is <b>very</b> good</p><table><tr><td>0</td><td>{i}</td></tr></table>{block}</main>" for i in range(60)]
    assert texts(spark, bodies) == {i: f"Head story {i} is very good 0 {i}" for i in range(60)}


def test_what_recurs_in_an_article_inside_main_stays(spark):
    bodies = [f"<main><article><p>story {i}</p><p>Licence line</p></article></main>" for i in range(30)]
    assert texts(spark, bodies) == {i: f"story {i} Licence line" for i in range(30)}


def test_repeated_rows_and_mirrors_keep_their_text(spark):
    page = "<html><body><div><p>The only story</p><p>in two parts</p></div></body></html>"
    rows = [(1, "http://a.example/1", page)] * 8 + [(10 + i, f"http://a.example/print/{i}", page) for i in range(30)] + [(2, None, None), (3, "x", "")]
    got = pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted((i, "The only story in two parts" if h else "") for i, _, h in rows)


def test_recurring_headings_and_paragraphs_stay(spark):
    for tag in ("main", "div", "section"):
        bodies = [f"<{tag}><h1>T{i}</h1><h2>History</h2><p>unique {i}</p><h2>Notes</h2><p>As above.</p></{tag}>" for i in range(10)]
        note = " As above." if tag == "main" else ""  # outside main a paragraph on every page is a notice
        assert texts(spark, bodies) == {i: f"T{i} History unique {i} Notes{note}" for i in range(10)}, tag
    bodies = [f"<div><h2>History</h2><p>unique {i}</p>{'<p>As above.</p>' if i % 10 == 0 else ''}</div>" for i in range(300)]
    assert texts(spark, bodies) == {i: f"History unique {i}" + (" As above." if i % 10 == 0 else "") for i in range(300)}


def test_a_container_counts_by_its_place(spark):
    box = "<div><p>Seven parts oil</p></div>"
    bodies = [f"{'<section>' * (i % 40)}<p>story {i}</p>{box}{'</section>' * (i % 40)}" for i in range(160)]
    assert texts(spark, bodies) == {i: f"story {i} Seven parts oil" for i in range(160)}


def test_neutral_names_give_the_same_as_marked_ones(spark, monkeypatch):
    menu, side, note = "<{0}><ul><li>Home</li><li>News</li></ul></{0}>", "<{0}><h3>Read on</h3><p>Our ten best</p></{0}>", "<{0}><p>We use cookies</p></{0}>"
    def bodies(a, b, c):
        return [menu.format(a) + f"<div><h2>Report</h2><p>story {i} is told</p></div>" + side.format(b) + (note.format(c) if i % 8 == 0 else "") for i in range(400)]
    expected = {i: f"Report story {i} is told" for i in range(400)}
    assert texts(spark, bodies("nav", "aside", "footer")) == expected
    assert texts(spark, bodies("div", "section", "div")) == expected
