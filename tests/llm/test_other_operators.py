"""Vectors, pages, licences and the pipeline."""

import collections
import math

import duckdb
import pytest

from vernissage.llm import extract, licences, queries, topk

SF = "/root/testdata/sf0.001"


def test_top_k_against_all_pairs(spark):
    vectors = [(i, [((i * 37 + j * 11) % 19 - 9) / 7 for j in range(5)]) for i in range(60)]
    vectors += [(i, [0.5, -0.25, 1.0, 0.0, 2.0]) for i in range(100, 140)] + [(200, None), (201, []), (202, [1.0, None]), (203, [math.nan, 1.0]), (204, [math.inf]), (205, [1.0, 2.0])]
    vectors += [(20, vectors[20][1])]
    df = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<float>, v long, ids long")
    rows = topk.scaled(df)
    got = sorted(tuple(r) for r in topk.top_k(rows.filter("vec_id % 20 = 0"), rows, 7).collect())
    import numpy as np

    whole = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], whole[d], strict=False)), d) for d in whole if d != q)[:7]
            want += [(q, k + 1, d, -s) for k, (s, d) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(rows.filter("vec_id < 0"), rows, 7).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a>Home</a></ul></nav><div class="ad-box">Buy</div><article><h1>Title &amp;  more</h1><p>One<br>two <b>three
<p>Caf&eacute;</p><aside>Side</aside><form>Mail</form><div id="comments"><p>First!</p></div></article><footer>F</footer></body></html>"""


def test_main_text(spark):
    pages = [(1, "http://a.org/1", PAGE), (2, None, None), (2, "x", ""), (3, "http://a.org/3", "<article><p>cut <b>here</b> <p cla")]
    shell = "<body><div>Home about us contact our team the jobs press and more</div><div><p>Story {0} has its own {0} words to tell {0} all</p></div><p class='cookie'>ok</p>"
    pages += [(10 + i, f"http://b.org/{i}", shell.format(i)) for i in range(4)]
    got = {(r.page_id, r.url): r.text for r in extract.main_texts(spark.createDataFrame([(*p, "z", 1) for p in pages], "page_id long, url string, html string, text string, key long"), part_pages=2).collect()}
    assert got[1, "http://a.org/1"] == "Title & more\nOne two three\nCafé"
    assert got[2, None] == got[2, "x"] == ""
    assert got[3, "http://a.org/3"] == "cut here"
    assert all(got[10 + i, f"http://b.org/{i}"] == f"Story {i} has its own {i} words to tell {i} all" for i in range(4))
    assert extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_licences(spark):
    rows = [(1, "All rights reserved.\nfoo"), (2, "The driver renewed his license"), (3, None), (4, ""), (5, "x\nCopyright 2021 Y. Released under the MIT License."),
            (6, "Licensed under CC BY-SA 4.0."), (7, "nothing here"), (5, "Licensed under the Apache License, Version 2.0.")]
    got = sorted((r.doc_id, r.paragraph, r.family) for r in licences.licence_notices(spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, family string")).collect())
    assert got == [(1, 0, "all-rights-reserved"), (2, 0, "unknown"), (5, 0, "apache-2.0"), (5, 1, "mit"), (6, 0, "cc-by-sa")]


@pytest.mark.parametrize("name", ["op5_language_id", "op7_html_extraction", "op10_source_mixing"])
def test_query_runs_on_its_whole_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    n = df.count()
    documents = duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0]
    pages = duckdb.sql(f"select count(*) from '{SF}/pages.parquet'").fetchall()[0][0]
    assert n == (pages if name.startswith("op7") else documents)


def test_pipeline_stages(spark):
    """Each stage against plain rules over what the one before it kept."""
    import corpus_pipeline as cp
    from vernissage.llm import decontaminate, jaccard
    from vernissage.llm.store import Store, read

    store, docs = Store(spark), read(spark, SF, "documents")
    kept = []
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        docs = store.put(stage(spark, docs, SF), f"t{k}-{name}")
        assert tuple(docs.columns) == cp.COLUMNS
        kept.append({r.doc_id: r.text for r in docs.collect()})
    start = {r.doc_id: r.text for r in read(spark, SF, "documents").collect()}
    assert len(kept[0]) >= 0.98 * len(start) and all(start[i] == t for i, t in kept[0].items())
    assert len(kept[1]) < len(kept[0]) and set(kept[1]) <= set(kept[0])
    groups = jaccard.jaccard_components(spark.createDataFrame(list(kept[1].items()), "doc_id long, text string"))
    assert groups.filter("component_id <> doc_id").count() == 0
    assert set(kept[2]) == set(kept[1]) and any(len(kept[2][i]) < len(t) for i, t in kept[1].items())
    seen = collections.Counter(hash(b[k : k + 400]) for t in kept[1].values() for b in [t.encode()] for k in range(len(b) - 399))
    for i, t in kept[1].items():
        b, gone = t.encode(), set()
        for k in range(len(b) - 399):
            if seen[hash(b[k : k + 400])] > 1:
                gone.update(range(k, k + 400))
        assert kept[2][i] == bytes(x for k, x in enumerate(b) if k not in gone).decode(errors="ignore")
    assert decontaminate.contaminated(docs, read(spark, SF, "benchmark")).count() == 0
    last = cp.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(kept[3]) and last.filter("taken > 2 * size").count() == 0


def test_names_that_hold_the_page(spark):
    def main(body):
        found, any_main = extract.blocks(body)
        return "\n".join(t for t, dropped, inside in found if not dropped and (inside or not any_main))

    for name in ("class='layout has-sidebar'", "id='page-with-menu'", "class='widget'"):
        for tag in ("article", "main"):
            assert main(f"<div {name}><div class='menu'>Home</div><{tag}><p>The text</p></{tag}></div>") == "The text"
    for head in ("<div class='article-header'><h1>Title</h1></div>", "<header class='entry-header'><h1>Title</h1></header>"):
        assert main(f"<article>{head}<p>Text</p></article>") == "Title\nText"
    assert main("<article><div class='related-work'>One</div><div class='social-policy'>Two</div><div class='related-posts'>No</div><div class='social'>No</div></article>") == "One\nTwo"
    assert main("<div class='sidebar'><article>Teaser</article></div><main><p>Text</p><div id='comments'><article>First</article></div></main>") == "Text"
    assert main("<nav><article>Link</article></nav><div>Text</div>") == "Text"
    story = "<body><div><p>One story that stands at two addresses of its host and nowhere else</p></div>"
    shell = "<div>Home about us contact our team the jobs press and more</div>"
    pages = [(1, "http://c.org/a", story), (2, "http://c.org/a?print=1", story.replace("<div>", "<div data-at='2'>")),
             (3, "http://d.org/1", shell + "<p>One</p>"), (4, "http://d.org/2", shell + "<p>Two</p>")]
    got = {r.page_id: r.text for r in extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "One story that stands at two addresses of its host and nowhere else"
    assert got[3] == "One" and got[4] == "Two"


def test_near_duplicates_with_null_and_repeated_ids(spark):
    import corpus_pipeline as cp

    long = " ".join(f"w{i}" for i in range(100))
    rows = [(None, "only here and of no id at all"), (None, long), (5, long + " end"), (5, long + " end"), (5, "another text of the same id is here"),
            (3, long), (7, "twice the very same row and text"), (7, "twice the very same row and text"), (None, ""), (None, None), (9, None),
            (None, "two rows of no id are equal"), (None, "two rows of no id are equal"), (3, long + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()), key=str)
    group = [t for i, t in got if t and t.startswith("w0")]
    assert len(group) == 1 and (3, group[0]) in got
    assert sorted((x for x in got if x[1] not in group), key=str) == sorted(
        [rows[0], rows[4], rows[6], rows[8], rows[9], rows[10], rows[11]], key=str)
