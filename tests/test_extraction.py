"""Page literals: the generic page, a grouped listing, posts and the page frontier."""

import random

import duckdb
from pyspark.sql import functions as F

from noticeflow.operators import html, links, listings, posts
from noticeflow.workload import all_queries
from tests.oracle_compare import differences

GENERIC = """<body><nav><a href="/agenda">Agenda cultural</a><a href="tel:190">Fone</a></nav>
<section><h3>Concurso 7/2031: monitores de museu</h3><p>Leia o documento.</p>
<a href="docs/concurso-7.odt">Baixar</a></section>
<ul><li><a href="/mapa.pdf">Mapa do campus</a></li><li><a href="#fim">Fim</a></li>
<li><a href="javascript:abre()">Abre</a></li><li><a href="mailto:a@b.example">Escreva</a></li></ul></body>"""

LISTING = """<table class="listagem grande">
<tr><td class="agrupador"><a href="#" title="Monitores*" onclick="abre({'x':'x','id':'808'},'')">Monitores de museu *</a></td></tr>
<tr><td>Historia</td><td>4</td><td class="datas">01/03/2031 a 09/03/2031</td></tr>
<tr><td class="agrupador"><a href="#">Tutores</a></td></tr>
<tr><td>*</td><td>Botanica</td><td>2</td><td class="datas fechado">05/02/2031</td></tr></table>"""

FALLBACK = """<table><tr><td>Edital de bolsa</td><td><a href="/a.pdf">PDF</a> <a href="/b">Detalhes</a></td></tr>
<tr><td>Nada</td><td><a href="/c">x</a></td></tr></table>"""


def pages(spark, **sources):
    rows = [(i, f"https://example.edu.br/{n}/", s) for i, (n, s) in enumerate(sources.items())]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_broken_markup_keeps_document_order():
    page = html.Page("<div><p>a<p>b<li>c &amp; d&zz;</div></x>e<br>f<script>no</script>")
    assert page.all_text() == "a b c & d&zz e f"
    assert page.text(0) == "a b c & d&zz"


def test_reference_without_semicolon():
    source = "<title>a &amp; b &amp</title><p>x&ampy &#65; &lt;&ltz &copy"
    assert html.Page(source).text(0) == "a & b &"
    page = html.Page(source, bare_references=False)
    assert page.all_text() == "a & b &amp x&ampy A <&ltz &copy"


def test_signals_of_a_cut_title_match_their_sql(spark, tmp_path):
    rows = [(1, "https://a.example/", "<html><head><title>ver &amp</title></head><body><p>que &amp; der&amp</p></body></html>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    queries, sql = all_queries()
    oracle = sql["a07_page_signals"].rpartition("\nSELECT ")[2]
    assert differences(queries["a07_page_signals"](spark, str(tmp_path)), con, f"SELECT {oracle}") is None


def test_contexts_of_texts_that_show_markup_match_their_sql(spark, tmp_path):
    texts = ["a <b>der</b> c\nx", "Ã© que", "< & > &eacute; the", "x<!-- c -->y", "plain & simple", "x " * 400]
    docs = [(i, t, "en", f"src{i}", len(t)) for i, t in enumerate(texts)]
    tables = {"documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
              "pages": spark.createDataFrame([(1, "https://a.example/", "<p></p>")], "page_id long, url string, html string")}
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    queries, sql = all_queries()
    parts = sql["p03_link_context"]
    begin = parts.index("raw_links AS (")
    assert differences(queries["p03_link_context"](spark, str(tmp_path)), con, "WITH " + parts[begin:]) is None


def test_plain_markup_reads_as_the_parser_does(monkeypatch):
    rng = random.Random(11)
    pieces = ["<p>", "</p>", "<DIV class=\"A b\" id=\"x'>y\">", "</Div>", "<br>", "<td\n title=\"\" >", "</td>", " a ", "b > c\n", "é\xa0",
              "<a href=\"/q?x=1\" href=\"/r\">", "</a>", "<table>", "<tr>", "</tr>", "</table>", "<template>", "</template>", "<li>"]
    odd = ["&amp;", "<script>if (a<b) x</script>", "<title>t</title>", "<br/>", "<!-- c -->", "<a href=x>", "</p >", "< ", "<p a=\"1\"b=\"2\">", "<x-y>", "\0"]
    sources = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(300)]
    sources += [s + rng.choice(odd) + t for s, t in zip(sources, sources[1:])]
    sources += ["", "<p", "x<", "</p", LISTING, FALLBACK, GENERIC]
    facts = lambda p: (p.tags, p.attrs, p.parents, p.ends, p.text_from, p.text_to, p.texts)
    quick = [facts(html.Page(s)) for s in sources]
    assert sum(html._plain_tokens(s) is not None for s in sources) >= 300
    monkeypatch.setattr(html, "_plain_tokens", lambda source: None)
    assert quick == [facts(html.Page(s)) for s in sources]


def test_rows_leave_the_parser_clean_unless_untidy(spark):
    cells = ["a  b\n c", "x\xa0", "SeleÃ§Ã£o  1", "&lt;b&gt;um&lt;/b&gt;  dois", "", " 1 &lt; 2 "]
    source = "".join(f'<tr><td class="c">{c}</td><td class="agrupador"><a href="/a/b.pdf" title=" t  {i} ">{c}</a></td></tr>' for i, c in enumerate(cells))
    flags = [fact[-1] for fact in html.page_rows(html.Page(source), "https://h.example/x?y=1")]
    assert flags == [False, False, True, True, False, False]
    rows = html.extract_rows(pages(spark, x="<table>" + source, none=None, empty="")).orderBy("pos").collect()
    want = ["a b c", "x", "Seleção 1", "um dois", "", "1 < 2"]
    assert [r["cells"][0]["text"] for r in rows] == [r["link_text"] for r in rows] == [r["links"][0]["text"] for r in rows] == want
    assert [r["link_title"] for r in rows] == [f"t {i}" for i in range(6)]
    assert [r["row_text"] for r in rows] == [f"{w} {w}".strip() for w in want]
    assert {r["links"][0]["abs_url"] for r in rows} == {"https://example.edu.br/a/b.pdf"} and rows[0]["cells"][1]["cls"] == "agrupador"


def test_addresses_below_a_host_join_as_urljoin_does():
    bases = ["https://h.example/x/y?z=1#f", "http://h.example:80", "https://u@h/", "ftp://h/", "", None, "https://[::1]/a", "HTTPS://H.example/q"]
    hrefs = ["/a", "/a/b.pdf", "/", "//x/y", "/a//b", "/./a", "/a/../b", "/a.b/c/", "/a?", "/a#", "/a b", "/é", "/a;p", "a", "#", "", "/.a"]
    assert [[html._absolute(b, h) for h in hrefs] for b in bases] == [[html.urljoin(b or "", h) for h in hrefs] for b in bases]


def test_classes_need_texts_and_titles_only(spark):
    hidden = "<p>a <rt>no</rt> b</p><template>no</template>"
    src = pages(spark, sel=LISTING, tab=FALLBACK, login="Acesso ao Sistema formUsuario <table><tr><td>edital<a href='/z'>z</a>",
                vazio="Nenhum processo  seletivo\nencontra-se aberto", mixed=hidden, plain=" x <b>y</b>\n<i> </i>z", cut="<p>x &amp", none=None)
    texts = {r["page_id"]: r["body_text"] for r in html.extract_texts(src).collect()}
    signals = html.extract_signals(src, ())
    assert texts == {r["page_id"]: r["body_text"] for r in signals.collect()}
    groups = listings.listing_groups(html.extract_rows(src))
    found = listings.classify_pages(html.extract_texts(src), listings.listed_pages(groups))
    whole = listings.classify_pages(signals, listings.listing_items(listings.listing_details(groups)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_generic_page_yields_one_item(spark):
    (item,) = links.extract_generic(pages(spark, museu=GENERIC)).collect()
    assert item["title"] == "Concurso 7/2031: monitores de museu"
    assert item["url"] == "https://example.edu.br/museu/docs/concurso-7.odt"
    assert (item["notice_type"], item["description"]) == ("concurso", None)


def test_texts_of_links_are_cleaned_outside_the_parser(spark):
    src = pages(spark, x="<div><h2>SeleÃ§Ã£o  1</h2><a href=' /a\n b '>um\n <b>dois</b></a></div><p>" + "y " * 700 + "<a href='/c'>z</a></p>")
    one, two = html.extract_links(src).orderBy("pos").collect()
    assert (one["text"], one["context"], one["href"]) == ("um dois", "Seleção 1", "/a b")
    assert len(two["context"]) <= 600 and two["context"].endswith("...")


def test_listing_and_fallback(spark):
    src = pages(spark, sel=LISTING, tab=FALLBACK, login="Acesso ao Sistema formUsuario <table><tr><td>edital<a href='/z'>z</a>",
                vazio="Nenhum processo seletivo encontra-se aberto")
    got = listings.extract_process_pages(src, html.extract_signals(src, ())).orderBy("page_id", "pos").collect()
    assert [r["title"] for r in got] == ["Monitores de museu", "Tutores", "Edital de bolsa PDF Detalhes"]
    assert got[0]["dedupe_url"] == "https://example.edu.br/sel/?id=808"
    assert got[0]["description"].startswith("Curso: Historia; Vagas: 4; Periodo de inscricoes: 01/03/2031 a 09/03/2031")
    assert got[1]["dedupe_url"] == "https://example.edu.br/sel/?id=tutores%7Cbotanica%7C05%2F02%2F2031%7C2"
    assert got[1]["description"].endswith("Situacao: Fechado")
    assert (got[2]["url"], got[2]["notice_type"]) == ("https://example.edu.br/a.pdf", "bolsa")


def test_long_processes_stay_apart(spark):
    row = '<tr><td class="agrupador"><a href="#">{}</a></td></tr><tr><td>C</td><td>1</td><td class="datas">01/01/2031</td></tr>'
    src = pages(spark, sel='<table class="listagem">' + "".join(row.format("processo " * 30 + k) for k in ("um", "dois", "dois")) + "</table>")
    got = listings.extract_process_pages(src, html.extract_signals(src, ())).collect()
    assert len({r["dedupe_url"] for r in got}) == len(got) == 2


def test_posts_and_channel_merge(spark):
    payload = (
        '[{"link":"/p/1","title":{"rendered":"<b>Edital</b> 1"},"excerpt":{"rendered":"x"}},'
        '{"link":"/p/2","title":{"rendered":"Resultado"},"excerpt":{"rendered":"final"}},'
        '{"link":"/p/3","title":{"rendered":"Resultado"},"excerpt":{"rendered":"do processo seletivo"}}]'
    )
    base = "https://h.org/noticias/"
    responses = spark.createDataFrame(
        [(1, base, 0, 200, payload), (1, base, 1, 200, payload), (1, base, 2, 200, '{"a":1}'), (2, base, 0, 500, payload)],
        "source_id long, url string, term_order int, status_code int, payload string",
    )
    api = posts.extract_posts(posts.read_posts(responses))
    assert sorted(r["url"] for r in api.collect()) == ["https://h.org/p/1", "https://h.org/p/3"]
    page = spark.createDataFrame(
        [(1, "t", "https://h.org/p/1", "edital", None, 0), (2, "u", "https://h.org/q", "edital", None, 0)],
        "source_id long, title string, url string, notice_type string, description string, pos int",
    )
    failures = spark.createDataFrame([(1,), (3,)], "source_id long")
    items, failed = posts.merge_channels(api, page, failures)
    assert items.count() == 3
    assert [r[0] for r in failed.collect()] == [3]


def test_frontier(spark):
    one = "<a class='next' href='?p=1'>a</a><a href='b.html'>Próxima</a><a rel='next' href='c.html'>3</a><a href='/edital'>edital</a>"
    src = spark.createDataFrame(
        [(1, "https://h.org/?p=1", one), (2, "https://h.org/b.html", "<a href='/edital'>edital x</a><a href='/edital-2'>edital y</a>")],
        "page_id long, url string, html string",
    )
    seeds = src.filter("page_id = 1")
    frontier = links.page_frontier(links.next_pages(html.extract_links(seeds)))
    assert [r["next_url"] for r in frontier.collect()] == ["https://h.org/b.html"]
    got = links.union_frontier(frontier, seeds, src, links.extract_generic).orderBy("rank", "pos").collect()
    assert [(r["url"], r["title"]) for r in got] == [
        ("https://h.org/edital", "edital x"), ("https://h.org/edital-2", "edital y"),
    ]


def test_containers(spark):
    src = pages(spark, x="<div class='notice-item'><a href='/1'>T</a><span class='date'>01/02</span></div><div class='notice-item'>no</div>")
    got = html.extract_containers(src, "notice-item").collect()
    assert [(r["title"], r["href"], r["date"]) for r in got] == [("T", "/1", "01/02")]
