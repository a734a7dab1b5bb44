import base64

import pytest

from corpusloom.errors import FileNotReadable, FileTypeNotValid, ImageNotValid, NoAvailableSource, NotAFile, UnknownExtension
from corpusloom.operators.paged import paged_chunks, paged_images
from corpusloom.schema import IMAGE
from corpusloom.sources import dom, images, pdf, registry
from corpusloom.sources.markdown import blocks, digest_markdown
from corpusloom.sources.markup import digest_markup
from corpusloom.sources.reader import digest_file, read_files
from corpusloom.sources.registry import Options

PNG = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")


def texts(rows):
    return [r["text_content"] for r in rows]


# markup


def test_each_header_has_its_own_text():
    got = texts(digest_markup("<body><h1 id=a>Start</h1><p>First words.</p><h2>More</h2><p>Second words.</p></body>", 1000))
    assert got == ["Start: (#a)\n\nFirst words.", "More: (html > body > h2)\n\nSecond words."]


def test_tables_become_markdown():
    [t] = texts(digest_markup("<h1 id=r>R</h1><table><caption>By year</caption><thead><tr><th>Y<th>S</thead><tbody><tr><td>1<td>20</tbody></table>", 1000))
    assert t == "R: (#r)\n\n|Y | S|\n|---|---|\n|1 | 20|\n*By year*"


def test_headers_in_wrappers_and_loose_text():
    got = digest_markup("<div class=w><h2 id=n>Nested</h2>loose <p>inner <a href=x>link</a></p></div><ul><li>one<li>two</ul>", 1000)
    assert texts(got) == ["Nested: (#n)\n\nlooseinner linkone two"]
    assert got[0]["anchor"]["selectors"] == ["html > body > div.w", "html > body > div.w > p", "html > body > ul"]


def test_text_before_the_first_header():
    assert texts(digest_markup("<p>Welcome.</p><h1>L</h1><p>x</p>", 1000))[0] == "Welcome.: (html > body)\n\nWelcome."
    assert texts(digest_markup("<title>Doc</title><p>Welcome.</p>", 1000)) == ["Doc: (html > body)\n\nWelcome."]


def test_long_pieces_are_cut_and_carry_the_header():
    got = digest_markup("<h1 id=w>Wall</h1><p>" + "This goes on and on. " * 40 + "</p>", 200)
    assert len(got) > 1 and all(t.startswith("Wall: (#w)\n\n") and len(t) <= 200 for t in texts(got))
    assert [r["sequence_index"] for r in got] == list(range(len(got))) and {r["document_length"] for r in got} == {len(got)}


def test_small_pieces_are_packed():
    got = digest_markup("<h1 id=n>Notes</h1>" + "".join(f"<p>Note number {i} takes up some room here.</p>" for i in range(10)), 150)
    assert 1 < len(got) < 10 and all(len(t) <= 150 for t in texts(got))


def test_images_part_the_text_and_those_that_fail_take_no_number():
    html = "<h1 id=p>P</h1><p>before</p><img src=a.png alt='A dog'><p>mid</p><img src=gone.png><p>after</p><img alt=x>"
    got = digest_markup(html, 1000, lambda src: PNG if src == "a.png" else None)
    assert [(r["content_type"], r["sequence_index"], r["document_length"]) for r in got] == [(0, 0, 4), (1, 1, 4), (0, 2, 4), (0, 3, 4)]
    assert got[1]["text_content"] == "A dog" and got[1]["data_content"] == PNG


def test_headers_only_nothing_and_junk():
    assert digest_markup("<h1>A</h1><h2>B</h2>", 100) == digest_markup("", 100) == digest_markup(None, 100) == digest_markup("  ", 100) == []
    assert digest_markup("<p>open <b>never <i>closed < & &bogus; </div></p></span>tail", 100)
    assert digest_markup("<script>var x = '<p>no</p>'</script><style>p{}</style>", 100) == []
    assert len(digest_markup("<div>" * 3000 + "deep" + "<h1>x</h1>y", 10_000)) == 2


def test_xml_plist_and_outlines():
    xml = '<?xml version="1.0" encoding="UTF-8"?>'
    assert texts(digest_markup(xml + "<catalog><item><name>Wheel</name><price>9.99</price></item></catalog>", 1000)) == ["Wheel 9.99: (#root)\n\nWheel 9.99"]
    got = texts(digest_markup(xml + "<book><h1 id='one'>One</h1><p>First.</p><H2>no header</H2></book>", 1000))
    assert got == ["One: (#one)\n\nFirst.no header"]
    assert "Name Wheel" in texts(digest_markup(xml + "<plist><dict><key>Name</key><string>Wheel</string></dict></plist>", 1000))[0]
    outline = xml + "<opml><head><title>Feeds</title></head><body><outline text='News'/><outline text='Blogs'/></body></opml>"
    assert texts(digest_markup(outline, 1000)) == ["Feeds: (opml > body)\n\nNewsBlogs"]
    assert texts(digest_markup(xml + "<broken><p>still read</broken>", 1000)) == ["still read: (html > body)\n\nstill read"]


def test_selectors():
    root = dom.parse_html("<body><div><p class='a b'>1</p><p>2</p></div><div id=x><span>3</span></div></body>")
    found = {e.text(): e.selector() for e in root.descendants() if e.tag in ("p", "span")}
    assert found == {"1": "html > body > div:nth-child(1) > p.a.b", "2": "html > body > div:nth-child(1) > p:nth-child(2)", "3": "#x > span"}


# Markdown


def test_headings_part_the_text():
    got = digest_markdown("# A\n## B\n### C\n# D", 512)
    assert texts(got) == ["A\n# A\n## B\n### C", "D\n# D"] and got[1]["sequence_index"] == 1 and got[1]["document_length"] == 2


def test_prefix_is_of_where_the_text_began():
    source = "# A\ntext\n\n# B\nmore"
    assert texts(digest_markdown(source, 512)) == ["A\n# A\ntext", "B\n# B\nmore"]
    assert texts(digest_markdown(source, 512, prefix="reference"))[0] == "# A\ntext"
    with pytest.raises(ValueError):
        digest_markdown(source, 512, prefix="x")


def test_kinds_of_blocks():
    source = "| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = 1\n\ny\n```\n\n<div class=\"f\">\n&copy; Foo\n</div>\n\n- one\n  - two\n\n> quoted\nlazy\n\n    indented\n\nTitle\n=====\n\n***\n\n[t](u.png) ![i](v.png)"
    kinds = [(b.kind, b.text) for b in blocks(source)]
    assert kinds == [("text", "| a | b |\n|---|---|\n| 1 | 2 |"), ("text", "```py\nx = 1\n\ny\n```"), ("text", '<div class="f">\n&copy; Foo\n</div>'), ("text", "one"), ("text", "two"), ("text", "quoted\nlazy"), ("text", "```\nindented\n```"), ("heading", "# Title"), ("break", ""), ("text", "[t](u.png) ![i](v.png)")]


def test_emphasis_is_written_with_asterisks():
    [t] = texts(digest_markdown("*a* _b_ **c** __d__ snake_case_name `_code_`", 512))
    assert t == "*a* *b* **c** **d** snake_case_name `_code_`"


def test_places_and_breaks():
    got = digest_markdown("first\nline\n\nsecond\n\n---\n\nthird", 512)
    assert [(r["anchor"]["text_range"]["lower"], r["anchor"]["text_range"]["upper"]) for r in got] == [({"line": 1, "column": 1}, {"line": 4, "column": 7}), ({"line": 8, "column": 1}, {"line": 8, "column": 6})]
    assert len(digest_markdown("a " * 100 + "\n\n" + "b " * 100, 210)) == 2
    assert digest_markdown("", 10) == digest_markdown(None, 10) == []


# paged documents


def test_pages():
    got = pdf.digest_pages(pdf.Pages(texts=[(2, "Third page. Ends."), (0, "First page."), (1, None)], images=[(1, b"y"), (0, b"x"), (2, None)], labels={1: "ii"}), 12)
    assert [(r["content_type"], r["sequence_index"], r["document_length"], r["anchor"]["page"]) for r in got] == [(0, 0, 3, 0), (0, 1, 3, 2), (0, 2, 3, 2), (1, 0, 2, 0), (1, 1, 2, 1)]
    assert [r["text_content"] for r in got if r["content_type"] == IMAGE] == ["Page 0 of PDF", "Page ii of PDF"]
    assert pdf.digest_pages(pdf.Pages(texts=[(0, None)], whole="All of it."), 100)[0]["anchor"]["kind"] == "text"
    assert pdf.digest_pages(pdf.Pages(), 100) == []


def test_pages_as_rows(spark):
    rows = spark.createDataFrame([(1, 1, "B one. B two."), (1, 0, "A."), (1, None, "whole"), (2, None, "Whole text."), (3, 0, None)], "doc_id long, page int, text string")
    got = [(r.doc_id, r.page, r.text_content, r.sequence_index, r.document_length, r.anchor.kind) for r in paged_chunks(rows, context_size=7).orderBy("doc_id", "sequence_index").collect()]
    assert got == [(1, 0, "A.", 0, 3, "pdf"), (1, 1, "B one.", 1, 3, "pdf"), (1, 1, "B two.", 2, 3, "pdf"), (2, None, "Whole text.", 0, 1, "text")]
    pics = spark.createDataFrame([(1, 0, b"x", "i"), (1, 1, None, None), (1, 2, b"z", None)], "doc_id long, page int, data binary, label string")
    assert [(r.text_content, r.sequence_index, r.document_length) for r in paged_images(pics, label="label").orderBy("page").collect()] == [("Page i of PDF", 0, 2), ("Page 2 of PDF", 1, 2)]


# images, types, files


def test_images(tmp_path):
    (tmp_path / "a b.png").write_bytes(PNG)
    (tmp_path / "no.png").write_text("text")
    page = str(tmp_path / "page.html")
    load = images.loader(page)
    assert load("a%20b.png") == PNG and load("no.png") is None and load("gone.png") is None and load("http://x/y.png") is None
    assert load("data:image/png;base64," + base64.b64encode(PNG).decode()) == PNG
    assert images.sniff(PNG) == "image/png" and images.sniff(b"\xff\xd8\xff\xe0") == "image/jpeg" and images.sniff(b"") is None
    answers = {"http://h/ok": (200, "image/png", PNG), "http://h/bad": (404, "image/png", PNG), "http://h/text": (200, "text/html", PNG), "http://h/junk": (200, "image/png", b"junk")}
    assert images.load_image("http://h/ok", answers.get) == PNG
    for a in ("bad", "text", "junk"):
        with pytest.raises(ImageNotValid):
            images.load_image(f"http://h/{a}", answers.get)


def test_the_most_specific_source():
    for kind, name in {"plain": "text", "source": "text", "utf16": "text", "csv": "text", "html": "markup", "xml": "markup", "opml": "markup", "plist": "markup", "markdown": "markdown", "pdf": "pdf"}.items():
        assert registry.source_for(kind).name == name
    for kind in ("font", "png", "unheard"):
        with pytest.raises(NoAvailableSource):
            registry.source_for(kind)
    assert registry.most_specific(["text", "plain", "data"], "markdown") == "plain" and registry.most_specific(["xml"], "html") is None
    assert "opml" in registry.supported_types()


def test_validation(tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("x")
    (tmp_path / "a.unheard").write_text("x")
    assert registry.validate(f"file://{f}") == registry.validate(str(f)) == str(f)
    for path, error in ((f"http://h{f}", NotAFile), (str(tmp_path / "none.txt"), FileNotReadable), (str(tmp_path / "a.unheard"), UnknownExtension)):
        with pytest.raises(error):
            registry.validate(path)
    with pytest.raises(FileTypeNotValid):
        registry.validate(str(f), ("pdf",))


def test_encodings():
    assert registry.decode("é\r\n".encode()) == "é\n" and registry.decode("é".encode("utf-16")) == "é" and registry.decode("é".encode("utf-16-le"), "utf16") == "é" and registry.decode(b"\xef\xbb\xbfx") == "x"


def test_a_folder_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("\nOne. Two.")
    (tmp_path / "sub" / "b.html").write_text("<h1 id=t>T</h1><p>p</p><img src=i.png>")
    (tmp_path / "sub" / "i.png").write_bytes(PNG)
    (tmp_path / "c.md").write_text("# M\ntext")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.csv2").write_text("no")
    o = Options(pdf=lambda data: pdf.Pages(texts=[(0, "Page.")]))
    got = {}
    for r in read_files(spark, str(tmp_path), o).orderBy("path", "sequence_index").collect():
        got.setdefault(r.path.rpartition("/")[2], []).append((r.content_type, r.text_content, r.anchor.kind))
    assert got == {"a.txt": [(0, "One. Two.", "text")], "b.html": [(0, "T: (#t)\n\np", "selector"), (1, None, "selector")], "c.md": [(0, "M\n# M\ntext", "location")], "d.pdf": [(0, "Page.", "pdf")]}
    assert "d.pdf" not in {r.path.rpartition("/")[2] for r in read_files(spark, str(tmp_path)).collect()}
    assert digest_file(str(tmp_path / "a.txt"))[0]["anchor"]["char_range"] == {"lower": 1, "upper": 10}
    with pytest.raises(NoAvailableSource):
        digest_file(str(tmp_path / "d.pdf"))
