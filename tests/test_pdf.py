"""PDF files made by hand: filters, fonts, object streams, forms, damage."""

import base64
import zlib

import pytest

from quire.operators import structure
from quire.plans.pdf import written
from quire.sources import files, pdf

HELVETICA = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"


def file_of(bodies, tail=b"trailer <</Root 1 0 R>>"):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj %b endobj\n" % (i, b) for i, b in bodies.items()) + tail


def stream(data, head=b""):
    return b"<<%b/Length %d>>\nstream\n%b\nendstream" % (head, len(data), data)


def one_page(content, fonts=HELVETICA, head=b"", more=()):
    return file_of({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1>>", 3: b"<</Type/Page/Contents 4 0 R/Resources<</Font<</F 5 0 R>>/XObject<</X 6 0 R>>>>>>", 4: stream(content, head), 5: fonts, **dict(more)})


def texts(data):
    return [row[7] for row in pdf.decode(data) if row[7] is not None]


def errors(data):
    return [(row[0], row[8]) for row in pdf.decode(data) if row[8]]


SHOW = b"BT /F 12 Tf 10 700 Td (Hello) Tj ET"


def lzw(data):
    """Nine-bit codes, cleared often enough to stay so wide."""
    bits = "".join(("100000000" if i % 200 == 0 else "") + f"{b:09b}" for i, b in enumerate(data)) + "100000001"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


@pytest.mark.parametrize("packed,head", [
    (SHOW, b""),
    (zlib.compress(SHOW), b"/Filter/FlateDecode"),
    (lzw(SHOW), b"/Filter[/LZWDecode]"),
    (SHOW.hex().encode() + b">", b"/Filter/ASCIIHexDecode"),
    (base64.a85encode(zlib.compress(SHOW)) + b"~>", b"/Filter[/ASCII85Decode/FlateDecode]"),
    (zlib.compress(b"\0" + SHOW), b"/Filter/FlateDecode/DecodeParms<</Predictor 15/Columns %d>>" % len(SHOW)),
])
def test_filters(packed, head):
    assert texts(one_page(packed, head=head)) == ["Hello"]


def test_every_row_filter_is_undone():
    rows = [bytes((i * 7 + j * j) % 256 for j in range(6)) for i in range(5)]

    def near(a, b, c):
        return min((a, b, c), key=lambda v: abs(a + b - c - v))

    packed, up = b"", bytes(6)
    for how, row in enumerate(rows):
        left = bytes(2) + row[:-2]
        corner = bytes(2) + up[:-2]
        guess = [(0, a, b, (a + b) // 2, near(a, b, c))[how] for a, b, c in zip(left, up, corner, strict=True)]
        packed += bytes([how]) + bytes((x - g) % 256 for x, g in zip(row, guess, strict=True))
        up = row
    assert pdf._unpredicted(packed, {"Predictor": 12, "Columns": 3, "Colors": 2}) == b"".join(rows)


def test_strings_and_steps():
    shown = rb"BT /F 10 Tf 0 700 Td (a\(b\)\101\n(c)) Tj T* [(wi) 20 (de) -300 (gap)] TJ 14 TL (next) ' 1 2 (last) " + b'" ET'
    assert texts(one_page(shown)) == ["a(b)A\n(c)", "wide", "gap", "next", "last"]


def test_encodings():
    differences = b"<</Subtype/Type1/BaseFont/X/Encoding<</Differences[65/eacute/uni4E2D/fi 97/quoteright/strange]>>>>"
    assert texts(one_page(b"BT /F 9 Tf (ABCabD) Tj ET", differences)) == ["é中ﬁ’�D"]
    assert texts(one_page(b"BT /F 9 Tf (\x92\x8a) Tj ET", HELVETICA.replace(b"WinAnsi", b"MacRoman"))) == ["íä"]
    assert texts(one_page(b"BT /F 9 Tf (\x92\xe4) Tj ET")) == ["’ä"]
    cmap = stream(b"2 beginbfchar <01> <00660069> <02> <D83DDE00> endbfchar 1 beginbfrange <03> <04> [<0041> <0042>] endbfrange")
    assert texts(one_page(b"BT /F 9 Tf <01020304> Tj ET", b"<</Subtype/Type1/BaseFont/X/ToUnicode 6 0 R>>", more={6: cmap}.items())) == ["fi😀AB"]


def test_widths_decide_blanks():
    font = b"<</Subtype/Type1/BaseFont/X/FirstChar 97/Widths[1000 500]>>"
    together = b"BT /F 10 Tf 0 0 Td (ab) Tj 15 0 Td (a) Tj ET"
    apart = b"BT /F 10 Tf 0 0 Td (ab) Tj 18 0 Td (a) Tj ET"
    assert texts(one_page(together, font)) == ["aba"]
    assert texts(one_page(apart, font)) == ["ab", "a"]


def test_forms_matrices_and_inline_images():
    form = stream(b"BT /F 10 Tf 5 5 Td (in a form) Tj ET /X Do", b"/Subtype/Form/Matrix[2 0 0 2 0 0]")
    data = one_page(b"q 1 0 0 1 100 0 cm /X Do Q BI /W 1 ID \x00)(\xff EI BT /F 10 Tf (after) Tj ET", more={6: form}.items())
    rows = [r for r in pdf.decode(data) if r[7]]
    assert [(r[7], r[2], r[4], r[5]) for r in rows] == [("in a form", 110, 10, 20), ("after", 0, 0, 10)]


def test_packed_objects_and_the_last_of_a_number():
    packed = [(1, b"<</Type/Catalog/Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]>>"), (5, HELVETICA)]
    body, places = b"", b""
    for n, b in packed:
        places += b"%d %d " % (n, len(body))
        body += b + b" "
    store = stream(zlib.compress(places + body), b"/Type/ObjStm/N 3/First %d/Filter/FlateDecode" % len(places))
    page = b"<</Type/Page/Contents 4 0 R/Resources<</Font<</F 5 0 R>>>>>>"
    data = b"%PDF-1.5\n" + b"".join(b"%d 0 obj %b endobj\n" % x for x in ((3, page), (4, stream(b"old")), (9, store), (8, stream(b"", b"/Type/XRef/Root 1 0 R")), (4, stream(SHOW))))
    assert texts(data) == ["Hello"]


def test_damage_is_a_row():
    assert errors(None) == errors(b"") == errors(b"no") == [(0, "ValueError: no PDF header")]
    assert errors(b"%PDF-1.4 and no more") == [(0, "ValueError: no catalog")]
    assert errors(file_of({1: b"<</Type/Catalog/Pages 2 0 R>>"}, b"trailer <</Root 1 0 R/Encrypt 3 0 R>>")) == [(0, "ValueError: encrypted")]
    assert errors(one_page(SHOW, head=b"/Filter/JBIG2Decode")) == [(1, "ValueError: filter JBIG2Decode")]
    assert errors(one_page(b"(a) 1 Td BT /F 12 Tf (x) Tj ET [(a) (b)] TJ (x) (y) Td")) == [(1, "ValueError: operands of Td")]
    bad = zlib.compress(SHOW * 50)
    assert errors(one_page(b"\x99" + bad[1:], head=b"/Filter/FlateDecode"))[0][1].startswith("error:")
    assert texts(one_page(SHOW)[:-40]) == ["Hello"]  # without its trailer


def test_page_trees_with_cycles_and_references_to_each_other():
    data = file_of({1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[2 0 R 3 0 R 3 0 R 7 0 R]/Resources<</Font<</F 5 0 R>>>>>>", 3: b"<</Type/Page/Contents[4 0 R 4 0 R]>>", 4: stream(SHOW), 5: HELVETICA, 7: b"8 0 R", 8: b"7 0 R"})
    assert [(r[0], r[1], r[7]) for r in pdf.decode(data)] == [(1, 0, None), (1, 1, "Hello"), (1, 2, "Hello")]


@pytest.mark.parametrize("cut", range(0, 100, 7))
def test_cut_and_changed_files_never_fail(cut):
    whole = written([f"line {i} with words" for i in range(90)])
    for data in (whole[: len(whole) * cut // 100], whole[: cut * 9] + bytes(40) + whole[cut * 9 + 40 :], whole.replace(b"/", b"(", cut)):
        assert all(len(row) == 9 for row in pdf.decode(data))


def test_files_to_structure(spark, tmp_path):
    """Two books in folders, a damaged file and one of another kind: lines, fonts, pages and headings."""
    book = [f"CHAPTER {i // 40 + 1}" if i % 40 == 0 else f"Sentence {i} of the book is plain prose." for i in range(100)]
    (tmp_path / "in" / "er").mkdir(parents=True)
    (tmp_path / "in" / "er" / "one.pdf").write_bytes(written(book))
    (tmp_path / "in" / "er" / "two.PDF").write_bytes(written(["Only a line", "", "  and \xad another one"]))
    (tmp_path / "in" / "bad.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "in" / "note.txt").write_text("not this")
    read = pdf.runs(pdf.files(spark, f"file://{tmp_path}/in"))
    assert [tuple(r) for r in pdf.errors(read).collect()] == [("bad", 0, "ValueError: no catalog")]
    lines = pdf.lines(read)
    assert lines.schema.simpleString() == "struct<doc_id:string,page:int,line_no:int,global_idx:bigint,text:string,font_size:double,is_bold:boolean>"
    got = {d: [tuple(r)[1:] for r in lines.where(f"doc_id = '{d}'").orderBy("global_idx").collect()] for d in ("er/one", "er/two", "bad")}
    assert got["er/one"] == [(i // 40 + 1, i % 40 + 1, i, t, 14.0 if i % 40 == 0 else 10.0, i % 40 == 0) for i, t in enumerate(book)]
    assert [x[:4] for x in got["er/two"]][0] == (1, 1, 0, "Only a line") and got["bad"] == []
    texts = {r.doc_id: r.text for r in files.page_texts(pdf.pages(read)).collect()}
    assert texts["er/one"] == "\n\n".join("\n".join(book[i : i + 40]) for i in range(0, 100, 40)) and set(texts) == {"er/one", "er/two"}
    heads = [r.title for r in structure.headings(lines.where("doc_id = 'er/one'")).orderBy("line_idx").collect()]
    assert heads == ["CHAPTER 1", "CHAPTER 2", "CHAPTER 3"]


def test_empty_pages_nulls_and_empty_tables(spark):
    given = spark.createDataFrame([("a", written([])), ("n", None), (None, written(["one line"])), ("b", written(["x y", "z w"]))], "doc_id string, content binary")
    read = pdf.runs(given.selectExpr("content", "doc_id", "1 AS page", "'x' AS text"))
    assert sorted((r.doc_id or "", r.page, r.text) for r in pdf.pages(read).collect()) == [("", 1, "one line"), ("a", 1, ""), ("b", 1, "x y\nz w")]
    assert {(r.doc_id, r.error) for r in pdf.errors(read).collect()} == {("n", "ValueError: no PDF header")}
    assert pdf.lines(pdf.runs(given.limit(0))).collect() == pdf.pages(pdf.runs(given.limit(0))).collect() == []


def test_lines_of_the_map_equal_those_of_windows(spark):
    """Runs of a line meet where they are decoded: gaps, steps back, sizes, bold fonts, empty and damaged pages as by windows."""
    wide = one_page(b"BT /F 10 Tf 0 700 Td (a) Tj 30 0 Td (b ) Tj 30 0 Td (c) Tj -90 0 Td (back) Tj 0 3 Td /F 20 Tf (up) Tj 0 -40 Td (down) Tj ET", HELVETICA.replace(b"Helvetica", b"Helvetica-BOLD"))
    data = [("w", wide), ("e", written([])), ("n", None), (None, written(["one line"])), ("m", written([f"line {i} of many words in several pieces of four" for i in range(95)])), ("cut", one_page(b"BT /F 12 Tf (x) Tj ET (a) 1 Td"))]
    given = spark.createDataFrame(data, "doc_id string, content binary")
    runs, placed = pdf.runs(given), pdf.in_lines(given)
    for what in (pdf.raw_lines, pdf.lines, pdf.pages, pdf.errors):
        a, b = (sorted(map(str, what(x).collect())) for x in (runs, placed))
        assert a == b and a
        assert what(runs).columns == what(placed).columns


def test_content_is_read_in_chunks_and_arrays_in_one_piece(monkeypatch):
    """Few values are scanned one by one: a line of twelve words is one array, and the words between arrays are cut at once."""
    whole, calls = written([" ".join(["word"] * 12)] * 400), []
    plain = pdf.Scanner.value
    monkeypatch.setattr(pdf.Scanner, "value", lambda self: (calls.append(1), plain(self))[1])
    assert len(texts(whole)) == 1200
    assert len(calls) < 1200  # one by one they are 4000
    assert texts(one_page(rb"BT/F 12 Tf 0 0 Td[(a)-300<62 63>]TJ[<646>-300<65>]TJ 0 -20 Td (x)Tj BI /W 1 ID [<61>]TJ EI 0 -20 Td(y)Tj ET")) == ["a", "bcd`", "e", "x", "y"]
