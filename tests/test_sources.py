"""Word and PDF files built in memory, and what the sources make of them."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folio.sources import docx, images, pdf
from folio.sources.pdf import content, fonts, objects

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId5" Type="http://x/image" Target="media/image1.png"/><Relationship Id="rId6" Type="http://x/styles" Target="styles.xml"/></Relationships>'


def paragraph(text, style=None, size=None, bold=False, centred=False, more=""):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ('<w:jc w:val="center"/>' if centred else "")
    run = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{size}"/>' if size else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r>{more}</w:p>"


def drawing(kind, rid):
    return f'<w:r><w:drawing><wp:{kind}><a:graphic><a:blip r:embed="{rid}"/></a:graphic></wp:{kind}></w:drawing><w:t>hidden</w:t></w:r>'


def word_file(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", RELS)
        z.writestr("word/media/image1.png", b"png bytes")
        z.writestr("word/media/empty.png", b"")
    return out.getvalue()


BODY = "".join(
    (
        paragraph("Report", size=40, bold=True, centred=True), paragraph("1 Aim .... 3", style="TOC1"), paragraph("listed", style="12"), paragraph("Scope", style="Heading1"), paragraph("范围", style="标题 2"), paragraph("Three", style="3"),
        paragraph("Seven", style="heading 7"), paragraph("big", size=48, bold=True), paragraph("thin", size=48), paragraph("1. First", bold=True), paragraph("## marked"), paragraph("see ", more=drawing("inline", "rId5") + drawing("anchor", "rId9")),
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>",
    )
)


def test_word(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(word_file(BODY))), ("b", bytearray(b"no zip")), ("c", None)], "path string, content binary")
    rows = {r.path: r for r in docx.documents(files).withColumn("md", docx.markdown(F.col("elements"))).collect()}
    assert rows["b"].elements is None and rows["c"].elements is None
    got = rows["a"]
    assert got.title == "Report"
    assert [(e.text, e.level) for e in got.elements if e.kind == "paragraph"] == [("Report", 5), ("Scope", 1), ("范围", 2), ("Three", 3), ("Seven", 1), ("big", 3), ("thin", 0), ("1. First", 2), ("## marked", 2), ("see {{IMAGE:image1.png}}", 0)]
    assert got.md.startswith("##### Report\n\n# Scope\n\n") and got.md.endswith("see {{IMAGE:image1.png}}\n\n| a\\|b |  |\n| --- | --- |\n| c |  |\n\n")
    pictures = docx.images(files, prefix="x/p_")
    assert [(r.path, r.id, r.saved, bytes(r.data)) for r in pictures.collect()] == [("a", "image1.png", "p_image1.png", b"png bytes")]
    text = spark.createDataFrame([("a", "x {{IMAGE:image1.png}}{{IMAGE:q}} y"), ("b", "{{IMAGE:z}}"), ("b", None)], "path string, text string")
    assert sorted(str(r.text) for r in docx.with_image_links(text, pictures).collect()) == ["None", "x ![](p_image1.png){{IMAGE:q}} y", "{{IMAGE:z}}"]
    images.write_images(pictures, str(tmp_path / "out"))
    assert (tmp_path / "out" / "p_image1.png").read_bytes() == b"png bytes"
    with pytest.raises(Exception, match="not a name"):
        images.write_images(pictures.withColumn("saved", F.lit("../up")), str(tmp_path / "out"))
    named = spark.createDataFrame([(bytearray(b"x"), "jpg"), (bytearray(b"x"), None)], "d binary, f string").select(images.page_image_name(F.col("d"), F.col("f"), "p-").alias("n"))
    assert [r.n for r in named.collect()] == ["p-2d711642b726b044.jpeg", "p-2d711642b726b044.png"]


def pdf_file(streams, extra=(), rotate=0, packed=False):
    """A file with one page for each content stream; extra: bodies of objects from number 10."""
    kids = " ".join(f"{100 + 2 * k} 0 R" for k in range(len(streams)))
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(streams)} /MediaBox [0 0 200 100] /Rotate {rotate} /Resources << /Font << /F1 10 0 R /F2 11 0 R >> /XObject << /Fm 12 0 R /Im 13 0 R >> >> >>".encode()}
    stream = lambda data, more=b"": b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), more, data)
    bodies |= {10 + k: x for k, x in enumerate(extra)}
    for k, s in enumerate(streams):
        bodies[100 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (101 + 2 * k)
        bodies[101 + 2 * k] = stream(zlib.compress(s), b" /Filter /FlateDecode")
    out = b"%PDF-1.5\n"
    if packed:  # what isn't a stream goes into an object stream
        inside = [n for n in bodies if b"stream" not in bodies[n]]
        heads, body = b"", b""
        for n in inside:
            heads += b"%d %d " % (n, len(body))
            body += bodies.pop(n) + b" "
        bodies[900] = stream(zlib.compress(heads + body), b" /Type /ObjStm /Filter /FlateDecode /N %d /First %d" % (len(inside), len(heads)))
    for n, b in bodies.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <4E2D> endbfchar\n2 beginbfrange\n<0002> <0003> <0061>\n<0004> <0005> [<0078> <0069>]\nendbfrange"
FONTS = (
    b"<< /Type /Font /Subtype /Type1 /BaseFont /A /FirstChar 65 /Widths [500 600] /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [66 /eacute /uni4E2D] >> >>",
    b"<< /Type /Font /Subtype /Type0 /BaseFont /B /DescendantFonts [20 0 R] /ToUnicode 21 0 R >>",
    b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 10 20] /Length 36 >>\nstream\nBT /F1 10 Tf 0 0 Td (A) Tj ET /Fm Do  \nendstream",
    b"<< /Type /XObject /Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Length 2 >>\nstream\n\x00\xff\nendstream",
    b"", b"", b"", b"", b"", b"",
    b"<< /Type /Font /Subtype /CIDFontType2 /DW 1000 /W [1 [300 400] 3 4 700] >>",
    b"<< /Length %d >>\nstream\n%s\nendstream" % (len(CMAP), CMAP),
)
FONTS = tuple(x or b"null" for x in FONTS)
PAGE = b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 5 6 Td (AB\\103) Tj [(A) -800 (A)] TJ ET Q /Fm Do q 20 0 0 10 50 60 cm /Im Do Q 1 2 30 40 re S 5 5 m 5 50 l S BT /F2 8 Tf 1 0 0 1 0 80 Tm <000100020005> Tj ET"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf_page(packed):
    (row,) = pdf.read_pages(pdf_file([PAGE], FONTS, packed=packed), with_images=True, fail=True)
    g = row["glyphs"]
    assert [x["text"] for x in g] == ["A", "é", "中", "A", " ", "A", "A", "中", "a", "i"]
    assert (g[0]["ox"], g[0]["oy"], g[0]["advance"], g[0]["visual_size"]) == (10.0, 12.0, 10.0, 20.0)
    assert g[0]["bbox"] == {"x0": 10.0, "y0": 8.0, "x1": 20.0, "y1": 28.0}
    assert (g[1]["ox"], g[2]["advance"]) == (20.0, 10.0)  # a width of 0.6, and one that isn't known
    assert round(g[4]["advance"], 6) == 1.6 and g[4]["bbox"]["x1"] == 0.0
    assert (g[6]["ox"], g[6]["oy"], g[6]["form_obj"]) == (10.0, 20.0, 12)
    assert [round(x["advance"], 6) for x in g[7:]] == [2.4, 3.2, 8.0]
    assert row["rects"] == [{"x0": 1.0, "y0": 2.0, "x1": 31.0, "y1": 42.0}] and row["segments"] == [{"x0": 5.0, "y0": 5.0, "x1": 5.0, "y1": 50.0}]
    (image,) = row["images"]
    assert (image["obj_nr"], image["width"], image["format"], image["bbox"]) == (13, 2, "png", {"x0": 50.0, "y0": 60.0, "x1": 70.0, "y1": 70.0})
    assert image["data"].startswith(b"\x89PNG")


def test_pdf_errors_and_pages():
    data = pdf_file([PAGE, b"BT /F1 10 Tf (A) Tj (broken", b""], FONTS)
    assert [r["page_num"] for r in pdf.read_pages(data)] == [1, 2, 3]
    assert [r["page_num"] for r in pdf.read_pages(data, (3, 1, 9, 1))] == [3, 1, 1]
    assert [len(r["glyphs"]) for r in pdf.read_pages(data, (2, 3))] == [1, 0]
    assert next(pdf.read_pages(b"nothing"))["error"] == "not a PDF file"
    with pytest.raises(objects.PdfError):
        list(pdf.read_pages(b"nothing", fail=True))


def test_pdf_streams_and_strings():
    lexer = objects.Lexer(rb"(a\(b\)\n\053(c)) <4a4> /N#41me [1 -2.5 .5] << /K 3 0 R >> true % note", 0)
    assert [lexer.read() for _ in range(6)] == [b"a(b)\n+(c)", b"J@", "NAme", [1, -2.5, 0.5], {"K": objects.Ref(3)}, True]
    doc = objects.Document(b"%PDF-1.4")
    of = lambda raw, **p: doc.decoded(objects.Stream(p, raw))
    assert of(b"616263>", Filter="ASCIIHexDecode") == b"abc"
    assert of(b"87cURD]i,\"Ebo80~>", Filter="ASCII85Decode") == b"Hello World!"
    assert of(bytes([2, 97, 98, 99, 254, 120, 128]), Filter="RunLengthDecode") == b"abcxxx"
    assert of(b"\x80\x0b\x60\x50\x22\x0c\x0c\x85\x01", Filter="LZWDecode") == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert of(zlib.compress(bytes([2, 1, 2, 2, 1, 1])), Filter="FlateDecode", DecodeParms={"Predictor": 12, "Columns": 2}) == bytes([1, 2, 2, 3])
    with pytest.raises(objects.PdfError):
        of(b"", Filter="Unknown")


@pytest.mark.parametrize("name,text", [("A", "A"), ("eacute", "é"), ("Ccaron", "Č"), ("alpha", "α"), ("seven", "7"), ("uni00E9", "é"), ("u1F600", "😀"), ("afii10017", "А"), ("afii10023", "Ё"), ("afii10097", "я"), ("quoteright", "’"), ("nonsense", "")])
def test_glyph_names(name, text):
    assert fonts.named(name) == text


def test_fonts():
    assert fonts.byte_table("StandardEncoding")[0x27] == "’" and fonts.byte_table("MacRomanEncoding")[0x8E] == "é" and fonts.byte_table(None)[0x80] == "€"
    assert fonts.GbkFont(1.0).decode("中a".encode("gbk")) == [("中", 1.0), ("a", 1.0)]
    import struct

    four = struct.pack(">HHHHHHH", 4, 0, 0, 4, 0, 0, 0) + struct.pack(">HHHHHHHHH", 0x42, 0xFFFF, 0, 0x41, 0xFFFF, (3 - 0x41) & 0xFFFF, 1, 0, 0)
    font = struct.pack(">IHHHH", 0x10000, 1, 0, 0, 0) + b"cmap" + struct.pack(">III", 0, 28, 0) + struct.pack(">HHHHI", 0, 1, 3, 1, 12) + four
    assert fonts.true_type_chars(font) == {3: 0x41, 4: 0x42} and fonts.true_type_chars(b"xx") == {}
    twelve = struct.pack(">HHIIIIII", 12, 0, 0, 0, 1, 0x1F600, 0x1F601, 7)
    assert fonts._cmap_table(twelve, 0) == {7: 0x1F600, 8: 0x1F601}


def test_forms_and_states():
    doc = objects.Document(pdf_file([b""], FONTS))
    found = content.interpreted(content.Resources(doc), doc.pages[0])
    found.run(b"q " * 300 + b"Q " * 300 + b"/F1 9 Tf 2 TL BT 5 6 Td (A) ' 1 2 (A) \" ET W n 0 0 m 3 4 l h S")
    assert [(g["ox"], g["oy"]) for g in found.glyphs] == [(5.0, 6.0), (5.0, 6.0)]
    assert found.state.clipped and found.segments == [(0.0, 0.0, 3.0, 4.0)]


def test_pdf_tables(spark, tmp_path):
    rules = b" ".join(b"%d %d 60 20 re" % (x, y) for x in (20, 80) for y in (20, 40)) + b" S "
    text = b"".join(b"BT /F1 10 Tf %d %d Td (%s) Tj ET " % v for v in ((30, 46, b"AA"), (90, 46, b"DE"), (30, 26, b"A|"), (10, 80, b"AD-"), (10, 70, b"DA")))
    (tmp_path / "one.pdf").write_bytes(pdf_file([rules + text, PAGE], FONTS))
    (tmp_path / "bad.pdf").write_bytes(b"oops")
    found = pdf.read(spark, str(tmp_path), images=True)
    assert [r.error for r in found.errors.collect()] == ["not a PDF file"]
    cells = {(r.page_num, r.row, r.col): r.text for r in found.tables().collect()}
    assert cells == {(1, 0, 0): "AA", (1, 0, 1): "DE", (1, 1, 0): "A|", (1, 1, 1): ""}
    (md,) = [r.markdown for r in found.markdown(with_images=True).collect()]
    assert md.index("AD-\nDA\n") < md.index("| AA | DE |\n| --- | --- |\n| A\\| |  |\n") and "![image](image_1)" in md
    pdf.register(spark)
    rows = spark.read.format("pdf").option("pages", "1,2,7").option("pages_per_task", "1").load(str(tmp_path / "one.pdf"))
    assert sorted((r.page_num, r.n) for r in rows.select("page_num", F.size("rects").alias("n")).collect()) == [(1, 4), (2, 1)]


def test_stream(spark, tmp_path):
    from folio import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(word_file(paragraph("Scope", style="Heading1") + paragraph("Some text.")))
    for _ in range(2):  # the second run finds nothing new
        streaming.write(streaming.word_markdown(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"), streaming.chunks_of).awaitTermination()
    assert [(r.title, r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("Scope", "Some text.")]
