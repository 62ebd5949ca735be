"""Round trips of whole packages: what is written in one pass, copies, and what they cost."""

import io
import os
import time
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.document import Paragraph, Piece, Rev, from_texts
from palimpsest.plans import catalogue
from palimpsest.sources import ooxml

SF = "/root/testdata/sf0.001"
DATE = "2026-01-01T00:00:00Z"
ODD = ["", " a", "b  c", "d <&> \"e\"", "tab\there", "two\nlines", "é \U0001f600", "days", "Note: days days"]


def whole(el):
    return ET.tostring(el, encoding="UTF-8", xml_declaration=True)


def test_serialised_as_the_library_does():
    odd = f'<w:a xmlns:w="{ooxml.W}" xmlns:x="urn:x" x:k="1&#10;&quot;&lt;"> t &amp;<w:b/>tail &gt;<x:c y="&#9;&#13;"><n xmlns="urn:n" w:z="é">ü</n></x:c><plain/></w:a>'
    for text in (odd, "<a/>", "<a> </a>", '<a xml:space="preserve"><b>\U0001f600</b></a>'):
        assert ooxml.serialised(ET.fromstring(text)) == whole(ET.fromstring(text))


def test_plain_paragraphs_are_written_as_by_elements():
    one, two, three = Rev("ins", "1", 'A "&" <b>', DATE), Rev("del", "2", "B", DATE), Rev("moveTo", "3", "", None)
    shapes = [(), (one,), (one,), (one, two), (two,), (three, two), (), (Rev("ins", "1", "A", DATE),)]
    p = Paragraph([Piece(t, revs) for t in ("x", " y", "z  z", "<&>", "é") for revs in shapes], source={ooxml.q("rsidR"): "00"})
    root, plain = ET.Element(ooxml.q("body")), {}
    assert ooxml.update_blocks(root, [p], ("body",), plain) and len(plain) == 1
    want = ET.Element(ooxml.q("body"))
    want.append(ooxml.write_paragraph(p))
    assert ooxml.serialised(root, plain) == whole(want)


def test_odd_texts_both_ways():
    doc = ooxml.read(ooxml.write(from_texts(ODD, date=DATE)), date=DATE)
    assert doc.texts() == ODD
    assert doc.replace_text("days", "working days", count=None) == 3 and doc.delete_matching("Note: ") == 1
    again = ooxml.read(ooxml.write(doc))
    assert len(again.revisions()) == 7
    accepted = again.copy()
    accepted.accept()
    assert accepted.texts() == [t.replace("days", "working days").replace("Note: ", "") for t in ODD]
    assert len(again.revisions()) == 7  # a copy's own
    again.reject()
    assert again.texts() == ODD


def test_writing_a_long_document_costs_little_more_than_its_xml():
    texts = [f"{i}.1  Supply of part {i}. Fees follow Section 3.1 and 4 within {i} days." for i in range(3000)]

    def seconds(call):
        best = 1e9
        for _ in range(3):
            began = time.process_time()
            out = call()
            best = min(best, time.process_time() - began)
        return best, out

    doc = ooxml.read(ooxml.write(from_texts(texts, date=DATE)), date=DATE)
    assert doc.replace_text("days", "working days", count=None) == 3000
    own, content = seconds(lambda: ooxml.write(doc))
    part = ooxml.read(content).package[0]["word/document.xml"]
    xml, _ = seconds(lambda: ET.tostring(ET.fromstring(part)))
    assert own < 2 * xml


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_contracts_in_one_row_each(spark):
    rows = catalogue.contracts(spark, SF).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("para_id", "text"))), lambda x: x["text"]).alias("texts"))
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, catalogue.contract_texts(spark, SF).collect()))


def test_prefixes_wherever_they_are_declared():
    many = " ".join(f'xmlns:p{i}="urn:{i:0100d}"' for i in range(30))
    for part in ('<a xmlns:x="urn:x"/>', '<a xmlns="urn:x"><b xmlns:y="urn:y"/></a>', f"<a {many}><b/></a>", f"<!--{' ' * 5000}--><a {many}/>", "<a><b xmlns='urn:z'/></a>", "<a/>", '<a xmlns:x="urn:x">xmlns</a>'):
        for data in (part.encode(), part.encode("utf-16")):
            assert ooxml._spaces(data) == dict(x for _, x in ET.iterparse(io.BytesIO(data), ("start-ns",)))
