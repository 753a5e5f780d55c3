import io
import zipfile

import pytest
from pyspark.sql import functions as F

from karst.plans.plugins import ask_table, read_only
from karst.sources import readers as S


def test_front_matter_round_trip():
    front = {"title": "è: un titolo", "tags": ["a", "b"], "n": None}
    blocks = [{"content": "# x\n\ntext\n", "block_type": "text", "page": 2, "heading_path": ["x"]}, {"content": "", "block_type": "table", "page": 1, "heading_path": []}]
    assert S.from_markdown(S.to_markdown(front, blocks)) == (front, blocks)


def test_csv_blocks_of_large_tables():
    data = "a,b\n" + "\n".join(f"{i},x" for i in range(120))
    assert [len(b["content"].splitlines()) for b in S.read_csv(data.encode())] == [52, 52, 22]
    assert len(S.read_csv(b"a,b\n1,2\n")) == 1


def test_header_row_below_notes():
    rows = [["note", None, None], [None], ["a", "b", "c"], ["1", None, "3"]]
    assert S.header_row(rows) == 2 and S.header_row([["x"], ["y"]]) == 0
    assert "| a | c |" in S.sheet_blocks("s", rows)[0]["content"]


def test_html():
    html = "<title> A  b </title><nav>menu</nav><p>One</p><p class='ads x'>no</p><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>two</td></tr></table>"
    assert S.html_transform(html, {"nav"}, {"ads"}) == "One\nk\nv\n1\ntwo"
    assert S.html_tables(html)[0]["col_names"] == ["k", "v"] and S.html_tables(None) == []
    assert S.page(html).title == "A b"


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    xml = f"<w:document {w}><w:body>{p('Top', 'Heading1')}{p('text')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/media/i.png", b"123")
    blocks = S.read_docx(out.getvalue())
    assert [(b["block_type"], b["heading_path"]) for b in blocks] == [("heading", []), ("text", ["Top"]), ("table", ["Top"])]
    assert S.docx_images(out.getvalue())[0]["size"] == 3


def test_files_and_snapshots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,2\n")
    assert S.read_files(spark, str(tmp_path / "in"), "csv").first().block_type == "table"
    df = spark.createDataFrame([(1, "n")], "id int, namespace string")
    S.save_snapshot(df, str(tmp_path / "snap"), "20240101")
    S.save_snapshot(df.withColumn("id", F.lit(2)), str(tmp_path / "snap"), "20240202")
    assert S.load_snapshot(spark, str(tmp_path / "snap")).select("id").collect()[0][0] == 2
    assert S.load_snapshot(spark, str(tmp_path / "snap"), "20240101").select("id").collect()[0][0] == 1


@pytest.mark.parametrize("bad", ["DROP TABLE x", "SELECT 1; SELECT 2", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", ""])
def test_read_only_guard(bad):
    with pytest.raises(ValueError):
        read_only(bad)


def test_ask_table(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert ask_table(df, "SELECT sum(x) AS s, 'drop' AS w FROM {t}").first().s == 3
