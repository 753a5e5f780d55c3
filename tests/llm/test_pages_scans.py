import datetime as dt

from karst.llm import mainbody as M
from karst.llm import scanned as S

SENTENCE = "Questa è una frase piuttosto lunga, con una virgola e con un punto alla fine."


def page(n, note=""):
    return (
        f"<html><head><title>T{n}</title></head><body><nav class='menu'><a>Home</a><a>Contatti</a></nav><article class='x'><h1>Titolo numero {n}</h1><p class='meta'>Tempo di lettura: {n} minuti</p>"
        f"<p>{SENTENCE} Pagina {n}.</p>{note}<ul><li>una voce</li></ul><div class='rel'><a>Leggi anche: altro {n}</a></div></article><footer><p>{SENTENCE}</p><p>© 2024 Sito</p></footer></body></html>"
    )


def plain(n, note=False):
    return "\n".join(["Home | Contatti", f"Titolo numero {n} ", f"Tempo di lettura: {n} minuti", "", f"{SENTENCE} Pagina {n}.", *(["Nota: " + SENTENCE] if note else []), "una voce", f"Leggi anche: altro {n}", SENTENCE, "© 2024 Sito"])


def test_main_body(spark):
    rows = [(n, f"https://s.example/titolo-numero-{n}", "s", page(n), plain(n), "x") for n in range(1, 25)]
    rows += [(50, "https://s.example/titolo-numero-50", "s", None, plain(50), "x"), (51, "u", "s", page(51, f"<aside class='nota'>Nota: {SENTENCE}</aside>"), plain(51, True), "x")]
    rows += [(60, None, None, None, None, None), (61, None, None, "", " \n ", None), (62, "u", "s", "<p>broken <b", "x", None), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, site string, html string, text string, tags string")
    params = spark.createDataFrame([("s", ["nav", "aside"], None)], "site string, unwanted_tags array<string>, unwanted_classnames array<string>")
    got = {}
    for r in M.main_body(pages, params).collect():
        got.setdefault(r.page_id, []).append(r.line_no)
    assert all(sorted(got[n]) == [1, 4, 5] for n in range(1, 25))
    assert sorted(got[50]) == [1, 4, 5] and sorted(got[51]) == [1, 4, 5, 6]
    assert not {60, 61} & set(got)
    assert M.main_body(pages.limit(0), params).count() == 0


WORDS = "il contratto di fornitura deve essere conservato in archivio con la polizza assicurativa".split()


def line(n):
    """Lines of like words that don't repeat."""
    w = WORDS[n % 12 :] + WORDS[: n % 12]
    return " ".join([*w, WORDS[n // 12 % 12], "e", WORDS[(n + 5) % 12]])


def scan(spark):
    rows, n = [], 0
    for doc in range(4):
        for page_no in range(1, 6):
            body = [line(n + k) for k in range(6)]
            n += 6
            if doc:
                body = [f"Manuale operativo n. {doc}    {page_no}", "", *body[:4], f"{WORDS[page_no]} {WORDS[doc + 4]} il contratto di forni-", f"- {page_no} -"]
            if doc == 1 and page_no == 2:
                body[3] = "deve essere conservato il c0ntratto di fornitura con la po1izza assicurativa"
            rows.append((f"b{doc}{page_no}", f"d{doc}", page_no, "\n".join(body), "ns", dt.datetime(2024, 1, 1)))
        rows.append((f"b{doc}6", f"d{doc}", 6, f"tura deve essere {WORDS[doc]}\n" + line(130 + doc), "ns", None))
    rows += [rows[0], ("bn", None, None, None, None, None), ("be", "d9", 1, "", None, None)]
    pages = spark.createDataFrame(rows, "body_id string, doc_id string, page_no int, body string, namespace string, converted_at timestamp")
    elements = spark.createDataFrame([("t1", "e1", 0, 0, "Text", "fornitura deve esserc conservato"), ("t2", "e1", None, None, None, None)], "element_id string, doc_id string, page int, seq int, element_type string, text string")
    return pages, elements


def test_spots(spark):
    pages, elements = scan(spark)
    repaired = S.repair(pages, elements)
    found = {(r.item_id, r.line_no, r.kind, r.word) for r in repaired.spots.collect()}
    assert ("b12", 0, "running", "") in found and ("b12", 7, "page_number", "") in found
    assert {("b12", 3, "misread", "contratto"), ("b12", 3, "misread", "polizza"), ("t1", 0, "misread", "essere")} <= found
    assert ("b15", 6, "hyphen", "fornitura") in found
    assert not any(i.startswith("b0") for i, *_ in found)
    flow = "\n".join(r.paragraph for r in S.paragraphs(repaired).where("doc = 'b/d1'").collect())
    assert "Manuale" not in flow and "forni-" not in flow and "c0ntratto" not in flow
    assert "il contratto di fornitura deve essere" in flow  # the second half left the next page
    assert "contratto di fornitura con la polizza assicurativa" in flow


def test_lines_without_words_and_two_words_of_one_skeleton(spark):
    rows = [(f"x{n}", "d", n, line(n) + "\n" + line(n + 40)) for n in range(30)]
    rows += [("z1", "z", 1, "deve essere conser-\n* * *\n| |"), ("z2", "z", 2, "...\nvato in archivio, c0ntratto e c0ntratt0 e Contratto"), ("z3", "z", None, "---"), ("z4", "z", 64, "- - -"), ("z5", "z", 200, "la poliz-"), ("z6", "z", 300, "za")]
    pages = spark.createDataFrame(rows, "body_id string, doc_id string, page_no int, body string")
    elements = spark.createDataFrame([], "element_id string, doc_id string, page int, seq int, element_type string, text string")
    repaired = S.repair(pages, elements)
    found = [(r.item_id, r.line_no, r.kind, r.word) for r in repaired.spots.where("item_id like 'z%'").collect()]
    assert sorted(found) == [("z1", 0, "hyphen", "conservato"), ("z2", 1, "misread", "contratto"), ("z5", 0, "hyphen", "polizza")]
    assert sorted(r.pos for r in repaired.fixes.where("item_id = 'z2'").collect()) == [3, 5]
    text = " ".join(r.paragraph for r in S.paragraphs(repaired).where("doc = 'b/z'").orderBy("paragraph_no").collect())
    assert "deve essere conservato" in text and "in archivio, contratto e contratto e Contratto" in text and "la polizza" in text and "poliz-" not in text


def test_sieve_loses_no_partner(spark):
    from karst.llm.sieve import sieve

    rows = spark.range(20000).selectExpr("cast(id as string) as k", "id as __n").union(spark.sql("select cast(null as string), 1L"))
    keys = spark.range(0, 20000, 37).selectExpr("cast(id as string) as k")
    got = {r.k for r in sieve(rows, "k", keys).collect()}
    assert {str(n) for n in range(0, 20000, 37)} <= got and len(got) < 2000 and None not in got
    assert sieve(rows, "k", keys.limit(0)).count() == 0


def test_empty_scans(spark):
    pages, elements = scan(spark)
    repaired = S.repair(pages.limit(0), elements.limit(0))
    assert repaired.spots.count() == 0 and S.paragraphs(repaired).count() == 0


def test_long_lines_of_one_beginning_have_different_keys(spark):
    same = "una pagina senza fine di riga che comincia sempre allo stesso modo " * 5
    rows = spark.createDataFrame([(same + "coda prima",), (same + "altra fine",), (same + "coda prima",)], "line string")
    a, b, c = (r.key for r in rows.select(S.key_of(rows.line).alias("key")).collect())
    assert a == c != b


def test_lines_behind_a_long_menu_are_aligned():
    nodes = [M.Node((), f"voce {i}") for i in range(200)] + [M.Node((), "Home"), M.Node((), "Testo con"), M.Node((), "un link"), M.Node((), "Home")]
    lines = ["voce 0", "manca", "Home", "Testo con un link", "", "Home"]
    assert M.align(lines, nodes) == [[0], [], [200], [201, 202], [], [203]]
    assert M.align([], nodes) == [] and M.align(["x"], []) == [[]]


def test_ratios_alone_find_the_paragraphs():
    kinds = M.classify(M.parse(page(7)), set(), set(), rules=False)
    texts = [n.text for n, (kind, _) in zip(M.parse(page(7)), kinds) if kind == M.CONTENT]
    assert f"{SENTENCE} Pagina 7." in texts and "Home" not in texts


def test_markup_of_any_kind_is_read():
    html = (
        '<!doctype html><!-- <p>no</p> --><html><head><title>T</title><script>if (a<b) "<p>no</p>"</script></head><body class=\'x y\'><p title="a > b">uno &amp; due</p>'
        "<br/><div class=z><span/>tre</i></div></section><P>quattro <b>cinque</div> sei <a href='x"
    )
    got = [("/".join(f"{t}.{c}" if c else t for _, t, c in n.path), n.text) for n in M.parse(html)]
    assert got[:3] == [("html/body.x y/p", "uno & due"), ("html/body.x y/div.z", "tre"), ("html/body.x y/p", "quattro")]
    assert ("html/body.x y/p/b", "cinque") in got and M.parse("") == [] and [n.text for n in M.parse("solo <")] == ["solo <"]
    assert len(M.parse("<p title='" * 3000 + "x")) <= 1
