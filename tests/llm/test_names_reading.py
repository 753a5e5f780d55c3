from karst.llm import names as N
from karst.llm import reading as R


def test_second_names_are_assigned_whatever_their_number():
    reader = N.Reader({w: "given" for w in "anna bea carla diana elena fiamma gaia".split()})
    a = reader.parse("Anna Bea Carla Diana Elena Fiamma Gaia Rossettini")
    assert reader.same(a, reader.parse("Anna G. F. E. D. C. B. Rossettini")) and not reader.same(a, reader.parse("Anna G. G. E. Rossettini"))
    assert reader.parse("Anna Bo")["core"] == "bo" and reader.parse("Studio 54 s.r.l.")["kind"] == "O" and reader.parse("12 marzo 2024") is None
    sectors = N.Reader({w: "sector" for w in "azienda sanitaria locale umbria nord".split()})
    assert sectors._sector(["azienda", "locale", "nord", "sanitaria", "umbria"], ["~aslun"])


def test_symmetric_deletes_cover_two_edits():
    words = ["folgarini", "folgarni", "flogarini", "folgarinni", "folgxrinx", "bertoldi"]
    for a in words:
        for b in words:
            if len(a) >= 8 and len(b) >= 8 and N.edits(a, b, 2) <= 2:
                assert N.deletes(a, 2) & N.deletes(b, 2)
    assert N.edits("abcd", "abdc", 2) == 1 and N.edits("abcd", "xyzw", 2) == 3


def test_abbreviations():
    assert N.abbreviates("costruz", "costruzioni") and N.abbreviates("flli", "fratelli") and N.abbreviates("bca", "banca")
    assert not N.abbreviates("b", "banca") and not N.abbreviates("fin", "idrico")


ENTITIES = [
    ("a1", "Stefano Gellebeldi", "n"), ("a2", "GELLEBELDI  STEFANO M.", "n"), ("a3", "Geom. Stefsno Margherita Gelebeldi", "n"), ("a4", "S. Gellebeldi", "n"),
    ("b1", "Ottavia Gellebeldi", "n"), ("b2", "Tavia Gelle beldi (delegato)", "n"), ("c1", "Stefano Gellebeldi", "other"),
    ("o1", "Banca di Credito Corsinosti S.p.A. (Fenhurst)", "n"), ("o2", "B.CA DI CREDITO CORSINOSTTI SPA", "n"), ("o3", "Costruzioni Generali Corsinosti scarl", "n"), ("o4", "Costr. Gen. Corsinosti Soc. Coop.", "n"),
    ("x1", "Fenhurst", "n"), ("x2", "12/03/2024", "n"), ("x3", "1.000,00 €", "n"), ("x4", None, "n"), ("x5", "  ", "n"), ("x6", "Luca Nessuno", None), ("a1", "Stefano Gellebeldi", "n"),
]


#: firms of other namespaces, from which sector words and the place are learned
FIRMS = [
    (f"{sector[:3]}{i}", f"{sector} {core} S.r.l. ({place})", f"s{i}")
    for sector, cores in {"Banca di Credito": "bertoldezzi fandolango", "Costruzioni Generali": "molinapardi zuccherossi"}.items()
    for i, (core, place) in enumerate([(c + x, "Fenhurst") for c in cores.split() for x in ("", "nivelli", "squorto")])
]


def test_same_names(spark):
    entities = spark.createDataFrame([(k, n, s, "junk") for k, n, s in ENTITIES + FIRMS], "entity_id string, entity_name string, namespace string, root string")
    nodes = spark.createDataFrame([("g1", {"name": "Gellebeldi, Stefano"}, "n"), ("g2", None, "n"), ("g3", {"city": "x"}, "n")], "id string, properties map<string,string>, namespace string")
    got = {(r.key_a, r.key_b) for r in N.pairs_of(N.same_names(entities, nodes)).collect()}
    groups = [["a1", "a2", "a3", "a4", "g1"], ["b1", "b2"], ["o1", "o2"], ["o3", "o4"]]
    assert got == {(a, b) for g in groups for a in g for b in g if a < b}


def test_no_names(spark):
    e = spark.createDataFrame([], "entity_id string, entity_name string, namespace string")
    n = spark.createDataFrame([], "id string, properties map<string,string>, namespace string")
    assert N.pairs_of(N.same_names(e, n)).count() == 0


TEXTS = {
    1: "il gatto vede la casa e il cane. la bimba ha una palla. ",
    2: "la filiale invia una lettera al cliente prima della scadenza mensile del bollettino postale. ",
    3: "la commissione di gara valuta la documentazione richiesta relativa al secondo lotto, mentre il servizio registra la differenza rispetto alla griglia di conformità descritta nell'allegato. ",
    4: "la sussidiarietà dell'obbligazione fideiussoria aggrava l'indeterminatezza interpretativa riguardante la natura sinallagmatica della prestazione remunerata nel perimetro degli intermediari consolidati. ",
}


def test_levels(spark):
    rows = [(100 * level + i, text * 6, "x") for level, text in TEXTS.items() for i in range(12)]
    rows += [(1, None, "x"), (2, "", "x"), (3, "poche parole", "x"), (4, "123 456 !!! " * 50, "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, reading_level string")
    labels = [(100 * level + i, g, level, None) for level in TEXTS for i in range(6) for g in "ab"]
    labels += [(100, "c", None, None), (100, "d", 9, None), (300, "e", 1, None), (7777, "a", 2, None), labels[0]]
    lab = spark.createDataFrame(labels, "doc_id long, grader string, reading_level int, graded_at timestamp")
    got = {r.doc_id: r.reading_level for r in R.reading_levels(docs, lab).collect()}
    assert got == {100 * level + i: level for level in TEXTS for i in range(12)}
    assert {r.reading_level for r in R.reading_levels(docs, lab.limit(0)).collect()} == {2}
    assert R.reading_levels(docs.limit(0), lab).count() == 0
    tagged = docs.selectExpr("doc_id", "text", "case doc_id % 4 when 0 then 'IT' when 1 then 'ita' when 2 then null else 'xx' end as lang")
    assert {r.doc_id: r.reading_level for r in R.reading_levels(tagged, lab).collect()} == got


def test_lists_come_from_document_frequencies_alone():
    import numpy as np

    p = R.Params(shares=(0.5, 0.1))
    lists = R.Lists({"casa": np.array([9.0, 1.0]), "perizia": np.array([2.0, 0.0]), "house": np.array([0.0, 8.0])}, np.array([10.0, 10.0]), p)
    x = lists.features("casa perizia. ignota casa.", ["casa", "perizia", "ignota", "casa"]).reshape(2, -1)
    assert x[0].round(6).tolist() == [0.5, 0.25, round(float(np.log(2)), 6), 1.0] and not x[1].any()


def test_long_cores_within_two_edits_are_candidates(spark):
    from karst.llm import names

    base = "abcdefghijklmnopqrstuvwxyz" * 3
    want = set()
    for n in (24, 26, 40, 70):
        core = base[:n]
        for other in (core[:3] + "0" + core[4:-3] + "1" + core[-2:], core[:5] + core[6 : n // 2] + core[n // 2 + 1 :], "00" + core, core[:9] + core[11:]):
            want.add((str(n), *sorted((core, other))))
    rows = [(space, "firm", core) for space, *pair in want for core in pair] + [("26", "firm", "z" * 26)]
    got = {(r.namespace, r.a, r.b) for r in names.near_cores(spark.createDataFrame(rows, "namespace string, kind string, core string")).collect()}
    assert want <= got
    assert not any(a != b and "z" * 26 in (a, b) for _, a, b in got)
