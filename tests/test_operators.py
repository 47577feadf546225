"""Operators on small fixtures worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.functions import dates, ids, text
from lodestar.operators import catalog as C, coverage as V, eligibility as E, gold as O, graph as G, matching as M, metrics as X, retrieval as R, silver as S, validity as T
from lodestar.sources import bronze as B, web as W


@pytest.fixture(scope="module")
def one(spark):
    def value(*columns):
        row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return row[0] if len(columns) == 1 else tuple(row)

    return value


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def D(day):
    return dt.date.fromisoformat(day)


def test_dates_and_ids(one):
    assert one(dates.iso_to_br(F.lit("2024-05-06")), dates.iso_to_br(F.lit("06/05/2024")), dates.iso_to_br(F.lit("x"))) == ("06/05/2024", "06/05/2024", "")
    assert one(dates.parse_deadline(F.lit("31/12/2024")), dates.parse_deadline(F.lit("31/02/2024")), dates.parse_deadline(F.lit("a"))) == (D("2024-12-31"), None, None)
    url = F.lit("HTTPS://Www.A.org/Path/?utm_source=x&b=1#top")
    assert one(ids.normalize_web_url(url), ids.norm_url(url), ids.host_of(url)) == ("https://www.a.org/Path?b=1", "https://www.a.org/path/?utm_source=x&b=1", "www.a.org")
    assert one(ids.host_in(F.lit("https://m.facebook.com/x"), ids.SOCIAL_HOSTS), ids.host_in(F.lit("https://notfacebook.com"), ids.SOCIAL_HOSTS)) == (True, False)
    assert one(*ids.parse_id(F.lit("web:a:b"))) == ("web", "a:b") and one(ids.make_id(F.lit("web"), F.lit("1"))) == "web:1"
    assert one(ids.node_id(F.lit("ict"), F.lit("ict:1")), ids.node_id(F.lit("ict"), F.lit("1"))) == ("ict:1", "ict:1")
    assert one(ids.entity_key(F.lit("k"), F.lit("s"), F.lit("n"))) == "k|s|n"
    assert one(ids.valid_hostname(F.lit(" A.B-c.org ")), ids.valid_hostname(F.lit("bad host"))) == ("a.b-c.org", None)
    assert one(ids.record_hash(F.lit(""), F.lit(None).cast("string"))) != one(ids.record_hash(F.lit(None).cast("string"), F.lit("")))
    assert len(one(ids.content_hash(F.array(F.lit("a"))))) == 64


def test_text(one):
    assert one(text.slugify(F.lit(" Ação & Reação! "))) == "acao-reacao"
    assert one(text.or_query(F.lit("Qual o prazo do prazo da subvenção 2024?"))) == "prazo | subvenção"
    assert one(text.query_flags(F.lit("Quando encerra e qual o valor?"))) == ["has_date", "has_money"]
    assert one(text.tail_words(F.lit("a b c d e f"), 4)) == "d e f"
    assert one(text.trigram_overlap(F.lit("abcd"), F.lit("bcde"))) == 0.5
    assert one(text.contains_ws(F.lit("a  b\nc"), F.lit("b c")), text.contains_ws(F.lit("abc"), F.lit(" "))) == (True, False)
    assert one(text.singular(F.lit("projetos")), text.singular(F.lit("fiscais")), text.singular(F.lit("gás"))) == ("projeto", "fiscais", "gás")


def test_versions(spark):
    names = ["faq_versao_2_01_02_2024.pdf", "faq versão 3.pdf", "edital_01_02_2023.pdf", "2_rerratificacao_edital.pdf", "edital rerratificado.pdf", "anexo_2_x.pdf", "anexo final.pdf", "regulamento anexo.pdf", "nota.pdf"]
    got = {r.name: (r.family, r.recency, r.authority) for r in B.mark_versions(spark.createDataFrame([(1, n) for n in names], "group_key int, name string"), spark.createDataFrame([("edital_01_02_2023.pdf", "vigente")], "name string, authority string")).collect()}
    assert got["faq_versao_2_01_02_2024.pdf"] == ("__faq__", 2000 + 20240201, "vigente") and got["faq versão 3.pdf"] == ("__faq__", 3000, "superseded")
    assert got["2_rerratificacao_edital.pdf"] == ("__edital__", 200_000_000, "vigente") and got["edital rerratificado.pdf"] == ("__edital__", 50_000_000, "superseded")
    assert got["edital_01_02_2023.pdf"] == ("__edital__", 20230201, "vigente")  # by hand
    assert got["anexo_2_x.pdf"][0] == "__anexo_2__" and got["anexo final.pdf"][0] == "__anexo_geral__" and got["regulamento anexo.pdf"][0] == "__regulamento__"
    assert got["nota.pdf"] == (None, 0, "vigente")


def test_bronze(spark, tmp_path):
    records = spark.createDataFrame([(1, "u1", "t", "b"), (2, "u2", "t", "b")], "id int, url string, title string, body string")
    one = B.fingerprint(F.col("url"), F.col("title"), F.col("body"))
    path = str(tmp_path / "bronze")
    assert B.write_snapshot(records, one, path) and not B.write_snapshot(records.orderBy(F.desc("id")), one, path)
    assert B.write_snapshot(records.where("id = 1"), one, path)
    read = spark.read.schema("id int, url string, snapshot int").json(path + "/snapshot=*").count()
    assert read == 3
    B.save_blob(spark, str(tmp_path / "kv"), "index", '{"a":1}')
    B.save_blob(spark, str(tmp_path / "kv"), "icts", "{}")
    B.save_blob(spark, str(tmp_path / "kv"), "index", '{"a":2}')
    assert rows(B.load_blobs(spark, str(tmp_path / "kv")), "key", "blob") == [("icts", "{}"), ("index", '{"a":2}')]
    (tmp_path / "a.xml").write_text('<all><article id="1"><title>x</title></article><article id="2"><title>y</title></article></all>')
    assert rows(B.read_articles(spark, str(tmp_path / "a.xml")), "_id", "title") == [(1, "x"), (2, "y")]
    (tmp_path / "b.json").write_text('[{"a": 1},\n {"a": "x"}]')
    assert [r.a for r in B.read_json(spark, str(tmp_path / "b.json"), "a int").collect()] == [1, None]
    (tmp_path / "c.jsonl").write_text('{"idx": 0, "doc": "d", "section_path": ["a"], "kind": "heading", "text": "T"}\n')
    assert B.read_blocks(spark, str(tmp_path / "c.jsonl")).first().section_path == ["a"]
    (tmp_path / "m.json").write_text('{"source_hash": "h", "n_blocks": 3}')
    assert B.read_sidecars(spark, str(tmp_path / "m.json")).first().n_blocks == 3
    with pytest.raises(ValueError, match="none of"):
        B.dimension(spark, [("a", "bad")], "k string, mode string", "mode", {"good"})
    assert B.dimension(spark, [("a", "good")], "k string, mode string", "mode", {"good"}).count() == 1


def test_raw_records(spark):
    good, bad = B.require(spark.createDataFrame([("a", "u"), (" ", None)], "name string, url string"), ["name", "url"])
    assert good.count() == 1 and bad.first().lacking == ["name", "url"]
    articles = spark.createDataFrame([("Edital", "MCTI/X", "Chamada", "seleção de projetos"), ("Portaria", "MCTI", "Chamada", "seleção"), ("Edital", "Poder Judiciário", "Chamada", "seleção"), ("Edital", "MCTI", "Resultado final", "seleção"), ("Edital", None, "Aviso", "nada")], "type string, org string, title string, body string")
    assert B.gazette_candidates(articles, ["portaria"], ["Poder Judiciário"], "(?i)resultado", "(?i)seleção", ["MCTI"]).count() == 1
    feed = spark.createDataFrame([(D("2024-06-07"), 2, "u"), (D("2024-06-07"), 1, "u"), (D("2024-06-08"), 1, "v")], "day date, section_order int, url string")
    assert rows(B.daily_feed(feed), "section_order", "url") == [(1, "u")]
    links = spark.createDataFrame([(1, "Edital completo 2023", "u1"), (1, "Edital 2024", "u2"), (1, "Retificação 2024", "u3"), (1, "Edital resultado", "u4"), (1, "Aditivo 2023", "u5")], "page int, anchor string, url string")
    assert rows(B.normative_documents(links), "composition_order", "url") == [(0, "u1"), (1, "u5"), (2, "u3")]
    described = B.describe(spark.createDataFrame([("k", " ", "01/02/2024"), ("m", "T", "soon")], "key string, title string, deadline string"), spark.createDataFrame([("k", "heading", 1, "Second"), ("k", "heading", 0, "First")], "key string, kind string, idx int, text string"))
    assert rows(described) == [("k", "First", D("2024-02-01")), ("m", "T", None)]
    assert B.active_documents(spark.createDataFrame([("superseded",), (None,)], "authority string")).count() == 1
    got = spark.range(1).select(B.native_id(F.lit("html"), F.lit(1), F.lit("http://x/16466/"), F.lit("h")), B.native_id(F.lit("web"), F.lit(1), F.lit("u"), F.lit("h")), B.status_of(F.lit(" em analise ")), B.audience(F.array(F.struct(F.lit("A").alias("name")), F.struct(F.lit(" ").alias("name"))))).first()
    assert tuple(got) == ("16466", "h", "EM_ANALISE", "A")


def test_web(spark, one):
    hub = spark.createDataFrame([(1, "http://h.org/hub/", "<a href='/hub/a'>x</a><a href='/hub/a#z'>x</a><a href='/edital-1'>y</a><a href='/other'>z</a><a href='http://else.org/hub/b'>e</a><a href='/hub/known'>k</a><a href='/hub/c'>c</a>")], "page_id int, url string, html string")
    known = spark.createDataFrame([("http://h.org/hub/known",)], "norm string")
    assert rows(W.hub_children(W.links(hub), known, 2), "norm") == [("http://h.org/edital-1",), ("http://h.org/hub/a",)]
    fields = W.call_fields(F.lit("Modalidade: Auxílio\nÁreas: Saúde.\nPrazo para envio: 10/03/2025"))
    assert one(fields["mode"], fields["areas"], fields["deadline"], fields["continuous"], fields["status"]) == ("Auxílio", "Saúde", "2025-03-10", False, "ABERTA")
    assert one(W.title(F.lit("<meta property='og:title' content='Shared &amp; good'><title>x</title>"), F.lit("u")), W.title(F.lit(""), F.lit("http://h/a/last"))) == ("Shared & good", "last")
    staged = spark.createDataFrame([("a",)], "url_hash string")
    assert rows(W.stage(staged, spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "url_hash string, seq int"))) == [("b", 2)]
    assert W.page_records(hub).first().title == "hub"


def test_blocks(spark, one):
    items = S.numbered_items(F.lit("intro\n1) Objeto\ncorpo\n1.1) Fim\n2) Prazo\nb\nc"))
    blocks = one(S.typed_blocks(items))
    assert [(b.kind, b.text, b.section_path) for b in blocks] == [
        ("paragraph", "intro", []), ("heading", "1) Objeto", ["1) Objeto"]), ("paragraph", "corpo", ["1) Objeto"]), ("heading", "1.1) Fim", ["1) Objeto", "1.1) Fim"]), ("heading", "2) Prazo", ["2) Prazo"]), ("paragraph", "b\nc", ["2) Prazo"])]
    reset = one(S.typed_blocks(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("text")) for k, t in (("heading", "4. A"), ("heading", "ANEXO"), ("heading", "41. B"), ("heading", "4.1. C"))])))
    assert [b.section_path for b in reset] == [["4. A"], ["ANEXO"], ["41. B"], ["4.1. C"]]
    assert one(S.split_units(F.lit("a" * 5 + "\n\n" + "b" * 5 + "\n\n" + "c" * 5), 12)) == ["aaaaa\n\nbbbbb", "ccccc"]
    assert one(S.split_oversize(F.lit("one two three\nfour five six"), 4)) == ["one two three", "four five six"] and one(S.split_oversize(F.lit("a b c d e f g h"), 2)) == ["a b c d e f g h"]
    assert one(S.page_range(F.array(F.lit(3), F.lit(1))), S.page_range(F.array(F.lit(2)))) == ("p.1-3", "p.2")
    carried = S.carry_sections(spark.createDataFrame([("d", 1, 0, ["A"]), ("d", 2, 0, []), ("d", 2, 1, ["B"])], "doc string, page int, idx int, section_path array<string>"), ["doc"])
    assert [r.section_path for r in carried.orderBy("page", "idx").collect()] == [["A"], ["A"], ["B"]]
    assert [r.idx for r in S.renumber(carried, ["doc"], "page", "idx").orderBy("page", "idx").collect()] == [0, 1, 2]

    def structurer(page):
        if "bad" in page:
            raise ValueError(page)
        return [{"kind": "paragraph", "text": t} for t in page.split("|")]

    made = S.structure(spark.createDataFrame([("d", 1, "a|b"), ("d", 2, "bad")], "doc string, page int, text string"), structurer)
    assert rows(made, "page", "local_idx", "text") == [(1, 0, "a"), (1, 1, "b")]


def test_chunks(spark):
    word = lambda n, c: " ".join([c] * n)
    blocks = [(1, 0, "d1", 1, ["A"], "paragraph", word(400, "x")), (1, 1, "d1", 2, ["A"], "paragraph", word(400, "y")), (1, 2, "d1", 3, ["A"], "paragraph", "short tail"), (1, 3, "d1", 3, ["B"], "paragraph", "other section"), (1, 4, "d2", 1, ["B"], "paragraph", "other document"), (1, 5, "d2", 1, ["B"], "signature", "dropped"), (1, 6, "d2", 1, [], "paragraph", "R$ 5 até 01/02/2024")]
    got = S.chunks(spark.createDataFrame(blocks, "k int, idx int, doc string, page int, section_path array<string>, kind string, text string"), ["k"]).orderBy("chunk_index").collect()
    assert [(c.section, c.page_range, c.source_file) for c in got] == [("A", "p.1", "d1"), ("A", "p.2-3", "d1"), ("B", "p.3", "d1"), ("B", "p.1", "d2"), (None, "p.1", "d2")]
    assert got[1].text.startswith("[…] x") and got[1].text.endswith("short tail") and got[3].text == "other document"
    assert got[4].has_money and got[4].has_date and not got[0].has_money


def test_silver_gates(spark, one):
    claims = [("a", 1, "stated", "x"), ("a", 2, "stated", "x"), ("b", 1, "stated", "x"), ("b", 2, "stated", "y"), ("c", 1, "inferred", "x"), ("c", 2, "unknown", None), ("d", 2, "inferred", "z"), ("e", 1, "absent", None)]
    assert rows(S.merge_claims(spark.createDataFrame(claims, "field string, batch int, state string, value string"))) == [("a", "stated", "x"), ("b", "unknown", None), ("c", "unknown", None), ("d", "inferred", "z"), ("e", "absent", None)]
    A = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(S.evidence_quotes(A("ab c"), A(" the abc ", "the abc")), S.evidence_quotes(A("zz"), A("abc"))) == (["the abc"], [])
    assert one(S.title_only(F.lit(" T "), F.array(A("T"))), S.evidence_contract(A("x"), A("x"), A("y")), S.evidence_contract(A("x"), A("x", "z"), A())) == (True, True, False)
    assert one(*S.coerce(F.lit("03/04/2024"), "date"), *S.coerce(F.lit("abc"), "number")) == ("2024-04-03", None, None, "not_a_number")
    desired = spark.createDataFrame([("s", "h", 2), ("t", "h", 1), ("u", "h", 1)], "subject string, content_hash string, n_chunks long")
    indexed = spark.createDataFrame([("s", "h"), ("s", "h"), ("t", "old")], "subject string, content_hash string")
    assert rows(S.index_mismatch(desired, indexed), "subject") == [("t",), ("u",)]
    add, drop = S.multiset_changes(spark.createDataFrame([("a",), ("a",)], "text string"), spark.createDataFrame([("a", "profile"), ("b", "profile"), ("c", "hyde")], "text string, origin string"))
    assert rows(add) == [("a",)] and rows(drop) == [("b",)]
    assert one(S.wants_made_up(F.lit(0), F.lit(10)), S.wants_made_up(F.lit(1), F.lit(10))) == (True, False)
    constraint = lambda k, o, *v: F.struct(F.lit(k).alias("kind"), F.lit(o).alias("op"), A(*v).alias("values"))
    good, why = E.normalize_constraints(F.array(constraint("porte", "in", "Média"), constraint("trl", "gte", "4")))
    assert [c["values"] for c in one(good)] == [["media"], ["4"]] and one(why) is None
    bad, why = E.normalize_constraints(F.array(constraint("porte", "in", "me"), constraint("trl", "gte", "12")))
    assert one(bad, why) == (None, "invalid_constraint")


def test_gold(spark, one, monkeypatch):
    A = lambda *x: F.array(*map(F.lit, x))
    assert one(O.normalize_tags(A(" IA ", "Projetos", "TRL 5", "Lei nº 10", "inovação", "ia", "energia solar"), {"ia": "inteligência artificial"})) == ["inteligência artificial", "energia solar"]
    assert one(O.split_agencies(F.lit("MCTI / finep e FAPs"), {"finep": "FINEP"})) == ["MCTI", "FINEP", "FAPs"]
    assert one(O.mechanism_of(F.lit("Subvenção Econômica")), O.mechanism_of(F.lit("uma bolsa")), O.mechanism_of(F.lit("nada"))) == ("subvencao", "bolsa", None)
    assert one(O.state_of(F.lit("Rua X, São Paulo, SP")), O.state_of(F.lit("RJ - Rua AB")), O.state_of(F.lit("x"))) == ("SP", "RJ", None)
    assert one(O.format_of(F.lit("Pré-Aceleração"), {}), *O.ticket(F.lit("10"), F.lit("x"))) == ("pre_aceleracao", 10.0, None)
    assert one(O.canonical_themes(A("IA", " ia ", "Saúde"), {"ia": "inteligência artificial"})) == ["inteligência artificial", "saúde"]
    kids = O.replace_children(spark.createDataFrame([(1, "a"), (2, "b")], "p int, c string"), spark.createDataFrame([(1, "x"), (1, "y")], "p int, c string"), "p")
    assert rows(kids) == [(1, "x"), (1, "y"), (2, "b")]
    tokens = O.unique_tokens(spark.createDataFrame([(1, "Programa Centelha"), (2, "Programa Tecnova")], "id int, name string"), ["programa"])
    assert rows(O.detect_programme(spark.createDataFrame([("k", "Edital CENTELHA 2"), ("m", "Outro")], "key string, title string"), tokens), "key", "programme") == [("k", 1), ("m", None)]
    claims = [("s", "f", "v1", "d1", None, "opportunity", True), ("s", "f", "v2", "d2", "d1", "opportunity", True), ("t", "f", "v1", "d1", None, "program", True), ("t", "f", "v2", "d2", None, "program", True)]
    got = O.resolve_claims(spark.createDataFrame(claims, "subject string, field string, value string, document string, amends string, page_role string, official boolean"))
    assert rows(got) == [("s", "f", "stated", "v2"), ("t", "f", "conflicting", None)]
    quotes = spark.createDataFrame([("q1", "s", "alpha  beta"), ("q2", "s", "twice"), ("q3", "s", "spread"), ("q4", "s", "none"), ("q5", "s", "bare")], "quote_id string, subject string, quote string")
    blocks = spark.createDataFrame([("s", "d", 1, 0, "x alpha\nbeta"), ("s", "d", 1, 1, "twice"), ("s", "e", 1, 0, "twice"), ("s", "d", 2, 2, "spread"), ("s", "d", 3, 3, "spread"), ("s", "d", None, 4, "bare"), ("s", "d", None, 5, "bare too")], "subject string, doc string, page int, idx int, text string")
    assert rows(O.resolve_quotes(quotes, blocks), "quote_id", "quality", "page") == [("q1", "exact", 1), ("q2", "unresolved", None), ("q3", "document_only", None), ("q4", "unresolved", None), ("q5", "document_only", None)]
    more = quotes.union(spark.createDataFrame([("q6", "s", "one  two three four"), ("q7", "s", "wo x yz"), ("q8", "t", "one two three"), ("q9", "s", "one gone three"), ("q10", "s", " ")], quotes.schema))
    texts = [("s", "f", 1, 0, "says one two\nthree four"), ("s", "f", 1, 0, "says one two\nthree four"), ("s", "g", 2, 1, "two x yz"), ("s", "g", 2, None, "one two"), ("t", "g", None, 0, "one two three"), ("s", None, 1, 1, "and two three one")]
    few = rows(O.resolve_quotes(more, blocks.union(spark.createDataFrame(texts, blocks.schema))))
    monkeypatch.setattr(O, "QUOTES", 0)
    assert rows(O.resolve_quotes(more, blocks.union(spark.createDataFrame(texts, blocks.schema)))) == few and ("q6", "exact", "f", 1, 2) in few
    overlay = O.review_overlay(spark.createDataFrame([(1, "unknown", None), (2, "stated", "a"), (3, "stated", "b")], "claim_id int, state string, value string"), spark.createDataFrame([(1, "mark_unknown", None, 1), (1, "correct", "new", 2), (2, "mark_unknown", None, 1)], "claim_id int, decision string, corrected string, created int"))
    assert rows(overlay) == [(1, "stated", "new"), (2, "unknown", None), (3, "stated", "b")]
    states = F.array(F.struct(F.lit("a").alias("field"), F.lit("stated").alias("state")), F.struct(F.lit("b").alias("field"), F.lit("unknown").alias("state")))
    assert one(O.gaps(A("a", "c"), states)) == ["b", "c"]
    subjects = spark.createDataFrame([(1,), (2,)], "subject int")
    adaptive, legacy = spark.createDataFrame([(1, "n")], "subject int, value string"), spark.createDataFrame([(1, "o"), (2, "o")], "subject int, value string")
    assert rows(O.family_or_legacy(subjects, adaptive, legacy, True)) == [(1, "n"), (2, "o")] and rows(O.family_or_legacy(subjects, adaptive, legacy, False)) == [(1, "o"), (2, "o")]
    stored = spark.createDataFrame([(1, "a")], "id int, v string")
    assert rows(O.conflicts(stored, spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string"), ["id"], ["v"])) == [(1, "b")]
    assert rows(O.append_new(stored, spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "id int, v string"), ["id"])) == [(2, "c")]
    again = spark.createDataFrame([(1, "p", "x"), (1, "q", "y"), (2, "p", "x")], "id int, path string, value string")
    assert rows(O.backfill(again, spark.createDataFrame([(1, "p", "x"), (1, "q", "z"), (2, "p", "x")], "id int, path string, value string"), spark.createDataFrame([(2, "p")], "id int, path string"), ["id", "path"])) == [(1, "p", "x")]
    repacked = spark.createDataFrame([(1, "t", "d", 0), (1, "u", "d", 1), (1, "u", "d", 2)], "entity int, text string, doc string, idx int")
    assert rows(O.chunk_coordinates(spark.createDataFrame([(1, 0, "t"), (1, 1, "u")], "entity int, chunk int, text string"), repacked)) == [(1, 0, "d", 0)]
    assert O.sample_by_kind(again, ["path"], "id", 1).count() == 2
    facts = F.create_map(F.lit("public.a"), F.struct(F.lit(True).alias("citable")), F.lit("public.b"), F.struct(F.lit(False).alias("citable")), F.lit("x"), F.struct(F.lit(True).alias("citable")))
    assert list(one(O.public_provenance(facts, "^public"))) == ["public.a"]
    assert O.unchanged(spark.createDataFrame([(1, "h"), (2, "g")], "id int, source_hash string"), spark.createDataFrame([(1, "h"), (2, "h")], "id int, source_hash string"), ["id"]).count() == 1


def test_retrieval(spark, one):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank int")
    again = R.rerank(ranked, spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 1.0)], "id string, rescore double"), pool=2)
    assert rows(again, "rank", "id") == [(1, "b"), (2, "a"), (3, "c")] and R.rerank(ranked, None) is ranked
    assert one(R.section_family(F.lit("3 RERRATIFICAÇÃO > 4.3.2 Prazo")), R.section_family(F.lit("sem"))) == ("4", None)
    chunks = spark.createDataFrame([("a", "f", "4.1 x", 3), ("b", "f", "4.2 y", 1), ("c", "f", "5 z", 2), ("d", "g", "4 w", 0)], "id string, source_file string, section string, chunk_index int")
    selected = spark.createDataFrame([("a", 0.9, 1), ("d", 0.5, 2)], "id string, score double, rank int")
    assert [(r.id, r.score) for r in R.expand_sections(selected, chunks, 3).collect()] == [("b", 0.0), ("a", 0.9), ("d", 0.5)]
    assert one(R.lexical_score(F.lit("a b"), F.lit("b c"))) == 0.5
    themes = lambda *t: F.array(*map(F.lit, t))
    assert one(R.theme_match(F.lit(""), themes()), R.theme_match(F.lit("saúde"), themes("Multissetorial")), R.theme_match(F.lit("agro"), themes("Agronegócio")), R.theme_match(F.lit("energias renováveis"), themes("energia")), R.theme_match(F.lit("água"), themes("energia"))) == (True, True, True, True, False)
    few = spark.createDataFrame([("a", 0.9, None), ("b", 0.8, ""), ("c", 0.7, None), ("d", 0.6, "x")], "id string, score double, source_file string")
    assert [r.id for r in R.diversify(few, 9, 2).collect()] == ["a", "b", "d"] and R.diversify(few, 9, 0).count() == 4


def test_matching(spark, one):
    edges = spark.createDataFrame([("a", "b", "similar_a", 0.8), ("c", "a", "similar_a", 0.9), ("a", "d", "other", 1.0), ("b", "c", "similar_a", 1.0)], "src string, dst string, type string, weight double")
    got = M.structural_factors(edges, spark.createDataFrame([("a",), ("b",)], "entity string"))
    assert rows(got) == [("c", 1.05)]
    hits, misses = M.cached(spark.createDataFrame([(1, "h"), (2, "h")], "id int, input_hash string"), spark.createDataFrame([(1, "h", "alta"), (2, "old", "baixa")], "id int, input_hash string, verdict string"), ["id", "input_hash"])
    assert rows(hits) == [(1, "h", "alta")] and rows(misses) == [(2, "h")]
    assert one(M.path_status(F.lit("ict"), F.lit(True), F.lit("elegivel")), M.path_status(F.lit("edital"), F.lit(True), F.lit("elegivel")), M.path_status(F.lit("edital"), F.lit(True), F.lit("nao_verificada"))) == ("possibilidade", "candidatura_viavel", "lacunas")
    assert one(M.money_range(F.lit(1000.0), F.lit(None).cast("double")), M.money_range(F.lit(1.0), F.lit(2000.0))) == ("a partir de R$ 1,000", "R$ 1 – R$ 2,000")
    assert one(M.infer_sectors(F.lit("Uma empresa de saude"), ["Saúde", "Energia"]), M.has_project(F.lit(" "), F.lit(None).cast("string")), M.path_kind(F.lit("edital"), F.lit("Subvenção"))) == (["Saúde"], False, "subvencao")
    centres = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, ["a", "c"])], "id int, themes array<string>")
    assert rows(M.partners(centres, F.array(F.lit("a"))), "id") == [(1,), (3,)] and M.no_matches(centres).count() == 0
    assert tuple(M.freshness(centres.withColumn("updated", F.col("id")), centres).first()) == (3, 3, 3)


def test_profiles_of_many_chunks(spark, monkeypatch):
    company = spark.range(2001).select(F.col("id").alias("company_chunk"), F.array(F.col("id") + 1.0, F.lit(5.0)).alias("vector"), F.lit("p").alias("origin"))
    entities = spark.range(40).select((F.col("id") % 4).alias("entity"), F.col("id").alias("entity_chunk"), F.array(F.lit(3.0), F.col("id") * 1.0 + 1).alias("vector"))
    many = M.pair_scores(company, entities)
    assert many.count() == 2001 * 40
    got = sorted(map(str, M.affinity(many).select("entity", F.round("affinity", 7), "best").collect()))
    monkeypatch.setattr(M, "PROFILE_CHUNKS", 5000)
    assert got == sorted(map(str, M.affinity(M.pair_scores(company, entities)).select("entity", F.round("affinity", 7), "best").collect()))


def test_validity(spark):
    as_of = F.to_date(F.lit("2024-01-10"))
    exceptions = spark.createDataFrame([("x1", "s1", "deadline", "2024-02-01", "open"), ("x2", "s2", "deadline", "aberta", "resolved"), ("x3", "s3", "deadline", "2023-01-01", "open"), ("x4", "s4", "status", "aberta", "open"), ("x5", "s5", "deadline", "2024-02-01", "resolved")], "exception_id string, subject_id string, field_path string, produced string, status string")
    reviews = spark.createDataFrame([("x2", "confirm_continuous", None, 1, 1), ("x5", "correct", "2024-01-01", 1, 1)], "exception_id string, decision string, corrected string, reviewed int, seq int")
    assert rows(T.prevented(exceptions, reviews, as_of)) == [("x1", "s1"), ("x5", "s5")]
    days, passed = T.days_remaining(F.to_date(F.lit("2024-01-08")), as_of)
    assert tuple(spark.range(1).select(days, passed).first()) == (-2, True)


def test_graph(spark):
    entities = spark.createDataFrame([("e:1", "1", "Ação"), ("e:2", "2", "Outro")], "id string, native_id string, name string")
    refs = spark.createDataFrame([("e:1",), ("2",), ("acao",), ("none",)], "ref string")
    assert rows(G.resolve(refs, entities)) == [("2", "e:2"), ("acao", "e:1"), ("e:1", "e:1"), ("none", None)]
    edges = spark.createDataFrame([(1, 2, "t", 1.0), (2, 3, "t", 1.0), (3, 1, "t", 0.2), (5, 6, "t", 1.0)], "src long, dst long, type string, weight double")
    nodes, inside = G.picture(edges, spark.createDataFrame([(1,)], "node long"), 2, nodes=2)
    assert rows(nodes) == [(1, 0), (2, 1)] and rows(inside, "src", "dst") == [(1, 2)]
    star = spark.createDataFrame([(9, 1, "t", 1.0), (1, 4, "b", 1.0), (1, 3, "t", 1.0), (3, 9, "t", 1.0), (9, 3, "t", 2.0), (4, 7, "t", 1.0), (4, 6, "a", 1.0), (7, 8, "t", 1.0), (1, 5, "t", 0.1), (6, 7, "t", 1.0)], "src long, dst long, type string, weight double")
    met, used = G.discovered(star, 1, 2, 60, 0.5)
    assert rows(met, "place", "node", "distance") == [(0, 1, 0), (1, 4, 1), (2, 3, 1), (3, 9, 1), (4, 6, 2), (5, 7, 2)]
    assert rows(used, "src", "dst", "type") == [(1, 3, "t"), (1, 4, "b"), (3, 9, "t"), (4, 6, "a"), (4, 7, "t"), (9, 1, "t")]
    assert rows(G.discovered(star, 1, 2, 3, 0.5)[0], "node") == [(1,), (3,), (4,)] and rows(G.discovered(star, 99, 2)[0], "node") == [(99,)]
    steps = spark.createDataFrame([(1, 0, 2, 1), (1, 1, 1, 9)], "path_id int, step int, at long, to long")
    assert rows(G.enrich_paths(steps, edges), "step", "weight", "type") == [(0, 1.0, "t"), (1, 1.0, None)]
    paths = spark.createDataFrame([([1, 2], 1, 2), ([1, 2], 1, 2), ([1, 3], 1, 3)], "nodes array<long>, hops int, goal long")
    assert G.select_paths(paths, 5).count() == 2
    assert G.topology_kept(edges.limit(1), edges).count() == 0
    communities = {r.node: r.community for r in G.label_communities(edges).collect()}
    assert communities[5] == communities[6] != communities[1]
    constraint = lambda k, o, v: F.struct(F.lit(k).alias("kind"), F.lit(o).alias("op"), F.lit(v).alias("value"))
    low, high = G.readiness_range(F.array(constraint("trl", "gte", 3), constraint("trl", "in", 5), constraint("trl", "lte", 8), constraint("porte", "lte", 1)))
    assert tuple(spark.range(1).select(low, high).first()) == (5, 8)


def test_coverage_and_catalog(spark, one):
    bundles = spark.createDataFrame([("s", "h1", "official", True), ("s", "h2", "other", False), ("t", "h", None, None)], "subject string, bundle_hash string, role string, has_lineage boolean")
    assert rows(V.bundle_diagnostics(bundles)) == [("s", 2, 2, 0.5, 1), ("t", 1, 0, None, 0)]
    assert one(V.clean_metrics(F.create_map(F.lit("ok"), F.lit(1.0), F.lit("bad key"), F.lit(1.0), F.lit("neg"), F.lit(-1.0)))) == {"ok": 1.0}
    runs = spark.createDataFrame([("b", "k", 1, "running"), ("b", "m", 2, "failed")], "batch string, source_key string, run_id int, status string")
    assert rows(V.start_runs(runs, spark.createDataFrame([("b", "k"), ("b", "n")], "batch string, source_key string"))) == [("b", "n", "running")]
    assert rows(V.finish_runs(runs, spark.createDataFrame([(1, "succeeded"), (2, "succeeded")], "run_id int, final string")), "run_id", "status") == [(1, "succeeded"), (2, "failed")]
    stages = F.create_map(F.lit("a"), F.lit("done"), F.lit("b"), F.lit("failed"))
    assert one(V.overall_status(stages, "b"), V.overall_status(F.create_map(F.lit("b"), F.lit("done")), "b")) == ("failed", "completed")
    assert V.without_themes(spark.createDataFrame([(1, " "), (2, "x")], "id int, themes string"), 5).count() == 1
    assert rows(C.titles(spark.createDataFrame([(1, " T "), (2, " ")], "id int, title string"), spark.createDataFrame([(1,), (2,)], "id int"))) == [(1, "T")]
    insights = spark.createDataFrame([(1, 2, None, 1), (2, 1, None, 2), (3, 2, 5, 3)], "id int, level int, deactivated_at int, created int")
    assert [r.id for r in C.active_insights(insights).collect()] == [1, 2]
    assert C.new_generation(insights, spark.createDataFrame([(4, 2, None, 9)], insights.schema), F.lit(8)).where("deactivated_at IS NULL").count() == 2
    assert C.outcomes(spark.createDataFrame([(1, "won", 1), (2, "open", 2)], "id int, status string, updated int"), ("won", "lost"), 5).count() == 1
    check = C.checklist(spark.createDataFrame([(1, "# A\n" + "x" * 250 + "\n# B\nshort\n# C\n[todo]")], "proposal int, text string"), spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "section string"))
    assert rows(check, "section", "state", "score") == [("a", "adequate", 37), ("b", "shallow", 37), ("c", "empty", 37), ("d", "empty", 37)]
    assert rows(C.playbook(spark.createDataFrame([("s", 2, "b"), ("s", 1, "a")], "section string, layer int, text string"))) == [("s", "a\n\nb")]
    jobs = spark.createDataFrame([(1,), (7,)], "job_id long")
    assert rows(C.defer_jobs(jobs, spark.createDataFrame([("a",), ("b",)], "task string"), "task")) == [("a", 8), ("b", 9)]
    made = spark.createDataFrame([("t", "p", 5)], "task string, periodic string, at int")
    assert rows(C.defer_periodic(made, spark.createDataFrame([("t", "p", 5), ("t", "p", 6), ("t", "p", 6), ("u", "p", 1)], "task string, periodic string, at int")), "task", "at") == [("t", 6), ("u", 1)]
    assert one(*C.finish_job(F.lit("doing"), F.lit(1), F.lit("succeeded")), *C.finish_job(F.lit("failed"), F.lit(1), F.lit("succeeded"))) == ("succeeded", 2, "failed", 1)
    assert one(C.cancel_job(F.lit("todo"), F.lit(False)), C.cancel_job(F.lit("doing"), F.lit(True)), *C.retry_job(F.lit("failed"), F.lit(2))) == ("cancelled", "aborting", "todo", 3)
    sessions = spark.createDataFrame([("s", 3, "r1", "p")], "session string, version int, last_request string, last_payload string")
    turns = spark.createDataFrame([("s", "r1", 9, "p"), ("s", "r2", 3, "q"), ("s", "r3", 2, "q")], "session string, request string, version int, payload string")
    assert rows(C.save_turn(sessions, turns), "request", "outcome") == [("r1", "replayed"), ("r2", "saved"), ("r3", "conflict")]
    assert one(C.bump_if_changed(F.lit("a"), F.lit("a"), F.lit(1), F.lit(2)), C.bump_if_changed(F.lit("a"), F.lit("b"), F.lit(1), F.lit(2))) == (1, 2)
    when = dt.datetime(2024, 1, 10, 1, 0)
    workers = spark.createDataFrame([(1, when), (2, when - dt.timedelta(hours=1))], "worker_id int, last_heartbeat timestamp")
    assert C.live_workers(workers, F.lit(when), 60).count() == 1
    log = spark.createDataFrame([(1, "s", "c", 1)], "application int, session string, card string, updated int")
    apps = C.applications(log, spark.createDataFrame([("s", 1, 3)], "session string, filled int, outline int"), spark.createDataFrame([("c", "T", D("2024-01-12"))], "card string, title string, deadline date"), F.lit(when))
    assert rows(apps) == [(1, "T", 3, 33, 1)]  # the moment is the day before in local time
    report = C.job_report(spark.createDataFrame([(1, 1)], "job_id int, worker_id int"), spark.createDataFrame([(1, "started", 1), (1, "started", 3), (1, "failed", 4)], "job_id int, type string, at int"), workers)
    assert rows(report, "first_started", "last_started", "last_ended") == [(1, 3, 4)]


def test_metrics(spark, one):
    gold = spark.createDataFrame([("q", "a b c d"), ("r", "!")], "query string, text string")
    got = spark.createDataFrame([("q", 1, "a b"), ("q", 2, "b c"), ("q", 3, "d")], "query string, rank int, text string")
    assert rows(X.gold_recall(got, gold, 2)) == [("q", 0.75, 0.5), ("r", None, None)]
    assert rows(X.top1(got.withColumnRenamed("text", "id"), spark.createDataFrame([("q", 1, "a b"), ("z", 1, "x")], "query string, rank int, id string"))) == [("q", True), ("z", False)]
    assert one(X.matches_expected(F.lit("f"), F.lit("s"), F.lit("f"), F.lit(None).cast("string")), X.matches_expected(F.lit("f"), F.lit("s"), F.lit("f"), F.lit("t"))) == (True, False)
    assert one(*X.boundary_alignment(F.lit("1) a\ntext\n2) b\n\n3) c"), r"\d\)")) == (2, 3)
    values = lambda *v: spark.createDataFrame([(1, x) for x in v], "k int, value string")
    assert rows(X.multiset_recall(values("a", "a", "b"), values("a", "a", "a", "b"), ["k"])) == [(1, 0.75)]
    heads = lambda *v: spark.createDataFrame([(1, x) for x in v], "k int, text string")
    assert rows(X.prefix_recall(heads("The Objectives of it"), heads("objectives", "missing"), "k")) == [(1, 0.5)]
    fields = spark.createDataFrame([("f", "a", "a"), ("f", None, None), ("f", "a", "b"), ("f", None, "x")], "field string, got string, want string")
    assert rows(X.presence(fields)) == [("f", 0.75, 0.5)]
    assert one(X.gate(F.lit(0.7), "gte", 0.6), X.gate(F.lit(None).cast("double"), "gte", 0.6)) == (True, None)
    assert one(X.opportunity_guard(F.lit("in_scope"), F.lit("out_of_scope")), X.opportunity_guard(F.lit("in_scope"), F.lit(None).cast("string"))) == (0, 1)
    assert one(X.made_up_headings(F.lit("# Objetivos\nx\n## Inventado zyx"), F.array(F.lit("Objetivos gerais")))) == 1
    assert one(X.faithful(F.lit("a  B"), F.lit("x A b y"))) is True
    cases = spark.createDataFrame([(1, "k", "a", "a b"), (1, None, "z", "a b")], "case int, kind string, quote string, source_quote string")
    assert rows(X.contract_violations(cases)) == [(1, "duplicate_id"), (1, "missing_kind"), (1, "ungrounded_quote")]
    assert tuple(X.writing_runs(spark.createDataFrame([(1, 2, 0, True, True), (0, 0, 2, False, None)], "grounded int, claims int, errors int, saved boolean, coherent boolean")).first()) == (0.5, 1.0, 0.5, 1.0)
    assert X.audit(spark.createDataFrame([(1, "a", "a"), (2, "a", None)], "case int, want string, got string")).groupBy("bucket").count().count() == 2
    assert tuple(X.section_coverage(spark.createDataFrame([("a",), (" ",), ("a",), (None,)], "section string")).first()) == (0.5, 1)
