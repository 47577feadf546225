"""Stems against literal pairs; the index and its two rankings against plain versions."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar import session
from lodestar.functions.stems import stem
from lodestar.functions.text import STOPWORDS
from lodestar.operators import retrieval as R, text_index as T

#: Words with their stems, as the public description of the rules lists them.
PAIRS = """
boa boa boainain boainain boas boas bôas bôas boassu boassu boataria boat boate boat boates boat boatos boat bob bob boba bob bobagem bobag bobagens bobagens
bobalhões bobalhõ bobear bob bobeira bobeir bobinho bobinh bobinhos bobinh bobo bob bobs bobs boca boc bocadas boc bocadinho bocadinh bocado boc bocaiúva bocaiúv
boçal boçal bocarra bocarr bocas boc bode bod bodoque bodoqu body body boeing boeing boem boem boemia boem boêmio boêmi boêmios boêmi bogotá bogot boi boi bóia bói boiando boi
quiabo quiab quicaram quic quickly quickly quieto quiet quietos quiet quilate quilat quilates quilat quilinhos quilinh quilo quil quilombo quilomb quilométricas quilométr
quilométricos quilométr quilômetro quilômetr quilômetros quilômetr quilos quil quimica quimic quimicas quimic quimico quimic quimicos quimic quimioterapia quimioterap
quimioterápicos quimioteráp quimono quimon quincas quinc quinhão quinhã quinhentos quinhent quinn quinn quino quin quinta quint quintal quintal quintana quintan
quintanilha quintanilh quintão quintã quintessência quintessent quintino quintin quinto quint quintos quint quintuplicou quintuplic quinze quinz quinzena quinzen quiosque quiosqu
""".split()


def test_stems(spark):
    pairs = [(PAIRS[k], PAIRS[k + 1]) for k in range(0, len(PAIRS), 2)]
    made = spark.createDataFrame(pairs, "word string, want string").withColumn("got", stem(F.col("word")))
    assert [(r.word, r.want, r.got) for r in made.where("got is null or got <> want").collect()] == []
    rows = spark.createDataFrame([("",), (None,), ("a",), ("é",), ("ção",), ("felizmente",), ("rapidamente",), ("criativamente",), ("nacionalidade",), ("sociologia",), ("solução",), ("segue",)], "word string")
    got = [r[0] for r in rows.select(stem(F.col("word"))).collect()]
    assert got[:2] == ["", None] and got[5:] == ["feliz", "rapid", "criativ", "nacional", "sociolog", "soluçã", "seg"]


DOCS = [
    (1, "O projeto aprovado prevê subvenção para projetos de inovação; a subvenção econômica."),
    (2, "Financiamento de projetos. Financiamentos reembolsáveis e financiadores!"),
    (3, None),
    (4, ""),
    (5, "inovações inovação inovador projeto"),
    (6, "Texto sem nada em comum com a pergunta."),
    (7, "projeto " * 300),
    (8, "projeto e mais projetos"),
]


def words_of(text):
    return [(k, w) for k, w in enumerate(re.findall("[a-záéíóúâêîôûãõç]+", (text or "").lower()), 1) if len(w) >= 3 and w not in STOPWORDS]


@pytest.fixture(scope="module")
def indexed(spark):
    docs = spark.createDataFrame([(*d, 9) for d in DOCS], "id long, text string, tf int").repartition(3)
    return docs, T.build(docs)


def test_postings(spark, indexed):
    want = {}
    for key, text in DOCS:
        places = defaultdict(list)
        for k, w in words_of(text):
            places[w].append(k)
        want |= {(key, w): p for w, p in places.items()}
    assert {(r.id, r.word): list(r.positions) for r in indexed[1].postings.collect()} == want


@pytest.mark.parametrize("asked", ["subvenção para projeto de inovação", "projetos", "Financiamento e inovação, inovação?", "zebra", "", None])
def test_rankings(spark, indexed, asked):
    docs, index = indexed
    query = spark.createDataFrame([(asked,)], "text string")
    stems = dict(spark.createDataFrame(sorted({(w,) for _, t in [*DOCS, (0, asked)] for _, w in words_of(t)}), "word string").select("word", stem(F.col("word"))).collect())
    terms = {stems[w] for w in list(dict.fromkeys(w for _, w in words_of(asked)))[:8]}
    want = {}
    for key, text in DOCS:
        tf = Counter(stems[w] for _, w in words_of(text))
        rank = sum(0.1 * sum(1 / j**2 for j in range(1, min(tf[t], 255) + 1)) / 1.64493406685 for t in sorted(terms)) / max(1, len(terms))
        if rank > 0:
            want[key] = round(rank, 9)
    got = dict(map(tuple, T.full_text(index, query).collect()))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=2e-9) for k in want)
    assert sorted(map(tuple, T.bm25(index, query).collect())) == sorted(map(tuple, R.bm25(docs, query).collect()))


def test_second_query_reads_postings_only(spark, indexed):
    docs, index = indexed
    for ranked in (T.full_text, T.bm25):
        plan = ranked(index, spark.createDataFrame([("projeto",)], "text string"))._jdf.queryExecution().toString()
        assert "postings-" in plan and "stem IN" in plan.replace("`", "") or "IsNotNull(stem)" in plan
        assert "LocalTableScan [id" not in plan and "Scan ExistingRDD" not in plan.split("postings-")[0].split("== Physical")[-1]


def test_hot_word_and_empty_table(spark):
    hot = spark.range(3000).select("id", F.lit("projeto comum").alias("text"))
    index = T.build(hot, files=4)
    files = index.postings.where("word = 'projeto'").select(F.input_file_name()).distinct().count()
    assert files > 1 and T.full_text(index, spark.createDataFrame([("projeto",)], "text string")).count() == 3000
    empty = T.build(spark.createDataFrame([], "id long, text string"))
    query = spark.createDataFrame([("projeto",)], "text string")
    assert T.full_text(empty, query).count() == 0 == T.bm25(empty, query).count()
    with pytest.raises(ValueError):
        T.full_text(index, query.union(query))
    assert session.clear(spark) > 0


def test_repeated_ids(spark):
    rows = [*DOCS, (2, "projeto de financiamento"), (2, None), (None, "projeto sem número"), (None, "outro projeto")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    index = T.build(docs)
    want = defaultdict(list)
    lengths = Counter()
    for key, text in rows:
        for k, w in words_of(text):
            want[key, w].append(k)
            lengths[key] += 1
    got = {(r.id, r.word): (r.tf, list(r.positions), r.length) for r in index.postings.collect()}
    assert got == {(key, w): (len(p), sorted(p), lengths[key]) for (key, w), p in want.items()}
    assert index.documents == len({key for key, _ in rows})


def test_no_posting_is_shuffled(spark):
    docs = spark.range(2000).select("id", F.concat(F.lit("projeto comum "), F.col("id").cast("string")).alias("text"))
    packs = T._packed(docs)
    assert packs.count() <= 2 * packs.rdd.getNumPartitions() and packs.agg(F.sum("n")).first()[0] == 4000
    assert "Exchange" not in packs._jdf.queryExecution().executedPlan().toString()
