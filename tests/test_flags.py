"""Flags of texts are those of the SQL, next to letters and spaces beyond ASCII too."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar import plans
from lodestar.functions.text import CONTENT_FLAGS, QUERY_FLAGS, portable
from lodestar.registry import REGISTRY
from tests.oracle import assert_same, connect

plans.load()

TEXTS = [
    None, "", "ñnota", "ónota final", "notañ", "NOTA", "é01/02/2024", "01/02/2024ª", "x01/02/2024", "R$\x0b5", "r$ 5", "|\x0b---|", "| --- |", "ñicts", "ícnpj", "CNPJ", "crıtério", "CRITÉRIO", "CRİTERIO", "peſo", "PEſO",
    "ópesoó", "peso", "milhões", "milhõeſ", "milhõeſx", "recursoſ", "MILHÕES", "ámilhõesá", "bilhoes", "ELEGÍV", "ñelegív", "_nota", "nota_", "クlassifica", "classificação", "K",
]


def test_content_flags_next_to_other_letters(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(REGISTRY.queries["content_flags"](spark, str(tmp_path)), REGISTRY.oracles["content_flags"], str(tmp_path))


def test_chunks_next_to_other_letters(spark, tmp_path):
    spark.createDataFrame([(k, "s", t) for k, t in enumerate(TEXTS) if t is not None], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(REGISTRY.queries["rag_chunks"](spark, str(tmp_path)), REGISTRY.oracles["rag_chunks"], str(tmp_path))


@pytest.mark.parametrize("seed", [1, 2])
def test_patterns_find_what_they_find_in_the_sql(spark, seed):
    draw = random.Random(seed)
    patterns = list((CONTENT_FLAGS | {f"q_{n}": p for n, p in QUERY_FLAGS.items()}).values())
    words = "nota peso critério criterio pontua classifica avalia julgament prazo data quando cronograma vigên encerr valor recursos recurso milhões milhoes milhos orcament financ ict cnpj elegív quem pode 01/02/2024 r$ 3,5 |---| | ---- |".split(" ")
    texts = ["".join(draw.choice([w, w.upper(), w.title(), draw.choice("ñó_1 \t\x0b ªıİſK")]) for w in draw.choices(words, k=8)) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r[0]: tuple(r[1:]) for r in frame.select("id", *[F.col("text").rlike(portable(p)).alias(f"f{k}") for k, p in enumerate(patterns)]).collect()}
    con = connect("/nowhere")
    for k, text in enumerate(texts):
        assert got[k] == con.execute("SELECT " + ", ".join("regexp_matches($1, ?)".replace("?", "'" + p.replace("(?iu)", "(?i)").replace("'", "''") + "'") for p in patterns), [text]).fetchone(), text
