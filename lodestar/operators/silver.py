"""Structured blocks: sections, grounding, gates, claims, and chunks.

Ordered folds run inside one row, over the array of a document's blocks, so a
document is one row and nothing is collected across documents.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lodestar.functions.text import approx_tokens, content_flags, contains_ws, fold, norm_ws, tail_words

#: Characters of a unit, tokens of a chunk (aim, overlap, least, most), characters and number of match chunks, share of failed pages that is an alert.
UNIT_CHARS, TARGET, OVERLAP, LEAST, MOST, MATCH_CHARS, MATCH_CHUNKS, DEGRADED = 3500, 800, 150, 80, 1500, 1200, 60, 0.2
DROPPED_KINDS = ("boilerplate", "signature")


def pack(texts: Column, size: Callable[[Column], Column], most: int, join: str, extra: int, per_join: int) -> Column:
    """Neighbouring texts packed greedily into units: a unit ends when the next text would pass most.

    extra counts once against the limit for a joint, per_join adds to a unit's
    size for each text in it.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("some"))

    def step(state: Column, text: Column) -> Column:
        n = size(text).cast("long")
        over = state["some"] & (state["n"] + n + extra > most)
        return F.struct(
            F.when(over, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"]).alias("done"),
            F.when(over | ~state["some"], text).otherwise(F.concat(state["now"], F.lit(join), text)).alias("now"),
            F.when(over | ~state["some"], n + per_join).otherwise(state["n"] + n + per_join).alias("n"),
            F.lit(True).alias("some"),
        )

    return F.aggregate(texts, empty, step, lambda s: F.when(s["some"], F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def split_units(text: Column, most: int = UNIT_CHARS) -> Column:
    """A text as units of whole paragraphs, or lines if there are none, of so many characters."""
    parts = lambda by: F.filter(F.split(text, by), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    paragraphs = parts("\n\n")
    chosen = F.when(F.size(paragraphs) > 0, paragraphs).otherwise(F.when(F.size(parts("\n")) > 0, parts("\n")).otherwise(F.array(text)))
    return _units(chosen, most)


def _units(parts: Column, most: int) -> Column:
    """Parts joined by two line feeds, which count, while they fit."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    step = lambda s, p: F.struct(
        F.when((s["now"] != "") & (F.length(s["now"]) + F.length(p) + 2 > most), F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
        F.when((s["now"] == "") | (F.length(s["now"]) + F.length(p) + 2 > most), p).otherwise(F.concat(s["now"], F.lit("\n\n"), p)).alias("now"),
    )
    return F.aggregate(parts, empty, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]))


def split_oversize(text: Column, most: int = MOST) -> Column:
    """A text of too many tokens as packs of its paragraphs, or lines; one that has neither stays whole."""
    parts = lambda by: F.filter(F.split(text, by), lambda p: norm_ws(p) != "")
    chosen = F.when(F.size(parts("\n\n")) > 1, parts("\n\n")).otherwise(parts("\n"))
    return F.when((approx_tokens(text) <= most) | (F.size(chosen) <= 1), F.array(text)).otherwise(pack(chosen, approx_tokens, most, "\n\n", 0, 0))


def typed_blocks(items: Column) -> Column:
    """Blocks (kind, text, section_path) of items (kind, text) in reading order.

    A numbered heading stands below those whose number starts its own; one
    without a number is a new root.
    """
    entry = "array<struct<number:string,text:string>>"
    block = "array<struct<kind:string,text:string,section_path:array<string>>>"
    empty = F.struct(F.array().cast(entry).alias("path"), F.array().cast(block).alias("out"))

    def step(state: Column, item: Column) -> Column:
        text = F.trim(F.regexp_replace(item["text"], r"^\s+|\s+$", ""))
        number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)*)[).]", 1)
        above = F.filter(state["path"], lambda e: (e["number"] != "") & F.concat(number, F.lit(".")).startswith(F.concat(e["number"], F.lit("."))) & (e["number"] != number))
        mine = F.array(F.struct(number.alias("number"), text.alias("text")))
        path = F.when((item["kind"] == "heading") & (text != ""), F.when(number == "", mine).otherwise(F.concat(above, mine))).otherwise(state["path"])
        made = F.array(F.struct(item["kind"].alias("kind"), text.alias("text"), F.transform(path, lambda e: e["text"]).alias("section_path")))
        return F.struct(path.alias("path"), F.when(text != "", F.concat(state["out"], made)).otherwise(state["out"]).alias("out"))

    return F.aggregate(F.filter(items, lambda i: i["text"].isNotNull()), empty, step, lambda s: s["out"])


def numbered_items(text: Column) -> Column:
    """Items (kind, text) of a legal text: a line that starts with a number and a bracket is a heading."""
    parts = F.split(text, r"(?m)(?=^[ \t]*\d+(?:\.\d+)*\)[ \t]+\S)")
    numbered = lambda p: p.rlike(r"^[ \t]*\d+(?:\.\d+)*\)[ \t]+\S")
    item = lambda kind, t: F.struct(F.lit(kind).alias("kind"), t.alias("text"))
    made = F.transform(parts, lambda p: F.when(numbered(p), F.array(item("heading", F.regexp_extract(p, r"^([^\n]*)", 1)), item("paragraph", F.regexp_extract(p, r"(?s)^[^\n]*\n(.*)$", 1)))).otherwise(F.array(item("paragraph", p))))
    return F.filter(F.flatten(made), lambda i: norm_ws(i["text"]) != "")


def renumber(blocks: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Blocks with a running idx from 0."""
    return blocks.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def carry_sections(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with the last open section_path where a page starts without one."""
    before = Window.partitionBy(*keys).orderBy("page", "idx").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section_path", F.last(F.when(F.size("section_path") > 0, F.col("section_path")), ignorenulls=True).over(before))


def structure(pages: DataFrame, structurer: Callable[[str], list[dict]], schema: str = "doc string, page int, local_idx int, kind string, text string") -> DataFrame:
    """Pages (doc, page, text) as blocks by a function that may call a model; a page that fails has no blocks."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                try:
                    made = structurer(r.text)
                except Exception:  # one page's failure is that page's alone
                    made = []
                rows += [(r.doc, r.page, k, b["kind"], b["text"]) for k, b in enumerate(made)]
            yield pd.DataFrame(rows, columns=["doc", "page", "local_idx", "kind", "text"])

    return pages.select("doc", "page", "text").mapInPandas(run, schema)


def degraded(pages: DataFrame, keys: list[str], share: float = DEGRADED) -> DataFrame:
    """Documents whose failed pages (failed boolean) are a share of all or more."""
    told = pages.groupBy(*keys).agg(F.count("*").alias("pages"), F.count_if(F.col("failed")).alias("failed_pages"))
    return told.where(F.col("failed_pages") >= share * F.col("pages"))


def stale(wanted: DataFrame, built: DataFrame, keys: list[str], versions: list[str]) -> DataFrame:
    """Rows of wanted that aren't built with the same versions and hash."""
    return wanted.join(built.select(*keys, *versions), [*keys, *versions], "left_anti")


def index_mismatch(desired: DataFrame, indexed: DataFrame) -> DataFrame:
    """Subjects (subject, content_hash, n_chunks) whose index lacks chunks, has more, or is of another content."""
    have = indexed.groupBy("subject").agg(F.count("*").alias("have"), F.max("content_hash").alias("hash"))
    joined = desired.join(have, "subject", "left")
    return joined.where(~(F.col("content_hash").eqNullSafe(F.col("hash"))) | (F.coalesce("have", F.lit(0)) != F.col("n_chunks"))).select(*desired.columns)


def merge_claims(claims: DataFrame) -> DataFrame:
    """Claims (field, batch, state, value) of several batches as one of each field.

    Absent only if all are; stated values that agree stay (the first batch's),
    others are unknown; an unknown one outweighs inferred ones, which stay if
    they agree.
    """
    stated, inferred, unknown = (F.col("state") == s for s in ("stated", "inferred", "unknown"))
    g = claims.groupBy("field").agg(
        F.countDistinct(F.when(stated, F.col("value"))).alias("s"), F.countDistinct(F.when(inferred, F.col("value"))).alias("i"), F.count_if(unknown).alias("u"),
        F.min_by("value", F.when(stated, F.col("batch"))).alias("sv"), F.min_by("value", F.when(inferred, F.col("batch"))).alias("iv"))
    state = F.when(F.col("s") == 1, "stated").when(F.col("s") > 1, "unknown").when(F.col("u") > 0, "unknown").when(F.col("i") == 1, "inferred").when(F.col("i") > 1, "unknown").otherwise("absent")
    out = g.withColumn("state", state)
    return out.select("field", "state", F.when(F.col("state") == "stated", F.col("sv")).when(F.col("state") == "inferred", F.col("iv")).alias("value"))


def evidence_quotes(items: Column, quotes: Column) -> Column:
    """Trimmed distinct quotes if each item is in one of them, however spaced; else none."""
    compact = lambda c: F.regexp_replace(c, r"\s+", "")
    held = F.forall(items, lambda i: F.exists(quotes, lambda q: F.contains(compact(q), compact(i))))
    return F.when(held, F.array_distinct(F.filter(F.transform(quotes, lambda q: F.trim(q)), lambda q: q != ""))).otherwise(F.array().cast("array<string>"))


def title_only(quote: Column, section_paths: Column) -> Column:
    """Whether a quote is no more than a section's title."""
    return F.exists(F.flatten(section_paths), lambda t: F.trim(t) == F.trim(quote))


def grounded(material: Column, quote: Column) -> Column:
    return contains_ws(material, quote)


def evidence_contract(evidence: Column, confirmed: Column, missing: Column) -> Column:
    """Whether evidence is for just the confirmed codes and none of them is missing."""
    return (F.size(F.array_except(evidence, confirmed)) == 0) & (F.size(F.array_except(confirmed, evidence)) == 0) & ~F.arrays_overlap(confirmed, missing)


def coerce(value: Column, kind: str) -> tuple[Column, Column]:
    """A text value as its type's normal text, and a reason if it is none."""
    made = {"number": value.try_cast("double").cast("string"), "date": F.date_format(F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "dd/MM/yyyy")), "yyyy-MM-dd"), "integer": value.try_cast("long").cast("string"), "text": F.nullif(norm_ws(value), F.lit(""))}[kind]
    return made, F.when(made.isNull() & value.isNotNull(), F.lit(f"not_a_{kind}"))


def page_range(pages: Column) -> Column:
    """p.1 or p.1-3; null without pages."""
    low, high = F.array_min(pages), F.array_max(pages)
    return F.when(low == high, F.concat(F.lit("p."), low.cast("string"))).when(low.isNotNull(), F.concat(F.lit("p."), low.cast("string"), F.lit("-"), high.cast("string")))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _packed(opens: pd.Series, sizes: pd.Series) -> pd.Series:
    """For each element its group: a new one where it has to open one, or would take the group's size beyond TARGET."""

    def fold(opened, size):
        out, group, total = [], -1, 0
        for new, n in zip(opened, size):
            if new or total + n > TARGET:
                group, total = group + 1, 0
            total += n
            out.append(group)
        return out

    return pd.Series([fold(o, n) for o, n in zip(opens, sizes)])


def _counters(count: Callable[[str], int] | None) -> tuple[Callable[[Column], Column], Callable[[Column], Column], Callable[[Column], Column]]:
    """Expressions for the tokens of a text, its packs of bounded size, and its tail, by a counter or by the rule of 1.3 a word."""
    if count is None:
        return approx_tokens, split_oversize, lambda text: tail_words(text, OVERLAP)

    @F.pandas_udf(T.IntegerType())
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(count)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def packs(texts: pd.Series) -> pd.Series:
        def split(text):
            parts = [p for p in text.split("\n\n") if p.strip()]
            parts = parts if len(parts) > 1 else [p for p in text.split("\n") if p.strip()]
            if count(text) <= MOST or len(parts) <= 1:
                return [text]
            made, size = [], 0
            for part in parts:
                n = count(part)
                if made and size + n <= MOST:
                    made[-1].append(part)
                    size += n
                else:
                    made.append([part])
                    size = n
            return ["\n\n".join(m) for m in made]

        return texts.map(split)

    @F.pandas_udf(T.StringType())
    def tail(texts: pd.Series) -> pd.Series:
        def last(text):
            words, n = (text or "").split(), max(1, int(OVERLAP / 1.3))
            while n > 1 and count(" ".join(words[-n:])) > OVERLAP:
                n = max(1, n // 2)
            return " ".join(words[-n:])

        return texts.map(last)

    return tokens, packs, tail


def chunks(blocks: DataFrame, keys: list[str], count: Callable[[str], int] | None = None) -> DataFrame:
    """Chunks (keys, chunk_index, text, section, pages, source_file and flags) of blocks (keys, idx, doc, page, section_path, kind, text).

    Blocks join while document and section stay and TARGET tokens aren't
    passed; groups below LEAST join the one before of their section; each has
    the last words of the one before it in the document ahead of it. Tokens
    are counted by a function, such as a tokenizer's, or by the rule of 1.3 a
    word. Blocks are shuffled once, by keys.
    """
    tokens, packs, tail_of = _counters(count)
    usable = blocks.where(~F.coalesce(F.col("kind"), F.lit("")).isin(*DROPPED_KINDS)).repartition(*keys).where(norm_ws(F.col("text")) != "")
    pieces = usable.select(*keys, "idx", "doc", "page", F.nullif(F.substring(F.array_join("section_path", " > "), 1, 200), F.lit("")).alias("section"), F.posexplode(packs(F.regexp_replace("text", r"^\s+|\s+$", ""))).alias("part", "piece"))
    sized = pieces.withColumn("n", tokens(F.col("piece")))
    ordered = sized.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "part", "doc", "section", "page", "piece", "n"))).alias("b"))
    before = lambda i: F.get("b", i - 1)
    opens = F.transform("b", lambda x, i: (i == 0) | ~before(i)["doc"].eqNullSafe(x["doc"]) | ~before(i)["section"].eqNullSafe(x["section"]))
    placed = ordered.withColumn("g", _packed(opens, F.transform("b", lambda x: x["n"]))).select(*keys, F.posexplode(F.arrays_zip("b", "g")).alias("place", "x"))
    body = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda p: p[text]), "\n\n").alias("body")
    groups = placed.select(*keys, "place", "x.g", "x.b.*").groupBy(*keys, "g").agg(F.first("doc").alias("doc"), F.first("section").alias("section"), F.min("page").alias("lo"), F.max("page").alias("hi"), body("place", "piece"))
    in_order = Window.partitionBy(*keys).orderBy("g")
    same = F.lag("doc").over(in_order).eqNullSafe(F.col("doc")) & F.lag("section").over(in_order).eqNullSafe(F.col("section")) & (F.row_number().over(in_order) > 1)
    counted = groups.withColumn("small", tokens(F.col("body")) < LEAST)
    numbered = counted.withColumn("joins", F.col("small") & same).withColumn("chunk_index", (F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(in_order) - 1).cast("int"))
    fused = numbered.groupBy(*keys, "chunk_index").agg(F.first("doc").alias("doc"), F.first("section").alias("section"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), body("g", "body"))
    place = Window.partitionBy(*keys).orderBy("chunk_index")
    told = fused.withColumn("before", F.when(F.lag("doc").over(place).eqNullSafe(F.col("doc")), F.lag("body").over(place)))
    full = told.withColumn("tail", tail_of(F.coalesce("before", F.lit("")))).withColumn("text", F.when(F.col("tail") != "", F.concat(F.lit("[…] "), F.col("tail"), F.lit("\n\n"), F.col("body"))).otherwise(F.col("body")))
    return full.select(*keys, "chunk_index", "text", "section", page_range(F.array("lo", "hi")).alias("page_range"), F.col("doc").alias("source_file"), *[c.alias(n) for n, c in content_flags(F.col("text")).items()])


def match_chunks(texts: Column) -> Column:
    """Texts, spaced evenly, packed to MATCH_CHARS characters, the first MATCH_CHUNKS packs: a limit of the matcher."""
    shaped = F.filter(F.transform(texts, norm_ws), lambda t: t != "")
    return F.slice(pack(shaped, F.length, MATCH_CHARS, "\n", 0, 1), 1, MATCH_CHUNKS)


def section_class(section_path: Column, kind: Column, eligibility: str, boilerplate: str, dropped: tuple[str, ...] = DROPPED_KINDS) -> Column:
    """boilerplate by kind, else eligibility, boilerplate or thematic by the titles of a path."""
    hits = lambda pattern: F.exists(F.coalesce(section_path, F.array().cast("array<string>")), lambda s: fold(s).rlike(pattern))
    return F.when(kind.isin(*dropped), "boilerplate").when(hits(eligibility), "eligibility").when(hits(boilerplate), "boilerplate").otherwise("thematic")


def multiset_changes(desired: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to add and to drop, repeated rows counted; rows that a model made up (origin hyde) don't count."""
    now = current.where("origin <> 'hyde'").select(*desired.columns)
    return desired.exceptAll(now), now.exceptAll(desired)


def wants_made_up(n_documents: Column, n_chars: Column) -> Column:
    """Whether a profile says so little that a made-up document should stand in."""
    return (n_documents == 0) & (n_chars < 280)
