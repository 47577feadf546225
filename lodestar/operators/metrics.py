"""Scores of rankings, extractions and classifications, and gates on them.

Rankings are rows (query, rank, id); what is relevant, rows (query, id).
Scores without a denominator are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.functions.text import contains_ws, word_tokens


#: Sizes of a run when a percentile is looked for, and bins of a range.
SPAN, BINS = 1024, 4096


def judged(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """The ranking with hit."""
    marks = relevant.select("query", "id").distinct().withColumn("_hit", F.lit(True))
    return ranking.join(marks, ["query", "id"], "left").select(*ranking.columns, F.coalesce("_hit", F.lit(False)).alias("hit"))


def rank_scores(marked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: precision over what is shown of the first k, recall, hit, reciprocal rank and NDCG of binary gains.

    relevant has the relevant rows (query, id), or how many they are (query, n_relevant).
    """
    wanted = relevant if "n_relevant" in relevant.columns else relevant.groupBy("query").agg(F.countDistinct("id").alias("n_relevant"))
    inside = F.col("rank") <= k
    gain = F.sum(F.when(inside & F.col("hit"), 1 / F.log2(F.col("rank") + 1)))
    g = marked.groupBy("query").agg(
        F.avg(F.when(inside, F.col("hit").cast("int"))).alias("precision"), F.count_if(inside & F.col("hit")).alias("found"), F.max(inside & F.col("hit")).alias("hit"),
        F.coalesce(1 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(gain, F.lit(0.0)).alias("dcg"))
    j = g.join(wanted, "query", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.coalesce("n_relevant", F.lit(0)), F.lit(k)).cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return j.select("query", "precision", F.try_divide(F.col("found"), F.col("n_relevant")).alias("recall"), "hit", "reciprocal_rank", F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal).alias("ndcg"))


def graded_ndcg(output: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """NDCG at k per query, with gains n - place (from 0) of the expected ranking (query, rank, id); three places."""
    n = expected.groupBy("query").agg(F.count("*").alias("n"))
    gains = expected.join(n, "query").select("query", "id", (F.col("n") - F.col("rank") + 1).alias("gain"), F.col("rank").alias("ideal_rank"))
    ideal = gains.where(F.col("ideal_rank") <= k).groupBy("query").agg(F.sum(F.col("gain") / F.log2(F.col("ideal_rank") + 1)).alias("ideal"))
    got = output.where(F.col("rank") <= k).join(gains, ["query", "id"]).groupBy("query").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"))
    return ideal.join(got, "query", "left").select("query", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 3).alias("ndcg"))


def top1(output: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether the first of both is the same."""
    first = lambda df, name: df.where("rank = 1").select("query", F.col("id").alias(name))
    return first(expected, "want").join(first(output, "got"), "query", "left").select("query", F.coalesce(F.col("want") == F.col("got"), F.lit(False)).alias("top1"))


def false_positives(ranking: DataFrame, irrelevant: DataFrame, k: int, floor: float) -> DataFrame:
    """Per query, shown rows (score at floor or above, the first k) that are confirmed as irrelevant."""
    shown = ranking.where((F.col("rank") <= k) & (F.col("score") >= floor))
    marks = irrelevant.select("query", "id").distinct()
    return ranking.select("query").distinct().join(shown.join(marks, ["query", "id"], "left_semi").groupBy("query").agg(F.count("*").alias("n")), "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("false_positives"))


def unjudged(ranking: DataFrame, judgements: DataFrame, k: int) -> DataFrame:
    """Per query, shown rows that no judgement is for."""
    shown = ranking.where(F.col("rank") <= k)
    return ranking.select("query").distinct().join(shown.join(judgements.select("query", "id").distinct(), ["query", "id"], "left_anti").groupBy("query").agg(F.count("*").alias("n")), "query", "left").select("query", F.coalesce("n", F.lit(0)).alias("unjudged"))


def gold_recall(retrieved: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query, share of the gold text's distinct words in the first k texts together, and in the best of them; four places."""
    words = F.array_distinct(word_tokens(F.col("text")))
    g = gold.select("query", words.alias("g"))
    one = retrieved.where(F.col("rank") <= k).select("query", words.alias("w")).join(g, "query").select("query", F.size(F.array_intersect("g", "w")).alias("n"), F.array_intersect("g", "w").alias("i"))
    told = one.groupBy("query").agg(F.max("n").alias("best"), F.size(F.array_distinct(F.flatten(F.collect_list("i")))).alias("all"))
    share = lambda c: F.round(F.try_divide(F.coalesce(F.col(c), F.lit(0)), F.nullif(F.size("g"), F.lit(0))), 4)
    return g.join(told, "query", "left").select("query", share("all").alias("recall"), share("best").alias("best_chunk_recall"))


def matches_expected(file: Column, section: Column, want_file: Column, want_section: Column) -> Column:
    """Whether a hit is where it is expected; no expected section means any."""
    return (file == want_file) & (want_section.isNull() | (section == want_section))


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Percentiles by linear interpolation, found by histograms; nulls and what is no finite number don't count, of none all are null.

    The range of values is cut in BINS, and a rank's bin in BINS again, until
    its values are all alike. A round reads the rows once for all ranks and
    brings BINS rows for each to the driver, at most.
    """
    v = F.col(column).cast("double")
    held = rows.select(v.alias("v")).where(F.abs(v) < float("inf"))
    n, low, high = held.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    places = {s: s * (n - 1) for s in shares}
    found: dict[int, float] = {}
    # Ranks that are looked for, with the range of their bin and how many values lie before it.
    asked = {k: (low, high, 0) for s in places.values() for k in (math.floor(s), math.ceil(s))}
    while asked:
        for rank in [k for k, (low, high, _) in asked.items() if low == high]:
            found[rank] = asked.pop(rank)[0]
        spans = sorted({(low, high) for low, high, _ in asked.values()})
        if not spans:
            break
        one = lambda low, high: F.least(F.lit(BINS - 1), F.coalesce(F.floor(F.try_divide(F.col("v") / 2 - low / 2, F.lit(high / 2 - low / 2)) * BINS), F.when(F.col("v") > low, BINS - 1).otherwise(0))).cast("int")
        cells = F.array_compact(F.array(*[F.when(F.col("v").between(low, high), F.struct(F.lit(k).alias("span"), one(low, high).alias("bin"))) for k, (low, high) in enumerate(spans)]))
        told = held.select("v", F.explode(cells).alias("c")).groupBy("c.span", "c.bin").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        by_span: dict[int, list] = {}
        for row in sorted(told, key=lambda r: (r["span"], r["bin"])):
            by_span.setdefault(row["span"], []).append(row)
        for rank, (low, high, before) in list(asked.items()):
            for row in by_span[spans.index((low, high))]:
                if before + row["n"] > rank:
                    asked[rank] = (row["low"], row["high"], before)
                    break
                before += row["n"]
    return [found[math.floor(k)] + (found[math.ceil(k)] - found[math.floor(k)]) * (k - math.floor(k)) for k in places.values()]


def latencies(rows: DataFrame, column: str) -> DataFrame:
    """Mean, median and 95th percentile by linear interpolation."""
    p50, p95 = percentiles(rows, column, [0.5, 0.95])
    return rows.agg(F.avg(column).alias("mean")).select("mean", F.lit(p50).cast("double").alias("p50"), F.lit(p95).cast("double").alias("p95"))


def size_distribution(rows: DataFrame, column: str, oversize: int, orphan: int) -> DataFrame:
    """Sizes: count, median, 95th percentile by nearest rank, most, shares above and below."""
    # Distinct sizes with their counts, not the rows, are gathered.
    counted = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    total = counted.agg(F.sum("c").alias("n"), F.max("v").alias("max"), F.sum(F.when(F.col("v") > oversize, F.col("c")).otherwise(0)).alias("o"), F.sum(F.when(F.col("v") < orphan, F.col("c")).otherwise(0)).alias("u"))
    # The rank is looked for among runs of SPAN sizes first and then within one run, so no task orders all sizes.
    runs = counted.groupBy(F.floor(F.col("v") / SPAN).alias("run")).agg(F.sum("c").alias("c"))
    at = F.bround(F.lit(0.95) * (F.col("n") - 1)) + 1
    upto = runs.select("run", "c", F.sum("c").over(Window.orderBy("run")).alias("upto")).join(F.broadcast(total)).where(F.col("upto") >= at)
    first = upto.agg(F.min(F.struct("run", (F.col("upto") - F.col("c")).alias("before"), at.alias("at"))).alias("x")).select("x.*")
    inside = counted.withColumn("run", F.floor(F.col("v") / SPAN)).join(F.broadcast(first), "run")
    ranked = inside.select("v", "at", (F.col("before") + F.sum("c").over(Window.partitionBy("run").orderBy("v"))).alias("upto"))
    p95 = ranked.where(F.col("upto") >= F.col("at")).agg(F.min("v").alias("p95"))
    median = F.lit(percentiles(rows, column, [0.5])[0]).cast("double").alias("median")
    return total.select("*", median).join(F.broadcast(p95)).select("n", "median", "p95", "max", F.round(F.col("o") / F.col("n"), 6).alias("oversize"), F.round(F.col("u") / F.col("n"), 6).alias("orphan"))


def section_coverage(chunks: DataFrame) -> DataFrame:
    """Share of chunks with a section, and distinct sections."""
    has = F.trim(F.coalesce("section", F.lit(""))) != ""
    return chunks.agg(F.round(F.avg(has.cast("int")), 6).alias("covered"), F.countDistinct(F.when(has, F.col("section"))).alias("sections"))


def boundary_alignment(text: Column, header: str) -> tuple[Column, Column]:
    """Headers of a text that start it or follow a blank line, and all headers."""
    return F.regexp_count(text, F.lit(rf"(?:\A|\n[ \t]*\n)(?={header})")), F.regexp_count(text, F.lit(rf"(?m)^(?={header})"))


def multiset_recall(output: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Share of expected values (keys, value), counted, that the output has."""
    count = lambda df, n: df.groupBy(*keys, "value").agg(F.count("*").alias(n))
    j = count(expected, "want").join(count(output, "got"), [*keys, "value"], "left")
    return j.groupBy(*keys).agg(F.round(F.sum(F.least("want", F.coalesce("got", F.lit(0)))) / F.sum("want"), 6).alias("recall"))


def prefix_recall(output: DataFrame, expected: DataFrame, key: str, length: int = 30) -> DataFrame:
    """Share of expected headings whose start is in one of the output's."""
    # Headings that repeat are compared once.
    e = expected.groupBy(key, F.lower(F.substring("text", 1, length)).alias("want")).agg(F.count("*").alias("n"))
    o = output.select(key, F.lower("text").alias("have")).distinct()
    hits = e.join(o, key, "left").groupBy(key, "want", "n").agg(F.max(F.coalesce(F.contains("have", "want"), F.lit(False))).alias("hit"))
    return hits.groupBy(key).agg((F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))


def presence(rows: DataFrame) -> DataFrame:
    """Per field: share of cases where both or neither have a value, and of right ones where both have."""
    a, b = F.col("got").isNotNull(), F.col("want").isNotNull()
    return rows.groupBy("field").agg(F.round(F.avg((a == b).cast("int")), 6).alias("presence"), F.round(F.avg(F.when(a & b, (F.col("got") == F.col("want")).cast("int"))), 6).alias("value"))


def faithful(evidence: Column, raw: Column) -> Column:
    """Whether evidence is in the raw text, however spaced, and in any case of letters."""
    return contains_ws(F.lower(raw), F.lower(evidence))


def decisions(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Per kind of rows (case, want, got; got null for an error): cases, correct, divergent, errors, rates, and in-scope recalls."""
    error, right = F.col("got").isNull(), F.col("got") == F.col("want")
    in_scope = F.col("want") == "in_scope"
    g = rows.groupBy(kind).agg(
        F.count("*").alias("cases"), F.count_if(right).alias("correct"), F.count_if(~error & ~right).alias("divergent"), F.count_if(error).alias("errors"),
        F.count_if(in_scope & right).alias("tp"), F.count_if(in_scope & ~error).alias("semantic"), F.count_if(in_scope).alias("in_scope"), F.count_if(~in_scope & (F.col("got") == "in_scope")).alias("fp"), F.count_if(F.col("got") == "needs_review").alias("review"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.nullif(b, F.lit(0))), 4)
    answered = F.col("cases") - F.col("errors")
    return g.select(kind, "cases", "correct", "divergent", "errors", rate("correct", answered).alias("agreement"), rate("tp", F.col("semantic")).alias("semantic_recall"), rate("tp", F.col("in_scope")).alias("end_to_end_recall"), rate("tp", F.col("tp") + F.col("fp")).alias("precision"), rate("review", answered).alias("review_rate"))


def code_scores(rows: DataFrame) -> DataFrame:
    """Per code of rows (case, want array, got array; got null for an error): TP, FP, FN, missed by errors, precision, recalls."""
    want = rows.select("case", F.explode("want").alias("code"), F.col("got").isNull().alias("error"), F.lit(1).alias("w"))
    got = rows.where("got IS NOT NULL").select("case", F.explode("got").alias("code"), F.lit(1).alias("g"))
    j = want.join(got, ["case", "code"], "full")
    both = F.col("w").isNotNull() & F.col("g").isNotNull()
    g = j.groupBy("code").agg(F.count_if(both).alias("tp"), F.count_if(F.col("w").isNull()).alias("fp"), F.count_if(F.col("w").isNotNull() & F.col("g").isNull() & ~F.coalesce("error", F.lit(False))).alias("fn"), F.count_if(F.col("w").isNotNull() & F.coalesce("error", F.lit(False))).alias("missed"))
    rate = lambda d: F.round(F.try_divide(F.col("tp"), F.nullif(d, F.lit(0))), 4)
    return g.select("code", "tp", "fp", "fn", "missed", rate(F.col("tp") + F.col("fp")).alias("precision"), rate(F.col("tp") + F.col("fn")).alias("semantic_recall"), rate(F.col("tp") + F.col("fn") + F.col("missed")).alias("end_to_end_recall"))


def audit(rows: DataFrame) -> DataFrame:
    """Cases by bucket, to be looked at: (bucket, case)."""
    bucket = F.when(F.col("got").isNull(), "error").when(F.col("got") == F.col("want"), "correct").otherwise("divergent")
    return rows.select(bucket.alias("bucket"), "case")


def means(scores: DataFrame) -> DataFrame:
    """Mean of each score (name, value), four places, half to even; true is 1."""
    return scores.groupBy("name").agg(F.bround(F.avg(F.col("value").cast("double")), 4).alias("mean"))


def gate(value: Column, op: str, threshold: float) -> Column:
    """Whether a mean passes; null if it wasn't observed."""
    return {"gte": value >= threshold, "lte": value <= threshold, "eq": value == threshold}[op]


def opportunity_guard(want: Column, got: Column) -> Column:
    """0 only where a true opportunity is lost."""
    return F.when((want == "in_scope") & F.coalesce(got == "out_of_scope", F.lit(False)), 0).otherwise(1)


def made_up_headings(text: Column, allowed: Column, least: float = 0.3) -> Column:
    """Headings of a Markdown text that overlap no allowed one in trigrams."""
    from lodestar.functions.text import trigram_overlap

    headings = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(.+)$"), F.lit(1)), lambda h: F.lower(F.trim(h)))
    return F.size(F.filter(headings, lambda h: ~F.exists(allowed, lambda a: trigram_overlap(h, F.lower(a)) >= least)))


def contract_violations(cases: DataFrame) -> DataFrame:
    """Golden cases (case, kind, quote, source_quote) that are repeated, without a kind, or whose quote isn't in its source."""
    repeated = cases.groupBy("case").count().where("count > 1").select("case", F.lit("duplicate_id").alias("violation"))
    lacking = cases.where("kind IS NULL").select("case", F.lit("missing_kind").alias("violation"))
    ungrounded = cases.where(~contains_ws(F.col("source_quote"), F.col("quote"))).select("case", F.lit("ungrounded_quote").alias("violation"))
    return repeated.unionByName(lacking).unionByName(ungrounded)


def writing_runs(runs: DataFrame) -> DataFrame:
    """One row over cases (grounded, claims, errors, saved, coherent): grounded share of all claims, and means."""
    return runs.agg(F.round(F.try_divide(F.sum("grounded"), F.nullif(F.sum("claims"), F.lit(0))), 6).alias("grounding"), F.round(F.avg("errors"), 6).alias("errors"), F.round(F.avg(F.col("saved").cast("int")), 6).alias("save_rate"), F.round(F.avg(F.col("coherent").cast("int")), 6).alias("coherence"))
