"""The match funnel: validity, eligibility, late-interaction affinity, boosts and order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from lodestar.functions.vectors import dot, unit
from lodestar.session import against, cut_lineage, small
from lodestar.sources.versions import Conflict, VersionedTable

#: Least affinity, boost of a shared sector, excerpts shown, matches shown, weight of a similar neighbour.
FLOOR, SECTOR_BOOST, EXCERPTS, TOP, ALPHA = 0.52, 1.1, 3, 8, 0.05
#: Chunks of one profile up to which they are sent to all tasks; a profile has a few dozen.
PROFILE_CHUNKS = 2000
#: Chunks of a block on average; blocks of one profile up to which they are sent to all tasks.
BLOCK, PROFILE_BLOCKS = 1024, 32


def pair_scores(company: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (entity, company_chunk, entity_chunk, similarity) of one profile's chunks with all entity chunks.

    company: (company_chunk, vector, origin); entities: (entity, entity_chunk,
    vector). The profile's chunks are sent to all tasks if they are few, and
    are met block by block otherwise.
    """
    own = company.select("company_chunk", "origin", unit(F.col("vector")).alias("cv"))
    units = entities.select("entity", "entity_chunk", unit(F.col("vector")).alias("ev"))
    return against(units, own, PROFILE_CHUNKS).select("entity", "company_chunk", "origin", "entity_chunk", F.round(dot(F.col("cv"), F.col("ev")), 9).alias("similarity"))


def affinity(pairs: DataFrame) -> DataFrame:
    """Rows (entity, affinity, best): the mean over company chunks of their best similarity, and the best of all."""
    best = pairs.groupBy("entity", "company_chunk").agg(F.max("similarity").alias("s"))
    return best.groupBy("entity").agg(F.avg("s").alias("affinity"), F.max("s").alias("best"))


def excerpts(pairs: DataFrame, n: int = EXCERPTS) -> DataFrame:
    """The n best pairs of each entity, one for each entity chunk, without company chunks that a model made up."""
    shown = pairs.where("origin <> 'hyde'")
    one = Window.partitionBy("entity", "entity_chunk").orderBy(F.desc("similarity"), "company_chunk")
    best = Window.partitionBy("entity").orderBy(F.desc("similarity"), "entity_chunk")
    kept = shown.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    return kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n).select("entity", "entity_chunk", "company_chunk", "similarity", "place")


def _blocks(company: DataFrame, entities: DataFrame) -> DataFrame:
    """Blocks of entity chunks (whole, es) with all blocks of a profile's chunks (block, cs); whole: all chunks of its entities are in it."""
    parts = max(1, -(-company.count() // BLOCK))
    own = company.select(F.pmod(F.xxhash64("company_chunk"), F.lit(parts)).cast("int").alias("block"), F.struct("company_chunk", "origin", "vector").alias("c"))
    profile = cut_lineage(own.groupBy("block").agg(F.collect_list("c").alias("cs")))
    bins = max(1, -(-entities.count() // BLOCK))
    dealt = entities.select(F.pmod(F.xxhash64("entity"), F.lit(bins)).alias("bin"), F.struct("entity", "entity_chunk", "vector").alias("e"))
    sizes = dealt.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts"))
    cut = F.pmod(F.xxhash64("e.entity_chunk"), F.col("cuts"))
    packed = dealt.join(small(sizes), "bin").groupBy("bin", "cuts", cut.alias("cut")).agg(F.collect_list("e").alias("es")).select((F.col("cuts") == 1).alias("whole"), "es")
    return against(packed, profile, PROFILE_BLOCKS)


def _vectors(vectors: pa.Array) -> np.ndarray:
    """Vectors of length 1, zeros as they are; a row that isn't there is not a number."""
    known = [k for k, v in enumerate(vectors.is_valid().to_pylist()) if v]
    rows = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(known), -1 if known else 0)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    out = np.full((len(vectors), rows.shape[1]), np.nan)
    out[known] = rows / np.where(size > 0, size, 1.0)
    return out


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of each row of `_blocks`: whole, block, its chunks of entities and of the profile as Arrow tables, and their similarities, rounded to nine places."""
    for batch in batches:
        for k in range(batch.num_rows):
            es, cs = batch["es"].slice(k, 1).flatten(), batch["cs"].slice(k, 1).flatten()
            ev, cv = _vectors(es.field("vector")), _vectors(cs.field("vector"))
            wide = max(ev.shape[1], cv.shape[1])
            ev, cv = (v if v.shape[1] == wide else np.full((len(v), wide), np.nan) for v in (ev, cv))
            yield batch["whole"][k].as_py(), batch["block"][k].as_py(), es, cs, np.round(ev @ cv.T, 9) + 0.0


def _by_entity(es: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows by entity, where each entity starts in it, and a row of each."""
    code = es.field("entity").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
    return order, start, order[start]


def affinities(company: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows (entity, affinity, best), as `affinity` of `pair_scores` has them, without a row for each pair of chunks.

    Blocks of entity chunks meet blocks of the profile's. Where all chunks of
    an entity are in its block, what leaves a task is a row for the entity and
    the profile's block; else one for the entity and each chunk of the profile.
    """
    chunk = company.schema["company_chunk"].dataType
    schema = StructType([StructField("entity", entities.schema["entity"].dataType), StructField("block", IntegerType()), StructField("company_chunk", chunk), StructField("s", DoubleType()), StructField("n", LongType()), StructField("best", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names
        for whole, block, es, cs, similar in _met(batches):
            order, start, row = _by_entity(es)
            most = np.maximum.reduceat(np.where(np.isnan(similar), -np.inf, similar)[order], start, axis=0)
            known = most > -np.inf
            ids = es.field("entity").take(pa.array(row))
            value = lambda x: pa.array(x, pa.float64(), mask=~np.isfinite(x))
            chunks = cs.field("company_chunk")
            if whole:
                columns = [ids, pa.array(np.full(len(row), block), pa.int32()), pa.nulls(len(row), chunks.type), value(np.where(known, most, 0.0).sum(axis=1)), pa.array(known.sum(axis=1), pa.int64()), value(most.max(axis=1))]
            else:
                flat, wide = most.ravel(), most.shape[1]
                columns = [ids.take(pa.array(np.repeat(np.arange(len(row)), wide))), pa.array(np.full(len(flat), -1), pa.int32()), chunks.take(pa.array(np.tile(np.arange(wide), len(row)))), value(flat), pa.array(known.ravel().astype(np.int64)), value(flat)]
            yield pa.RecordBatch.from_arrays(columns, names)

    met = _blocks(company, entities).mapInArrow(run, schema)
    # Blocks that hold one entity in parts agree on the best of each of the profile's chunks.
    one = met.groupBy("entity", "block", "company_chunk").agg(F.max("s").alias("s"), F.max("n").alias("n"), F.max("best").alias("best"))
    return one.groupBy("entity").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("affinity"), F.max("best").alias("best"))


def best_excerpts(company: DataFrame, entities: DataFrame, n: int = EXCERPTS) -> DataFrame:
    """The rows of `excerpts` of `pair_scores`, without a row for each pair of chunks.

    Of an entity and a block of the profile only the n best chunks leave a
    task: of what a block leaves out, n others are better there, and so are
    they in the end.
    """
    shown = company.where("origin <> 'hyde'")
    kinds = entities.schema["entity"].dataType, entities.schema["entity_chunk"].dataType, company.schema["company_chunk"].dataType
    schema = StructType([StructField("entity", kinds[0]), StructField("entity_chunk", kinds[1]), StructField("company_chunk", kinds[2]), StructField("similarity", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, es, cs, similar in _met(batches):
            by = cs.field("company_chunk")
            place = pc.array_sort_indices(by, null_placement="at_start").to_numpy()
            similar = np.where(np.isnan(similar), -np.inf, similar)[:, place]
            best = similar.argmax(axis=1)  # the first, and so the least chunk of the profile
            value = similar[np.arange(len(best)), best]
            rank = np.argsort(pc.array_sort_indices(es.field("entity_chunk"), null_placement="at_start").to_numpy(), kind="stable")
            code = es.field("entity").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((rank, -value, code))
            chunk = es.field("entity_chunk").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = order[np.sort(np.unique((code * (len(code) + 1) + chunk)[order], return_index=True)[1])]  # a chunk counts once
            start = np.concatenate([[True], np.diff(code[order]) != 0])
            within = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
            kept = order[within < n]
            columns = [es.field("entity").take(pa.array(kept)), es.field("entity_chunk").take(pa.array(kept)), by.take(pa.array(place[best[kept]])), pa.array(value[kept], mask=~np.isfinite(value[kept]))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    pairs = _blocks(shown, entities).mapInArrow(run, schema)
    return excerpts(pairs.withColumn("origin", F.lit("profile")), n)


def funnel(entities: DataFrame, pairs: DataFrame, sectors: Column, floor: float = FLOOR, k: int = TOP) -> DataFrame:
    """The k best living, not excluded entities (entity, validity, status, sectors) by boosted affinity.

    The boost comes before the floor. Cheap stages filter before any score.
    """
    alive = _alive(entities)
    return _ranked(alive, affinity(pairs.join(alive.select("entity"), "entity", "left_semi")), sectors, floor, k)


def funnel_of(entities: DataFrame, company: DataFrame, chunks: DataFrame, sectors: Column, floor: float = FLOOR, k: int = TOP) -> DataFrame:
    """The rows of `funnel` for a profile's chunks and entity chunks; only entities that have chunks leave the entities' table."""
    alive = cut_lineage(_alive(entities).join(small(chunks.select("entity").distinct()), "entity", "left_semi"))
    told = chunks.join(small(alive.select("entity").distinct()), "entity", "left_semi")
    return _ranked(alive, affinities(company, told), sectors, floor, k)


def _alive(entities: DataFrame) -> DataFrame:
    return entities.where("validity = 'active'").where("status <> 'inelegivel'")


def _ranked(alive: DataFrame, scored: DataFrame, sectors: Column, floor: float, k: int) -> DataFrame:
    raised = F.when(F.arrays_overlap("sectors", sectors), F.least(F.col("affinity") * SECTOR_BOOST, F.lit(1.0))).otherwise(F.col("affinity"))
    return scored.join(alive, "entity").withColumn("score", F.round(raised, 9)).where(F.col("score") >= floor).orderBy(F.desc("score"), "entity").limit(k).select("entity", "score", "best", "status")


def structural_factors(edges: DataFrame, seeds: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Factors (entity, factor) of neighbours of seeds along similar_a edges (src, dst, type, weight), seeds left out."""
    similar = edges.where("type = 'similar_a'").select("src", "dst", "weight")
    both = similar.union(similar.select("dst", "src", "weight"))
    near = both.join(seeds.select(F.col("entity").alias("src")), "src", "left_semi").join(seeds.select(F.col("entity").alias("dst")), "dst", "left_anti")
    return near.groupBy(F.col("dst").alias("entity")).agg(F.max(1 + alpha * F.col("weight")).alias("factor"))


def reorder_by_verdict(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Matches (keys, place, verdict), those of each key with high ones first and low ones last, else in their order."""
    rank = F.when(F.col("verdict") == "alta", 0).when(F.col("verdict") == "baixa", 2).otherwise(1)
    return matches.withColumn("new_place", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "place")))


def verdict_hash(*inputs: Column) -> Column:
    """SHA-256 that a cached verdict is valid for."""
    return F.sha2(F.to_json(F.struct(*inputs)), 256)


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Hits, with what the cache has, and misses; all keys must agree."""
    return wanted.join(cache, keys), wanted.join(cache.select(*keys), keys, "left_anti")


def partners(centres: DataFrame, themes: Column, limit: int = 4) -> DataFrame:
    """Centres (id, name, themes) that share a theme, by id."""
    return centres.where(F.arrays_overlap("themes", themes)).orderBy("id").limit(limit)


def infer_sectors(text: Column, labels: list[str]) -> Column:
    """Labels that occur in a text, both without accents and in lower case."""
    from lodestar.functions.text import fold

    return F.array_compact(F.array(*[F.when(F.contains(fold(text), fold(F.lit(label))), F.lit(label)) for label in labels]))


def money_range(low: Column, high: Column) -> Column:
    """A range of money as text; null if nothing is known."""
    show = lambda c: F.concat(F.lit("R$ "), F.format_number(c, 0))
    return F.when(low.isNotNull() & high.isNotNull(), F.concat_ws(" – ", show(low), show(high))).when(high.isNotNull(), F.concat(F.lit("até "), show(high))).when(low.isNotNull(), F.concat(F.lit("a partir de "), show(low)))


def path_kind(kind: Column, text: Column) -> Column:
    """What sort of path an entity opens, by its kind and marks in its text; null if none is clear."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(kind == "ict", "parceria").when(kind == "programa", "programa").when(t.rlike("subven"), "subvencao").when(t.rlike("cr[eé]dito|financiamento"), "credito").when(t.rlike("bolsa"), "bolsa").when(t.rlike("desafio"), "desafio")


def path_status(kind: Column, has_project: Column, status: Column) -> Column:
    """possibilidade, candidatura_viavel or lacunas."""
    return F.when((kind == "ict") | ~has_project | status.isNull(), "possibilidade").when(status == "elegivel", "candidatura_viavel").otherwise("lacunas")


def has_project(*fields: Column) -> Column:
    """Whether any field of a project says something."""
    out = F.lit(False)
    for field in fields:
        out = out | (F.trim(F.coalesce(field, F.lit(""))) != "")
    return out


def no_matches(entities: DataFrame) -> DataFrame:
    """The investor track, which is switched off: no rows, whatever the input."""
    return entities.limit(0)


def freshness(entities: DataFrame, chunks: DataFrame, moment: str = "updated") -> DataFrame:
    """One row that changes when a snapshot is out of date."""
    return entities.agg(F.count("*").alias("n"), F.max(moment).alias("newest")).join(F.broadcast(chunks.agg(F.count("*").alias("n_chunks"))))


def snapshot(store: VersionedTable, probe: DataFrame, load: Callable[[], DataFrame]) -> DataFrame:
    """Prepared rows that are kept under a probe's value (its one row, as `freshness` gives): stored ones if it is the same, else loaded and stored anew.

    Readers of an older snapshot keep it. Of two that load at once one stores,
    and both read what it stored, if their probes agree.
    """
    value = probe.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).first()["value"]
    for _ in range(2):
        if store.manifest()["notes"].get("probe") == value:
            return store.read()
        try:
            store.overwrite(load(), probe=value)
        except Conflict:
            continue
    return store.read()
