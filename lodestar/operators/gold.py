"""Gold rows: normal forms of tags, sectors and agencies, upserts, diffs and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestar.functions.text import fold, norm_ws, singular
from lodestar.session import cut_lineage, small

#: States, mechanisms, and the fallback of sectors with the most of an entity.
STATES = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()
FALLBACK_SECTOR, MOST_SECTORS = "Multissetorial", 3
#: Tags that measure maturity or cite a law, wherever they do, and tags that are no more than a word of every call.
METRIC_TAG = r"(?iuU)\b(trl|mrl|crl|irl)\b|technology readiness|n[íi]vel de maturidade tecnol[óo]g"
LEGAL_TAG = (
    r"(?iuU)\b(lgpd|lei geral de prote[çc][ãa]o de dados|marco civil)\b"
    r"|\b(lei(\s+complementar)?|decreto(-lei)?|portaria|medida provis[óo]ria|emenda constitucional)\b[\sºª°no.\-]*\d"
)
GENERIC_TAGS = (
    "programa programas tecnologia tecnologias consultoria inovacao projeto projetos pesquisa desenvolvimento p&d pd&i p&d&i pdi empresa empresas startup startups "
    "servico servicos produto produtos solucao solucoes sistema sistemas plataforma metodologia processo prototipagem prototipo prototipos benchmark ensaio teste testes "
    "calibracao validacao homologacao escala porte sustentabilidade viabilidade gestao governanca fomento incentivo subvencao financiamento credito investimento capital "
    "recurso recursos infraestrutura laboratorio laboratorios equipamento equipamentos ferramenta ferramentas dispositivo dispositivos instrumento instrumentos sensor sensores "
    "modulo unidade concepcao modelagem simulacao otimizacao caracterizacao parametrizacao padronizacao monitoramento mensuracao rastreamento rastreabilidade inspecao "
    "normatizacao certificacao afericao medicao quantificacao qualificacao mercado negocio negocios cliente clientes demanda demandas desafio desafios tendencia suporte "
    "assessoria apoio assistencia capacitacao treinamento formacao divulgacao comunicacao difusao transferencia absorcao adocao implantacao implementacao execucao realizacao "
    "coordenacao fase fases etapa etapas prazo cronograma vigencia qualidade eficiencia eficacia efetividade desempenho produtividade competitividade fundamento principio "
    "principios diretriz diretrizes norma normas regra regras criterio criterios premissa premissas"
).split()


#: Quotes up to which they are sent to all tasks.
QUOTES = 50_000


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.create_map().cast("map<string,string>")


def normalize_tag(raw: Column, synonyms: dict[str, str]) -> Column:
    """A tag in lower case, with its synonym, and in the singular if it is one word; null if it is too short."""
    t, known = F.lower(norm_ws(raw)), lookup(synonyms)
    one = singular(t)
    single = F.when(F.contains(t, F.lit(" ")), t).otherwise(F.coalesce(F.try_element_at(known, one), one))
    return F.when(F.length(t) >= 2, F.coalesce(F.try_element_at(known, t), single))


def is_no_class(tag: Column) -> Column:
    """Whether a tag is a metric, a law or a bare generic word."""
    return tag.rlike(METRIC_TAG) | tag.rlike(LEGAL_TAG) | fold(tag).isin(*GENERIC_TAGS)


def normalize_tags(raw: Column, synonyms: dict[str, str]) -> Column:
    """Tags in their normal form, without those that are no class, each once, in order."""
    return F.array_distinct(F.filter(F.transform(raw, lambda r: normalize_tag(r, synonyms)), lambda t: t.isNotNull() & ~is_no_class(t)))


def normalize_sectors(raw: Column, labels: list[str], aliases: dict[str, list[str]]) -> Column:
    """Up to three labels of a closed list; the fallback if none fits."""
    mapped = {k: "|".join(v) for k, v in aliases.items()} | {}
    table = lookup(mapped)
    own = F.create_map(*[x for label in labels for x in (fold(F.lit(label)), F.lit(label))])
    found = F.flatten(F.transform(raw, lambda r: F.split(F.coalesce(F.try_element_at(table, fold(r)), F.try_element_at(own, fold(r)), F.lit("")), r"\|")))
    kept = F.array_distinct(F.filter(found, lambda s: s.isin(*labels)))
    return F.when(F.size(kept) > 0, F.slice(kept, 1, MOST_SECTORS)).otherwise(F.array(F.lit(FALLBACK_SECTOR)))


def canonical_themes(raw: Column, synonyms: dict[str, str]) -> Column:
    """Themes in lower case with their synonyms, each once."""
    known = lookup(synonyms)
    return F.array_distinct(F.filter(F.transform(raw, lambda r: F.coalesce(F.try_element_at(known, F.lower(norm_ws(r))), F.lower(norm_ws(r)))), lambda t: t != ""))


def split_agencies(text: Column, canon: dict[str, str]) -> Column:
    """Agencies that a text joins by slash, semicolon or 'e', by their canonical names."""
    known = lookup(canon)
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[/;]|\s+e\s+"), norm_ws), lambda p: p != "")
    return F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, fold(p)), p))


def mechanism_of(text: Column) -> Column:
    """Mechanism that a text makes plain; null in doubt."""
    t = fold(text)
    grant = t.rlike("subvencao|nao reembolsavel|nao-reembolsavel")
    return F.when(grant, "subvencao").when(F.contains(t, F.lit("bolsa")), "bolsa").when(t.rlike("equity|participacao acionaria"), "equity")


def format_of(text: Column, canon: dict[str, str]) -> Column:
    """Format by a table, else its slug."""
    return F.when(norm_ws(text) != "", F.coalesce(F.try_element_at(lookup(canon), fold(text)), F.regexp_replace(fold(text), "-", "_")))


def state_of(address: Column) -> Column:
    """State at the end of an address, else the last two capitals that are one."""
    end = F.regexp_extract(F.trim(F.coalesce(address, F.lit(""))), r",\s*([A-Z]{2})\s*$", 1)
    some = F.filter(F.regexp_extract_all(F.coalesce(address, F.lit("")), F.lit(r"\b([A-Z]{2})\b"), F.lit(1)), lambda t: t.isin(*STATES))
    return F.when(end.isin(*STATES), end).otherwise(F.try_element_at(some, F.lit(-1)))


def call_status(raw: Column, deadline: Column, as_of: Column) -> Column:
    """aberta or encerrada by deadline, else by what the source says; null otherwise."""
    r = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    said = F.when(r.isin("ABERTA", "ABERTO"), "aberta").when(r.isin("ENCERRADA", "ENCERRADO", "FECHADA", "FECHADO"), "encerrada")
    return F.when(deadline.isNotNull(), F.when(deadline >= as_of, "aberta").otherwise("encerrada")).otherwise(said)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], keep_if_empty: list[str] = ()) -> DataFrame:
    """Stored rows with new ones in their place; columns of keep_if_empty keep what is stored where the new value is null or {}."""
    old = stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep_if_empty])
    joined = new.join(old, keys, "left") if keep_if_empty else new
    for c in keep_if_empty:
        joined = joined.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("{}")), F.col(f"_old_{c}"), F.col(c)))
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(joined.select(*stored.columns))


def insert_new(stored: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """New rows whose key isn't stored, each key once (the first by an order)."""
    once = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))).where("_n = 1").drop("_n")
    return once.join(stored.select(*keys), keys, "left_anti")


def replace_children(stored: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Stored child rows with all those of the new rows' parents replaced."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def unchanged(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key and hash (source_hash) are stored already."""
    return wanted.join(stored.select(*keys, "source_hash"), [*keys, "source_hash"], "left_semi")


def unique_tokens(programmes: DataFrame, stopwords: list[str]) -> DataFrame:
    """Tokens of six letters or more that name just one programme (id, name)."""
    tokens = programmes.select("id", F.explode(F.array_distinct(F.regexp_extract_all(fold(F.col("name")), F.lit("[a-z0-9]{6,}"), F.lit(0)))).alias("token"))
    return tokens.where(~F.col("token").isin(*stopwords) if stopwords else F.lit(True)).groupBy("token").agg(F.countDistinct("id").alias("n"), F.min("id").alias("id")).where("n = 1").select("token", "id")


def detect_programme(titles: DataFrame, tokens: DataFrame) -> DataFrame:
    """Titles (key, title) with the programme of their first telling token."""
    words = titles.select("key", F.posexplode(F.regexp_extract_all(fold(F.col("title")), F.lit("[a-z0-9]{6,}"), F.lit(0))).alias("place", "token"))
    first = words.join(tokens, "token").groupBy("key").agg(F.min_by("id", "place").alias("programme"))
    return titles.join(first, "key", "left")


def ticket(low: Column, high: Column) -> tuple[Column, Column]:
    """Least and most money, non-negative numbers or null."""
    number = lambda c: F.when(c.try_cast("double") >= 0, c.try_cast("double"))
    return number(low), number(high)


def _rare_hits(asked: DataFrame, blocks: DataFrame, words: Column) -> DataFrame:
    """Quotes (quote_id, subject, _q) beside the blocks (subject, doc, page, idx, _t) of their subject that have the quote's rarest word.

    Postings are kept of words that quotes have, and name a block by a digest.
    The word of a quote that the fewest blocks have is looked up, and a text is
    read again only for what comes of that.
    """
    name = F.sha2(F.concat_ws("\x1f", "subject", F.coalesce(F.col("doc").cast("string"), F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit("")), F.coalesce(F.col("idx").cast("string"), F.lit("")), "_t"), 256)
    asked, named = asked.select("quote_id", "subject", "_q"), blocks.select("subject", "doc", "page", "idx", "_t", name.alias("_block"))
    each = asked.select("quote_id", "subject", F.explode(F.array_distinct(words)).alias("word"))
    told = named.select("subject", "_block", F.explode(F.array_distinct(F.split("_t", " "))).alias("word"))
    postings = cut_lineage(told.join(each.select("subject", "word").distinct(), ["subject", "word"], "left_semi").distinct())
    counts = postings.groupBy("subject", "word").agg(F.count("*").alias("n"))
    rare = each.join(counts, ["subject", "word"], "left").groupBy("quote_id", "subject").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("m"))
    pairs = rare.where("m.n > 0").select("quote_id", "subject", "m.word").join(postings, ["subject", "word"]).select("quote_id", "subject", "_block")
    found = small(cut_lineage(pairs.distinct()))
    return named.drop("subject").join(found, "_block").join(asked, ["quote_id", "subject"])


def resolve_quotes(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """Where quotes (quote_id, subject, quote) stand in blocks (subject, doc, page, idx, text).

    Rows (quote_id, quality, doc, page, n_candidates): exact on one page,
    document_only within one document, else unresolved. The search is within a
    subject. A quote of three words or more is only looked for in blocks that
    have its longest word but for the first and last, which may be cut, or its
    rarest one if there are over QUOTES quotes. A quote_id has one quote.
    """
    words = F.split("_q", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w), w.alias("w"))))["w"]
    asked = quotes.withColumn("_q", norm_ws(F.col("quote"))).where("_q <> ''").withColumn("_key", key)
    spaced = blocks.withColumn("_t", norm_ws(F.col("text"))).drop("text")
    held = F.contains("_t", F.col("_q"))
    keyed, bare = asked.where("_key IS NOT NULL"), asked.where("_key IS NULL").drop("_key")
    if asked.limit(QUOTES + 1).count() <= QUOTES:
        # Few quotes: each block keeps only those of its words that are keys of its subject, so no text is copied or shuffled in vain.
        of_subject = F.broadcast(keyed.groupBy("subject").agg(F.collect_set("_key").alias("_keys")))
        hit = spaced.join(of_subject, "subject").withColumn("_key", F.explode(F.array_intersect(F.split("_t", " "), "_keys"))).drop("_keys")
        keyed, bare = F.broadcast(keyed), F.broadcast(bare)
        long_ = keyed.join(hit, ["subject", "_key"]).where(held)
    else:
        long_ = _rare_hits(keyed.drop("_key"), spaced, inner).where(held)
    short = bare.join(spaced, "subject").where(held)
    columns = ["quote_id", "doc", "page", "idx"]
    found = long_.select(*columns).unionByName(short.select(*columns))
    g = found.groupBy("quote_id").agg(F.countDistinct("doc").alias("docs"), F.countDistinct(F.coalesce("page", F.lit(-1))).alias("pages"), F.count("*").alias("n"), F.min("doc").alias("d"), F.max("page").alias("p"), F.count("page").alias("paged"))
    exact = (F.col("docs") == 1) & (F.col("pages") == 1) & ((F.col("paged") > 0) | (F.col("n") == 1))
    told = quotes.select("quote_id").join(g, "quote_id", "left")
    quality = F.when(exact, "exact").when(F.col("docs") == 1, "document_only").otherwise("unresolved")
    return told.select("quote_id", quality.alias("quality"), F.when(F.col("docs") == 1, F.col("d")).alias("doc"), F.when(exact, F.col("p")).alias("page"), F.coalesce("n", F.lit(0)).alias("n_candidates"))


def resolve_claims(claims: DataFrame) -> DataFrame:
    """Claims (subject, field, value, document, amends, page_role, official) as stated, conflicting or unknown.

    A value wins over another if each of the other's supports is preceded by
    one of its own: by an amendment of that document, by the call's own page
    over the programme's, or by an official source over a curated one.
    """
    key = ["subject", "field"]
    # Values, of which a field has few, meet the claims of the others; amendments are found by the document that they amend.
    flag = lambda c: F.coalesce(c, F.lit(False))
    rivals = claims.groupBy(*key, F.col("value").alias("winner")).agg(F.max(flag(F.col("page_role") == "opportunity")).alias("_call"), F.max(flag(F.col("official"))).alias("_official"))
    amended = claims.where("amends IS NOT NULL").select(*key, F.col("value").alias("winner"), F.col("amends").alias("document"), F.lit(True).alias("_amends")).distinct()
    met = claims.withColumnRenamed("value", "loser").join(rivals, key).where("loser <> winner").join(amended, [*key, "winner", "document"], "left")
    beaten = flag(F.col("_amends")) | (F.col("_call") & flag(F.col("page_role") == "program")) | (F.col("_official") & flag(~F.col("official")))
    each = met.groupBy(*key, "winner", "loser", "document").agg(F.max(beaten).alias("beaten"))
    over = each.groupBy(*key, "winner", "loser").agg(F.min("beaten").alias("dominates"))
    values = claims.groupBy(*key).agg(F.countDistinct("value").alias("n_values"), F.min("value").alias("only"))
    best = over.where("dominates").groupBy(*key, "winner").agg(F.count("*").alias("beats")).join(values, key).where("beats = n_values - 1")
    one = best.groupBy(*key).agg(F.count("*").alias("winners"), F.min("winner").alias("winner"))
    state = F.when(F.col("n_values") == 0, "unknown").when((F.col("n_values") == 1) | (F.col("winners") == 1), "stated").otherwise("conflicting")
    return values.join(one, key, "left").select(*key, state.alias("state"), F.when(F.col("n_values") == 1, F.col("only")).when(F.col("winners") == 1, F.col("winner")).alias("value"))


def public_provenance(provenance: Column, allowed: str) -> Column:
    """Entries of a map path -> (state, citable) that may be shown."""
    return F.map_filter(provenance, lambda path, fact: path.rlike(allowed) & fact["citable"])


def append_new(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: those that aren't there, each once; rows that are there are no error."""
    return insert_new(stored, rows, keys)


def conflicts(stored: DataFrame, rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Rows that have a stored key with another payload."""
    old = stored.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in payload])
    other = F.lit(False)
    for c in payload:
        other = other | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    return rows.join(old, keys).where(other).select(*rows.columns)


def backfill(rederived: DataFrame, stored: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Values that were derived again as they are stored, for paths without provenance yet."""
    same = rederived.join(stored.withColumnRenamed("value", "_stored"), keys).where(F.col("value").eqNullSafe(F.col("_stored"))).drop("_stored")
    return same.join(present.select(*keys), keys, "left_anti")


def chunk_coordinates(stored: DataFrame, repacked: DataFrame) -> DataFrame:
    """Coordinates of stored chunks (entity, chunk, text) whose text just one repacked chunk (entity, text, doc, idx) has."""
    single = repacked.withColumn("_n", F.count("*").over(Window.partitionBy("entity", "text"))).where("_n = 1").drop("_n")
    return stored.join(single, ["entity", "text"]).select("entity", "chunk", "doc", "idx")


def sample_by_kind(rows: DataFrame, kinds: list[str], key: str, n: int) -> DataFrame:
    """The first n rows of each kind by key: a trial run's sample."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*kinds).orderBy(key))).where(F.col("_n") <= n).drop("_n")


def review_overlay(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    """Claims (claim_id, state, value) with the decision of their last review (claim_id, decision, corrected, created)."""
    last = reviews.withColumn("_n", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("created")))).where("_n = 1").select("claim_id", "decision", "corrected")
    j = claims.join(last, "claim_id", "left")
    state = F.when(F.col("decision") == "mark_unknown", "unknown").when(F.col("decision").isin("confirm", "correct"), "stated").otherwise(F.col("state"))
    value = F.when(F.col("decision") == "mark_unknown", F.lit(None).cast("string")).when(F.col("decision") == "correct", F.col("corrected")).otherwise(F.col("value"))
    return j.select("claim_id", state.alias("state"), value.alias("value"))


def gaps(structural: Column, states: Column) -> Column:
    """Fields that are missing: those of the structure, and those of claims (field, state) that aren't settled."""
    open_ = F.transform(F.filter(states, lambda s: ~s["state"].isin("stated", "inferred")), lambda s: s["field"])
    settled = F.transform(F.filter(states, lambda s: s["state"].isin("stated", "inferred")), lambda s: s["field"])
    return F.array_sort(F.array_union(F.array_except(structural, settled), open_))


def family_or_legacy(subjects: DataFrame, adaptive: DataFrame, legacy: DataFrame, active: bool) -> DataFrame:
    """Values (subject, value): the adaptive one if its family is active and has one, else the legacy one."""
    j = subjects.join(adaptive.select("subject", F.col("value").alias("_a")), "subject", "left").join(legacy.select("subject", F.col("value").alias("_l")), "subject", "left")
    return j.select("subject", F.coalesce("_a", "_l").alias("value") if active else F.col("_l").alias("value"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Divergences (keys, kind, field) of two snapshots: missing and extra rows, and fields that differ, nulls alike."""
    a = old.select(*keys, F.lit(True).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = new.select(*keys, F.lit(True).alias("_b"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    j = a.join(b, keys, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), F.lit(f)) for f in fields]))
    what = F.when(F.col("_b").isNull(), F.array(F.struct(F.lit("missing").alias("kind"), F.lit("").alias("field")))).when(F.col("_a").isNull(), F.array(F.struct(F.lit("extra").alias("kind"), F.lit("").alias("field")))).otherwise(F.transform(changed, lambda f: F.struct(F.lit("field").alias("kind"), f.alias("field"))))
    return j.select(*keys, F.explode(what).alias("w")).select(*keys, "w.kind", "w.field")


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: row counts of two tables and whether their contents agree, whatever their order."""
    told = lambda df, n: df.agg(F.count("*").alias(f"rows_{n}"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).alias(f"hash_{n}"))
    return told(a, "a").join(F.broadcast(told(b, "b"))).select("rows_a", "rows_b", ((F.col("rows_a") == F.col("rows_b")) & (F.col("hash_a") == F.col("hash_b"))).alias("equal"))
