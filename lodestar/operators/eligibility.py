"""Eligibility of profiles under constraints, in three values.

A verdict is the string sat, unsat or unknown; unknown never eliminates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.functions.text import fold
from lodestar.session import small

#: States by region (the bare SE is a state), sizes of companies, legal forms that satisfy another.
REGIONS = {
    "N": "AC AP AM PA RO RR TO",
    "NORTE": "AC AP AM PA RO RR TO",
    "NE": "AL BA CE MA PB PE PI RN SE",
    "NORDESTE": "AL BA CE MA PB PE PI RN SE",
    "CO": "DF GO MT MS",
    "CENTRO-OESTE": "DF GO MT MS",
    "SUDESTE": "ES MG RJ SP",
    "S": "PR RS SC",
    "SUL": "PR RS SC",
}
SIZES = {"mei": "mei", "me": "me", "micro": "me", "microempresa": "me", "epp": "epp", "pequena": "epp", "pequeno": "epp", "pequena empresa": "epp", "media": "media", "medio": "media", "media empresa": "media", "grande": "grande", "grande empresa": "grande"}
SATISFIES = {"empresa": ("startup", "ltda", "sa", "eireli", "me", "epp")}
#: Operators of each kind of constraint, the kinds that are produced from texts, and kinds with a closed list of values.
CONSTRAINT_OPS = {
    "porte": "in not_in", "faturamento": "lte gte", "idade_empresa_meses": "lte gte", "sede_uf": "in not_in", "forma_juridica": "in not_in", "trl": "in lte gte",
    "cnae": "in not_in", "parceria": "exige", "vinculo_incubacao": "exige", "investidor_privado": "exige",
}
PRODUCED_KINDS = ("porte", "sede_uf", "faturamento", "trl", "forma_juridica", "parceria")
CLOSED_VALUES = {
    "porte": "mei me epp media grande",
    "forma_juridica": "empresa startup ict universidade cooperativa associacao",
    "sede_uf": "ac al ap am ba ce df es go ma mt ms mg pa pb pr pe pi rj rn rs ro rr sc sp se to",
}
FIELDS = {"porte": "size", "sede_uf": "uf", "faturamento": "revenue", "trl": "trl", "forma_juridica": "legal_form"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _lists(values: dict[str, str]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.split(F.lit(v), " "))])


def norm_size(value: Column) -> Column:
    """Size of a company in its short form."""
    return F.coalesce(F.try_element_at(_map(SIZES), fold(value)), fold(value))


def norm_state(value: Column) -> Column:
    return F.upper(F.trim(value))


def expand_states(values: Column) -> Column:
    """States with regions as their states."""
    regions = _map(REGIONS)
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.split(F.coalesce(F.try_element_at(regions, norm_state(v)), norm_state(v)), " "))))


def expand_legal_forms(values: Column) -> Column:
    """Legal forms with those that satisfy them."""
    more = _map({k: " ".join((k, *v)) for k, v in SATISFIES.items()})
    return F.array_distinct(F.flatten(F.transform(values, lambda v: F.split(F.coalesce(F.try_element_at(more, fold(v)), fold(v)), " "))))


def verdict(kind: Column, op: Column, values: Column, profile: dict[str, Column]) -> Column:
    """sat, unsat or unknown for one constraint (kind, op, values: array<string>) and the columns of a profile."""
    text = lambda name: F.nullif(profile[name].cast("string"), F.lit(""))
    number = F.when(kind == "faturamento", text("revenue")).when(kind == "trl", text("trl")).try_cast("double")
    bound = F.when(F.size(values) == 1, F.get(values, F.lit(0)).try_cast("double"))
    ordered = F.when(number.isNull() | bound.isNull(), "unknown").when(F.when(op == "lte", number <= bound).otherwise(number >= bound), "sat").otherwise("unsat")
    mine = F.when(kind == "sede_uf", norm_state(text("uf"))).when(kind == "porte", norm_size(text("size"))).when(kind == "forma_juridica", fold(text("legal_form"))).otherwise(number.cast("string"))
    wanted = (
        F.when(kind == "sede_uf", expand_states(values))
        .when(kind == "forma_juridica", expand_legal_forms(values))
        .when(kind == "porte", F.transform(values, norm_size))
        .otherwise(F.transform(values, lambda v: v.try_cast("double").cast("string")))
    )
    inside = F.array_contains(wanted, mine)
    listed = F.when(op == "in", F.when(inside, "sat").otherwise("unsat")).when(op == "not_in", F.when(inside, "unsat").otherwise("sat")).otherwise("unknown")
    stated = F.when(kind == "sede_uf", text("uf")).when(kind == "porte", text("size")).when(kind == "forma_juridica", text("legal_form")).when(kind == "trl", text("trl")).when(kind == "faturamento", text("revenue"))
    return F.when(stated.isNull(), "unknown").when(op.isin("lte", "gte"), ordered).otherwise(listed)


#: What the card asks for or says, by kind and operator of a constraint.
REASON_LABELS = {"faturamento": "faturamento anual", "trl": "nível de maturidade tecnológica", "forma_juridica": "natureza jurídica"}


def reason(kind: Column, op: Column, values: Column) -> Column:
    """A short text on a constraint that isn't met or can't be told."""
    label = F.coalesce(F.try_element_at(_map(REASON_LABELS), kind), F.lit("este requisito"))
    about = lambda before, after: F.concat(F.lit(before), label, F.lit(after))
    partner = F.coalesce(F.contains(F.lower(F.array_join(values, ",")), F.lit("ict")), F.lit(False))
    return (
        F.when(((kind == "parceria") | (op == "exige")) & partner, "É necessário ter parceria com uma ICT.")
        .when((kind == "parceria") | (op == "exige"), "É necessário comprovar a parceria exigida pelo edital.")
        .when(kind == "sede_uf", "Informe a UF da sede para confirmar a elegibilidade.")
        .when(kind == "porte", "Informe o porte da empresa para verificar este requisito.")
        .when(op == "in", about("A empresa precisa informar ", " para verificar este requisito."))
        .when(op == "not_in", about("O ", " informado não atende ao requisito do edital."))
        .when(op == "lte", about("O ", " precisa estar dentro do limite do edital."))
        .when(op == "gte", about("O ", " precisa atingir o mínimo do edital."))
        .otherwise("Complete o perfil para verificar este requisito.")
    )


def judge(opportunities: DataFrame, profile: dict[str, Column], keys: list[str]) -> DataFrame:
    """Rows (keys, status, counts, kinds and sorted reasons) over exploded constraints (keys, kind, op, values).

    Any unsat makes it inelegivel, else any unknown nao_verificada, else
    elegivel. A row whose kind is null stands for an opportunity without
    constraints, which is elegivel.
    """
    ruled = opportunities.withColumn("v", F.when(F.col("kind").isNull(), "sat").otherwise(verdict(F.col("kind"), F.col("op"), F.col("values"), profile)))
    failed, open_, why = F.col("v") == "unsat", F.col("v") == "unknown", reason(F.col("kind"), F.col("op"), F.col("values"))
    status = F.when(F.max(failed), "inelegivel").when(F.max(open_), "nao_verificada").otherwise("elegivel")
    return ruled.groupBy(*keys).agg(status.alias("status"), F.count_if(failed).alias("n_unsat"), F.count_if(open_).alias("n_unknown"), F.array_sort(F.collect_set(F.when(failed, F.col("kind")))).alias("unsat_kinds"), F.array_sort(F.collect_list(F.when(failed, why))).alias("unsat"), F.array_sort(F.collect_list(F.when(open_, why))).alias("unknown"))


def trail(opportunities: DataFrame, profile: dict[str, Column], keys: list[str]) -> DataFrame:
    """Each constraint with its verdict, in order of (kind, op)."""
    one = F.struct("kind", "op", verdict(F.col("kind"), F.col("op"), F.col("values"), profile).alias("verdict"))
    return opportunities.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("evaluations"))


def minimum_share(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """Least counterpart of profiles (size, state) by rules (size, region, percent): of the region, else of any."""
    short = {uf: region for region in ("N", "NE", "CO", "SUDESTE", "S") for uf in REGIONS[region].split()}
    named = profiles.withColumn("region", F.try_element_at(_map(short), norm_state(F.col("state"))))
    exact = small(rules.where("region is not null").select(F.col("size").alias("s1"), F.col("region").alias("r1"), F.col("percent").alias("p1")))
    any_ = small(rules.where("region is null").select(F.col("size").alias("s2"), F.col("percent").alias("p2")))
    joined = named.join(exact, (named["size"] == F.col("s1")) & (named.region == F.col("r1")), "left").join(any_, named["size"] == F.col("s2"), "left")
    return joined.select(*profiles.columns, "region", F.when(F.col("region").isNotNull(), F.coalesce("p1", "p2")).alias("percent"))


def constraint_error(kind: Column, op: Column, values: Column) -> Column:
    """Why a constraint is not valid; null if it is.

    Values of a closed list must be in it, bounds are one number, ages and
    readiness whole ones in range.
    """
    number = lambda v: v.try_cast("double")
    known = F.coalesce(F.array_contains(F.try_element_at(_lists(CONSTRAINT_OPS), kind), op), F.lit(False))
    listed = F.try_element_at(_lists(CLOSED_VALUES), kind)
    filled = F.coalesce((F.size(values) > 0) & F.forall(values, lambda v: F.coalesce(F.trim(v) != "", F.lit(False))), F.lit(False))
    numeric, whole = kind.isin("faturamento", "idade_empresa_meses", "trl"), kind.isin("idade_empresa_meses", "trl")
    return (
        F.when(~known, "constraint outside the authoritative vocabulary")
        .when(~filled, "constraint value is empty")
        .when(listed.isNotNull() & F.exists(values, lambda v: ~F.array_contains(listed, F.lower(F.trim(v)))), "constraint enum value is outside the schema")
        .when(numeric & ((kind != "trl") & (F.size(values) != 1) | F.exists(values, lambda v: number(v).isNull())), "constraint numeric value is invalid")
        .when(whole & F.exists(values, lambda v: number(v) != F.floor(number(v))), "constraint numeric value must be an integer")
        .when((kind == "idade_empresa_meses") & F.exists(values, lambda v: number(v) < 0), "company age is negative")
        .when((kind == "trl") & F.exists(values, lambda v: ~number(v).between(1, 9)), "trl is outside 1..9")
    )


def coerce_constraints(constraints: Column) -> tuple[Column, Column]:
    """All constraints with their values in normal form, or none and the reason of the first that is not valid."""
    errors = F.transform(constraints, lambda c: constraint_error(c["kind"], c["op"], c["values"]))
    why = F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))
    number = lambda v: v.try_cast("double")
    plain = lambda v: F.when(number(v) == F.floor(number(v)), number(v).cast("long").cast("string")).otherwise(number(v).cast("string"))
    shaped = F.transform(constraints, lambda c: F.struct(
        c["kind"].alias("kind"), c["op"].alias("op"),
        F.when(c["kind"].isin("faturamento", "idade_empresa_meses", "trl"), F.transform(c["values"], plain))
        .when(c["kind"] == "sede_uf", F.transform(c["values"], norm_state))
        .when(c["kind"] == "cnae", F.transform(c["values"], lambda v: F.trim(v)))
        .otherwise(F.transform(c["values"], lambda v: F.lower(F.trim(v)))).alias("values")))
    return F.when(why.isNull(), shaped), why


def valid_constraint(kind: Column, op: Column, values: Column) -> Column:
    """Whether a constraint has a known kind, an operator that fits it, and values in range."""
    ops = F.coalesce(F.array_contains(F.try_element_at(_lists({k: CONSTRAINT_OPS[k] for k in PRODUCED_KINDS}), kind), op), F.lit(False))
    in_range = F.when(kind == "trl", F.forall(values, lambda v: F.coalesce(v.try_cast("int").between(1, 9), F.lit(False)))).otherwise(F.lit(True))
    return F.coalesce(ops & in_range & (F.size(values) > 0), F.lit(False))


def normalize_constraints(constraints: Column) -> tuple[Column, Column]:
    """All constraints in their normal form, or none and a reason if one of them is not valid."""
    bad = F.exists(constraints, lambda c: ~valid_constraint(c["kind"], c["op"], c["values"]))
    shaped = F.transform(constraints, lambda c: F.struct(
        F.lower(F.trim(c["kind"])).alias("kind"), c["op"].alias("op"),
        F.when(c["kind"] == "porte", F.transform(c["values"], norm_size)).when(c["kind"] == "sede_uf", F.transform(c["values"], norm_state)).otherwise(c["values"]).alias("values")))
    return F.when(~bad, shaped), F.when(bad, F.lit("invalid_constraint"))
