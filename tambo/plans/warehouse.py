"""Snowflake warehouse on parquet.

Dimensions are small by construction (catalogue of products, calendar days,
two channels, unit x channel pairs).  The members of all dimensions that a batch
names are one frame of (table, natural key): new ones are found by one anti join
with the stored keys, sorted and checkpointed once, and numbered after the
current maximum id of their table.
Facts get their surrogate keys by equi-joins with the members that the batch
names: broadcast while their counted bytes stay under a bound, and beyond it
shuffled, apart from the members that hold a large share of the facts.
Facts are stored by load and year, so a range of dates reads the years it meets.
Fact ids follow the present maximum: partition offsets plus places within the
partitions, unique for any number of partitions and without a global ordering.
"""

from __future__ import annotations

import datetime as dt
import operator
import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tambo import schemas as S
from tambo.functions.columns import month_name
from tambo.operators.facts import to_semantic
from tambo.plans import manifest
from tambo.plans.ordinal import numbered, numbered_within
from tambo.session import checkpoint_dir

DIM_SCHEMAS = {
    "dim_producto": "id_producto long, producto string",
    "dim_anio": "id_anio long, anio int",
    "dim_mes": "id_mes long, mes int, nombre_mes string, id_anio long",
    "dim_tiempo": "id_tiempo long, fecha date, dia int, id_mes long",
    "dim_tipo_venta": "id_tipo_venta long, tipo_venta string",
    "dim_unidad": "id_unidad long, unidad string, equivalencia decimal(18,4), id_tipo_venta long",
}
FACT_SCHEMA = ("id_precio long, id_producto long, id_tiempo long, id_unidad long, id_tipo_venta long, "
               "precio_min decimal(18,2), precio_prom decimal(18,2), precio_max decimal(18,2), anio int")
STG_SCHEMA = ("fecha_registro date, fecha_captura timestamp, producto_nombre string, unidad_medida string, "
              "precio_mayorista_orig decimal(18,2), precio_minorista_orig decimal(18,2), hoja_origen string")
#: Mergeable sums of a load's facts by product, day and channel: exact decimals, so any grouping of loads gives one result.
SUMS = "agg_diario"
SUMS_SCHEMA = ("id_producto long, id_tiempo long, id_tipo_venta long, ultimo_id long, n_prom long, suma_prom decimal(38,2), "
               "max_max decimal(18,2), min_min decimal(18,2), n_rango long, suma_rango decimal(38,2)")
KPI_SCHEMA = "kpi_key long, nombre_kpi string, valor decimal(18,2), meta string, fecha_calculo timestamp"


@dataclass
class Warehouse:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    # Rows added by the last load for the appendable tables, and its load id.
    batch: dict[str, DataFrame] = field(default_factory=dict)
    load_id: int | None = None
    # The committed state that this content goes back to; None: none in particular.
    version: int | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def empty_warehouse(spark: SparkSession) -> Warehouse:
    """Idempotent creation of the table set (L1) as empty frames, which the optimizer knows to be empty."""
    schemas = {**DIM_SCHEMAS, "fact_precios": FACT_SCHEMA, "stg_precios_raw": STG_SCHEMA, SUMS: SUMS_SCHEMA, "fact_kpis": KPI_SCHEMA}
    none = F.lit(None).cast("string")

    def empty(schema: str) -> DataFrame:
        fields = StructType.fromDDL(schema).fields
        return spark.range(1).filter(F.lit(False)).select(*[none.cast(f.dataType).alias(f.name) for f in fields])

    return Warehouse({name: empty(schema) for name, schema in schemas.items()})


# ------------------------------------------------------------------ get-or-create
# grouping_id() of each grouping set over (producto, fecha, unidad, tipo_venta).
GID_PRODUCT, GID_DATE, GID_UNIT = 7, 11, 12
MEMBER_KEY = ["tabla", "texto", "canal", "dia"]


def batch_members(facts: DataFrame) -> DataFrame:
    """The dimension members of a fact batch in one pass.

    Grouping sets (producto), (fecha) and (unidad, tipo_venta) in a single
    partial aggregate; the result has one row per product, date and unit, so
    it is small.  ``n`` counts the facts.
    """
    return facts.groupingSets(
        [["producto"], ["fecha"], ["unidad", "tipo_venta"]],
        "producto", "fecha", "unidad", "tipo_venta",
    ).agg(F.grouping_id().alias("gid"), F.min("equivalencia").alias("equivalencia"), F.count(F.lit(1)).alias("n"))


def _key(texto: Column | None = None, canal: Column | None = None, dia: Column | None = None) -> list[Column]:
    """A member's natural key in the columns that all dimensions share; those without a part of it hold a fixed value."""
    return [(F.lit("") if texto is None else texto).alias("texto"), (F.lit("") if canal is None else canal).alias("canal"),
            (F.lit("1970-01-01") if dia is None else dia).cast("date").alias("dia")]


def member_keys(members: DataFrame) -> DataFrame:
    """(tabla, texto, canal, dia, equivalencia, n): each dimension's members that a batch names, and how many of its facts
    name them; keys with a null name none."""
    none = F.lit(None).cast("decimal(18,4)")

    def member(table: str, *key: Column, equivalence: Column = none) -> Column:
        return F.struct(F.lit(table).alias("tabla"), *key, equivalence.alias("equivalencia"), F.col("n"))

    producto, fecha, unidad, canal = (F.col(c) for c in ("producto", "fecha", "unidad", "tipo_venta"))
    of_date = [member("dim_anio", *_key(dia=F.trunc(fecha, "year"))), member("dim_mes", *_key(dia=F.trunc(fecha, "month"))),
               member("dim_tiempo", *_key(dia=fecha))]
    # First equivalence wins: the smallest of the batch; an existing row is kept.
    of_unit = [member("dim_tipo_venta", *_key(canal=canal)),
               F.when(unidad.isNotNull(), member("dim_unidad", *_key(unidad, canal),
                                                 equivalence=F.col("equivalencia").cast("decimal(18,4)")))]
    named = (F.when((F.col("gid") == GID_PRODUCT) & producto.isNotNull(), F.array(member("dim_producto", *_key(producto))))
              .when((F.col("gid") == GID_DATE) & fecha.isNotNull(), F.array(*of_date))
              .when((F.col("gid") == GID_UNIT) & canal.isNotNull(), F.array_compact(F.array(*of_unit))))
    return members.select(F.inline(named)).groupBy(*MEMBER_KEY).agg(F.min("equivalencia").alias("equivalencia"), F.sum("n").alias("n"))


def stored_keys(t: dict[str, DataFrame]) -> DataFrame:
    """(tabla, texto, canal, dia, id) of every member that the dimensions hold."""
    months = t["dim_mes"].join(t["dim_anio"], "id_anio", "left")
    units = t["dim_unidad"].join(t["dim_tipo_venta"], "id_tipo_venta", "left")
    found = {
        "dim_producto": (t["dim_producto"], _key(F.col("producto")), "id_producto"),
        "dim_anio": (t["dim_anio"], _key(dia=F.make_date("anio", F.lit(1), F.lit(1))), "id_anio"),
        "dim_mes": (months, _key(dia=F.make_date("anio", "mes", F.lit(1))), "id_mes"),
        "dim_tiempo": (t["dim_tiempo"], _key(dia=F.col("fecha")), "id_tiempo"),
        "dim_tipo_venta": (t["dim_tipo_venta"], _key(canal=F.col("tipo_venta")), "id_tipo_venta"),
        "dim_unidad": (units, _key(F.col("unidad"), F.col("tipo_venta")), "id_unidad"),
    }
    parts = [df.select(F.lit(name).alias("tabla"), *key, F.col(number).alias("id")) for name, (df, key, number) in found.items()]
    return reduce(DataFrame.unionByName, parts)


def _dimensions(wh: Warehouse, facts: DataFrame) -> tuple[Warehouse, DataFrame]:
    """The warehouse with a batch's members, and (tabla, texto, canal, dia, equivalencia, n, id) of the members it names.

    Insert-if-absent for all dimensions together; existing members keep their ids and attributes.
    """
    t = dict(wh.tables)
    checkpoint_dir(facts.sparkSession)
    stored = stored_keys(t)
    last = {r["tabla"]: r["id"] for r in stored.groupBy("tabla").agg(F.max("id").alias("id")).collect() if r["id"] is not None}
    named = member_keys(batch_members(facts)).join(stored, MEMBER_KEY, "left").checkpoint()
    new = numbered_within(named.filter(F.col("id").isNull()).drop("id"), "tabla", ["dia", "texto", "canal"], "id", last)

    def add(table: str, *columns: Column, parents: DataFrame | None = None, on: Column | None = None) -> None:
        rows = new.filter(F.col("tabla") == table)
        rows = rows if parents is None else rows.join(parents, on)
        t[table] = t[table].unionByName(rows.select(F.col("id").alias(t[table].columns[0]), *columns))

    add("dim_producto", F.col("texto").alias("producto"))
    add("dim_tipo_venta", F.col("canal").alias("tipo_venta"))
    add("dim_anio", F.year("dia").alias("anio"))
    # Years and months are bounded by the calendar (9,999 and twelve times that).
    add("dim_mes", F.month("dia").alias("mes"), month_name(F.month("dia")).alias("nombre_mes"), F.col("id_anio"),
        parents=F.broadcast(t["dim_anio"]), on=F.year("dia") == F.col("anio"))
    months = t["dim_mes"].join(F.broadcast(t["dim_anio"]), "id_anio").select("id_mes", "mes", "anio")
    add("dim_tiempo", F.col("dia").alias("fecha"), F.dayofmonth("dia").alias("dia"), F.col("id_mes"),
        parents=F.broadcast(months), on=(F.year("dia") == F.col("anio")) & (F.month("dia") == F.col("mes")))
    add("dim_unidad", F.col("texto").alias("unidad"), F.col("equivalencia"), F.col("id_tipo_venta"),
        parents=t["dim_tipo_venta"], on=F.col("canal") == F.col("tipo_venta"))
    return Warehouse(t, version=wh.version), named.filter(F.col("id").isNotNull()).unionByName(new)


def load_dimensions(wh: Warehouse, facts: DataFrame) -> Warehouse:
    """Product, year, month, date, channel and unit dimensions for a fact batch."""
    return _dimensions(wh, facts)[0]


# ------------------------------------------------------------------ natural keys -> ids
#: Members of a dimension are broadcast up to this many counted bytes.
LOOKUP_BYTES = 32 << 20
#: Beyond that, members named by more than one fact in this many (so fewer than this many members) are looked up apart.
FREQUENT = 64
#: Each looked-up dimension's id, and its natural key as (column of the facts: column of the members).
LOOKUPS = {"dim_producto": ("id_producto", {"producto": "texto"}), "dim_tiempo": ("id_tiempo", {"fecha": "dia"}),
           "dim_tipo_venta": ("id_tipo_venta", {"tipo_venta": "canal"}),
           "dim_unidad": ("id_unidad", {"unidad": "texto", "tipo_venta": "canal"})}


def _lookup_apart(facts: DataFrame, members: DataFrame, key: list[str], number: str, total: int) -> DataFrame:
    """An equi-join with members too many to broadcast, in which no member's facts meet in one task for being many.

    Frequent members are found by a broadcast of fewer than ``FREQUENT`` rows; their facts go through the shuffle of the
    others under keys that spread them and that no member has.
    """
    frequent = members.filter(F.col("n") * FREQUENT > total).select(*key, F.col(number).alias("_frequent"))
    found = facts.dropna(subset=key).join(F.broadcast(frequent), key, "left")
    spread = 1 + F.pmod(F.xxhash64(F.spark_partition_id(), *facts.columns), F.lit(1 << 20))
    found = found.withColumn("_apart", F.when(F.col("_frequent").isNull(), F.lit(0).cast("long")).otherwise(spread))
    # Always 0, but no literal: the optimizer would make that a filter and shuffle by the natural key alone.
    every = members.select(*key, number, F.least(F.col("n"), F.lit(0)).alias("_apart")).hint("shuffle_merge")
    both = found.join(every, [*key, "_apart"], "left").withColumn(number, F.coalesce("_frequent", number))
    return both.filter(F.col(number).isNotNull()).drop("_frequent", "_apart")


def dim_lookup(wh: Warehouse, facts: DataFrame, ids: DataFrame | None = None, broadcast_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """Natural keys -> surrogate keys for a fact batch (J2); facts with a key that no dimension holds have no row.

    ``ids`` are the members that the batch names (as ``_dimensions`` gives them); without them they are counted here.
    """
    if ids is None:
        checkpoint_dir(facts.sparkSession)
        ids = member_keys(batch_members(facts)).join(stored_keys(wh.tables), MEMBER_KEY).checkpoint()
    sizes = {r["tabla"]: r for r in ids.groupBy("tabla").agg(
        F.sum("n").alias("n"), F.sum(F.octet_length("texto") + F.octet_length("canal") + 64).alias("bytes")).collect()}     # six rows at most
    for table, (number, on) in LOOKUPS.items():
        members = ids.filter(F.col("tabla") == table).select(*[F.col(k).alias(f) for f, k in on.items()], F.col("id").alias(number), "n")
        size = sizes.get(table)
        if size is None or size["bytes"] <= broadcast_bytes:
            facts = facts.join(F.broadcast(members.drop("n")), list(on))
        else:
            facts = _lookup_apart(facts, members, list(on), number, size["n"])
    return facts


def fact_rows(wh: Warehouse, facts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Facts with surrogate keys, numeric(18,2) prices and their year, numbered after the present ones."""
    j = dim_lookup(wh, facts, ids)
    after = wh[SUMS].agg(F.max("ultimo_id")).first()[0] or 0
    rows = j.select(
        "id_producto", "id_tiempo", "id_unidad", "id_tipo_venta",
        F.col("precio_min").cast("decimal(18,2)").alias("precio_min"),
        F.col("precio_prom").cast("decimal(18,2)").alias("precio_prom"),
        F.col("precio_max").cast("decimal(18,2)").alias("precio_max"),
        F.year("fecha").alias("anio"))
    return numbered(rows, "id_precio", after)


def staging_rows(ok: DataFrame) -> DataFrame:
    """Staging projection of OK survey rows (L3): first unit of retail, wholesale, default."""
    unit = F.coalesce(F.nullif(F.col("unidad_min"), F.lit("")), F.nullif(F.col("unidad_may"), F.lit("")),
                      F.lit(S.NO_UNIT))
    return ok.select(
        F.col("fecha").cast("date").alias("fecha_registro"),
        F.current_timestamp().alias("fecha_captura"),
        F.col("producto").alias("producto_nombre"),
        unit.alias("unidad_medida"),
        F.col("precio_mayorista").cast("decimal(18,2)").alias("precio_mayorista_orig"),
        F.col("precio_minorista").cast("decimal(18,2)").alias("precio_minorista_orig"),
        F.col("hoja_origen"))


def daily_sums(facts: DataFrame) -> DataFrame:
    """Sums, counts and extremes of fact rows by product, day and channel (A10), to be merged with other loads'."""
    spread = F.col("precio_max") - F.col("precio_min")
    return facts.groupBy("id_producto", "id_tiempo", "id_tipo_venta").agg(
        F.max("id_precio").alias("ultimo_id"), F.count("precio_prom").alias("n_prom"),
        F.sum("precio_prom").cast("decimal(38,2)").alias("suma_prom"), F.max("precio_max").alias("max_max"),
        F.min("precio_min").alias("min_min"), F.count(spread).alias("n_rango"),
        F.sum(spread).cast("decimal(38,2)").alias("suma_rango"))


def _mean(total: str, count: str) -> Column:
    """Mean of merged sums; null when they are of no value."""
    return F.try_divide(F.sum(total).cast("double"), F.sum(count))


def daily_averages(wh: Warehouse) -> DataFrame:
    """Mean price by product, day and channel (A10) from the stored sums; reads no facts."""
    merged = wh[SUMS].groupBy("id_producto", "id_tiempo", "id_tipo_venta").agg(_mean("suma_prom", "n_prom").alias("precio_promedio"))
    return (merged.join(wh["dim_producto"], "id_producto").join(wh["dim_tiempo"].select("id_tiempo", "fecha"), "id_tiempo")
                  .join(wh["dim_tipo_venta"], "id_tipo_venta").select("producto", "fecha", "tipo_venta", "precio_promedio"))


def kpi_rows(sums: DataFrame) -> DataFrame:
    """KPI table (A3) from daily sums."""
    from tambo.operators.metrics import kpi_table_from
    k = sums.agg(_mean("suma_prom", "n_prom").alias("precio_promedio_general"),
                 F.max("max_max").cast("double").alias("precio_maximo_registrado"),
                 F.min("min_min").cast("double").alias("precio_minimo_registrado"),
                 _mean("suma_rango", "n_rango").alias("variacion_promedio"))
    return kpi_table_from(k).withColumn("fecha_calculo", F.current_timestamp())


def kpi_rows_of_table(facts: DataFrame) -> DataFrame:
    """KPI table (A3) recounted from a whole fact table."""
    from tambo.operators.metrics import kpi_table_from
    k = facts.agg(
        F.avg(F.col("precio_prom").cast("double")).alias("precio_promedio_general"),
        F.max("precio_max").cast("double").alias("precio_maximo_registrado"),
        F.min("precio_min").cast("double").alias("precio_minimo_registrado"),
        F.avg((F.col("precio_max") - F.col("precio_min")).cast("double")).alias("variacion_promedio"))
    return kpi_table_from(k).withColumn("fecha_calculo", F.current_timestamp())


def load(wh: Warehouse, ok: DataFrame, facts: DataFrame, replace: bool = True, load_id: int | None = None) -> Warehouse:
    """Load a batch (L8): replace clears facts, KPIs and staging but keeps dimensions.

    The batch is read three times: by the grouping-sets aggregate that yields
    every dimension member, by the fact-row projection that looks the surrogate
    keys up (stored once to be numbered), and by the staging table; batches that
    are costly to compute should be stored before (``session.stored_once``).
    KPIs are the batch's in replace mode, the whole table's in append mode;
    either way they come from the daily sums, taken once from the numbered facts,
    to which an append adds its own: it reads no old facts.
    """
    w2, ids = _dimensions(wh, facts)
    t = dict(w2.tables)
    batch = {"fact_precios": fact_rows(w2, facts, ids), "stg_precios_raw": staging_rows(ok)}
    batch[SUMS] = daily_sums(batch["fact_precios"]).checkpoint()
    t |= batch if replace else {n: wh[n].unionByName(df) for n, df in batch.items()}
    t["fact_kpis"] = kpi_rows(t[SUMS])
    return Warehouse(t, batch, load_id, wh.version)


# ------------------------------------------------------------------ semantic view
def semantic_view(wh: Warehouse) -> DataFrame:
    """Fact joined to its six dimensions, with the range as variacion_precio.

    Facts and dates also agree in the year, by which the facts are stored: a condition on the view's ``anio`` chooses the
    years read when the query is planned, one on its ``fecha`` when it runs (through the dates that are left).
    """
    f = wh["fact_precios"]
    # Days are bounded by the calendar; their size after two joins is guessed so large that all facts would be shuffled by day.
    t = wh["dim_tiempo"].join(wh["dim_mes"], "id_mes").join(wh["dim_anio"], "id_anio")
    return (f.join(wh["dim_producto"], "id_producto")
             .join(F.broadcast(t), ["id_tiempo", "anio"])
             .join(wh["dim_unidad"].drop("id_tipo_venta"), "id_unidad")
             .join(wh["dim_tipo_venta"], "id_tipo_venta")
             .select("id_precio", "producto", "fecha", "dia", "mes", "nombre_mes", "anio", "unidad",
                     "equivalencia", "tipo_venta",
                     F.col("precio_min").alias("precio_minimo"), F.col("precio_prom").alias("precio_promedio"),
                     F.col("precio_max").alias("precio_maximo"),
                     (F.col("precio_max") - F.col("precio_min")).alias("variacion_precio")))


def semantic_between(wh: Warehouse, since: str | None = None, until: str | None = None) -> DataFrame:
    """The semantic view of the days from ``since`` to ``until`` (ISO dates, both included; None: no bound).

    Reads the facts of the years in between only, whatever the join of the dates turns out to be.
    """
    view = semantic_view(wh)
    for day, inside in ((since, operator.ge), (until, operator.le)):
        if day is not None:
            date = dt.date.fromisoformat(day)
            view = view.filter(inside(F.col("fecha"), F.lit(date)) & inside(F.col("anio"), F.lit(date.year)))
    return view


def semantic_as_double(view: DataFrame) -> DataFrame:
    """Semantic rows with decimals as doubles, ready for the analytics."""
    return view.withColumns({c: F.col(c).cast("double") for c in
                             ["equivalencia", "precio_minimo", "precio_promedio", "precio_maximo",
                              "variacion_precio"]})


# ------------------------------------------------------------------ audits
def fk_check(wh: Warehouse) -> DataFrame:
    """Orphan foreign keys and duplicated unique keys, one row per constraint.

    All constraints are counted together: every key value gives one row with how
    often children and parents (or members, for unique keys) hold it, and one
    aggregate by (constraint, value) finds values without a parent and values
    held twice.  The facts are counted by their four keys first, in one reading.
    A null key is an orphan.
    """
    one, zero, nobody = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(None).cast("string")

    def held(constraint: str, value: Column, children: Column, parents: Column) -> list[Column]:
        return [F.lit(constraint).alias("restriccion"), value.cast("string").alias("clave"), children.alias("hijos"),
                parents.alias("padres")]

    keys = {"id_producto": "dim_producto", "id_tiempo": "dim_tiempo", "id_unidad": "dim_unidad", "id_tipo_venta": "dim_tipo_venta"}
    above = [("dim_tiempo", "id_mes", "dim_mes"), ("dim_mes", "id_anio", "dim_anio"), ("dim_unidad", "id_tipo_venta", "dim_tipo_venta")]
    uniques = [("dim_producto", ["producto"]), ("dim_anio", ["anio"]), ("dim_mes", ["id_anio", "mes"]), ("dim_tiempo", ["fecha"]),
               ("dim_tipo_venta", ["tipo_venta"]), ("dim_unidad", ["unidad", "id_tipo_venta"])]
    facts = wh["fact_precios"].groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rows = [facts.select(F.inline(F.array(*[F.struct(*held(f"fact_precios.{k}", F.col(k), F.col("n"), zero)) for k in keys])))]
    children = [(f"fact_precios.{k}", k, dim) for k, dim in keys.items()] + [(f"{table}.{k}", k, dim) for table, k, dim in above]
    rows += [wh[table].select(*held(f"{table}.{k}", F.col(k), one, zero)) for table, k, _ in above]
    rows += [wh[dim].filter(F.col(k).isNotNull()).select(*held(name, F.col(k), zero, one)) for name, k, dim in children]
    names = [name for name, _, _ in children]
    for table, key in uniques:
        name = f"{table}({','.join(key)})"
        names.append(name)
        rows.append(wh[table].select(*held(name, F.to_json(F.struct(*key)), zero, one)))
    every = wh["dim_anio"].sparkSession.createDataFrame([(n,) for n in names], "n string")      # a row for each constraint
    rows.append(every.select(F.col("n").alias("restriccion"), nobody.alias("clave"), zero.alias("hijos"), zero.alias("padres")))
    counted = reduce(DataFrame.unionByName, rows).groupBy("restriccion", "clave").agg(F.sum("hijos").alias("hijos"),
                                                                                      F.sum("padres").alias("padres"))
    wrong = (F.when(F.col("restriccion").contains("("), F.when(F.col("padres") > 1, one).otherwise(zero))
              .when(F.col("padres") == 0, F.col("hijos")).otherwise(zero))
    return counted.groupBy("restriccion").agg(F.sum(wrong).alias("violaciones"))


def schema_check(wh: Warehouse) -> DataFrame:
    """Required columns per table; lists the missing ones (L2)."""
    spark = next(iter(wh.tables.values())).sparkSession
    rows = []
    for name, required in S.REQUIRED_COLUMNS.items():
        have = set(wh.tables[name].columns) if name in wh.tables else set()
        missing = [c for c in required if c not in have]
        rows.append((name, len(required), ", ".join(missing), not missing))
    return spark.createDataFrame(rows, "tabla string, requeridas long, faltantes string, ok boolean")


# ------------------------------------------------------------------ parquet persistence
TABLES = [*DIM_SCHEMAS, "fact_precios", "stg_precios_raw", SUMS, "fact_kpis"]
APPENDABLE = ("fact_precios", "stg_precios_raw", SUMS)


#: Tables stored in one directory for each value of a column.
STORED_BY = {"fact_precios": "anio"}


def _write_new(df: DataFrame, root: str, table: str, prefix: str) -> list[str]:
    """Writes ``df`` into a directory of a new name below the table's folder; the names of what is to be read: that
    directory, or those below it by ``STORED_BY`` (none for no rows)."""
    name = manifest.new_name(prefix)
    path = os.path.join(root, table, name)
    if table not in STORED_BY:
        df.write.mode("errorifexists").parquet(path)
        return [name]
    df.write.mode("errorifexists").partitionBy(STORED_BY[table]).parquet(path)
    return [f"{name}/{d}" for d in manifest.folders(df.sparkSession, path) if d.startswith(f"{STORED_BY[table]}=")]


def _read_stored(spark: SparkSession, root: str, table: str, names: list[str], schema: StructType) -> DataFrame:
    folder = os.path.join(root, table)
    stored = spark.read.schema(schema).option("basePath", folder).parquet(*[os.path.join(folder, d) for d in names])
    return stored.select(*schema.names)


def save(wh: Warehouse, root: str, replace: bool = True) -> int:
    """Write a load as new per-table directories, then commit the state that lists them.

    Nothing existing is touched: a load that fails leaves readers on the previous state, which is the rollback, and of
    two loads that go back to the same state the second raises ``manifest.Conflict`` (its ids and members follow an
    outdated state; ``load_into`` repeats it).  Replace mode lists only the new facts, staging and KPIs; append mode adds the
    new fact and staging directories to the previous ones.  Dimensions are full snapshots.  Returns the state's number.
    """
    spark = next(iter(wh.tables.values())).sparkSession
    now = manifest.newest(spark, root)
    base = now if wh.version is None else wh.version
    if base != now:
        raise manifest.Conflict(f"{root} is at state {now}; this load began at {base}")
    state = manifest.state_of(spark, root, base)
    prefix = f"load={base + 1 if wh.load_id is None else wh.load_id}"
    for name in TABLES:
        append = not replace and name in APPENDABLE and name in wh.batch and name in state
        written = _write_new(wh.batch[name] if append else wh.tables[name], root, name, prefix)
        state[name] = (state[name] if append else []) + written
    return manifest.commit(spark, root, base, state)


def load_into(spark: SparkSession, root: str, ok: DataFrame, facts: DataFrame, replace: bool = True, attempts: int = 3) -> int:
    """Read, load and save; again from the newest state when another load was committed in between."""
    for left in reversed(range(attempts)):
        try:
            return save(load(read(spark, root), ok, facts, replace), root, replace)
        except manifest.Conflict:
            if not left:
                raise
    raise ValueError("attempts must be positive")


def read(spark: SparkSession, root: str) -> Warehouse:
    """Read the committed warehouse state (S6 reads its semantic view from here)."""
    version = manifest.newest(spark, root)
    state = manifest.state_of(spark, root, version)
    tables = empty_warehouse(spark).tables
    tables |= {n: _read_stored(spark, root, n, state[n], tables[n].schema) for n in TABLES if state.get(n)}
    if "fact_precios" in state and SUMS not in state:       # stored before the sums were kept
        tables[SUMS] = daily_sums(tables["fact_precios"])
    return Warehouse(tables, version=version)


# ------------------------------------------------------------------ result tables (L9), source choice
RESULTS = ("predicciones_precios", "ranking_incremento")


def save_results(root: str, forecast: DataFrame, ranking: DataFrame) -> int:
    """Replaces the batch job's two outputs together: both are written aside, then one commit lists both.

    They depend on no other table, so a commit by somebody else in between only means to commit after that.
    """
    spark = forecast.sparkSession
    written = {name: _write_new(df, root, name, "run") for name, df in zip(RESULTS, (forecast, ranking))}
    while True:
        base = manifest.newest(spark, root)
        try:
            return manifest.commit(spark, root, base, manifest.state_of(spark, root, base) | written)
        except manifest.Conflict:
            continue


def read_results(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The result tables of one run; none before the first."""
    state = manifest.state_of(spark, root, manifest.newest(spark, root))
    return {n: spark.read.parquet(*[os.path.join(root, n, d) for d in state[n]]) for n in RESULTS if n in state}


def choose_source(spark: SparkSession, root: str, session_facts: DataFrame | None = None) -> DataFrame:
    """The session's facts as semantic rows if there are any, else the stored view."""
    if session_facts is not None and not session_facts.isEmpty():
        return to_semantic(session_facts)
    return semantic_as_double(semantic_view(read(spark, root)))


def semantic_sorted(wh: Warehouse) -> DataFrame:
    """Semantic view ordered by date."""
    return semantic_view(wh).orderBy("fecha", "producto", "tipo_venta")

