"""The warehouse as catalog objects: tables by name over the committed state, and the report views (L1, T5).

``create_catalog`` may be run any number of times: databases and tables are created if they do not exist, the
partitions of each table (one for each load directory, or load and year) are brought in line with the committed state,
and views are replaced.  A table's ``carga`` column names the load; the views leave it out.
"""

from __future__ import annotations

import os
import zlib

from pyspark.sql import DataFrame, SparkSession

from tambo.operators import metrics as M
from tambo.plans import manifest
from tambo.plans import warehouse as WH

COLUMNS = {**WH.DIM_SCHEMAS, "fact_precios": WH.FACT_SCHEMA, "stg_precios_raw": WH.STG_SCHEMA, WH.SUMS: WH.SUMS_SCHEMA, "fact_kpis": WH.KPI_SCHEMA}
#: Each view's reading order.
VIEWS = {
    "vw_capa_semantica_bi": ["fecha", "producto", "tipo_venta"],
    "vw_kpis_precios": ["precio_promedio_general"],
    "vw_ranking_productos": ["ranking"],
    "vw_grafico_barras_top10": ["ranking"],
    "vw_grafico_circular": ["tipo_venta"],
    "vw_grafico_lineas": ["fecha"],
}


def database_of(root: str) -> str:
    """The name of a warehouse folder's database."""
    return f"mercado_{zlib.crc32(root.rstrip('/').encode()):08x}"


def partition_of(directory: str) -> str:
    """The partition that a directory of a state is: ``carga=<load>`` and what the directory says further."""
    load, *further = directory.split("/")
    return "/".join([f"carga={load.replace('=', '-')}", *further])


def _spec(partition: str) -> str:
    pairs = [part.partition("=") for part in partition.split("/")]
    return ", ".join(f"{column} = '{value}'" for column, _, value in pairs)


def create_catalog(spark: SparkSession, root: str) -> str:
    """Creates what is missing and follows the committed state; the database's name."""
    database = database_of(root)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    state = manifest.state_of(spark, root, manifest.newest(spark, root))
    for name, columns in COLUMNS.items():
        table = f"{database}.{name}"
        location = os.path.join(root, name)
        by = ", ".join(["carga", *([WH.STORED_BY[name]] if name in WH.STORED_BY else [])])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}, carga string) USING parquet PARTITIONED BY ({by}) LOCATION '{location}'")
        listed = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}      # one row a load (and year)
        stored = {partition_of(d): d for d in state.get(name, [])}
        for gone in sorted(listed - stored.keys()):
            spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({_spec(gone)})")
        for new in sorted(stored.keys() - listed):
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION ({_spec(new)}) LOCATION '{os.path.join(location, stored[new])}'")
        if name in WH.DIM_SCHEMAS:
            # Without a size a table counts as too large to broadcast: the views would shuffle all facts by each key in turn,
            # by the channel's two values too.  Takes the files' sizes and reads no rows; a change of partitions drops it.
            spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS NOSCAN")
        spark.catalog.refreshTable(table)
    for name, view in report_views(spark, database).items():
        view.createOrReplaceTempView(f"{database}_{name}")
    return database


def stored(spark: SparkSession, database: str) -> WH.Warehouse:
    """The warehouse read by its tables' names."""
    return WH.Warehouse({name: spark.table(f"{database}.{name}").drop("carga") for name in COLUMNS})


def report_views(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    semantic = WH.semantic_view(stored(spark, database))
    rows = WH.semantic_as_double(semantic)
    ranking = M.ranking_products(rows)
    return dict(zip(VIEWS, (semantic, M.kpis_global(rows), ranking, M.top_products(rows, 10),
                            M.avg_by_channel(rows), M.avg_by_date(rows))))


def read_view(spark: SparkSession, database: str, name: str) -> DataFrame:
    """A view by name, in its reading order."""
    return spark.table(f"{database}_{name}").orderBy(*VIEWS[name])
