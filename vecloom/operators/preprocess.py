"""From sparse cells (cell, gene, expr) to dense vectors: normalisation, choice of genes, densifying, scaling, PCA."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import checkpointed


#: Rows of cells that one task groups, aimed at.
CELL_ROWS = 1 << 19
#: Names of genes that are broadcast at most.
GENES = 1 << 21


def by_cell(cells: DataFrame) -> DataFrame:
    """cells dealt out by cell to as many tasks as their number asks for, so that what a task groups does not grow with the table.

    What groups or joins by cell, or by cell and more, needs no further exchange. Its count reads no more than one pass over the columns."""
    least = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(max(least, -(-cells.count() // CELL_ROWS)), "cell")


def positive(cells: DataFrame) -> DataFrame:
    """Without sentinels: only expr above 0."""
    return cells.where("expr > 0")


def filter_genes(cells: DataFrame, min_cells: int = 3) -> DataFrame:
    """Genes that at least min_cells cells have. Rows are dealt out by cell, where a pair's repeats meet; then a gene's pairs are counted, summed before their shuffle."""
    cells = by_cell(cells)
    once = cells.select("cell", "gene").distinct()
    often = once.groupBy("gene").agg(F.count("cell").alias("n")).where(F.col("n") >= min_cells).select("gene")
    often = checkpointed(often, "genes")
    if often.count() <= GENES:
        often = F.broadcast(often)
    return cells.join(often, "gene", "left_semi")


def log1p_normalize(cells: DataFrame, scale: float = 1e4) -> DataFrame:
    """expr = log(1 + expr / total of its cell * scale); cells without a positive total go. Totals are pre-aggregated, then joined."""
    cells = by_cell(cells)
    totals = cells.groupBy("cell").agg(F.sum("expr").alias("total")).where("total > 0")
    return cells.join(totals, "cell").select("cell", "gene", F.log1p(F.col("expr") / F.col("total") * scale).alias("expr"))


def variable_genes(cells: DataFrame, n_cells: int, top: int, skip: tuple = (0, 1)) -> DataFrame:
    """(gene, variance): the top genes by variance over all n_cells cells, where absent means 0; ties to smaller genes."""
    sums = cells.where(~F.col("gene").isin(*skip) if skip else F.lit(True)).groupBy("gene").agg(F.sum("expr").alias("s"), F.sum(F.col("expr") * F.col("expr")).alias("s2"))
    var = F.col("s2") / n_cells - (F.col("s") / n_cells) * (F.col("s") / n_cells)
    return sums.select("gene", var.alias("variance")).orderBy(F.desc("variance"), "gene").limit(top)


def densify(cells: DataFrame, panel: list) -> DataFrame:
    """(id, vec): each cell's expr of the panel's genes, 0 where absent; of a gene's several values the sum. The panel is a caller's list."""
    places = {g: i for i, g in enumerate(panel)}
    at = F.create_map(*(F.lit(v) for kv in places.items() for v in kv))[F.col("gene")] if panel else F.lit(None)
    summed = cells.select("cell", at.alias("pos"), "expr").groupBy("cell", "pos").agg(F.sum("expr").alias("x"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(len(panel) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    own = summed.groupBy("cell").agg(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "x"))).alias("p"))
    return own.select(F.col("cell").alias("id"), F.map_from_entries("p").alias("m")).select("id", grid.alias("vec"))


def scale(points: DataFrame, most: float = 10.0) -> DataFrame:
    """(id, vec): z-scores of each dimension, held to at most `most`; a flat dimension is 0. Variances divide by n - 1."""
    stats = points.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    rows = stats.orderBy("pos").collect()  # a row for each dimension
    mean = F.array(*(F.lit(float(r["mean"])) for r in rows))
    sd = F.array(*(F.lit(float(r["sd"] or 0) or 1.0) for r in rows))
    return points.select("id", F.transform("vec", lambda x, i: F.least(F.lit(most), (x - F.get(mean, i)) / F.get(sd, i))).alias("vec"))


def pca(points: DataFrame, k: int = 50, fit_on: DataFrame | None = None) -> DataFrame:
    """(id, vec): the first k principal components of centred vectors, fitted on a part if given. Signs are arbitrary."""
    base = points if fit_on is None else fit_on
    dims = base.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean")).orderBy("pos").collect()
    mean = F.array(*(F.lit(float(r["mean"])) for r in dims))
    centred = lambda df: df.select("id", array_to_vector(F.zip_with("vec", mean, lambda x, m: x - m)).alias("v"))
    model = PCA(k=min(k, len(dims)), inputCol="v", outputCol="o").fit(centred(base))
    return model.transform(centred(points)).select("id", vector_to_array("o").alias("vec"))


def recipe(cells: DataFrame, n_cells: int, genes: int = 2000, components: int = 50) -> DataFrame:
    """(id, vec): filter genes, normalise, choose variable genes, densify, scale, project."""
    normal = log1p_normalize(filter_genes(positive(cells)))
    panel = [r["gene"] for r in variable_genes(normal, n_cells, genes, ()).orderBy("gene").collect()]
    return pca(scale(densify(normal, panel)), components)
