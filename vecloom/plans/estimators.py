"""Estimators of other graphs with parameters of their own: layered graphs, and inverted lists with or without product codes."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.sql import DataFrame

from vecloom.functions.vectors import parse_metric
from vecloom.plans.index import KnnGraph, self_knn
from vecloom.plans.params import BuildParams, HnswParams, IvfParams, SearchParams


def _param(name: str, doc: str, convert) -> Param:
    return Param(Params._dummy(), name, doc, convert)


class LayeredKnnGraph(KnnGraph):
    """A layered graph: m links of a point (twice as many in the lowest layer), efConstruction candidates, efSearch wide; quantize none or sq8."""

    m = _param("m", "links of a point", TypeConverters.toInt)
    efConstruction = _param("efConstruction", "candidates of a point", TypeConverters.toInt)
    efSearch = _param("efSearch", "width of the search", TypeConverters.toInt)
    quantize = _param("quantize", "none or sq8", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, idCol="vec_id", vecCol="embedding", nNeighbors=15, metric="euclidean", cMax=2048, randomState=0, m=16, efConstruction=200, efSearch=64, quantize="none"):
        given = self._input_kwargs
        KnnGraph.__init__(self)
        self._setDefault(m=16, efConstruction=200, efSearch=64, quantize="none")
        self._set(**given)

    def _found(self, dataset: DataFrame, get) -> DataFrame:
        own = HnswParams(get("m"), get("efConstruction"), get("efSearch"), get("quantize"))
        build = BuildParams(metric=parse_metric(get("metric")), c_max=get("cMax"), seed=get("randomState"))
        return self_knn(dataset, get("nNeighbors"), get("idCol"), get("vecCol"), build, SearchParams(strategy="hnsw"), hnsw_params=own)


class ListKnnGraph(KnnGraph):
    """Inverted lists: nlist of them (0: by the number of rows), nprobe searched; pqM sub-vectors of product codes (0: vectors)."""

    nlist = _param("nlist", "lists", TypeConverters.toInt)
    nprobe = _param("nprobe", "lists that a search meets", TypeConverters.toInt)
    pqM = _param("pqM", "sub-vectors of a code", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, idCol="vec_id", vecCol="embedding", nNeighbors=15, metric="euclidean", randomState=0, nlist=0, nprobe=16, pqM=0):
        given = self._input_kwargs
        KnnGraph.__init__(self)
        self._setDefault(nlist=0, nprobe=16, pqM=0)
        self._set(**given)

    def _found(self, dataset: DataFrame, get) -> DataFrame:
        own = IvfParams(get("nlist") or None, get("nprobe"), get("pqM") or None)
        build = BuildParams(metric=parse_metric(get("metric")), seed=get("randomState"))
        return self_knn(dataset, get("nNeighbors"), get("idCol"), get("vecCol"), build, SearchParams(strategy="ivf"), ivf_params=own)
