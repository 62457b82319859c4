"""Relations of the engine: long tables with a fixed schema, checked where a caller hands them in."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


L, D, S, I, B = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType()
CELLS = _schema(cell_id=L, group_name=S)
GENES = _schema(gene=S)
EXPRESSION = _schema(cell_id=L, gene=S, value=D)
INTERACTION = _schema(lr_id=I, interaction_name=S, pathway_name=S, ligand=S, receptor=S, agonist=S, antagonist=S, co_a_receptor=S, co_i_receptor=S, interaction_type=S)
MEMBER = _schema(name=S, gene=S)
COORDS = _schema(cell_id=L, x=D, y=D)
NET = _schema(source=S, target=S, lr_id=I, prob=D, pval=D)
NETP = _schema(source=S, target=S, pathway=S, prob=D)
EDGES = _schema(src=L, dst=L, dist=D, contact=B)
DEG = _schema(gene=S, cluster=S, logfc=D, p_val_adj=D)


def check(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """``df`` with the columns of ``schema``, cast to its types; ValueError at once if one is missing."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}; it has {df.columns}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


class MeanMethod(str, Enum):
    TRI_MEAN = "triMean"
    MEDIAN = "median"
    TRUNCATED = "truncatedMean"
    THRESHOLDED = "thresholdedMean"
    MEAN = "mean"


@dataclass(frozen=True)
class Params:
    """Parameters of the scores; ``fast`` gives the median and 50 permutations."""

    mean_method: MeanMethod = MeanMethod.TRI_MEAN
    trim: float = 0.1
    kh: float = 0.5
    n: float = 1.0
    nboot: int = 100
    seed: int = 1
    population_size: bool = False

    @classmethod
    def fast(cls, **more) -> Params:
        return replace(cls(mean_method=MeanMethod.MEDIAN, nboot=50), **more)


@dataclass(frozen=True)
class SpatialParams:
    """Distances in microns: coordinates times ``ratio``. ``tol`` is half the contact range by default."""

    interaction_range: float = 250.0
    contact_range: float = 10.0
    ratio: float = 1.0
    tol: float | None = None
    scale_distance: float = 0.01

    @property
    def tolerance(self) -> float:
        return self.contact_range / 2 if self.tol is None else self.tol


@dataclass(frozen=True)
class Database:
    """The ligand-receptor knowledge base. Null and "" both mean none."""

    interaction: DataFrame
    complex_member: DataFrame
    cofactor_member: DataFrame


@dataclass(frozen=True)
class Dataset:
    """Expression without its zeros, labels of the cells, genes that were measured, and coordinates if there are any."""

    expression: DataFrame
    cells: DataFrame
    genes: DataFrame
    coords: DataFrame | None = None

    @property
    def datatype(self) -> str:
        return "RNA" if self.coords is None else "spatial"
