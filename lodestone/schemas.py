"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "doubles": T.ArrayType(T.DoubleType()), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split(":") for x in text.split())])


FILES = _schema("path:string hash:string mtime_ms:long size:long mode:string content:string summary:string config_hash:string")
NODES = _schema("kind:string name:string qualified_name:string file_path:string line_start:long line_end:long language:string")
EDGES = _schema("kind:string source:string target:string file_path:string")
FLOWS = _schema("id:long name:string entry:string file_count:long node_count:long criticality:double")
FLOW_MEMBERSHIPS = _schema("flow_id:long file_path:string")
COMMUNITIES = _schema("id:long name:string file_count:long node_count:long coupling:long")
EMBEDDINGS = _schema("qualified_name:string model:string vector:doubles text_hash:string fallback:boolean")
FILE_INDEX = _schema("file_path:string content_hash:string")
REPOS = _schema("alias:string path:string node_count:long edge_count:long registered_at:string")
CHANGES = _schema("file_path:string added:long deleted:long")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a schema in order, absent ones as null: additive migration of old tables."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
